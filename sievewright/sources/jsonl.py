"""JSONL: records with their line numbers, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators.review import last_per_key


def json_objects(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(line_number, data) of lines (line_number, value) that hold a JSON object.

    Blank lines are left out but numbered.  With ``strict`` a line that is no object raises an error with its number;
    without, it is dropped.  A byte order mark at the start of a line is ignored.  Null lines count as blank.
    """
    value = F.regexp_replace(F.coalesce("value", F.lit("")), "^﻿", "")
    rows = lines.select("line_number", F.trim(value).alias("data")).where("data <> ''")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("data")), F.lit("OBJECT")), F.lit(False))
    if strict:
        told = F.raise_error(F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(" holds no JSON object")))
        return rows.select("line_number", F.when(is_object, F.col("data")).otherwise(told.cast("string")).alias("data"))
    return rows.where(is_object)


def lines_of(text: Column) -> Column:
    """(line_number, value) structs of a text, numbered from 1."""
    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n"), lambda v, i: F.struct((i + 1).cast("bigint").alias("line_number"), v.alias("value")))


def read_texts(texts: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """Records of JSONL texts held in a column."""
    return json_objects(texts.select(F.explode(lines_of(F.col(column))).alias("l")).select("l.line_number", "l.value"), strict)


def read_file(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Records of one JSONL file with physical line numbers; the file is read whole, as line numbers need its start."""
    whole = spark.read.text(path, wholetext=True)
    return read_texts(whole, "value", strict)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, data) of all lines of a folder of JSONL files that hold an object; splittable, without line numbers."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT")), F.lit(False))
    return rows.where(is_object).select("file", F.col("value").alias("data"))


def write(rows: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None) -> None:
    """One JSON object per row with keys in alphabetical order; in a folder per value of ``by`` if given."""
    names = sorted(c for c in rows.columns if c != by)
    out = rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"), *([by] if by else []))
    writer = out.write.mode(mode)
    (writer.partitionBy(by) if by else writer).text(path)


def append(rows: DataFrame, path: str) -> None:
    """Append to a JSONL store."""
    write(rows, path, "append")


def invalid_rows(records: DataFrame, required: tuple[str, ...] = ("instruction", "output")) -> DataFrame:
    """(line_number, field) of required fields that are missing or blank."""
    blank = lambda f: F.trim(F.coalesce(F.get_json_object("data", f"$.{f}"), F.lit(""))) == ""
    listed = F.filter(F.array(*[F.when(blank(f), F.lit(f)) for f in required]), lambda f: f.isNotNull())
    return records.select("line_number", F.explode(listed).alias("field"))


def completion_text(payload: Column) -> Column:
    """Text of the first choice of a chat completion payload; null if there is none or it is blank."""
    return F.nullif(F.trim(F.get_json_object(payload, "$.choices[0].message.content")), F.lit(""))


def required_text(data: Column, field: str) -> Column:
    """A string field of a JSON object; an error names the field if it is missing, no string or blank."""
    found = F.try_variant_get(F.try_parse_json(data), f"$.{field}", "string")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), f"$.{field}", "variant")) == "STRING"
    return F.when(F.coalesce(is_text & (F.trim(found) != ""), F.lit(False)), found).otherwise(F.raise_error(F.lit(f"{field} must be a string")).cast("string"))


def optional_text(data: Column, field: str, default: str = "") -> Column:
    """A string field of a JSON object, or the default if it is missing or no string."""
    value = F.try_variant_get(F.try_parse_json(data), f"$.{field}", "variant")
    return F.when(F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)), F.try_variant_get(F.try_parse_json(data), f"$.{field}", "string")).otherwise(default)


def texts_of(data: Column, field: str) -> Column:
    """A field as list of strings: a string alone, or the elements of a list without empty ones; else empty."""
    none = F.array().cast("array<string>")
    listed = F.filter(F.coalesce(F.from_json(F.get_json_object(data, f"$.{field}"), "array<string>"), none), lambda v: v.isNotNull() & (v != ""))
    alone = optional_text(data, field)
    return F.when(alone != "", F.array(alone)).otherwise(listed)


def records_of(rows: DataFrame, schema: str, column: str = "data") -> DataFrame:
    """Typed rows of JSON texts; what ``native`` gives comes back the same."""
    return rows.select(F.from_json(column, schema).alias("r")).select("r.*")


def native(rows: DataFrame) -> DataFrame:
    """(data): each row as JSON object with the keys of all levels in order; nulls are kept."""
    return rows.select(T.canonical_json(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).alias("data"))


def stored(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Records of a store that ``append`` fills: the last of each key by ``order``, in that order; a line that is no object is an error."""
    rows = records_of(json_objects(spark.read.text(path).select(F.lit(0).alias("line_number"), "value"), strict=True), schema)
    return last_per_key(rows, [key], [order]).orderBy(order, key)


def clear(spark: SparkSession, path: str, schema: str) -> None:
    """Empty a store."""
    spark.createDataFrame([], schema).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
