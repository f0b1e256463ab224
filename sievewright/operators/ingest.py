"""Loose records to samples: instruction, conversation and plain-text rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.functions import text as T


def _field(name: str) -> Column:
    return T.squashed(F.get_json_object("data", f"$.{name}"))


def shape(records: DataFrame) -> DataFrame:
    """Records (line_number, data) with their shape: alpaca, sharegpt, text, other, in this precedence; by keys present."""
    keys = F.coalesce(F.json_object_keys("data"), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    return records.withColumn("shape", F.when(has("instruction") & has("output"), "alpaca").when(has("conversations") | has("messages"), "sharegpt").when(has("text"), "text").otherwise("other"))


def parsed_messages(data: Column) -> Column:
    """Messages (role, content) of a conversation record: aliases of roles and fields resolved, empty ones dropped."""
    one = "array<struct<role:string,from:string,speaker:string,content:string,value:string,text:string>>"
    listed = F.coalesce(F.from_json(F.get_json_object(data, "$.conversations"), one), F.from_json(F.get_json_object(data, "$.messages"), one), F.from_json(F.lit("[]"), one))
    alias = F.create_map(*[F.lit(x) for pair in L.ROLE_ALIASES.items() for x in pair])
    first = lambda *found: F.coalesce(*[F.nullif(T.squashed(f), F.lit("")) for f in found], F.lit(""))
    turned = F.transform(listed, lambda m: F.struct(F.coalesce(alias[F.lower(first(m["role"], m["from"], m["speaker"]))], F.lit("unknown")).alias("role"), first(m["content"], m["value"], m["text"]).alias("content")))
    return F.filter(turned, lambda m: m["content"] != "")


def conversation_text(messages: Column) -> Column:
    """``role: content`` lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def first_exchange(messages: Column) -> Column:
    """(instruction, output): the first user message and the first assistant message after it, null if there is none."""
    start = F.aggregate(
        messages, F.struct(F.lit("").alias("q"), F.lit("").alias("a")),
        lambda s, m: F.struct(
            F.when((s["q"] == "") & (m["role"] == "user"), m["content"]).otherwise(s["q"]).alias("q"),
            F.when((s["q"] != "") & (s["a"] == "") & (m["role"] == "assistant"), m["content"]).otherwise(s["a"]).alias("a"),
        ),
    )
    return F.when((start["q"] != "") & (start["a"] != ""), F.struct(start["q"].alias("instruction"), start["a"].alias("output")))


def samples(records: DataFrame, source_id: str, compatible_ids: bool = False) -> DataFrame:
    """(id, line_number, shape, content, sample_type, domains, keywords) of records (line_number, data) that can be used.

    A record whose keys show a shape must be complete in it; it does not fall back to another.  Ids carry the line
    number; with ``compatible_ids`` instruction and conversation rows are all numbered 1, as a record-at-a-time
    reader would do.
    """
    rows = shape(records)
    messages = parsed_messages(F.col("data"))
    alpaca = F.when((_field("instruction") != "") & (_field("output") != ""), F.concat_ws(" ", F.nullif(_field("instruction"), F.lit("")), F.nullif(_field("input"), F.lit("")), F.nullif(_field("output"), F.lit(""))))
    shared = F.when(F.size(messages) > 0, conversation_text(messages))
    content = F.when(F.col("shape") == "alpaca", alpaca).when(F.col("shape") == "sharegpt", shared).when(F.col("shape") == "text", F.nullif(_field("text"), F.lit("")))
    kind = F.create_map(*[F.lit(x) for x in ("alpaca", "instruction", "sharegpt", "conversation", "text", "text")])[F.col("shape")]
    number = F.when((F.col("shape") != "text") & F.lit(compatible_ids), F.lit(1)).otherwise(F.col("line_number"))
    rows = rows.withColumn("content", content).where("content is not null")
    kept = ["source"] if "source" in records.columns else []
    typed = F.when(F.col("shape") == "alpaca", T.sample_type(F.col("content"), "instruction")).when(F.col("shape") == "sharegpt", T.sample_type(F.col("content"), "conversation")).otherwise("unknown")
    return rows.select(
        *kept, F.concat(F.lit(f"{source_id}:"), kind, F.lit("-"), F.format_string("%04d", number)).alias("id"), "line_number", "shape", T.squashed(F.col("content")).alias("content"), typed.alias("sample_type"),
        T.domains_of(T.terms(F.col("content"))).alias("domains"), T.top_keywords(F.col("content")).alias("keywords"),
    )


def ingest_report(records: DataFrame) -> DataFrame:
    """(shape, records, accepted, rejected)."""
    done = samples(records, "x").select("line_number", F.lit(True).alias("ok"))
    rows = shape(records).join(done, "line_number", "left")
    return rows.groupBy("shape").agg(F.count(F.lit(1)).alias("records"), F.count("ok").alias("accepted"), (F.count(F.lit(1)) - F.count("ok")).alias("rejected"))


def use_decisions(manifests: DataFrame) -> DataFrame:
    """(name, use, allowed) of each known use: listed in allowed_uses, and for training exports without a blocked licence (as substring)."""
    uses = F.explode(T.words(L.MANIFEST_USES)).alias("use")
    rows = manifests.select("name", "license", "allowed_uses", uses)
    blocked = T.has_any(F.lower(F.trim(T.text_or_empty(F.col("license")))), L.BLOCKED_LICENSES)
    listed = F.coalesce(F.array_contains("allowed_uses", F.col("use")), F.lit(False))
    return rows.select("name", "use", (listed & ~((F.col("use") == "training_export_candidate") & blocked)).alias("allowed"))


def normalized_pairs(rows: DataFrame, question: str, answer: str, final: str | None = None, score: str | None = None, status: str | None = None, source: str = "pairs", minimum: float = 0.8) -> DataFrame:
    """(instruction, input, output, source) of loose question and answer rows, incomplete ones dropped.

    ``final`` is appended as a last line.  Rows with a score below ``minimum`` or a status that fails and doesn't pass
    are dropped; rows without one are kept.
    """
    q, a = F.trim(T.text_or_empty(F.col(question))), F.trim(T.text_or_empty(F.col(answer)))
    keep = (q != "") & (a != "")
    if score:
        keep = keep & ~F.coalesce(F.col(score).cast("string").try_cast("double") < minimum, F.lit(False))
    if status:
        low = F.lower(T.text_or_empty(F.col(status)))
        keep = keep & ~(F.contains(low, F.lit("fail")) & ~F.contains(low, F.lit("pass")))
    if final:
        end = F.trim(T.text_or_empty(F.col(final)))
        a = F.when(end != "", F.concat(a, F.lit("\n\nFinal answer: "), end)).otherwise(a)
    return rows.where(keep).select(q.alias("instruction"), F.lit("").alias("input"), a.alias("output"), F.lit(source).alias("source"))


def sources(manifests: DataFrame) -> DataFrame:
    """Manifests as sources: (name, source_id, source_type, format, license, language, reliability, metadata).

    Type by format, then by a code domain; formats that are not known are ``unknown``; language and reliability from the
    metadata, ``unknown`` and 0.5 without.
    """
    code = F.coalesce(F.array_contains("domains", "code"), F.lit(False))
    kind = F.when(F.col("format") == "sharegpt", "conversation_dataset").when(F.col("format") == "alpaca", "instruction_dataset").when(code, "code_dataset").otherwise("unknown")
    form = F.when(F.col("format").isin("alpaca", "sharegpt", "jsonl", "text"), F.col("format")).otherwise("unknown")
    return manifests.select(
        "name", F.concat(F.lit("dataset:"), T.slug(F.col("name"))).alias("source_id"), kind.alias("source_type"), form.alias("format"), "license",
        F.coalesce(F.get_json_object("metadata", "$.language"), F.lit("unknown")).alias("language"), F.coalesce(F.get_json_object("metadata", "$.reliability").try_cast("double"), F.lit(0.5)).alias("reliability"),
        _manifest_metadata().alias("metadata"),
    )


def _manifest_metadata() -> Column:
    own = F.from_json("metadata", "map<string,string>")
    known = F.map_from_arrays(
        T.words(("manifest_name", "manifest_source", "manifest_license", "manifest_allowed_uses", "manifest_requires_review")),
        F.array(F.col("name"), F.col("source"), F.col("license"), F.array_join("allowed_uses", ","), F.col("requires_review").cast("string")),
    )
    return T.merged(known, own)


def with_provenance(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """Records (source, line_number, data) with ``metadata`` (map): origin, line and manifest, then the manifest's metadata, then the record's own; the later ones win.

    Records whose source has no manifest keep origin and line only.
    """
    listed = manifests.select("source", _manifest_metadata().alias("__manifest"))
    line = F.map_from_arrays(T.words(("origin", "line_number")), F.array(F.lit("jsonl_dataset_record"), F.col("line_number").cast("string")))
    own = F.from_json(F.get_json_object("data", "$.metadata"), "map<string,string>")
    rows = records.join(listed, "source", "left")
    return rows.withColumn("metadata", T.merged(T.merged(line, F.col("__manifest")), own)).drop("__manifest")


def ingested(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """(source, line_number, accepted, reason) of records (source, line_number, data) under their manifests.

    A manifest that allows no use rejects all of its records, and so does a missing one; else a record must be complete in its shape.
    """
    allowed = use_decisions(manifests).groupBy("name").agg(F.bool_or("allowed").alias("any"))
    gate = manifests.select("name", "source").join(allowed, "name").groupBy("source").agg(F.bool_or("any").alias("any"))
    done = samples(records.select("line_number", "data", "source"), "x").select("line_number", "source", F.lit(True).alias("ok"))
    rows = records.select("source", "line_number").join(gate, "source", "left").join(done, ["line_number", "source"], "left")
    open_ = F.coalesce("any", F.lit(False))
    reason = F.when(~open_, "manifest policy rejected record").when(F.col("ok").isNull(), "unsupported or incomplete record")
    told = F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": "), reason)
    return rows.select("source", "line_number", reason.isNull().alias("accepted"), told.alias("reason"))


def seed_candidates(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """Ingested samples (id, content, domains, keywords, reliability, source) whose manifest allows the use knowledge_seed_candidate.

    Text rows take the manifest's domains if it has any.
    """
    may = use_decisions(manifests).where("use = 'knowledge_seed_candidate' and allowed").select("name")
    of = manifests.join(may, "name", "left_semi").select("source", F.concat(F.lit("dataset:"), T.slug(F.col("name"))).alias("__id"), F.col("domains").alias("__domains"), F.coalesce(F.get_json_object("metadata", "$.reliability").try_cast("double"), F.lit(0.5)).alias("reliability"))
    rows = samples(records.select("line_number", "data", "source"), "").join(of, "source")
    own = (F.col("shape") == "text") & (F.size(F.coalesce("__domains", F.array().cast("array<string>"))) > 0)
    return rows.select(F.concat("__id", "id").alias("id"), "content", F.when(own, F.col("__domains")).otherwise(F.col("domains")).alias("domains"), "keywords", "reliability", "source")


def scanned(rows: DataFrame, normalizer: Callable[[DataFrame], DataFrame], limit: int, max_chars: int = 5000, seed: int = 7, skipped: float = 0.15, key: str = "id") -> DataFrame:
    """At most ``limit`` of the rows that a normalizer gives, usable ones (see ``training.usable_rows``), in an order that depends on key and seed.

    While there are plenty of rows a share of them is skipped, by the same hash; it stands for a random stream's choice.
    """
    from sievewright.operators.training import shuffle_key, usable_rows

    kept = usable_rows(rows.transform(normalizer), max_chars).withColumn("__order", shuffle_key(F.col(key), seed))
    bound = f"{int(skipped * 16**4):04x}"
    chosen = kept.withColumn("__late", (F.substring("__order", 1, 4) < bound).cast("int"))
    return chosen.orderBy("__late", "__order").limit(limit).drop("__order", "__late")
