"""Small text artifacts (path, content) as rows, checked and written together."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Artifacts that the driver writes at once; larger sets belong into a table.
MOST = 10_000


def safe_path(path: Column) -> Column:
    """Whether a path is relative, has parts, and none of them is ``.`` or ``..``; null paths are not safe."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce(~bad & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit(":")), F.lit(False))


def sizes(artifacts: DataFrame) -> DataFrame:
    """(path, bytes, lines) of each artifact; an empty one has no line."""
    text = F.coalesce("content", F.lit(""))
    lines = F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")))
    return artifacts.select("path", F.octet_length(text).cast("bigint").alias("bytes"), lines.alias("lines"))


def totals(artifacts: DataFrame) -> DataFrame:
    """(artifacts, bytes)."""
    return sizes(artifacts).agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def missing(artifacts: DataFrame, required: DataFrame) -> DataFrame:
    """Required paths (path) that no artifact has."""
    return required.select("path").join(artifacts.select("path"), "path", "left_anti")


def write(artifacts: DataFrame, folder: str, dry_run: bool = True, overwrite: bool = False) -> list[tuple[str, str]]:
    """(path, state) of each artifact: planned, written or exists.

    Nothing is written in a dry run, if a path is unsafe or repeated (an error), or if a file exists and must not be
    overwritten.
    """
    rows = artifacts.select("path", "content", safe_path(F.col("path")).alias("safe")).orderBy("path").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} artifacts")
    if unsafe := [r.path for r in rows if not r.safe]:
        raise ValueError(f"unsafe paths: {unsafe}")
    if len({r.path for r in rows}) < len(rows):
        raise ValueError("a path is repeated")
    there = {r.path for r in rows if os.path.exists(os.path.join(folder, *PurePosixPath(r.path).parts))}
    if dry_run or (there and not overwrite):
        return [(r.path, "exists" if r.path in there else "planned") for r in rows]
    for r in rows:
        target = os.path.join(folder, *PurePosixPath(r.path).parts)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8", newline="\n") as file:
            file.write(r.content or "")
    return [(r.path, "written") for r in rows]
