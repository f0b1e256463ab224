"""Python sources to rows: one per public function or class, with its signature and first doc line."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """(path, text) of all files below a folder whose names match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "utf-8").alias("text"))


def _rows(text: str) -> list[tuple[str, str, str, str]]:
    out = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out
    todo = [("", node) for node in tree.body]
    while todo:
        owner, node = todo.pop(0)
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) or node.name.startswith("_"):
            continue
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if owner else "function"
        arguments = "" if kind == "class" else ast.unparse(node.args)
        doc = (ast.get_docstring(node) or "").strip().split("\n")[0]
        out.append((kind, f"{owner}{node.name}", arguments, doc))
        if kind == "class":
            todo += [(f"{owner}{node.name}.", n) for n in node.body]
    return out


def api_rows(files: DataFrame) -> DataFrame:
    """(path, kind, name, arguments, doc) of files (path, text).  Null text and text that is no Python give no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, *r) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in _rows(t or "")]
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "kind", "name", "arguments", "doc"])

    return files.select("path", "text").mapInArrow(run, "path string, kind string, name string, arguments string, doc string")
