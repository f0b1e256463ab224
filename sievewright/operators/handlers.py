"""User functions per module, applied to routed tasks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Handler = Callable[[Column], Column]


def handled(routes: DataFrame, tasks: DataFrame, handlers: Mapping[str, Handler], fallback: Handler | None = None) -> DataFrame:
    """(task_id, module, rank, result) of selected modules; a handler takes the task as Column and gives one.

    A handler may be an expression, which stays in the JVM, or a pandas UDF.  Modules without one get the fallback's
    result, or null.
    """
    chosen = routes.where("selected").select("task_id", "module", "rank").join(tasks.select("task_id", "task"), "task_id")
    out = fallback(F.col("task")).cast("string") if fallback else F.lit(None).cast("string")
    for name, handler in sorted(handlers.items()):
        out = F.when(F.col("module") == name, handler(F.col("task")).cast("string")).otherwise(out)
    return chosen.select("task_id", "module", "rank", out.alias("result"))


def combined(results: DataFrame) -> DataFrame:
    """(task_id, modules, text): the results of a task in order of rank, without null ones."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "module", "result")))
    text = F.array_join(F.filter(F.transform(listed, lambda s: s["result"]), lambda r: r.isNotNull()), "\n")
    return results.groupBy("task_id").agg(F.transform(listed, lambda s: s["module"]).alias("modules"), text.alias("text"))


def first_supporting(modules: DataFrame, adapters: DataFrame) -> DataFrame:
    """(module, adapter): of the adapters (adapter, supports) that support a module the first by name; null if none does."""
    each = adapters.select("adapter", F.explode("supports").alias("module")).groupBy("module").agg(F.min("adapter").alias("adapter"))
    return modules.select("module").join(each, "module", "left")
