"""Cutting lineage in the folder that the session names."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def checkpointed(frame: DataFrame) -> DataFrame:
    """checkpoint() in spark.checkpoint.dir; in a folder of its own only where none is set and all runs on one machine."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-", dir=os.environ.get("TMPDIR")))
    return frame.checkpoint()
