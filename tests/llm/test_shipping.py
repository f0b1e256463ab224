import os
import subprocess
import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.executor.memory", "1000m").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from sievewright.llm.queries import QUERIES
for name in {names!r}:
    QUERIES[name](spark, {data!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_executors_need_no_copy_of_the_package(tmp_path):
    names = ["p1_groups", "p3_budget", "p4_found", "p5_found", "p6_ids", "p7_uses", "p8_found"]
    program = PROGRAM.format(repo=str(Path(__file__).parents[2]), shared=str(tmp_path / "shared"), names=names, data=DATA)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
