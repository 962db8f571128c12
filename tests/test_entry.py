"""The entry module works from any working directory, as a driver would load it."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as contract
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = contract.entry(spark)
print("rows", df.count(), len(df.columns))
print("vocab", contract.queries()["vocab_check"](spark, {sf!r}).count())
"""


def test_entry_runs_outside_the_repository(sf, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, sf=sf)],
        cwd=tmp_path,
        env=env,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows " in done.stdout and "vocab 2" in done.stdout
