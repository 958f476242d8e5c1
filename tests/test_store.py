"""Tables in the shared folder, with and without a folder named by the session."""

import os
import subprocess
import sys
from pathlib import Path

from millwright.store import Cut, shared_dir

ALONE = """
from pyspark.sql import SparkSession
from millwright.store import Cut, shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
held = Cut(spark.range(7), "seven")
assert held.df.count() == 7 and held.where.startswith(shared_dir(spark)) and shared_dir(spark) == shared_dir(spark)
held.drop()
"""


def test_without_a_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    done = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]


def test_table(spark):
    held = Cut(spark.range(3), "three")
    assert held.where.startswith(shared_dir(spark)) and held.df.count() == 3
    held.drop()
    assert not Path(held.where.removeprefix("file:").replace("//", "/")).exists()
