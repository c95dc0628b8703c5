"""The shared folder without the cluster's setting."""

from __future__ import annotations

import os
import subprocess
import sys

_SCRIPT = """
from pyspark.sql import SparkSession
from pulsegrid import registry
from pulsegrid.sources.shared import new_folder, written
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None, "the setting is there"
assert registry.queries()["sink_parquet_by_day"](spark, "/root/testdata/sf0.001").count() > 0
assert written(spark.range(5)).count() == 5
class Far:
    sparkSession = None
    conf = spark.conf
    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
try:
    new_folder(Far)
except ValueError as refused:
    print("refused", refused)
"""


def test_a_sink_without_the_setting(tmp_path):
    (tmp_path / "spark-defaults.conf").write_text("")
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(sys.path)}
    ran = subprocess.run([sys.executable, "-c", _SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "refused spark.checkpoint.dir must name" in ran.stdout
