"""Shuffle files behind a cut, where executors are processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

RUN = """
import os, sys, time
from pyspark.sql import SparkSession
from kinloom.plans import lineage

folder = sys.argv[1]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
shuffled = lambda: [x for _, _, names in os.walk(f"{folder}/local") for x in names if x.startswith("shuffle_") and x.endswith(".data")]
for _ in range(4):
    kept = lineage.cut(spark.range(100_000).repartition(3).groupBy("id").count().mapInArrow(lambda s: s, "id long, count long"))
    end = time.time() + 5
    while shuffled() and time.time() < end:
        time.sleep(0.1)
    print(len(shuffled()), flush=True)
spark.stop()
"""


def test_no_shuffle_files_are_left_behind_a_cut(tmp_path):
    home, source = tmp_path / "home", Path(pyspark.__file__).parent  # executors work in the home of Spark
    home.mkdir()
    for x in source.iterdir():
        (home / x.name).symlink_to(x)
    more = {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": f"{tmp_path}/local", "PYTHONPATH": str(Path(__file__).parents[1]), "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 700m pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], env=os.environ | more, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.stdout.split("\n")[:-1] == ["0"] * 4, done.stdout + done.stderr[-2000:]
