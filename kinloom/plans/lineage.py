"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and all runs in one process (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared and not (context.master + "[").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="kinloom-checkpoint-"))


def release(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles that nothing refers to any more.

    It does so when the driver's garbage is collected, which may take half an hour by itself. Where executors are
    processes of their own, a collection just after a job was seen to leave that job's shuffles until the one after the
    next job; after a job of one task and a second they were gone. What holds them was not found.
    """
    gc.collect()
    context = spark.sparkContext
    if not (context.master + "[").startswith("local["):
        context._jsc.parallelize(context._jvm.java.util.Collections.singletonList(""), 1).count()
        time.sleep(1)
    context._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files, so that a lost executor costs no recomputation.

    The shuffles behind it are not needed any more and are deleted.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    del df  # else it holds its shuffles
    release(done.sparkSession)
    return done


def written(df: DataFrame) -> DataFrame:
    """As :func:`cut`, but through a Parquet table in that folder, for what a loop joins with itself round by round.

    Loops over checkpoints were seen to slow down from about the tenth round; the likely cause, not proved, is that a
    checkpoint keeps the planner's guess of its size and a join's guess is the product of its sides. A table has the
    size of its files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    schema, spark = df.schema, df.sparkSession
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(folder)
