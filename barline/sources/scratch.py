"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession


def process_state() -> types.ModuleType:
    """A module of its own for what lives as long as the process. (Functions reach the workers by value, and with
    them would come fresh copies of this module's globals.)"""
    return sys.modules.setdefault("barline_process_state", types.ModuleType("barline_process_state"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Only where that setting is absent and the master is local (tests, one machine) a temporary folder is made; a
    cluster without the setting is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    state = process_state().__dict__
    if "shared_dir" not in state:
        state["shared_dir"] = own = tempfile.mkdtemp(prefix="barline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + state["shared_dir"]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no table has yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`df` written to a shared table and read again: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    process_state().__dict__.setdefault("tables", set()).add(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete shared tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        process_state().__dict__.setdefault("tables", set()).discard(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete every shared table that this process made and that is still there. Results of operators read some of them, so
    call it when the results are written."""
    removed(spark, *list(process_state().__dict__.get("tables", ())))
