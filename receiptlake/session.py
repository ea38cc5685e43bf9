"""Session settings and places for intermediate tables that every executor can reach."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "receiptlake", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with the settings the operators assume; on a cluster the launcher's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only on one machine, as in tests, a local one is set where it is unset; on a
    cluster that is an error, since executors on other machines couldn't read what is written."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext.getCheckpointDir()
        if own:
            return own
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"receiptlake-{uuid.uuid4().hex[:12]}")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, removed when the driver ends."""
    path = f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        _RUNS.add(path)
        atexit.register(clear, spark, path)
    return path


_RUNS: set[str] = set()


def clear(spark: SparkSession, path: str | None = None) -> None:
    """Removes the intermediate tables of this application; results that still read them are lost, so it comes last."""
    path = path or run_dir(spark)
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at the end of the driver  # noqa: S110
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written once to the shared folder and read back, so later stages neither recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes a table that cut() wrote, once no plan reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
