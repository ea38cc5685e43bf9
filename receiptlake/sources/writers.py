"""Writers whose result is the same when they are run again."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir


def csv_out(df: DataFrame, path: str, columns: list[str]) -> str:
    """The named columns as RFC 4180 text, nulls as empty fields; others are ignored."""
    df.select(*[F.col(c).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def json_out(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: the latest row of each key of both, new ones on a tie."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_o")).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys aren't there yet; of several the first by all columns."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    rest = [c for c in new.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def repointed(df: DataFrame, lookup: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """df with column replaced where a lookup has another value for it."""
    cols = df.columns
    return df.join(lookup.select(F.col(old).alias("_old"), F.col(new).alias("_new")).dropDuplicates(["_old"]), F.col(column) == F.col("_old"), "left").select(*[F.coalesce("_new", c).alias(c) if c == column else F.col(c) for c in cols])


def derived_again(df: DataFrame, derived: dict) -> DataFrame:
    """df without the derived columns it may have, and with them computed anew: running it twice changes nothing."""
    return df.drop(*derived).withColumns(derived)


def long_metrics(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, value): one row for each metric."""
    return df.unpivot(by, metrics, "metric", "value")


def batch_tables(parts: dict[str, DataFrame], root: str, batch: int) -> None:
    """All tables of a batch under its number; a repeated batch replaces itself. Readers take batches with a marker only."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([(batch,)], "batch long").write.mode("overwrite").parquet(f"{root}/_done/batch={batch}")


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of the batches all of whose tables are there."""
    done = spark.read.parquet(f"{root}/_done").select(F.col("batch").cast("long").alias("batch")).distinct()
    return spark.read.parquet(f"{root}/{name}").join(done, "batch", "left_semi")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replaced(df: DataFrame, path: str) -> str:
    """A table put in place of another one whole: written aside, then renamed, the old one moved away before and removed after."""
    spark = df.sparkSession
    aside, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    fs, at = _fs(spark, path)
    there = fs.exists(at)
    if there:
        fs.rename(at, _fs(spark, old)[1])
    fs.rename(_fs(spark, aside)[1], at)
    if there:
        fs.delete(_fs(spark, old)[1], True)
    return path


def rewritten_once(df: DataFrame, path: str, derived: dict) -> DataFrame:
    """The table at path with derived columns computed anew; what was there first is kept beside it as ``<path>-pristine`` and every
    rewrite starts from it, so that a second one changes nothing. Written from df if there is none yet."""
    spark = df.sparkSession
    pristine = f"{path}-pristine"
    fs, kept = _fs(spark, pristine)
    if not fs.exists(kept):
        df.write.parquet(pristine)
    replaced(derived_again(spark.read.parquet(pristine), derived), path)
    return spark.read.parquet(path)


def truncated(spark: SparkSession, paths: list[str]) -> int:
    """Empties tables and counts what is left in all of them; anything but zero is an error."""
    for p in paths:
        replaced(spark.read.parquet(p).limit(0), p)
    left = sum(spark.read.parquet(p).count() for p in paths)
    if left:
        raise RuntimeError(f"{left} rows remain")
    return left


def audited(accepted: DataFrame, blocked: DataFrame, path: str, audit: str) -> tuple[str, str]:
    """Writes accepted rows and appends blocked ones to an audit table; an audit that can't be written doesn't stop the rows."""
    accepted.write.mode("append").parquet(path)
    try:
        blocked.write.mode("append").parquet(audit)
    except Exception as e:  # the audit is a side output
        warnings.warn(f"no audit written: {e}", stacklevel=2)
    return path, audit
