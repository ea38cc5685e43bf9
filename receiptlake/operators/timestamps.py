"""Dates and times in many forms and zones, normalised through a dictionary of distinct raw values."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instants
from ..session import shared_dir

KEY = ["raw", "tz_name", "date_order"]
_SCHEMA = "raw string, tz_name string, date_order string, moment string"


#: Changes with the reading of texts, so that no dictionary of another reading is used.
VERSION = "2"


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """Keys without nulls, so that both sides of a join hash alike."""
    return rows.select("raw", *[F.coalesce(c, F.lit("")).alias(c) for c in columns if c != "raw"])


def parse_moment(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for raw, tz, order in parts:
        yield pd.Series([instants.moment(r, z or None, o or None) for r, z, o in zip(raw, tz, order)], dtype="object")


class MomentDictionary:
    """Distinct (raw text, zone and day order of its source) with what it means, kept as a table that only grows.

    ``learn`` parses what the table doesn't hold yet, once however many rows hold it, and adds it as one batch; nothing is
    parsed again by a later call with the same path, which by default is one folder for all calls that share
    spark.checkpoint.dir. A batch is written aside and renamed to the next number; if another writer took that number, what
    it wrote is left out and the rest tried again, so keys stay unique. ``resolve`` joins moments back to rows. Both
    sides hash on the same key, so a raw value that a third of all rows share leads to one dictionary entry (the distinct
    is combined before the shuffle) and to a large partition on the rows' side only, which AQE splits.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/moments-{VERSION}"

    def _at(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def batches(self) -> list[str]:
        fs = self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(self._at()):
            return []
        return sorted(n for s in fs.listStatus(self._at()) if (n := s.getPath().getName()).startswith("batch-"))

    def table(self, batches: list[str] | None = None) -> DataFrame:
        names = self.batches() if batches is None else batches
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], _SCHEMA)

    def _publish(self, written: str, number: int) -> bool:
        """Whether the batch got that number: a rename that doesn't replace."""
        sc = self.spark.sparkContext
        fs, plain = sc._jvm.org.apache.hadoop.fs, getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        from py4j.protocol import Py4JJavaError

        try:
            fs.FileContext.getFileContext(self._at().toUri(), sc._jsc.hadoopConfiguration()).rename(self._at(written), self._at(f"batch-{number:06d}"), sc._gateway.new_array(plain, 0))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False

    def learn(self, rows: DataFrame) -> MomentDictionary:
        """rows: raw, tz_name, date_order."""
        wanted = _keyed(rows.where("raw IS NOT NULL"), *KEY).distinct()
        while True:
            there = self.batches()
            fresh = wanted.join(self.table(there), KEY, "left_anti") if there else wanted
            written = f"_{uuid.uuid4().hex}"
            fresh.select(*KEY, F.pandas_udf(parse_moment, "string")(*KEY).alias("moment")).write.parquet(f"{self.path}/{written}")
            if self._publish(written, len(there)):
                return self

    def resolve(self, rows: DataFrame) -> DataFrame:
        """rows plus moment, only where there is one; rows must have raw, tz_name and date_order."""
        known = self.table().where("moment IS NOT NULL")
        pairs = [(F.col(f"r.{c}") if c == "raw" else F.coalesce(F.col(f"r.{c}"), F.lit(""))) == F.col(f"k.{c}") for c in KEY]
        return rows.alias("r").join(known.alias("k"), pairs).select("r.*", "k.moment")


def dated_rows(tables: list[tuple[str, DataFrame, str, str, str | None]], profile: DataFrame) -> DataFrame:
    """(table_name, rec_key, raw, tz_name, date_order) of several tables.

    tables: name, rows, key column, text column, and either ``=SOURCE`` for a table of one source or the column that holds
    the source. Blanks around a text don't count. Null and blank texts give no row. A source without a profile has no
    zone, so that only its texts without time of day or with a zone of their own can be read.
    """
    parts = []
    for name, df, key, text, source in tables:
        src = F.lit(source[1:]) if source.startswith("=") else F.col(source)
        parts.append(df.select(F.lit(name).alias("table_name"), F.col(key).alias("rec_key"), F.trim(F.col(text)).alias("raw"), src.alias("_src")).where("length(raw) > 0"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    prof = profile.select(F.col("source").alias("_ps"), "tz_name", "date_order").where("_ps IS NOT NULL").dropDuplicates(["_ps"])
    return rows.join(prof, F.col("_src") == F.col("_ps"), "left").select("table_name", "rec_key", "raw", "tz_name", "date_order")


def normalise_moments(tables: list[tuple[str, DataFrame, str, str, str | None]], profile: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """(table_name, rec_key, moment) of each row whose text can be read as a date or an instant; see ``moment``.

    Repeated rows give a row each; unreadable texts none.
    """
    rows = dated_rows(tables, profile)
    book = MomentDictionary(rows.sparkSession, dictionary_path).learn(rows)
    return book.resolve(rows).select("table_name", "rec_key", "moment")
