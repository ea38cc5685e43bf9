"""Streams of uploads: repeats, time windows, and state per user that equals its batch twin."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import STATE_STORE
from ..sources.writers import _fs, batch_tables, scratch

_SETTING = "spark.sql.streaming.stateStore.providerClass"


def source(spark: SparkSession, path: str, schema, at: str = "ts") -> DataFrame:
    """A stream of the Parquet files of a table, be it a folder of them or one file, event time as timestamp."""
    r, (fs, p) = spark.readStream.schema(schema), _fs(spark, path)
    if fs.isFile(p):  # streams read folders only, whatever their names end in
        folder, _, name = path.rpartition("/")
        r, path = r.option("pathGlobFilter", name), folder
    return r.parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def without_repeats(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, width: str, by: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Counts and sums by time window and key."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), *by, "n", F.round("total", 2).alias("total"))


def sessions(stream: DataFrame, at: str, gap: str, by: str, late: str = "1 day") -> DataFrame:
    w = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


class InterestFold(StatefulProcessor):
    """Weights of a user's categories: all decay with each event, the event's category grows by log(1 + amount)."""

    decay = 0.98

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weights = handle.getMapState("weights", "category string", "weight double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        w = {k[0]: v[0] for k, v in self.weights.iterator()}
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for c, a in zip(batch["category"], batch["amount"]):
            for k in w:
                w[k] *= self.decay
            w[c] = w.get(c, 0.0) + math.log1p(max(float(a), 0.0) if a == a and a is not None else 0.0)
        for k, v in w.items():
            self.weights.updateValue((k,), (v,))
        yield pd.DataFrame([(key[0], k, round(v, 4)) for k, v in w.items()], columns=["user_id", "category", "weight"])

    def close(self) -> None:
        pass


class MedianGate(StatefulProcessor):
    """The last 50 positive amounts of a user; each new one is held against the median of those before it."""

    back, least, default = 50, 5, 2748.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "amount double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = [x[0] for x in self.past.get()]
        out = []
        for e, a in pd.concat(list(rows)).sort_values(["ts", "event_id"])[["event_id", "amount"]].itertuples(index=False):
            if not a > 0:
                continue
            last = sorted(past[-self.back :])
            n = len(last)
            ref = self.default if n < self.least else (last[(n - 1) // 2] + last[n // 2]) / 2
            out.append((e, key[0], n, round(ref, 4)))
            past.append(a)
        if past:
            self.past.put([(x,) for x in past[-self.back :]])
        yield pd.DataFrame(out, columns=["event_id", "user_id", "n_before", "reference"])

    def close(self) -> None:
        pass


class Ledger(StatefulProcessor):
    """Points of a user in order of time: a claim (negative) only counts if the balance covers it and it wasn't made before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "points long")
        self.made = handle.getMapState("made", "title string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        b = self.balance.get()[0] if self.balance.exists() else 0
        out = []
        for e, points, title in pd.concat(list(rows)).sort_values(["ts", "event_id"])[["event_id", "points", "title"]].itertuples(index=False):
            ok = points >= 0 or b + points >= 0 and not self.made.containsKey((title,))
            if ok:
                b += int(points)
                if points < 0:
                    self.made.updateValue((title,), (1,))
            out.append((e, key[0], bool(ok), int(b)))
        self.balance.update((b,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted", "balance"])

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, by: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy(by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="None")


def pipeline(stream: DataFrame, root: str, keys: list[str], late: str = "30 days") -> None:
    """Uploads (upload_id, user_id, merchant, total, ts) through one stream, in order: checked, first of their keys only, scored, written
    whole with their batch, and counted into the profiles of their users. Batches that fail are done again and replace themselves.

    Tables under root: ``uploads`` and ``rejected`` by batch, ``profiles`` (user_id, n, spent, last) by batch; ``committed`` reads
    those whose batch is whole. Profiles are additions, summed when read, so that no batch rewrites another's.
    """
    spark = stream.sparkSession
    if spark.conf.get(_SETTING, None) != STATE_STORE:
        spark.conf.set(_SETTING, STATE_STORE)
    bad = F.col("user_id").isNull() | F.coalesce(F.trim("merchant"), F.lit("")).isin("") | F.coalesce(F.col("total") <= 0, F.lit(True))
    checked = stream.withColumn("why", F.when(bad, F.lit("invalid")))
    first = without_repeats(checked.where("why IS NULL"), keys, "ts", late).unionByName(checked.where("why IS NOT NULL"))

    def save(batch: DataFrame, i: int) -> None:
        rows = batch.persist()
        good = rows.where("why IS NULL").select("upload_id", "user_id", "merchant", "total", F.round(F.log1p("total"), 6).alias("score"))
        seen = rows.where("why IS NULL").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("total"), 4).alias("spent"), F.max("ts").alias("last"))
        batch_tables({"uploads": good, "rejected": rows.where("why IS NOT NULL").select("upload_id", "why"), "profiles": seen}, root, i)
        rows.unpersist()

    first.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{root}/_state").trigger(availableNow=True).start().awaitTermination()


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there, through the stream once, into a table of the shared folder; complete results keep the last batch."""
    spark = df.sparkSession
    if spark.conf.get(_SETTING, None) != STATE_STORE:  # sessions not built here; never set back, so that streams side by side agree
        spark.conf.set(_SETTING, STATE_STORE)
    root = scratch(spark, name)
    if mode == "append":
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    else:

        def save(batch: DataFrame, i: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out/{'last' if mode == 'complete' else i}")

        q = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{root}/out")
