"""Ordered computations per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def trailing_median(df: DataFrame, by: str, order: list[str], value: str, back: int = 50, least: int = 5, default: float = 2748.0) -> DataFrame:
    """df's positive values with ``n_before`` and ``reference``: the median of up to ``back`` values before, or a default.

    The frame is bounded, so a window holds ``back`` values however long a user's history is.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-back, -1)
    n = F.count(value).over(w)
    return df.where(F.col(value) > 0).withColumn("n_before", n).withColumn("reference", F.when(n >= least, F.percentile(value, F.lit(0.5)).over(w)).otherwise(F.lit(default)))


def log_ratio(value: Column, reference: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0))) - F.log1p(F.greatest(reference, F.lit(1e-9)))


def decayed_interest(df: DataFrame, by: str, category: str, order: list[Column], amount: str, decay: float = 0.98) -> DataFrame:
    """(by, category, weight, share): each event adds log(1 + amount) to its category after all weights of the user decayed.

    The fold has a closed form: an event that ``k`` later ones follow weighs ``decay ** k``.
    """
    later = F.row_number().over(Window.partitionBy(by).orderBy(*[c.desc() for c in order])) - 1
    w = df.select(F.col(by).alias("by_"), F.col(category).alias("category"), (F.pow(F.lit(decay), later) * F.log1p(F.greatest(F.coalesce(F.col(amount), F.lit(0.0)), F.lit(0.0)))).alias("w"))
    sums = w.groupBy("by_", "category").agg(F.sum("w").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("by_"))
    return sums.select(F.col("by_").alias(by), "category", F.round("weight", 4).alias("weight"), F.round(F.when(total > 0, F.col("weight") / total).otherwise(0.0), 4).alias("share"))


def recent_values(df: DataFrame, by: str, value: str, order: list[Column], n: int = 10, width: int = 80) -> DataFrame:
    """(by, recent): the last n non-empty values, oldest first, each cut to a width."""
    rows = df.where(F.length(F.col(value)) > 0)
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*[c.desc() for c in order]))).where(F.col("_r") <= n)
    return last.groupBy(by).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_r", F.substring(value, 1, width).alias("v"))))), lambda x: x["v"]), "|").alias("recent"))


def latest_users(df: DataFrame, by: str, at: str, keep: int) -> DataFrame:
    """The ``keep`` users seen last: a distributed top-k, ties by user."""
    return df.groupBy(by).agg(F.max(at).alias("last_seen")).orderBy(F.desc("last_seen"), by).limit(keep)


def top_one(df: DataFrame, by: list[str], value: Column, seq: str, choice: str) -> DataFrame:
    """The choice with the largest sum per group; the one seen first wins a tie."""
    sums = df.groupBy(*by, choice).agg(F.sum(value).alias("s"), F.min(seq).alias("seen"))
    return sums.groupBy(*by).agg(F.max_by(F.struct(choice, "s"), F.struct(F.round("s", 6), -F.col("seen"))).alias("m")).select(*by, F.col(f"m.{choice}").alias("top"), F.round("m.s", 2).alias("top_sum"))


def fold_tail(df: DataFrame, by: list[str], choice: str, amount: str, keep: int = 4) -> DataFrame:
    """The ``keep`` largest choices per group and the rest as Other, if there are more than keep + 1."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(amount), F.col(choice)))).withColumn("_n", F.count("*").over(w))
    name = F.when((F.col("_n") > keep + 1) & (F.col("_r") > keep), F.lit("Other")).otherwise(F.col(choice))
    return ranked.groupBy(*by, name.alias("choice")).agg(F.round(F.sum(amount), 2).alias("amount"))


def running_total(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows of the group up to each one, in the order of a column unique in the group.

    Rows are cut into ranges of that column, written once so that the cuts stay; sums of whole ranges give each range its
    start, and a window only orders within a range. So no task holds a whole group, nor the whole table if there is none.
    """
    placed = cut(df.repartitionByRange(*by, order).withColumn("_p", F.spark_partition_id()), "ranges")
    start = F.sum("_t").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy(*by, "_p").agg(F.sum(value).alias("_t")).select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_p").alias("_q"), F.coalesce(start, F.lit(0)).alias("_start"))
    on = F.col("_p") == F.col("_q")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    within = F.sum(value).over(Window.partitionBy(*by, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(starts, on).withColumn(out, F.col("_start") + within).drop("_p", "_q", "_start", *[f"_by{i}" for i in range(len(by))])


def average_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1 with ties at their mean, without one task sorting all rows: counts of values, then a running total."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = running_total(counts, by, value, "_c", "_u").select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col(value).alias("_v"), (F.col("_u") - F.col("_c") + (F.col("_c") + 1) / 2).alias(out))
    on = F.col(value) == F.col("_v")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    return df.join(upto, on).drop("_v", *[f"_by{i}" for i in range(len(by))])


def jumps(df: DataFrame, by: str, order: list[str], value: str, limit: float) -> DataFrame:
    """(by, n_jumps): how often a value differs from the one before by more than a limit."""
    d = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))
    return df.select(F.col(by), d.alias("d")).groupBy(by).agg(F.count_if(F.col("d") > limit).alias("n_jumps"))


def numbered(df: DataFrame, by: list[str], order: list[str | Column], out: str) -> DataFrame:
    """df with the place of each row, from 1, in its group, in an order that is unique there; ranges in place of whole groups."""
    ordered = df.withColumn("_o", F.struct(*order)).withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(ordered, by, "_o", "_one", out).drop("_o", "_one")


def dealt(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Rows dealt to n modes in turn within their group, however large it is."""
    return numbered(df, by, order, "_nth").withColumn("mode", F.pmod(F.col("_nth") - 1, F.lit(n)).cast("int")).drop("_nth")


def stop_points(df: DataFrame, by: str, step: str, score: str, patience: int) -> DataFrame:
    """(by, best_step, stop_step): where a series stops once its running best is ``patience`` steps old."""
    w = Window.partitionBy(by).orderBy(step)
    best_so_far = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.when(best_so_far.isNull() | (F.col(score) > best_so_far), F.col(step))
    marked = df.select(by, step, score, better.alias("b")).withColumn("best_step", F.last("b", ignorenulls=True).over(w))
    stopped = marked.where(F.col(step) - F.col("best_step") >= patience).groupBy(by).agg(F.min(step).alias("stop_step"))
    last = marked.groupBy(by).agg(F.max(step).alias("last_step"))
    end = last.join(stopped, by, "left").select(by, F.coalesce("stop_step", "last_step").alias("stop_step"))
    return end.join(marked, by).where(F.col(step) == F.col("stop_step")).select(by, "best_step", "stop_step")


def balances(df: DataFrame, by: str, order: list[str], delta: str) -> DataFrame:
    """df with the running balance of a ledger after each entry."""
    return df.withColumn("balance", F.sum(delta).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
