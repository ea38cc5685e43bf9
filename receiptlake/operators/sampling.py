"""Deterministic splits, folds and samples by hashes that any engine can compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranking


def draw(key: Column, seed: int = 42) -> Column:
    """A whole number below 16**7 from the MD5 of key and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 7), 16, 10).cast("bigint")


def stratified(df: DataFrame, key: str, stratum: str, shares: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """(key, stratum, split): exact shares per stratum, cut where int(n * share) falls; the last split takes the rest.

    Draws are uniform, so ranges of them are buckets of alike size and no task orders a whole stratum.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), draw(F.col(key), seed).alias("_d"))
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    buckets = max(1, -(-rows.count() // ranking.BUCKET))
    ranked = ranking.ranked_in(rows, ["stratum"], F.floor(F.col("_d") * buckets / 16**7), [F.col("_d"), F.col("k")], "r").join(sizes, "stratum")
    split, upto = F.lit(shares[-1][0]), F.lit(0).cast("bigint")
    cond = None
    for name, share in shares[:-1]:
        upto = upto + F.floor(F.col("n") * F.lit(share))
        cond = F.when(F.col("r") <= upto, name) if cond is None else cond.when(F.col("r") <= upto, name)
    return ranked.select(F.col("k").alias(key), "stratum", (cond.otherwise(split) if cond is not None else split).alias("split"))


def group_folds(df: DataFrame, group: Column, folds: int, seed: int = 42) -> DataFrame:
    """df with ``grp`` and ``fold``: all rows of a group in one fold, without a shuffle."""
    return df.withColumn("grp", group).withColumn("fold", F.pmod(draw(F.col("grp"), seed), F.lit(folds)).cast("int"))


def leaks(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that lie in more than one part; empty if nothing leaks."""
    return df.select(group, part).distinct().groupBy(group).agg(F.count("*").alias("n_parts")).where("n_parts > 1")


def hashed_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """A share of the rows, always the same ones."""
    return df.where(draw(F.col(key), seed) < int(share * 16**7))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows by classes times the rows of the class."""
    per = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    t, k = total.first()
    return per.select("label", "n", F.round(F.lit(float(t or 0)) / (F.lit(float(k or 1)) * F.col("n")), 6).alias("weight"))


def learning_fractions(df: DataFrame, group: Column, fractions: list[float], repeats: int) -> DataFrame:
    """(fraction, rep, n_groups, n_rows): the rows that whole groups drawn by hash give at each fraction and repetition."""
    grid = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(r).alias("rep")) for f in fractions for r in range(repeats)])
    rows = df.select(group.alias("g")).groupBy("g").agg(F.count("*").alias("c")).select("g", "c", F.explode(grid).alias("x")).select("g", "c", "x.fraction", "x.rep")
    d = F.conv(F.substring(F.md5(F.concat_ws(":", "g", F.col("rep").cast("string"))), 1, 7), 16, 10).cast("bigint")
    return rows.where(d < F.floor(F.col("fraction") * 16**7)).groupBy("fraction", "rep").agg(F.count("*").alias("n_groups"), F.sum("c").alias("n_rows"))


def stratified_group_folds(df: DataFrame, group: Column, label: str, folds: int, seed: int = 42) -> DataFrame:
    """(grp, label, fold): whole groups to folds, so that each fold gets its share of the groups of each main label.

    A group counts for the label that most of its rows have, the least on a tie. The groups of a label are dealt to the folds
    in turn in the order of their draws, by ranks that no task makes for a whole label.
    """
    rows = df.select(group.alias("grp"), F.coalesce(F.col(label), F.lit("")).alias("label")).where("grp IS NOT NULL")
    main = rows.groupBy("grp", "label").agg(F.count("*").alias("n")).groupBy("grp").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    drawn = main.withColumn("_d", draw(F.col("grp"), seed))
    buckets = max(1, -(-drawn.count() // ranking.BUCKET))
    ranked = ranking.ranked_in(drawn, ["label"], F.floor(F.col("_d") * buckets / 16**7), [F.col("_d"), F.col("grp")])
    return ranked.select("grp", "label", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int").alias("fold"))


def weighted_pick(df: DataFrame, by: str, choice: str, weight: str, seed: int = 42) -> DataFrame:
    """(by, choice): one choice of each group, drawn with odds by weight: the least -ln(u) / weight, u from a hash."""
    u = (draw(F.concat_ws("|", F.col(by), F.col(choice)), seed) + 0.5) / 16**7
    rows = df.where(F.col(weight) > 0).select(by, choice, (-F.log(u) / F.col(weight)).alias("_t"))
    return rows.groupBy(by).agg(F.min_by(choice, F.struct("_t", choice)).alias(choice))


def synthetic_ratings(users: int, categories: list[str], per_user: int, spark: SparkSession, seed: int = 42) -> DataFrame:
    """(user, nth, category, rating): made-up users with one preferred category, which 60 of 100 of their ratings are of; ratings are
    about 4 for it and about 3 for others, give or take one, within 1 to 5. All from hashes, so any engine makes the same."""
    cats = F.array(*map(F.lit, categories))
    pick = lambda name, n: F.pmod(draw(F.concat_ws("|", F.lit(name), "user", "nth"), seed), F.lit(n)).cast("int")
    own = F.pmod(draw(F.concat_ws("|", F.lit("own"), F.col("user")), seed), F.lit(len(categories))).cast("int")
    rows = spark.range(users).select(F.col("id").alias("user"), F.explode(F.sequence(F.lit(1), F.lit(per_user))).alias("nth"))
    at = F.when(pick("like", 100) < 60, own).otherwise(pick("other", len(categories)))
    rating = F.greatest(F.lit(1), F.least(F.lit(5), F.when(at == own, 4).otherwise(3) + pick("noise", 3) - 1))
    return rows.select("user", "nth", F.element_at(cats, at + 1).alias("category"), rating.alias("rating"))


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the least of its rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])
