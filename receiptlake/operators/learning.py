"""Models trained here: text classifier, isolation forest, factor model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_table
from .forest import forest


def text_features(text: str, terms: int = 10_000) -> list[Transformer]:
    """Stages from a text column to ``features``: words and pairs of words, counted, weighed and scaled to length one."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_w1", pattern=r"\w\w+", gaps=False),
        NGram(n=2, inputCol="_w1", outputCol="_w2"),
        CountVectorizer(inputCol="_w1", outputCol="_c1", vocabSize=terms, minDF=2.0),
        CountVectorizer(inputCol="_w2", outputCol="_c2", vocabSize=terms, minDF=2.0),
        VectorAssembler(inputCols=["_c1", "_c2"], outputCol="_c"),
        IDF(inputCol="_c", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="features", p=2.0),
    ]


def _featured(train: DataFrame, text: str, label: str) -> tuple[list[Transformer], DataFrame, list[float]]:
    """Stages from text and label to ``_y`` and ``features``, the training rows with both, written once, and the balanced weight of each class."""
    steps = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc"), *text_features(text)]).fit(train)
    rows = cut(steps.transform(train).select("_y", "features"), "features")
    counts = dict(rows.groupBy("_y").count().collect())
    return steps.stages, rows, [sum(counts.values()) / (len(counts) * counts[float(i)]) for i in range(len(counts))]


def _fitted(rows: DataFrame, weights: list[float], kind: str, trees: int) -> Transformer:
    if kind == "rf":
        return forest(rows, "_y", rows.select("features").first()[0].size, weights, trees)
    model = {
        "lr": LogisticRegression(labelCol="_y", weightCol="_weight", maxIter=30, regParam=1e-3),
        "svc": OneVsRest(classifier=LinearSVC(maxIter=30, regParam=1e-3), labelCol="_y", weightCol="_weight", parallelism=len(weights)),
    }[kind]
    return model.fit(rows.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_y") + 1).cast("int"))))


def classifier(train: DataFrame, text: str, label: str, kind: str = "lr", trees: int = 50) -> PipelineModel:
    """A text classifier with balanced class weights; kind: lr, svc or rf."""
    stages, rows, weights = _featured(train, text, label)
    model = PipelineModel(stages=[*stages, _fitted(rows, weights, kind, trees)])
    drop_table(rows)
    return model


def _named(labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("prediction") + 1).cast("int"))


def classified(model: PipelineModel, df: DataFrame, key: str, gate: float = 0.65, fallback: str | None = None) -> DataFrame:
    """(key, predicted, confidence): the class with its probability; below the gate, the fallback column if one is named."""
    labels = model.stages[0].labels
    indexer = model.stages[0].getInputCol()
    rows = df.withColumn(indexer, F.coalesce(F.col(indexer), F.lit(labels[0])) if indexer in df.columns else F.lit(labels[0]))
    out = PipelineModel(stages=model.stages[1:]).transform(rows)
    name = _named(labels)
    sure = F.round(F.array_max(vector_to_array("probability")), 4) if "probability" in out.columns else F.lit(None).cast("double")
    chosen = name if fallback is None else F.when(sure >= gate, name).otherwise(F.col(fallback))
    return out.select(key, chosen.alias("predicted"), sure.alias("confidence"))


def boosted(train: DataFrame, features: list[str], label: str, trees: int = 20) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), GBTClassifier(labelCol=label, maxIter=trees, seed=42)]).fit(train)


def _c(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) <= 1 or np.all(x.max(0) == x.min(0)):
        return (len(x),)
    i = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
    at = rng.uniform(x[:, i].min(), x[:, i].max())
    left = x[:, i] < at
    return (int(i), float(at), _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1))


def _depths(tree: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + _c(tree[0]))
    out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
    out[left], out[~left] = _depths(tree[2], x[left], depth + 1), _depths(tree[3], x[~left], depth + 1)
    return out


def isolation_forest(train: DataFrame, features: list[str], trees: int = 200, sample: int = 256, seed: int = 42) -> list[tuple]:
    """Trees of an isolation forest (Liu, Ting, Zhou 2008). Each is grown from ``sample`` rows drawn by hash, which the
    method prescribes and which bounds what any task and the driver hold, however large the table."""
    rows = train.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    n = rows.count()
    # each row is offered to as many trees as give each of them somewhat more than its sample: to one or none in a large table
    copies = min(trees, max(1, -(-13 * sample * trees // (10 * max(1, n)))))
    chance = min(1.0, 1.3 * sample * trees / (max(1, n) * copies))
    offered = F.filter(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.pmod(F.xxhash64("x", "_at", i, F.lit(seed)), F.lit(1_000_003)) < int(chance * 1_000_003) + 1)
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).select("x", "_at", F.explode(offered).alias("i"))
    many = placed.select("x", F.pmod(F.xxhash64("x", "_at", F.lit(seed + 1)) + F.col("i"), F.lit(trees)).cast("int").alias("t"))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        rng = np.random.default_rng(seed + int(key[0]))
        x = np.array(pdf["x"].tolist(), dtype=float)
        x = x[rng.permutation(len(x))[:sample]]
        return pd.DataFrame({"t": [int(key[0])], "n": [len(x)], "tree": [json.dumps(_tree(x, rng, int(np.ceil(np.log2(max(2, len(x)))))))]})

    grown = many.groupBy("t").applyInPandas(grow, "t int, n int, tree string").orderBy("t").collect()
    import json

    def tuples(a):
        return tuple(tuples(v) if isinstance(v, list) else v for v in a)

    return [(r["n"], tuples(json.loads(r["tree"]))) for r in grown]


def isolation_scores(df: DataFrame, key: str, features: list[str], forest: list[tuple]) -> DataFrame:
    """(key, score): near 1 for what is isolated fast, about 0.5 for the rest; null features give no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
            d = np.mean([_depths(t, x) for _, t in forest], axis=0) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"k": pdf["k"], "score": np.round(2.0 ** (-d / max(_c(np.mean([n for n, _ in forest])), 1e-9)), 6)})

    rows = df.select(F.col(key).alias("k"), F.array(*[F.col(c).cast("double") for c in features]).alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    return rows.mapInPandas(run, f"k {dict(df.dtypes)[key]}, score double").withColumnRenamed("k", key)


def biased_factors(ratings: DataFrame, user: str, item: str, rating: str, rank: int = 10, damping: float = 5.0) -> tuple[float, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Mean, user biases, item biases, user and item factors: damped means, then alternating least squares on what is left."""
    mean = ratings.agg(F.avg(rating)).first()[0] or 0.0
    bi = ratings.groupBy(item).agg((F.sum(F.col(rating) - F.lit(mean)) / (F.count("*") + F.lit(damping))).alias("bi"))
    with_i = ratings.join(bi, item)
    bu = with_i.groupBy(user).agg((F.sum(F.col(rating) - F.lit(mean) - F.col("bi")) / (F.count("*") + F.lit(damping))).alias("bu"))
    rest = with_i.join(bu, user).select(F.col(user).cast("int").alias("u"), F.col(item).cast("int").alias("i"), (F.col(rating) - F.lit(mean) - F.col("bi") - F.col("bu")).cast("float").alias("r"))
    als = ALS(userCol="u", itemCol="i", ratingCol="r", rank=rank, maxIter=8, regParam=0.1, seed=42, coldStartStrategy="nan").fit(rest)
    return mean, bu, bi, als.userFactors, als.itemFactors


def estimate(pairs: DataFrame, user: str, item: str, model: tuple, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """pairs with ``estimate``; a side that isn't known drops its terms, both unknown give null."""
    mean, bu, bi, pu, qi = model
    j = pairs.join(bu, user, "left").join(bi, item, "left").join(pu.select(F.col("id").alias("_u"), F.col("features").alias("_p")), F.col(user).cast("int") == F.col("_u"), "left").join(qi.select(F.col("id").alias("_i"), F.col("features").alias("_q")), F.col(item).cast("int") == F.col("_i"), "left")
    dot = F.when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), F.aggregate(F.zip_with("_p", "_q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    value = F.least(F.lit(high), F.greatest(F.lit(low), F.lit(mean) + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0)) + dot))
    return j.select(*pairs.columns, F.when(F.col("bu").isNotNull() | F.col("bi").isNotNull(), F.round(value, 6)).alias("estimate"))


def importance(model: PipelineModel, df: DataFrame, key: str, features: list[str], label: str) -> list[tuple[str, float]]:
    """(feature, loss of accuracy) when a feature's values are moved to other rows: ranks by two hashes of key are joined."""
    hit: Column = (F.col("prediction") == F.col(label)).cast("double")
    n, base = model.transform(df).agg(F.count("*"), F.avg(hit)).first()
    cells = max(1, n // 64)
    given = df.groupBy(F.pmod(F.xxhash64(key, F.lit(2)), F.lit(cells)).alias("_c")).agg(*[F.min_by(f, F.xxhash64(key, F.lit(3))).alias(f"_{f}") for f in features])
    moved = df.withColumn("_c", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(cells))).join(given, "_c")
    out = []
    for f in features:
        one = moved.withColumn(f, F.col(f"_{f}"))
        out.append((f, base - (model.transform(one).agg(F.avg(hit)).first()[0] or 0.0)))
    return sorted(out, key=lambda x: -x[1])


def selected(train: DataFrame, held_out: DataFrame, text: str, label: str, key: str, kinds: tuple[str, ...] = ("lr", "svc", "rf"), trees: int = 50) -> tuple[str, PipelineModel, list[tuple[str, float]]]:
    """(kind, model, [(kind, macro F1)] best first): models of all kinds, told apart by macro F1 on held-out rows; a tie goes to the first."""
    from .evaluation import class_report, confusion

    stages, rows, weights = _featured(train, text, label)
    held = cut(PipelineModel(stages=stages[1:]).transform(held_out).select(label, "features"), "held")
    scores, models = [], {}
    for kind in kinds:
        model = _fitted(rows, weights, kind, trees)
        models[kind] = PipelineModel(stages=[*stages, model])
        got = model.transform(held).select(label, _named(stages[0].labels).alias("predicted"))
        scores.append((kind, class_report(confusion(got, label, "predicted")).agg(F.avg("f1")).first()[0] or 0.0))
    drop_table(rows)
    drop_table(held)
    scores.sort(key=lambda x: (-x[1], kinds.index(x[0])))
    return scores[0][0], models[scores[0][0]], scores


def flagged_share(scores: DataFrame, score: str, share: float = 0.12) -> DataFrame:
    """scores with ``flagged``: the share of rows that score highest, cut at the exact percentile."""
    at = scores.agg(F.percentile(score, F.lit(1 - share))).first()[0]
    return scores.withColumn("flagged", F.col(score) > F.lit(at))


def cross_validated(ratings: DataFrame, user: str, item: str, rating: str, folds: int = 5, rank: int = 10) -> DataFrame:
    """(fold, n, rmse): errors of the factor model on each fold when trained on the others; folds by hash of user and item."""
    placed = ratings.withColumn("_f", F.pmod(F.xxhash64(user, item), F.lit(folds)).cast("int"))
    out = None
    for k in range(folds):
        held = placed.where(F.col("_f") == k)
        got = estimate(held, user, item, biased_factors(placed.where(F.col("_f") != k), user, item, rating, rank))
        one = got.where("estimate IS NOT NULL").agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col(rating) - F.col("estimate"), F.lit(2)))), 6).alias("rmse"))
        out = one if out is None else out.union(one)
    return out


def stacked(train: DataFrame, df: DataFrame, key: str, scores: list[str], label: str) -> DataFrame:
    """(key, fused): probability of a logistic model over several scores, fitted on train."""
    model = Pipeline(stages=[VectorAssembler(inputCols=scores, outputCol="_v", handleInvalid="skip"), LogisticRegression(featuresCol="_v", labelCol=label, maxIter=30, regParam=1e-3)]).fit(train)
    return model.transform(df).select(key, F.round(F.element_at(vector_to_array("probability"), 2), 6).alias("fused"))


_MISSING: set[str] = set()


def loaded(path: str, stages: int) -> PipelineModel | None:
    """A model kept at path if it is there and has as many stages as it should; else None, which is remembered, so that a path without a
    model is only tried once by a driver."""
    if path in _MISSING:
        return None
    try:
        model = PipelineModel.load(path)
    except Exception:  # missing or broken: callers go on without  # noqa: BLE001
        model = None
    if model is None or len(model.stages) != stages:
        _MISSING.add(path)
        return None
    return model
