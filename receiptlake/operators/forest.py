"""A random forest over sparse features, grown level by level from counts of what the rows hold."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, drop_table, run_dir

BINS = 32
#: Features lie between 0 and 1, since rows are of length one; a row goes right where its value is above the threshold of a node.
CUTS = np.arange(BINS - 1) / (BINS - 1)
_VECTOR = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
_NODE = "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"


def _gini(x: np.ndarray) -> np.ndarray:
    s = np.maximum(x.sum(-1, keepdims=True), 1e-300)
    return 1 - ((x / s) ** 2).sum(-1)


def _blocks(trees: int, seed: int):
    """Arrow batches of (y, indices, values) as blocks of arrays, each with how often the rows are drawn for each tree."""

    def run(parts: Iterator) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for i, b in enumerate(parts):
            n = len(b)
            if not n:
                continue
            row = np.repeat(np.arange(n), [len(x) for x in b["indices"]])
            held = np.searchsorted(CUTS, np.concatenate(b["values"].tolist())).astype(np.uint8)
            drawn = np.random.default_rng([seed, part, i]).poisson(1.0, (trees, n)).clip(0, 255).astype(np.uint8)
            block = {
                "y": b["y"].to_numpy().astype(np.int64), "n_held": np.bincount(row[held > 0], minlength=n), "feature": np.concatenate(b["indices"].tolist()).astype(np.int32)[held > 0], "bin": held[held > 0],
                "drawn": drawn, "node": np.where(drawn > 0, 0, -1).astype(np.int32),
            }
            yield pd.DataFrame({"tree": [-1], "counts": [None], "block": [pickle.dumps(block)]})

    return run


def _level(depth: int, trees: int, sizes: list[int], splits: list, size: int, classes: int, seed: int):
    """Blocks with their rows moved to the nodes of this level, and what each tree's nodes hold: counts by node and class, and by node,
    feature, bin and class for the features that a node may split on, those whose hash with the node is low."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_feature = np.random.default_rng([seed, 1]).integers(0, 2**64, size, dtype=np.uint64)
        of_node = [np.random.default_rng([seed, 2, t, depth]).integers(0, 2**64, max(1, sizes[t]), dtype=np.uint64) for t in range(trees)]
        below = np.uint64(min(2**64 - 1, int(2.0**64 * (1.0 if trees == 1 else np.ceil(np.sqrt(size)) / size))))
        keys, sums, totals = [[] for _ in range(trees)], [[] for _ in range(trees)], [np.zeros(n * classes) for n in sizes]
        for pdf in parts:
            for raw in pdf["block"]:
                b = pickle.loads(raw)  # noqa: S301
                y, n_held, feature, held, node = b["y"], b["n_held"], b["feature"], b["bin"], b["node"]
                row, hashes = np.repeat(np.arange(len(y), dtype=np.int32), n_held), of_feature[feature]
                for t in range(trees):
                    if splits:
                        f, at, left, right = splits[t]
                        on = np.flatnonzero(feature == np.repeat(np.append(f, -1)[node[t]], n_held))
                        over = np.zeros(len(y), dtype=bool)
                        over[row[on[held[on] > np.append(at, 0)[node[t][row[on]]]]]] = True
                        node[t] = np.where(node[t] < 0, -1, np.where(over, np.append(right, -1)[node[t]], np.append(left, -1)[node[t]]))
                    here = node[t] >= 0
                    if not here.any():
                        continue
                    totals[t] += np.bincount(node[t][here] * classes + y[here], b["drawn"][t][here], len(totals[t]))
                    x = hashes ^ np.repeat(of_node[t][node[t]], n_held)
                    x *= np.uint64(0x9E3779B97F4A7C15)
                    x ^= x >> np.uint64(32)
                    x *= np.uint64(0xD6E8FEB86659FD93)
                    on = np.flatnonzero(x <= below)
                    on = on[here[row[on]]]
                    r = row[on]
                    keys[t].append(((node[t][r].astype(np.int64) * size + feature[on]) * BINS + held[on]) * classes + y[r])
                    sums[t].append(b["drawn"][t][r])
                yield pd.DataFrame({"tree": [-1], "counts": [None], "block": [pickle.dumps(b)]})
        for t in range(trees):
            if totals[t].any():
                k, at = np.unique(np.concatenate(keys[t]), return_inverse=True)
                yield pd.DataFrame({"tree": [t], "counts": [pickle.dumps((k, np.bincount(at, np.concatenate(sums[t]), len(k)), totals[t]))], "block": [None]})

    return run


def _best(size: int, classes: int, weights: list[float]):
    """For each node of a tree: counts by class, and the feature, bin, gain and counts on the right of its best split (feature -1: none)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts, w = [pickle.loads(x) for x in pdf["counts"]], np.array(weights)  # noqa: S301
        totals = sum(p[2] for p in parts).reshape(-1, classes)
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys))
        cell, at = np.unique(keys // classes, return_inverse=True)
        h = np.zeros((len(cell), classes))
        h[at, keys % classes] = n
        feature, gain = np.full(len(totals), -1), np.full(len(totals), -1.0)
        bins, right = np.zeros(len(totals), dtype=int), np.zeros_like(totals)
        if len(cell):
            own, node = cell // BINS, cell // BINS // size
            up = np.append(np.cumsum(h[::-1], axis=0)[::-1], np.zeros((1, classes)), axis=0)
            r = up[:-1] - up[np.searchsorted(own, own, side="right")]  # rows of this bin and those above, of the same node and feature
            whole, over = totals[node] * w, r * w
            rest = whole - over
            g = _gini(whole) - (rest.sum(1) * _gini(rest) + over.sum(1) * _gini(over)) / whole.sum(1)
            g[r.sum(1) >= totals[node].sum(1)] = -1.0
            order = np.lexsort((cell, -g, node))
            first = order[np.unique(node[order], return_index=True)[1]]
            first = first[g[first] > 1e-12]
            i = node[first]
            feature[i], bins[i], gain[i], right[i] = own[first] % size, cell[first] % BINS - 1, g[first], r[first]
        return pd.DataFrame({"tree": [int(key[0])], "found": [pickle.dumps((totals, feature, bins, gain, right))]})

    return run


def _model(spark: SparkSession, nodes: list[tuple], size: int, classes: int, trees: int, depth: int, label: str, seed: int) -> RandomForestClassificationModel:
    """The nodes as a model of Spark: one of as many classes, features and trees is kept, its nodes are replaced, and it is loaded."""
    rows = spark.createDataFrame([(float(c), Vectors.sparse(size, [], [])) for c in range(classes)], [label, "features"])
    path = f"{run_dir(spark)}/forest-{uuid.uuid4().hex}"
    RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(rows).save(path)
    spark.createDataFrame(nodes, _NODE, verifySchema=False).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def forest(rows: DataFrame, label: str, size: int, weights: list[float], trees: int, depth: int = 12, seed: int = 42) -> RandomForestClassificationModel:
    """A random forest (Breiman 2001) over ``features`` of a table written by ``cut``, with a weight for each class.

    Rows keep only what they hold: Spark's own forest turns each into as many numbers as there are features. As there, rows are drawn for
    each tree by Poisson counts and a node looks at about the root of all features. Each level is one pass over all rows; counts are
    added up by tree, and the driver gets one split a node.
    """
    spark, classes = rows.sparkSession, len(weights)
    held = spark.read.schema(f"{label} double, features {_VECTOR}").parquet(*rows.inputFiles())
    held = held.select(F.col(label).alias("y"), F.coalesce("features.indices", F.expr("sequence(0, size(features.values) - 1)")).alias("indices"), F.col("features.values").alias("values"))
    form = "tree int, counts binary, block binary"
    state = cut(held.mapInPandas(_blocks(trees, seed), form), "forest")
    w, sizes, splits = np.array(weights), [1] * trees, []
    ids = [np.zeros(1, dtype=int) for _ in range(trees)]
    stats: list[list] = [[np.zeros(classes)] for _ in range(trees)]  # counts of each node by its id
    inner: list[dict] = [{} for _ in range(trees)]
    for d in range(depth):
        if not any(sizes):
            break
        after = cut(state.where("block IS NOT NULL").select("block").mapInPandas(_level(d, trees, sizes, splits, size, classes, seed), form), "forest")
        drop_table(state)
        state = after
        found = {r["tree"]: pickle.loads(r["found"]) for r in state.where("tree >= 0").select("tree", "counts").groupBy("tree").applyInPandas(_best(size, classes, weights), "tree int, found binary").collect()}  # noqa: S301
        splits = []
        for t in range(trees):
            totals, feature, bins, gain, right = found.get(t, (np.zeros((sizes[t], classes)), np.full(sizes[t], -1), np.zeros(sizes[t], dtype=int), np.zeros(sizes[t]), np.zeros((sizes[t], classes))))
            if d == 0:
                stats[t] = [totals[0]]
            to, new = np.full((2, sizes[t]), -1), []
            for i in np.flatnonzero(feature >= 0):
                inner[t][int(ids[t][i])] = (int(feature[i]), float(CUTS[bins[i]]), float(gain[i]), len(stats[t]))
                for side, s in enumerate((totals[i] - right[i], right[i])):
                    if d + 1 < depth and np.count_nonzero(s) > 1:
                        to[side, i] = len(new)
                        new.append(len(stats[t]))
                    stats[t].append(s)
            splits.append((feature, bins, *to))
            ids[t], sizes[t] = np.array(new, dtype=int), len(new)
    drop_table(state)
    nodes = []
    for t in range(trees):
        for i, s in enumerate(stats[t]):
            f, at, gain, left = inner[t].get(i, (-1, None, -1.0, -1))
            x = s * w
            nodes.append((t, (i, float(x.argmax()), float(_gini(x)) if x.any() else 0.0, x.tolist(), int(s.sum()), gain, left, left + 1 if f >= 0 else -1, (f, [] if at is None else [at], -1))))
    return _model(spark, nodes, size, classes, trees, depth, label, seed)
