"""Several values packed into one field: delimiters inferred per source, then one row a value."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed
from ..session import cut

#: A candidate is a delimiter of a source if its score reaches this.
SCORE = 0.4
#: Texts of a source that count as much as the verdict of all sources together.
PRIOR = 20
#: How far two distributions may lie apart by chance, times the root of the texts (Kolmogorov and Smirnov, 5 %).
CHANCE = 1.36
_EVIDENCE = "source string, by string, what string, value string, n long"


def _evidence(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and source, counted before anything is shuffled: types of first pieces, types of the pieces behind each
    candidate, and in how many texts a candidate makes how many pieces."""
    for pdf in parts:
        out = []
        for source, texts in pdf.groupby("_s", dropna=False)["_t"]:
            first, after, pieces = Counter(), Counter(), Counter()
            for t, n in texts.value_counts().items():
                a, b, c = Counter(), Counter(), Counter()
                packed.evidence(t, a, b, c)
                for into, got in ((first, a), (after, b)):
                    for k, v in got.items():
                        into[k] += v * n
                for by, v in c.items():
                    pieces[by, str(v + 1)] += n
            s = None if pd.isna(source) else source
            out += [(s, "", "first", h, n) for h, n in first.items()]
            out += [(s, by, "type", h, n) for (by, h), n in after.items()]
            out += [(s, by, "pieces", k, n) for (by, k), n in pieces.items()]
        yield pd.DataFrame(out, columns=["source", "by", "what", "value", "n"])


def agreement(counts: dict[str, dict[int, int]], weight: dict[str, float]) -> dict[str, float]:
    """How far each candidate's piece counts over texts agree with those of all candidates, weighed: 1 less the largest gap
    between the two distributions beyond what chance explains.

    The number of values in a text doesn't depend on the mark between them, so real delimiters agree; what stands inside
    values makes two pieces of almost every text that holds it.
    """
    grid = sorted({k for c in counts.values() for k in c})
    pooled = [sum(weight[by] * c.get(k, 0) for by, c in counts.items()) for k in grid]
    whole = sum(pooled)
    out = {}
    for by, c in counts.items():
        n, own, ref, gap = sum(c.values()), 0.0, 0.0, 0.0
        for k, p in zip(grid, pooled):
            own, ref = own + c.get(k, 0) / n, ref + (p / whole if whole else 0.0)
            gap = max(gap, abs(own - ref))
        out[by] = 1.0 - max(0.0, gap - CHANCE / n**0.5) if whole else 0.0
    return out


def _scored(pdf: pd.DataFrame) -> pd.DataFrame:
    counts: dict[str, dict[int, int]] = {}
    weight = dict(zip(pdf["by"], pdf["regular"]))
    for by, k, n in zip(pdf["by"], pdf["value"], pdf["n"]):
        counts.setdefault(by, {})[int(k)] = int(n)
    agree = agreement(counts, weight)
    rows = [(pdf["whole"].iloc[0], pdf["source"].iloc[0], by, sum(c.values()), weight[by], agree[by]) for by, c in counts.items()]
    return pd.DataFrame(rows, columns=["whole", "source", "by", "texts", "regular", "consistent"])


def candidates(df: DataFrame, text: str, source: str) -> DataFrame:
    """(whole, source, by, texts, regular, consistent): how each candidate fares in each source, and, with ``whole``, in all.

    ``regular`` is the share of the pieces behind it whose type (first two words) is also the type of some first piece: a
    delimiter puts any value behind it, whereas what stands inside a value (``w/``, ``&``, ``@``) is followed by its own few
    words. ``consistent`` is the agreement of its piece counts with those of the others, weighed by texts and regularity.
    Counts are made over all rows, combined within batches before the shuffle; a task that scores a source holds one number
    for each candidate and piece count.
    """
    rows = df.select(F.col(source).alias("_s"), F.col(text).alias("_t")).where("length(_t) > 0")
    made = cut(rows.mapInPandas(_evidence, _EVIDENCE).groupBy("source", "by", "what", "value").agg(F.sum("n").alias("n")), "evidence")  # read more than once
    scope = F.explode(F.array(F.struct(F.lit(False).alias("whole"), F.col("source")), F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("source"))))
    counts = made.select(scope.alias("scope"), "by", "what", "value", "n").groupBy("scope.whole", "scope.source", "by", "what", "value").agg(F.sum("n").alias("n"))
    types = counts.where("what <> 'pieces'").groupBy("whole", "source", "value").agg(F.max(F.expr("what = 'first'")).alias("begins"), F.collect_list(F.when(F.col("what") == "type", F.struct("by", "n"))).alias("behind"))
    each = types.select("whole", "source", "begins", F.inline("behind"))
    regular = each.groupBy("whole", "source", "by").agg((F.sum(F.when(F.col("begins"), F.col("n")).otherwise(0)) / F.sum("n")).alias("regular"))
    same = [F.col("c.whole") == F.col("r.whole"), F.col("c.source").eqNullSafe(F.col("r.source")), F.col("c.by") == F.col("r.by")]
    both = counts.where("what = 'pieces'").alias("c").join(regular.alias("r"), same).select("c.whole", "c.source", "c.by", "c.value", "c.n", "regular")
    return both.groupBy("whole", "source").applyInPandas(_scored, "whole boolean, source string, by string, texts long, regular double, consistent double")


def delimiters(df: DataFrame, text: str, source: str) -> DataFrame:
    """(source, names): the delimiters of each source, those whose score, regularity times consistency, reaches ``SCORE``.

    The score of a source is drawn towards that of all sources as if ``PRIOR`` texts had it, so that a mark which a source
    hardly uses is judged by what it is elsewhere, and one that it uses often by what it is there.
    """
    got = candidates(df, text, source).withColumn("score", F.col("regular") * F.col("consistent"))
    own, whole = got.where("NOT whole"), got.where("whole").select("by", F.col("score").alias("everywhere"))
    drawn = own.join(whole, "by").withColumn("drawn", (F.col("texts") * F.col("score") + PRIOR * F.col("everywhere")) / (F.col("texts") + PRIOR))
    return drawn.where(F.col("drawn") >= SCORE).groupBy("source").agg(F.sort_array(F.collect_set("by")).alias("names"))


def _split(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Values joined by the unit separator, which delimits in any source, since texts cross to Python and back faster than lists."""
    known: dict = {}
    for texts, names in parts:
        out = []
        for t, n in zip(texts, names):
            if n not in known:
                known[n] = ("separator", *(n or "").split(","))
            out.append("\x1f".join(packed.items(t, known[n])))
        yield pd.Series(out, dtype="object")


def unpack(df: DataFrame, key: str = "row_id", text: str = "items_text", source: str = "source") -> DataFrame:
    """(key, pos, item): one row for each non-empty value packed in text, counted from 1.

    Null, empty and blank texts and texts of delimiters only give no row; a text with one value gives one; repeated rows
    give their values again. Lists in JSON are read as such in any source. Rows meet the delimiters of their source in a
    join whose right side has one row a source; Catalyst broadcasts it by its measured size, so a source of any share of
    the rows isn't moved.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(source).alias("_s")).where("length(_t) > 0")
    found = delimiters(rows, "_t", "_s")
    got = rows.join(found, F.col("_s").eqNullSafe(F.col("source")), "left").select("_k", F.pandas_udf(_split, "string")("_t", F.array_join("names", ",")).alias("_v")).where("_v <> ''")
    return got.select(F.col("_k").alias(key), F.posexplode(F.split("_v", "\x1f")).alias("pos", "item")).select(key, (F.col("pos") + 1).cast("int").alias("pos"), "item")
