"""Measures of classifiers, rankings and regressions, over any number of rows."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import draw
from .windows import average_rank, running_total


def roc_auc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc) from the sum of the positives' average ranks; null if a class is missing."""
    by = by or []
    ranked = average_rank(df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()), score, "_rank", by)
    pos = F.col(truth).cast("int") == 1
    sums = ranked.groupBy(*by).agg(F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"), F.sum(F.when(pos, F.col("_rank"))).alias("_s"))
    u = F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return sums.select(*by, "n_pos", "n_neg", F.round(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), u / (F.col("n_pos") * F.col("n_neg"))), 6).alias("auc"))


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, tpr, fpr) at each distinct score as threshold, by running totals over the distinct scores."""
    pos = F.col(truth).cast("int") == 1
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    np, nn = counts.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    falling = counts.select("score", "p", "n", (-F.col("score")).alias("_o"))
    run = running_total(running_total(falling, [], "_o", "p", "tp"), [], "_o", "n", "fp")
    return run.select("score", F.round(F.col("tp") / max(np, 1), 6).alias("tpr"), F.round(F.col("fp") / max(nn, 1), 6).alias("fpr"))


def best_threshold(points: DataFrame) -> DataFrame:
    """The score with the largest tpr - fpr, the higher score on a tie."""
    return points.agg(F.max_by(F.struct("score", "tpr", "fpr"), F.struct(F.round(F.col("tpr") - F.col("fpr"), 6), "score")).alias("b")).select("b.score", "b.tpr", "b.fpr")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """(cls, support, precision, recall, f1) from a confusion matrix; 0 where a class is never predicted or never true."""
    t = matrix.groupBy(F.col("truth").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    p = matrix.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("said"))
    j = t.join(p, "cls", "full").select("cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("said", F.lit(0)).alias("said"))
    pr = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    rc = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("said") + F.col("support") > 0, 2 * F.col("hit") / (F.col("said") + F.col("support"))).otherwise(0.0)
    return j.select("cls", "support", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def overall(report: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted F1."""
    acc = matrix.agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a"))
    a = acc.first()[0]
    return report.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1")).withColumn("accuracy", F.round(F.lit(a), 6))


def by_bins(df: DataFrame, score: str, correct: Column, edges: list[float]) -> DataFrame:
    """(bin, n, share_correct): accuracy by bin of confidence; the last bin takes all above."""
    b = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        b = F.when(F.col(score) < edges[i], F.lit(i)).otherwise(b)
    return df.where(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(correct.cast("double")), 6).alias("share_correct"))


def operating_points(df: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, recall, fpr) for given thresholds in one pass."""
    pos = F.col(truth).cast("int") == 1
    one = df.agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"), *[F.struct(F.count_if(pos & (F.col(score) >= t)).alias("tp"), F.count_if(~pos & (F.col(score) >= t)).alias("fp")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}.tp").alias("tp"), F.col(f"t{i}.fp").alias("fp")) for i, t in enumerate(thresholds)])
    return one.select("p", "n", F.explode(rows).alias("r")).select("r.threshold", F.round(F.col("r.tp") / F.greatest("p", F.lit(1)), 6).alias("recall"), F.round(F.col("r.fp") / F.greatest("n", F.lit(1)), 6).alias("fpr"))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Spearman's correlation, ties at their mean rank."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_rank(average_rank(both, a, "_ra"), b, "_rb").agg(F.round(F.corr("_ra", "_rb"), 6).alias("rho"))


def errors(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    e = truth - predicted
    return df.agg(F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"))


def ranking(df: DataFrame, user: str, score: list[Column], gain: str, k: int, relevant: float) -> DataFrame:
    """(user, precision, recall, ndcg) of the k best scored items, gains 2**gain - 1 by log2 of the place plus one."""
    w = Window.partitionBy(user)
    place = F.row_number().over(w.orderBy(*score))
    ideal = F.row_number().over(w.orderBy(F.desc(gain), *score))
    r = df.select(F.col(user).alias("u"), F.col(gain).alias("g"), place.alias("p"), ideal.alias("i"))
    worth = lambda at: (F.pow(F.lit(2.0), F.col("g")) - 1) / F.log2(F.col(at) + 1.0)
    rel = F.col("g") >= relevant
    s = r.groupBy("u").agg(
        F.sum(F.when(F.col("p") <= k, worth("p")).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("i") <= k, worth("i")).otherwise(0.0)).alias("idcg"),
        F.count_if(rel & (F.col("p") <= k)).alias("hit"),
        F.count_if(rel).alias("all_rel"),
    )
    return s.select(
        F.col("u").alias(user),
        F.round(F.col("hit") / k, 6).alias("precision"),
        F.round(F.when(F.col("all_rel") > 0, F.col("hit") / F.col("all_rel")).otherwise(0.0), 6).alias("recall"),
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"),
    )


def injected_recall(df: DataFrame, value: Column, reference: Column, multipliers: list[float], cut: float) -> DataFrame:
    """(multiplier, n, flag_rate): how often an amount of m times the reference is flagged by log ratio; m = 1 keeps the value."""
    ratio = lambda v: F.log1p(v) - F.log1p(F.greatest(reference, F.lit(1e-9)))
    rows = F.array(*[F.struct(F.lit(float(m)).alias("m"), (ratio(value if m == 1 else reference * float(m)) > cut).alias("flag")) for m in multipliers])
    each = df.select(F.explode(rows).alias("x"))
    return each.groupBy(F.col("x.m").alias("multiplier")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("x.flag").cast("double")), 6).alias("flag_rate"))


def poisson_copies(u: Column) -> Column:
    """How many copies a uniform number draws by the Poisson law with mean one, up to five."""
    out, upto, p = F.lit(5), 0.0, exp(-1.0)
    steps = []
    for k in range(5):
        upto += p
        steps.append((k, upto))
        p /= k + 1
    for k, at in reversed(steps):
        out = F.when(u < round(at, 8), F.lit(k)).otherwise(out)
    return out


def bootstrap_auc(df: DataFrame, group: str, truth: str, a: str, b: str, times: int, seed: int = 42) -> DataFrame:
    """One row: mean, 95 % interval and two-sided p of the difference of two scores' AUC when whole groups are drawn again with repeats.

    Each group gets a Poisson number of copies in each repetition, from a hash, so that an executor that is lost draws the
    same again. Rows are counted by group and score first; repetitions copy these counts, not rows, and are combined before
    they are shuffled. A window of a repetition holds its distinct scores.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(truth).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    pos = F.col(truth).cast("int") == 1
    groups = rows.select(F.col(group).alias("_g")).distinct()
    drawn = groups.select("_g", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("rep"))
    w = drawn.select("_g", "rep", poisson_copies(draw(F.concat_ws("|", "_g", "rep"), seed) / float(16**7)).alias("w")).where("w > 0")

    def auc(score: str, out: str) -> DataFrame:
        counts = rows.groupBy(F.col(group).alias("_h"), F.col(score).alias("_s")).agg(F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_n"))
        c = counts.join(w, F.col("_h") == F.col("_g")).groupBy("rep", "_s").agg(F.sum(F.col("w") * F.col("_p")).alias("p"), F.sum(F.col("w") * F.col("_n")).alias("n"))
        below = F.sum("n").over(Window.partitionBy("rep").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
        s = c.withColumn("_b", F.coalesce(below, F.lit(0))).groupBy("rep").agg(F.sum(F.col("p") * (F.col("_b") + F.col("n") / 2)).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
        return s.where("p > 0 AND n > 0").select("rep", (F.col("s") / (F.col("p") * F.col("n"))).alias(out))

    d = auc(a, "auc_a").join(auc(b, "auc_b"), "rep").select((F.col("auc_a") - F.col("auc_b")).alias("d"))
    return d.agg(F.count("*").alias("n_reps"), F.round(F.avg("d"), 6).alias("mean_diff"), F.round(F.percentile("d", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("high"), F.round(2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))), 6).alias("p_value"))


def disagreement(df: DataFrame, a: str, b: str, cut_a: float, cut_b: float) -> DataFrame:
    """One row: rows with both scores, and the share in which their verdicts at a cut each differ."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("n"), F.round(F.avg(((F.col(a) >= cut_a) != (F.col(b) >= cut_b)).cast("double")), 6).alias("disagreement"))


def best_of(metrics: DataFrame, most_fpr: float = 0.15) -> DataFrame:
    """The model with the best recall among those whose false alarms stay below a limit, the fewest false alarms on a tie; without any
    such one, that with the fewest. metrics: model, fpr, recall."""
    ok = F.col("fpr") < most_fpr
    order = F.struct(ok, F.when(ok, F.col("recall")), -F.col("fpr"), F.col("recall"), F.col("model"))
    return metrics.agg(F.max_by(F.struct("model", "fpr", "recall"), order).alias("m")).select("m.model", "m.fpr", "m.recall")


def group_recall(df: DataFrame, user: str, score: list[Column], group: str, relevant: Column, k: int) -> DataFrame:
    """(user, covered, wanted, recall): share of a user's relevant groups (categories) that the k best scored items cover."""
    place = F.row_number().over(Window.partitionBy(user).orderBy(*score))
    r = df.select(F.col(user).alias("u"), F.col(group).alias("g"), relevant.alias("rel"), place.alias("p"))
    per = r.groupBy("u", "g").agg(F.max(F.col("rel").cast("int")).alias("rel"), F.max((F.col("p") <= k).cast("int")).alias("top"))
    s = per.groupBy("u").agg(F.count_if((F.col("rel") == 1) & (F.col("top") == 1)).alias("covered"), F.count_if(F.col("rel") == 1).alias("wanted"))
    return s.select(F.col("u").alias(user), "covered", "wanted", F.round(F.when(F.col("wanted") > 0, F.col("covered") / F.col("wanted")).otherwise(0.0), 6).alias("recall"))
