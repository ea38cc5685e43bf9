"""Queries of evaluation, sampling, sources and sinks, streams and models over whole tables."""

from __future__ import annotations

import base64
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, text
from ..operators import evaluation, learning, sampling, windows
from ..session import cut, drop_table, table
from ..sources import readers, writers
from ..streaming import events as streams
from .analytics import _OWN, _receipts

SQL: dict[str, str] = {}
_C = F.col


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a truth (a receipt or not) and two scores."""
    return table(spark, d, "documents").where("n_chars IS NOT NULL AND doc_type IS NOT NULL").select("doc_id", "source", (_C("doc_type") == "receipt").cast("int").alias("y"), _C("n_chars").cast("double").alias("s1"), F.pmod("n_chars", F.lit(97)).cast("double").alias("s2"))


_DOCS = "SELECT doc_id, source, CAST(doc_type = 'receipt' AS INTEGER) AS y, n_chars::DOUBLE AS s1, (n_chars % 97)::DOUBLE AS s2 FROM documents WHERE n_chars IS NOT NULL AND doc_type IS NOT NULL"


def auc_by_source(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.roc_auc(table(spark, d, "category_records").select("split", (_C("category_3class") == "Food & Beverage").cast("int").alias("y"), F.length("text").cast("double").alias("s")), "y", "s", ["split"])


SQL["auc_by_source"] = """
WITH r AS (SELECT split, CAST(category_3class = 'Food & Beverage' AS INTEGER) AS y, length(text)::DOUBLE AS s FROM category_records WHERE category_3class IS NOT NULL AND text IS NOT NULL AND split IS NOT NULL),
k AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY s) + (count(*) OVER (PARTITION BY split, s) - 1) / 2.0::DOUBLE AS rk FROM r),
a AS (SELECT split, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, sum(rk) FILTER (WHERE y = 1) AS sr FROM k GROUP BY 1)
SELECT split, n_pos, n_neg, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (sr - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg) END, 6) AS auc FROM a"""


def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.roc_points(_scored(spark, d), "y", "s2")


_ROC = f"""WITH c AS (SELECT s2 AS score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM ({_DOCS}) GROUP BY 1),
r AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM c)
SELECT score, round(tp::DOUBLE / greatest(np, 1), 6) AS tpr, round(fp::DOUBLE / greatest(nn, 1), 6) AS fpr FROM r"""
SQL["roc_curve"] = _ROC


def best_cut(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_threshold(evaluation.roc_points(_scored(spark, d), "y", "s1"))


SQL["best_cut"] = f"SELECT score, tpr, fpr FROM ({_ROC.replace('s2 AS score', 's1 AS score')}) ORDER BY round(tpr - fpr, 6) DESC, score DESC LIMIT 1"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "category_records").where("category_3class IS NOT NULL").select("rec_id", "category_3class", text.spend_class(_C("text")).alias("guess"))


def class_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_predicted(spark, d), "category_3class", "guess")


_GUESS = f"""SELECT rec_id, category_3class AS truth, CASE WHEN regexp_matches(' ' || lower(coalesce(text, '')) || ' ', '{"|".join(text.FOOD_WORDS)}') THEN 'Food & Beverage'
 WHEN regexp_matches(' ' || lower(coalesce(text, '')) || ' ', '{"|".join(text.GROCERY_WORDS)}') THEN 'Supermarket / Grocery' ELSE 'General Retail' END AS predicted FROM category_records WHERE category_3class IS NOT NULL"""
SQL["class_confusion"] = f"SELECT truth, predicted, count(*) AS n FROM ({_GUESS}) GROUP BY 1, 2"


def class_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.class_report(class_confusion(spark, d))


_REPORT = f"""WITH m AS (SELECT truth, predicted, count(*) AS n FROM ({_GUESS}) GROUP BY 1, 2), t AS (SELECT truth AS cls, sum(n) AS support, coalesce(sum(n) FILTER (WHERE truth = predicted), 0) AS hit FROM m GROUP BY 1),
p AS (SELECT predicted AS cls, sum(n) AS said FROM m GROUP BY 1), j AS (SELECT coalesce(t.cls, p.cls) AS cls, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(said, 0) AS said FROM t FULL JOIN p ON t.cls = p.cls)
SELECT cls, CAST(support AS BIGINT) AS support, round(CASE WHEN said > 0 THEN hit::DOUBLE / said ELSE 0.0::DOUBLE END, 6) AS precision, round(CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0.0::DOUBLE END, 6) AS recall,
 round(CASE WHEN said + support > 0 THEN 2.0::DOUBLE * hit / (said + support) ELSE 0.0::DOUBLE END, 6) AS f1 FROM j"""
SQL["class_report"] = _REPORT


def class_overall(spark: SparkSession, d: str) -> DataFrame:
    m = class_confusion(spark, d)
    return evaluation.overall(evaluation.class_report(m), m)


SQL["class_overall"] = f"SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, (SELECT round(avg(CAST(truth = predicted AS INTEGER)), 6) FROM ({_GUESS})) AS accuracy FROM ({_REPORT})"


def confidence_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d).withColumn("conf", F.pmod("rec_id", F.lit(100)) / 100.0)
    return evaluation.by_bins(rows, "conf", _C("guess") == _C("category_3class"), [0.45, 0.55, 0.65, 0.75])


SQL["confidence_bins"] = f"""SELECT CAST(CASE WHEN c < 0.45::DOUBLE THEN 0 WHEN c < 0.55::DOUBLE THEN 1 WHEN c < 0.65::DOUBLE THEN 2 WHEN c < 0.75::DOUBLE THEN 3 ELSE 4 END AS INTEGER) AS bin, count(*) AS n, round(avg(CAST(truth = predicted AS INTEGER)), 6) AS share_correct
FROM (SELECT *, (rec_id % 100) / 100.0::DOUBLE AS c FROM ({_GUESS})) GROUP BY 1"""


def operating_points(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.operating_points(_scored(spark, d), "y", "s1", [100.0, 200.0, 300.0, 400.0])


SQL["operating_points"] = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, round(count(*) FILTER (WHERE y = 1 AND s1 >= {t})::DOUBLE / greatest(count(*) FILTER (WHERE y = 1), 1), 6) AS recall, round(count(*) FILTER (WHERE y = 0 AND s1 >= {t})::DOUBLE / greatest(count(*) FILTER (WHERE y = 0), 1), 6) AS fpr FROM ({_DOCS})" for t in (100.0, 200.0, 300.0, 400.0))


def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.rank_correlation(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


SQL["rank_correlation"] = "SELECT round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)"


def price_errors(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), _C("l_partkey") == _C("p_partkey"))
    return evaluation.errors(j, _C("l_extendedprice"), _C("l_quantity") * _C("p_retailprice"))


SQL["price_errors"] = "SELECT round(sqrt(avg((l_extendedprice - l_quantity * p_retailprice) ** 2)), 6) AS rmse, round(avg(abs(l_extendedprice - l_quantity * p_retailprice)), 6) AS mae FROM lineitem JOIN part ON l_partkey = p_partkey"


def _gains(spark: SparkSession, d: str) -> DataFrame:
    per = _receipts(spark, d).groupBy("user_id", "category").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("s"))
    return per.select("user_id", "category", _C("s").alias("score"), F.least(_C("n"), F.lit(5)).cast("double").alias("gain"))


def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ranking(_gains(spark, d), "user_id", [F.desc("score"), _C("category")], "gain", 3, 2.0)


SQL["ranking_quality"] = f"""
WITH g AS (SELECT user_id, category, round(sum(total), 2) AS score, least(count(*), 5)::DOUBLE AS gain FROM ({_OWN}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, category) AS p, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, score DESC, category) AS i FROM g),
s AS (SELECT user_id, sum(CASE WHEN p <= 3 THEN (pow(2.0::DOUBLE, gain) - 1) / log2(p + 1.0::DOUBLE) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 3 THEN (pow(2.0::DOUBLE, gain) - 1) / log2(i + 1.0::DOUBLE) ELSE 0 END) AS idcg, count(*) FILTER (WHERE gain >= 2 AND p <= 3) AS hit, count(*) FILTER (WHERE gain >= 2) AS rel FROM r GROUP BY 1)
SELECT user_id, round(hit / 3.0::DOUBLE, 6) AS precision, round(CASE WHEN rel > 0 THEN hit::DOUBLE / rel ELSE 0.0::DOUBLE END, 6) AS recall, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0::DOUBLE END, 6) AS ndcg FROM s"""


def injected_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.trailing_median(_receipts(spark, d), "user_id", ["created_at", "export_id"], "total", default=100.0)
    return evaluation.injected_recall(rows, _C("total"), _C("reference"), [1, 3, 5, 10, 20, 50], 1.9)


SQL["injected_outliers"] = f"""
WITH w AS (SELECT *, count(total) OVER p AS nb, median(total) OVER p AS md FROM (SELECT * FROM ({_OWN}) WHERE total > 0) WINDOW p AS (PARTITION BY user_id ORDER BY created_at, export_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
x AS (SELECT total, CASE WHEN nb >= 5 THEN md ELSE 100.0::DOUBLE END AS ref FROM w), m AS (SELECT unnest([1.0, 3.0, 5.0, 10.0, 20.0, 50.0])::DOUBLE AS m)
SELECT m AS multiplier, count(*) AS n, round(avg(CASE WHEN ln(1 + CASE WHEN m = 1 THEN total ELSE ref * m END) - ln(1 + greatest(ref, 1e-9::DOUBLE)) > 1.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS flag_rate FROM x, m GROUP BY 1"""


BOOTSTRAPS = 4000


def score_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.bootstrap_auc(_scored(spark, d), "source", "y", "s1", "s2", BOOTSTRAPS)


def _auc_sql(score: str) -> str:
    return f"""(SELECT rep, sum(p * (b + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM (SELECT rep, s, p, n, coalesce(sum(n) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
FROM (SELECT rep, s, sum(w * p)::DOUBLE AS p, sum(w * n)::DOUBLE AS n FROM (SELECT source, {score} AS s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM r GROUP BY 1, 2) JOIN w USING (source) GROUP BY 1, 2)) GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0)"""


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(table(spark, d, "category_records"), "rec_id", "category_3class", [("train", 0.7), ("val", 0.15), ("test", 0.15)])


_DRAW = "CAST(('0x' || substr(md5(CAST({} AS VARCHAR) || ':42'), 1, 7)) AS BIGINT)"
SQL["stratified_split"] = f"""
WITH r AS (SELECT rec_id, coalesce(category_3class, '') AS stratum, {_DRAW.format('rec_id')} AS d FROM category_records), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY d, rec_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM r)
SELECT rec_id, stratum, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k"""


def grouped_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.group_folds(table(spark, d, "fraud_manifest"), text.receipt_group(_C("image_path")), 5).select("manifest_id", "grp", "fold")


_STEPS = [round(sum(exp(-1.0) / factorial(j) for j in range(k + 1)), 8) for k in range(5)]
SQL["score_bootstrap"] = f"""WITH r AS (SELECT * FROM ({_DOCS}) WHERE source IS NOT NULL), w AS (SELECT source, rep, CASE {" ".join(f"WHEN u < {x}::DOUBLE THEN {k}" for k, x in enumerate(_STEPS))} ELSE 5 END AS w
FROM (SELECT source, rep, {_DRAW.format("source || '|' || CAST(rep AS VARCHAR)")} / {float(16**7)}::DOUBLE AS u FROM (SELECT DISTINCT source FROM r), (SELECT unnest(range({BOOTSTRAPS})) AS rep))),
d AS (SELECT x.auc - z.auc AS d FROM {_auc_sql("s1")} x JOIN {_auc_sql("s2")} z USING (rep))
SELECT count(*) AS n_reps, round(avg(d), 6) AS mean_diff, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(2 * least(avg(CASE WHEN d <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), avg(CASE WHEN d >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS p_value FROM d"""
_GRP = r"lower(trim(regexp_replace(regexp_replace(string_split(image_path, '/')[-1], '\.[^.]+$', ''), '_tampered(_v\d+)?$', '')))"
SQL["grouped_folds"] = f"SELECT manifest_id, grp, CAST({_DRAW.format('grp')} % 5 AS INTEGER) AS fold FROM (SELECT manifest_id, {_GRP} AS grp FROM fraud_manifest)"


def fold_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Images that lie in several splits of the category records: what a split by row lets through."""
    return sampling.leaks(table(spark, d, "category_records"), "image_path", "split")


SQL["fold_leaks"] = "SELECT image_path, count(DISTINCT coalesce(split, '')) AS n_parts FROM category_records GROUP BY 1 HAVING count(DISTINCT coalesce(split, '')) > 1"


def hashed_quarter(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hashed_share(table(spark, d, "events"), "event_id", 0.25).select("event_id", "value")


SQL["hashed_quarter"] = f"SELECT event_id, value FROM events WHERE {_DRAW.format('event_id')} < {int(0.25 * 16**7)}"


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return sampling.class_weights(table(spark, d, "category_records").where("category_3class IS NOT NULL"), "category_3class")


SQL["class_weights"] = "SELECT category_3class AS label, count(*) AS n, round((SELECT count(*) FROM category_records WHERE category_3class IS NOT NULL)::DOUBLE / ((SELECT count(DISTINCT category_3class) FROM category_records) * count(*)), 6) AS weight FROM category_records WHERE category_3class IS NOT NULL GROUP BY 1"


def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    return sampling.learning_fractions(table(spark, d, "fraud_manifest").where("image_path IS NOT NULL"), text.receipt_group(_C("image_path")), [0.25, 0.5, 0.75, 1.0], 3)


SQL["learning_curve"] = f"""
WITH g AS (SELECT {_GRP} AS g, count(*) AS c FROM fraud_manifest WHERE image_path IS NOT NULL GROUP BY 1), x AS (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS fraction), r AS (SELECT unnest([0, 1, 2])::INTEGER AS rep)
SELECT fraction, rep, count(*) AS n_groups, CAST(sum(c) AS BIGINT) AS n_rows FROM g, x, r WHERE CAST(('0x' || substr(md5(g || ':' || CAST(rep AS VARCHAR)), 1, 7)) AS BIGINT) < floor(fraction * {16**7}) GROUP BY 1, 2"""


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two scores as average ranks by the number of rows, fused half and half."""
    s = _scored(spark, d)
    n = s.count()
    both = windows.average_rank(windows.average_rank(s, "s1", "r1"), "s2", "r2")
    return both.select("doc_id", F.round((_C("r1") / n + _C("r2") / n) / 2, 6).alias("fused"))


SQL["rank_fusion"] = f"SELECT doc_id, round((r1 / n + r2 / n) / 2, 6) AS fused FROM (SELECT doc_id, count(*) OVER () AS n, rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2.0::DOUBLE AS r1, rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2.0::DOUBLE AS r2 FROM ({_DOCS}))"


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    cols = ["row_id", *readers.MASTER]
    path = writers.csv_out(table(spark, d, "receipts_master"), writers.scratch(spark, "csv"), cols)
    return readers.csv_strings(spark, path, cols).select(*[F.coalesce(c, F.lit("")).alias(c) for c in cols])


SQL["csv_round_trip"] = "SELECT CAST(row_id AS VARCHAR) AS row_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in readers.MASTER) + " FROM receipts_master"


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "sroie_entities")
    path = writers.json_out(src, writers.scratch(spark, "json"))
    return spark.read.schema(src.schema).json(path)


SQL["json_round_trip"] = "SELECT * FROM sroie_entities"


def payload_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Base64 payloads decoded and told by their first bytes; every fifth isn't base64."""
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"RIFF\x00\x00\x00\x00WEBP", b"\x00\x00\x00\x18ftypheic"]
    body = F.element_at(F.array(*[F.lit(base64.b64encode(h + b"12345").decode()) for h in heads], F.lit("***")), (F.pmod("manifest_id", F.lit(5)) + 1).cast("int"))
    kind = readers.image_kind(readers.decoded_payload(F.concat(F.lit("data:image/x;base64,"), body)))
    return table(spark, d, "fraud_manifest").select("manifest_id", kind.alias("kind"))


SQL["payload_kinds"] = "SELECT manifest_id, CASE manifest_id % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'heic' END AS kind FROM fraud_manifest"


def menu_texts(spark: SparkSession, d: str) -> DataFrame:
    """Annotations in nested JSON read into master columns: made of the part table, one in seven without a menu list."""
    nm, cnt = _C("p_name"), _C("p_size").cast("string")
    menu = F.when(_C("p_partkey") % 7 == 0, F.lit('"none"')).otherwise(F.concat(F.lit('[{"nm":"'), nm, F.lit('","cnt":"'), cnt, F.lit('"},{"nm":"'), _C("p_brand"), F.lit('"}]')))
    doc = F.concat(F.lit('{"gt_parse":{"total":{},"sub_total":{"subtotal_price":"'), _C("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit('"},"menu":'), menu, F.lit('},"meta":{"image_id":"'), _C("p_partkey").cast("string"), F.lit('"}}'))
    return readers.annotation_rows(table(spark, d, "part").select(doc.alias("doc")), "doc").select("image_path", "total", "items_text")


SQL["menu_texts"] = "SELECT 'dataset/temp_cord/image/receipt_' || p_partkey || '.png' AS image_path, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS total, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || ' (' || p_size || '), ' || p_brand END AS items_text FROM part"


def merged_merchants(spark: SparkSession, d: str) -> DataFrame:
    """Merchants as an upsert keeps them: the early export rows merged with the late ones."""
    r = table(spark, d, "firestore_receipts").where("merchant IS NOT NULL").select("merchant", "category", "created_at", "export_id")
    return writers.merged(r.where("created_at < '2022-01-01'"), r.where("created_at >= '2022-01-01'"), ["merchant"], ["created_at", "export_id"]).select("merchant", "category", "export_id")


SQL["merged_merchants"] = "SELECT merchant, category, export_id FROM (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY created_at DESC, export_id DESC) AS k FROM firestore_receipts WHERE merchant IS NOT NULL) WHERE k = 1"


def new_users(spark: SparkSession, d: str) -> DataFrame:
    """Users of the documents that the export doesn't have yet, each once."""
    old = table(spark, d, "firestore_receipts").where("user_id IS NOT NULL").select("user_id").distinct()
    return writers.added(old, table(spark, d, "documents").where("user_id IS NOT NULL").select("user_id", "doc_id"), ["user_id"])


SQL["new_users"] = "SELECT user_id, min(doc_id) AS doc_id FROM documents WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM firestore_receipts WHERE user_id IS NOT NULL) GROUP BY 1"


def repointed_paths(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "fraud_manifest").select("manifest_id", "image_path")
    look = m.where(F.lower("image_path").endswith(".pdf")).select(_C("image_path").alias("pdf"), F.regexp_replace("image_path", r"(?i)\.pdf$", ".jpg").alias("jpg"))
    return writers.repointed(m, look, "image_path", "pdf", "jpg")


SQL["repointed_paths"] = r"SELECT manifest_id, regexp_replace(image_path, '(?i)\.pdf$', '.jpg') AS image_path FROM fraud_manifest"


def derived_twice(spark: SparkSession, d: str) -> DataFrame:
    spend, fraud = text.split_category(_C("category"))
    cols = {"spend_category": spend, "fraud_label": fraud}
    return writers.derived_again(writers.derived_again(table(spark, d, "receipts_master"), cols), cols).select("row_id", "spend_category", "fraud_label")


SQL["derived_twice"] = "SELECT row_id, CASE WHEN lower(trim(coalesce(category, ''))) IN ('retail', 'restaurant') THEN lower(trim(coalesce(category, ''))) ELSE '' END AS spend_category, CASE WHEN lower(trim(coalesce(category, ''))) IN ('genuine', 'tampered', 'multi_bill', 'handwritten') THEN lower(trim(coalesce(category, ''))) ELSE '' END AS fraud_label FROM receipts_master"


def metrics_long(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.max("value"), 6).alias("max_value"))
    return writers.long_metrics(per, ["event_type"], ["mean_value", "max_value"])


SQL["metrics_long"] = "SELECT event_type, 'mean_value' AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'max_value', round(max(value), 6) FROM events GROUP BY 1"


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Three tables in one schema with their name, by column names, missing columns null."""
    a = table(spark, d, "sroie_entities").select(_C("entity_id").alias("id"), _C("company").alias("merchant"), "date", "total", F.lit("entities").alias("origin"))
    b = table(spark, d, "category_records").select(_C("rec_id").alias("id"), "merchant", "date", "total", F.lit("categories").alias("origin"))
    c = table(spark, d, "documents").select(_C("doc_id").alias("id"), F.lit("documents").alias("origin"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


SQL["union_sources"] = "SELECT entity_id AS id, company AS merchant, date, total, 'entities' AS origin FROM sroie_entities UNION ALL SELECT rec_id, merchant, date, total, 'categories' FROM category_records UNION ALL SELECT doc_id, NULL, NULL, NULL, 'documents' FROM documents"


def committed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of two tables each, one written twice; only whole batches are read."""
    root = writers.scratch(spark, "batches")
    o = table(spark, d, "orders")
    for i, part in enumerate([o.where("o_orderdate < '1998-01-01'"), o.where("o_orderdate >= '1998-01-01'")]):
        for _ in range(1 + (i == 0)):
            writers.batch_tables({"orders": part.select("o_orderkey", "o_totalprice"), "audit": part.select("o_orderkey")}, root, i)
    return writers.committed(spark, root, "orders").select("o_orderkey", "o_totalprice", _C("batch").cast("int").alias("batch"))


SQL["committed_batches"] = "SELECT o_orderkey, o_totalprice, CAST(o_orderdate >= TIMESTAMP '1998-01-01' AS INTEGER) AS batch FROM orders"


def latest_uploads(spark: SparkSession, d: str) -> DataFrame:
    return readers.latest(table(spark, d, "firestore_receipts").select("export_id", "user_id", "created_at"), "created_at", 300, "export_id").select("export_id", "user_id")


SQL["latest_uploads"] = "SELECT export_id, user_id FROM firestore_receipts ORDER BY created_at DESC, export_id LIMIT 300"


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    return readers.where_equal(readers.parquet_columns(spark, f"{d}/firestore_receipts.parquet", ["export_id", "user_id", "total"]), user_id="u00000001")


SQL["looked_up"] = "SELECT export_id, user_id, total FROM firestore_receipts WHERE user_id = 'u00000001'"


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return streams.source(spark, path, spark.read.parquet(path).schema)


def stream_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    """One event for each user and type, through the stream."""
    s = streams.without_repeats(_events(spark, d).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "60 days")
    return streams.run_once(s.select("user_id", "event_type"), "dedup")


SQL["stream_first_of_key"] = "SELECT DISTINCT user_id, event_type FROM events"


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    s = streams.windowed(_events(spark, d), "ts", "1 day", ["event_type"], "value")
    return streams.run_once(s, "daily", "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


SQL["stream_daily"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = streams.sessions(_events(spark, d), "ts", "6 hours", "user_id")
    return streams.run_once(s, "sessions", "complete").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


SQL["stream_sessions"] = """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"""


def stream_interest(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).select("event_id", "ts", "user_id", _C("event_type").alias("category"), _C("value").alias("amount"))
    return streams.run_once(streams.stateful(s, "user_id", streams.InterestFold(), "user_id long, category string, weight double"), "interest", "update")


SQL["stream_interest"] = """
WITH r AS (SELECT user_id, event_type AS category, pow(0.98::DOUBLE, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1) * ln(1 + greatest(value, 0.0::DOUBLE)) AS w FROM events)
SELECT user_id, category, round(sum(w), 4) AS weight FROM r GROUP BY 1, 2"""


def stream_medians(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).select("event_id", "ts", "user_id", _C("value").alias("amount"))
    got = streams.run_once(streams.stateful(s, "user_id", streams.MedianGate(), "event_id long, user_id long, n_before int, reference double"), "medians", "update")
    return got.select("event_id", "n_before", F.round("reference", 3).alias("reference"))


SQL["stream_medians"] = """
WITH w AS (SELECT event_id, count(*) OVER p AS n, median(value) OVER p AS m FROM events WHERE value > 0 WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
SELECT event_id, CAST(n AS INTEGER) AS n_before, round(CASE WHEN n >= 5 THEN m ELSE 2748.0::DOUBLE END, 3) AS reference FROM w"""


def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events give points, errors claim a title once if the balance allows; each verdict depends on those before."""
    s = _events(spark, d).select("event_id", "ts", "user_id", F.when(_C("event_type") == "error", -20).otherwise(F.floor(_C("value") / 10)).cast("long").alias("points"), F.concat(F.lit("t"), F.pmod("event_id", F.lit(7)).cast("string")).alias("title"))
    return streams.run_once(streams.stateful(s, "user_id", streams.Ledger(), "event_id long, user_id long, accepted boolean, balance long"), "ledger", "update")


SQL["stream_ledger"] = """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN -20 ELSE CAST(floor(value / 10) AS BIGINT) END AS p, 't' || (event_id % 7) AS t, ts FROM events),
l AS (SELECT user_id, list({'e': event_id, 'p': p, 't': t} ORDER BY ts, event_id) AS es FROM e GROUP BY 1),
f AS (SELECT user_id, list_reduce(list_transform(es, lambda x: {'b': 0::BIGINT, 'made': []::VARCHAR[], 'done': [{'e': x.e, 'p': x.p::BIGINT, 't': x.t, 'ok': false, 'b': 0::BIGINT}]}),
 lambda s, x: {'b': CASE WHEN x.done[1].p >= 0 OR s.b + x.done[1].p >= 0 AND NOT list_contains(s.made, x.done[1].t) THEN s.b + x.done[1].p ELSE s.b END,
  'made': CASE WHEN x.done[1].p < 0 AND s.b + x.done[1].p >= 0 AND NOT list_contains(s.made, x.done[1].t) THEN list_append(s.made, x.done[1].t) ELSE s.made END,
  'done': list_append(s.done, {'e': x.done[1].e, 'p': x.done[1].p, 't': x.done[1].t, 'ok': x.done[1].p >= 0 OR s.b + x.done[1].p >= 0 AND NOT list_contains(s.made, x.done[1].t),
   'b': CASE WHEN x.done[1].p >= 0 OR s.b + x.done[1].p >= 0 AND NOT list_contains(s.made, x.done[1].t) THEN s.b + x.done[1].p ELSE s.b END})},
 {'b': 0::BIGINT, 'made': []::VARCHAR[], 'done': []::STRUCT(e BIGINT, p BIGINT, t VARCHAR, ok BOOLEAN, b BIGINT)[]}) AS r FROM l)
SELECT u.e AS event_id, user_id, u.ok AS accepted, u.b AS balance FROM (SELECT user_id, unnest(r.done) AS u FROM f)"""


def stream_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """What a stream of uploads leaves behind: accepted ones, rejected ones, and profiles summed over batches."""
    root = writers.scratch(spark, "pipeline")
    path = f"{d}/firestore_receipts.parquet"
    s = streams.source(spark, path, spark.read.parquet(path).schema, "created_at").select(_C("export_id").alias("upload_id"), "user_id", "merchant", "total", _C("created_at").alias("ts"), "category")
    streams.pipeline(s, root, ["user_id", "category"], "9000 days")
    up = writers.committed(spark, root, "uploads")
    rejected = writers.committed(spark, root, "rejected").count()
    profiles = writers.committed(spark, root, "profiles").groupBy("user_id").agg(F.sum("n").alias("n_profile"))
    per = up.groupBy("user_id").agg(F.count("*").alias("n_accepted"))
    return per.join(profiles, "user_id").select("user_id", "n_accepted", "n_profile", F.lit(rejected).cast("bigint").alias("n_rejected"))


SQL["stream_pipeline"] = """WITH b AS (SELECT *, user_id IS NULL OR coalesce(trim(merchant), '') = '' OR coalesce(total <= 0, true) AS bad FROM firestore_receipts),
g AS (SELECT user_id, count(DISTINCT coalesce(category, '?')) AS n FROM b WHERE NOT bad GROUP BY 1) SELECT user_id, n AS n_accepted, n AS n_profile, (SELECT count(*) FROM b WHERE bad) AS n_rejected FROM g"""


def text_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Category of the records outside train, by a model of those in train."""
    rows = table(spark, d, "category_records").where("category_3class IS NOT NULL AND length(trim(text)) > 0").select("rec_id", "text", "category_3class", "split")
    model = learning.classifier(rows.where("split = 'train'"), "text", "category_3class")
    return learning.classified(model, rows.where("split <> 'train'"), "rec_id")


def isolated_receipts(spark: SparkSession, d: str) -> DataFrame:
    """How fast each receipt's log ratio and points are isolated from the others."""
    rows = windows.trailing_median(_receipts(spark, d), "user_id", ["created_at", "export_id"], "total", default=100.0)
    rows = rows.select("export_id", windows.log_ratio(_C("total"), _C("reference")).alias("ratio"), _C("points").cast("double").alias("p"))
    return learning.isolation_scores(rows, "export_id", ["ratio", "p"], learning.isolation_forest(rows, ["ratio", "p"], trees=100))


def factor_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Ratings estimated from biases and factors for every pair of user and part type seen."""
    r = table(spark, d, "orders").join(table(spark, d, "lineitem"), _C("o_orderkey") == _C("l_orderkey")).groupBy(_C("o_custkey").cast("int").alias("u"), _C("l_partkey").cast("int").alias("i")).agg(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.round(F.avg("l_quantity") / 10, 0))).alias("r"))
    return learning.estimate(r, "u", "i", learning.biased_factors(r, "u", "i", "r"))


def factor_folds(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the factor model on five folds, each estimated from the other four."""
    r = table(spark, d, "firestore_receipts").where("user_id IS NOT NULL AND merchant IS NOT NULL AND total IS NOT NULL")
    r = r.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(2**31 - 1)).cast("int").alias("u"), F.pmod(F.xxhash64("merchant"), F.lit(2**31 - 1)).cast("int").alias("i")).agg(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.round(F.log1p(F.avg("total")), 0))).alias("r"))
    return learning.cross_validated(r, "u", "i", "r", 5, 5)


def classifier_choice(spark: SparkSession, d: str) -> DataFrame:
    """Three kinds of model by their macro F1 on the validation records, best first."""
    rows = table(spark, d, "category_records").where("category_3class IS NOT NULL AND length(trim(text)) > 0").select("rec_id", "text", "category_3class", "split")
    rows = cut(sampling.unique_keys(rows, "rec_id").where("split IN ('train', 'val')"), "records")
    _, _, scores = learning.selected(rows.where("split = 'train'"), rows.where("split = 'val'"), "text", "category_3class", "rec_id", trees=20)
    drop_table(rows)
    return spark.createDataFrame([(k, round(float(f), 6)) for k, f in scores], "model string, macro_f1 double")


def _features(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL AND doc_type IS NOT NULL")
    lines = F.size(F.split("text", "\n")).cast("double")
    digits = F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double")
    return docs.select("doc_id", (_C("doc_type") == "receipt").cast("int").alias("y"), F.length("text").cast("double").alias("chars"), lines.alias("lines"), digits.alias("digits"), F.pmod("doc_id", F.lit(4)).alias("part"))


def stacked_scores(spark: SparkSession, d: str) -> DataFrame:
    """Three scores stacked by a logistic model: its AUC on the documents it wasn't fitted on."""
    f = _features(spark, d)
    test = f.where("part = 0")
    got = learning.stacked(f.where("part <> 0"), test, "doc_id", ["chars", "lines", "digits"], "y")
    return evaluation.roc_auc(got.join(test, "doc_id"), "y", "fused")


def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """What boosted trees lose when the values of one feature go to other documents; the ten most important."""
    f = _features(spark, d)
    model = learning.boosted(f.where("part <> 0"), ["chars", "lines", "digits"], "y", 10)
    top = learning.importance(model, f.where("part = 0"), "doc_id", ["chars", "lines", "digits"], "y")[:10]
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in top], "feature string, loss double")


def image_features(spark: SparkSession, d: str) -> DataFrame:
    """Hash and features of images: each embedding drawn as an 8 by 8 pattern of 64 by 64 gray pixels."""

    def draw(parts):
        for pdf in parts:
            out = []
            for k, e in zip(pdf["vec_id"], pdf["embedding"]):
                v = np.asarray(e, dtype=float)[:64]
                g = np.kron(((v - v.min()) / (np.ptp(v) + 1e-9) * 255).reshape(8, 8), np.ones((8, 8))).astype(np.uint8)
                out.append((str(k), 64, 64, 1, g.tobytes()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "channels", "pixels"])

    px = table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(draw, "path string, width int, height int, channels int, pixels binary")
    f = images.features(px)
    return f.select("path", "phash", F.round(F.col("features")["sharpness"], 3).alias("sharpness"), F.round(F.col("features")["copy_share"], 4).alias("copy_share"), F.size("features").alias("n_features"))


ALL = [
    auc_by_source, roc_curve, best_cut, class_confusion, class_report, class_overall, confidence_bins, operating_points, rank_correlation, price_errors, ranking_quality, injected_outliers, score_bootstrap, stratified_split,
    grouped_folds, fold_leaks, hashed_quarter, class_weights, learning_curve, rank_fusion, csv_round_trip, json_round_trip, payload_kinds, menu_texts, merged_merchants, new_users, repointed_paths, derived_twice, metrics_long,
    union_sources, committed_batches, latest_uploads, looked_up, stream_first_of_key, stream_daily, stream_sessions, stream_interest, stream_medians, stream_ledger, stream_pipeline, text_classifier, classifier_choice, factor_folds, stacked_scores, feature_importance, isolated_receipts, factor_estimates, image_features,
]


def queries():
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
