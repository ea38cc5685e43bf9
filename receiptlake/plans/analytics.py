"""Queries of aggregation, profiling, duplicates and ordered computations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, money, text
from ..operators import dedup, profiling, windows
from ..session import table

SQL: dict[str, str] = {}
_C = F.col
_OWN = "SELECT export_id, user_id, coalesce(nullif(trim(category), ''), 'General') AS category, coalesce(nullif(trim(merchant), ''), 'Unknown') AS merchant, coalesce(total, 0.0::DOUBLE) AS total, coalesce(points_earned, 0) AS points, created_at, date FROM firestore_receipts WHERE user_id IS NOT NULL"


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    """The export with missing values filled; rows without user belong to nobody."""
    filled = lambda c, v: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v)).alias(c)
    return table(spark, d, "firestore_receipts").where("user_id IS NOT NULL").select("export_id", "user_id", filled("category", "General"), filled("merchant", "Unknown"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("points_earned", F.lit(0)).alias("points"), "created_at", "date")


def user_analytics(spark: SparkSession, d: str) -> DataFrame:
    """Per user: receipts, spend, points, rounded mean, top category with its share. One shuffle by user and category, one by user."""
    r = _receipts(spark, d)
    per = r.groupBy("user_id", "category").agg(F.count("*").alias("n"), F.sum("total").alias("s"), F.sum("points").alias("p"), F.min("export_id").alias("seen"))
    u = per.groupBy("user_id").agg(F.sum("n").alias("n_receipts"), F.round(F.sum("s"), 2).alias("total_spend"), F.sum("p").cast("bigint").alias("points"), F.max_by(F.struct("category", "s"), F.struct(F.round("s", 4), -_C("seen"))).alias("top"))
    avg = money.half_up(_C("total_spend") / _C("n_receipts")).cast("bigint")
    share = F.when(_C("total_spend") > 0, money.half_up(F.round("top.s", 2) * 100 / _C("total_spend"))).otherwise(0).cast("bigint")
    return u.select("user_id", "n_receipts", "total_spend", "points", avg.alias("avg_spend"), _C("top.category").alias("top_category"), share.alias("top_share_pct"))


SQL["user_analytics"] = f"""
WITH r AS ({_OWN}), per AS (SELECT user_id, category, count(*) AS n, sum(total) AS s, sum(points) AS p, min(export_id) AS seen FROM r GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 4) DESC, seen) AS k FROM per),
u AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n_receipts, round(sum(s), 2) AS total_spend, CAST(sum(p) AS BIGINT) AS points, max(CASE WHEN k = 1 THEN category END) AS top_category, max(CASE WHEN k = 1 THEN round(s, 2) END) AS top_s FROM t GROUP BY 1)
SELECT user_id, n_receipts, total_spend, points, CAST(floor(total_spend / n_receipts + 0.5) AS BIGINT) AS avg_spend, top_category, CAST(CASE WHEN total_spend > 0 THEN floor(top_s * 100 / total_spend + 0.5) ELSE 0 END AS BIGINT) AS top_share_pct FROM u"""


def category_share(spark: SparkSession, d: str) -> DataFrame:
    return profiling.share_of_total(_receipts(spark, d), ["user_id", "category"], ["user_id"], _C("total"))


SQL["category_share"] = f"""
WITH s AS (SELECT user_id, category, round(sum(total), 2) AS amount FROM ({_OWN}) GROUP BY 1, 2)
SELECT user_id, category, amount, CAST(floor(CASE WHEN w <> 0 THEN amount * 100 / w ELSE 0 END + 0.5) AS BIGINT) AS share_pct FROM (SELECT *, sum(amount) OVER (PARTITION BY user_id) AS w FROM s)"""


def other_bucket(spark: SparkSession, d: str) -> DataFrame:
    sums = _receipts(spark, d).groupBy("user_id", "merchant").agg(F.round(F.sum("total"), 2).alias("amount"))
    return windows.fold_tail(sums, ["user_id"], "merchant", "amount").withColumnRenamed("choice", "merchant")


SQL["other_bucket"] = f"""
WITH s AS (SELECT user_id, merchant, round(sum(total), 2) AS amount FROM ({_OWN}) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, merchant) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT user_id, CASE WHEN n > 5 AND r > 4 THEN 'Other' ELSE merchant END AS merchant, round(sum(amount), 2) AS amount FROM k GROUP BY 1, 2"""


def top_category(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_one(_receipts(spark, d), ["merchant"], _C("total"), "export_id", "category").select("merchant", "top", "top_sum")


SQL["top_category"] = f"""
WITH s AS (SELECT merchant, category, sum(total) AS s, min(export_id) AS seen FROM ({_OWN}) GROUP BY 1, 2)
SELECT merchant, category AS top, round(s, 2) AS top_sum FROM (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY round(s, 6) DESC, seen) AS k FROM s) WHERE k = 1"""


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return profiling.value_counts(table(spark, d, "fraud_manifest"), "label")


SQL["label_counts"] = "SELECT label AS value, count(*) AS n FROM fraud_manifest GROUP BY 1"
_SOURCES = ["CORD", "SROIE", "indian_folders", "app_upload_uk", "app_upload_us", "app_upload_au", "partner_csv"]


def category_by_source(spark: SparkSession, d: str) -> DataFrame:
    return profiling.crosstab(table(spark, d, "receipts_master"), "category", "source", _SOURCES)


SQL["category_by_source"] = "SELECT category AS row_value, " + ", ".join(f"count(*) FILTER (WHERE source = '{s}') AS n_{i}_{s}" for i, s in enumerate(_SOURCES)) + ", count(*) AS n_all FROM receipts_master GROUP BY 1"
_COLS = ["merchant", "date", "total", "category", "items_text"]


def missing_rates(spark: SparkSession, d: str) -> DataFrame:
    return profiling.missing_rates(table(spark, d, "receipts_master"), _COLS, {"merchant": ("UNKNOWN",)})


def _miss(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = ''" + (" OR upper(trim(merchant)) = 'UNKNOWN')" if c == "merchant" else ")")


SQL["missing_rates"] = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_miss(c)}) AS n_missing, round(count(*) FILTER (WHERE {_miss(c)}) * 100.0::DOUBLE / greatest(count(*), 1), 3) AS missing_pct FROM receipts_master" for c in _COLS)


def missing_by_source(spark: SparkSession, d: str) -> DataFrame:
    return profiling.missing_by_group(table(spark, d, "receipts_master"), "source", ["merchant", "date", "total"], {"merchant": ("UNKNOWN",)})


SQL["missing_by_source"] = "SELECT source AS grp, " + ", ".join(f"round(avg(CASE WHEN {_miss(c)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 3) AS {c}_missing_pct" for c in ("merchant", "date", "total")) + " FROM receipts_master GROUP BY 1"


def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return profiling.distinct_counts(table(spark, d, "category_records"), ["image_path", "merchant", "category", "split"])


SQL["distinct_counts"] = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM category_records" for c in ("image_path", "merchant", "category", "split"))


def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    return profiling.repeats(table(spark, d, "receipts_master"), ["image_path", "merchant", "date", "total", "items_text", "source"])


SQL["repeated_rows"] = "SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c - 1) AS BIGINT) AS n_repeats FROM (SELECT count(*) AS c FROM receipts_master GROUP BY image_path, merchant, date, total, items_text, source)"


def conflicting_labels(spark: SparkSession, d: str) -> DataFrame:
    return profiling.conflicting(table(spark, d, "fraud_manifest").withColumn("l", F.lower(F.trim("label"))), text.receipt_group(_C("image_path")), "l")


SQL["conflicting_labels"] = r"""
SELECT grp, count(*) AS n_values, string_agg(l, ',' ORDER BY l) AS value_list FROM (SELECT DISTINCT lower(trim(regexp_replace(regexp_replace(string_split(image_path, '/')[-1], '\.[^.]+$', ''), '_tampered(_v\d+)?$', ''))) AS grp, lower(trim(label)) AS l FROM fraud_manifest WHERE image_path IS NOT NULL AND label IS NOT NULL) GROUP BY 1 HAVING count(*) > 1"""


def readable_by_source(spark: SparkSession, d: str) -> DataFrame:
    t = money.repaired_total(_C("total"), _C("source"))
    return profiling.conditional_counts(table(spark, d, "receipts_master"), "source", {"n_read": t.isNotNull(), "n_unread": t.isNull(), "n_dated": F.length(F.trim("date")) > 0})


SQL["readable_by_source"] = r"""
WITH p AS (SELECT *, rtrim(list_extract(regexp_extract_all(coalesce(total, ''), '(\d[\d.,]*)', 1), -1), '.,') AS token FROM receipts_master),
q AS (SELECT *, CASE WHEN source = 'CORD' THEN try_cast(regexp_replace(token, '[.,]', '', 'g') AS DOUBLE) ELSE try_cast(replace(token, ',', '') AS DOUBLE) END AS v FROM p)
SELECT source, count(*) AS n_rows, count(v) AS n_read, count(*) - count(v) AS n_unread, count(*) FILTER (WHERE length(trim(date)) > 0) AS n_dated FROM q GROUP BY 1"""


def spend_moments(spark: SparkSession, d: str) -> DataFrame:
    return profiling.moments(_receipts(spark, d).where("total > 0"), "category", _C("total"))


_PCT = ", ".join(f"round(quantile_cont(total, {p / 100}), 6) AS " + f"p{p:g}".replace(".", "_") for p in profiling.PERCENTILES)
SQL["spend_moments"] = f"""
SELECT category AS grp, count(total) AS n, round(avg(total), 6) AS mean, round(stddev_samp(total), 4) AS sd, round(1.96::DOUBLE * stddev_samp(total) / sqrt(count(total)::DOUBLE), 4) AS ci95, round(kurtosis_pop(total) + 3, 4) AS kurtosis,
  round(max(total) - min(total), 4) AS "range", round(max(total) / (median(total) + 1e-6::DOUBLE), 4) AS max_by_median, {_PCT} FROM ({_OWN}) WHERE total > 0 GROUP BY 1"""


#: Share of the events from which on a bin is named here, where values are spread evenly.
DOMINANT = 0.028


def dominant_bins(spark: SparkSession, d: str) -> DataFrame:
    return profiling.dominant_bins(table(spark, d, "events"), _C("value"), 0.0, 180.0, 36, DOMINANT)


SQL["dominant_bins"] = f"""WITH h AS (SELECT CAST(floor(value / 5.0::DOUBLE) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 180 GROUP BY 1)
SELECT bin, n, round(n::DOUBLE / (SELECT sum(n) FROM h), 6) AS share FROM h WHERE n > {DOMINANT}::DOUBLE * (SELECT sum(n) FROM h)"""


def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profiling.histogram(table(spark, d, "events"), _C("value"), 0.0, 180.0, 36)


SQL["value_histogram"] = "SELECT CAST(floor(value / 5.0::DOUBLE) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 180 GROUP BY 1"


def median_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _receipts(spark, d).where("total > 0").groupBy("user_id", "category").agg(F.round(F.median("total"), 6).alias("median_total"), F.round(F.avg("total"), 6).alias("mean_total"))


SQL["median_by_category"] = f"SELECT user_id, category, round(median(total), 6) AS median_total, round(avg(total), 6) AS mean_total FROM ({_OWN}) WHERE total > 0 GROUP BY 1, 2"


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    keys = {"merchant_words": text.merchant_words(F.coalesce("merchant", F.lit(""))), "day": F.trim(F.coalesce("date", F.lit(""))), "amount": money.normal_total(_C("total")).cast("string")}
    return dedup.exact_groups(table(spark, d, "receipts_master"), keys, "row_id")


SQL["exact_duplicates"] = r"""
SELECT trim(regexp_replace(lower(coalesce(merchant, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS merchant_words, trim(coalesce(date, '')) AS day, CAST(CAST(round_even(coalesce(try_cast(trim(total) AS DECIMAL(28,8)), 0), 2) AS DECIMAL(18,2)) AS VARCHAR) AS amount,
  count(*) AS n_rows, min(row_id) AS first_member, max(row_id) AS last_member FROM receipts_master GROUP BY 1, 2, 3 HAVING count(*) > 1"""


def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "firestore_receipts").select("export_id", "user_id", "merchant", "total", "date", "created_at")
    return dedup.keep_first(rows, ["user_id", "merchant", "total", "date"], [_C("created_at"), _C("export_id")]).select("export_id", "user_id", "total")


SQL["first_of_each"] = "SELECT export_id, user_id, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, merchant, total, date ORDER BY created_at, export_id) AS k FROM firestore_receipts) WHERE k = 1"


def seen_before(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the master table whose merchant, date and total are also those of an entity file."""
    probes = table(spark, d, "sroie_entities").select(F.col("company").alias("merchant"), "date", "total")
    return dedup.probe(table(spark, d, "receipts_master").select("row_id", "merchant", "date", "total"), probes, ["merchant", "date", "total"]).select("row_id")


SQL["seen_before"] = "SELECT row_id FROM receipts_master r WHERE EXISTS (SELECT 1 FROM sroie_entities s WHERE s.company = r.merchant AND s.date = r.date AND s.total = r.total)"


def fuzzy_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "firestore_receipts").where("user_id IS NOT NULL AND category IS NOT NULL")
    return dedup.fuzzy_pairs(rows, "export_id", ["user_id", "category"], "total", text.merchant_key(_C("merchant")), text.name_similarity)


_KEY = "trim(regexp_replace(regexp_replace(lower(merchant), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
SQL["fuzzy_duplicates"] = f"""
WITH r AS (SELECT export_id, user_id, category, total, {_KEY} AS m FROM firestore_receipts WHERE user_id IS NOT NULL AND category IS NOT NULL AND total IS NOT NULL AND merchant IS NOT NULL),
p AS (SELECT x.export_id AS a, y.export_id AS b, x.m AS ma, y.m AS mb, list_filter(string_split(x.m, ' '), lambda z: z <> '') AS wa, list_filter(string_split(y.m, ' '), lambda z: z <> '') AS wb FROM r x JOIN r y ON x.user_id = y.user_id AND x.category = y.category AND x.export_id < y.export_id AND abs(x.total - y.total) <= 2.0::DOUBLE),
j AS (SELECT a, b, ma, mb, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(list_intersect(wa, wb)))::DOUBLE / len(list_distinct(list_concat(wa, wb))) END AS o FROM p),
s AS (SELECT a, b, round(CASE WHEN ma = '' OR mb = '' THEN 0.0::DOUBLE WHEN ma = mb THEN 1.0::DOUBLE ELSE greatest(1 - levenshtein(ma, mb)::DOUBLE / greatest(length(ma), length(mb)), o) END, 6) AS score FROM j)
SELECT a, b, score FROM s WHERE score >= 0.84::DOUBLE"""


def claimed_by_others(spark: SparkSession, d: str) -> DataFrame:
    fp = F.concat_ws("|", F.coalesce("category", F.lit("")), F.coalesce("date", F.lit("")))
    return dedup.first_claims(table(spark, d, "firestore_receipts"), "export_id", "user_id", fp, "created_at")


SQL["claimed_by_others"] = """
WITH r AS (SELECT export_id, user_id, coalesce(category, '') || '|' || coalesce(date, '') AS fp, created_at FROM firestore_receipts WHERE user_id IS NOT NULL),
f AS (SELECT *, first_value(export_id) OVER w AS fk, first_value(user_id) OVER w AS fo FROM r WINDOW w AS (PARTITION BY fp ORDER BY created_at, export_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT export_id, fk AS first_key, fo AS first_owner FROM f WHERE fo <> user_id"""
_BITS = "SELECT vec_id, (SELECT bit_or(CASE WHEN e > m THEN (CASE WHEN i = 64 THEN (-9223372036854775807 - 1)::BIGINT ELSE (1::BIGINT << (i - 1)::INTEGER) END) ELSE 0::BIGINT END) FROM (SELECT unnest(embedding) AS e, unnest(range(1, 65)) AS i, list_aggregate(list_transform(embedding, lambda q: q::DOUBLE), 'median') AS m)) AS h FROM embeddings"


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", hashing.median_bits(_C("embedding")).alias("h"))


def near_hashes(spark: SparkSession, d: str) -> DataFrame:
    return dedup.hash_pairs(_hashes(spark, d), "vec_id", _C("h"), 16)


SQL["near_hashes"] = f"WITH h AS MATERIALIZED ({_BITS}) SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.h, y.h)) <= 16"


def near_hash_links(spark: SparkSession, d: str) -> DataFrame:
    """How many others are near each hash: the form of near_hashes that stays linear where many are copies."""
    return dedup.hash_links(_hashes(spark, d), "vec_id", _C("h"), 18)


SQL["near_hash_links"] = f"WITH h AS MATERIALIZED ({_BITS}) SELECT x.vec_id, count(*) AS n_near FROM h x JOIN h y ON x.vec_id <> y.vec_id WHERE bit_count(xor(x.h, y.h)) <= 18 GROUP BY 1"


def near_hashes_recent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", hashing.median_bits(_C("embedding")).alias("h"))
    return dedup.hash_pairs_recent(rows, "vec_id", _C("h"), _C("label").cast("bigint"), "vec_id", 24, 300)


SQL["near_hashes_recent"] = f"""WITH h AS MATERIALIZED (SELECT e.vec_id, e.label, b.h FROM embeddings e JOIN ({_BITS}) b ON e.vec_id = b.vec_id)
SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM h x JOIN h y ON x.vec_id - y.vec_id BETWEEN 1 AND 300 AND abs(x.label - y.label) <= 1 WHERE bit_count(xor(x.h, y.h)) <= 24"""


def nearest_reference(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    return dedup.nearest(h, h.where("vec_id % 20 = 0"), "vec_id", _C("h"))


SQL["nearest_reference"] = f"""WITH h AS MATERIALIZED ({_BITS}), p AS (SELECT x.vec_id, y.vec_id AS ref, bit_count(xor(x.h, y.h)) AS dist FROM h x JOIN h y ON y.vec_id % 20 = 0 AND x.vec_id <> y.vec_id)
SELECT vec_id, ref, round(1 - dist / 64.0::DOUBLE, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, ref) AS k FROM p) WHERE k = 1"""


def resolved_images(spark: SparkSession, d: str) -> DataFrame:
    """Category records matched to master rows by path, else by file name, else by the number in it."""
    name = text.path_parts(_C("image_path"))["name"]
    number = F.regexp_extract(name, r"(\d{6,})", 1)
    return dedup.in_tiers(table(spark, d, "category_records"), table(spark, d, "receipts_master"), [(_C("image_path"), _C("image_path")), (F.lower(name), F.lower(name)), (number, number)], "rec_id", "row_id")


def _tier(e: str, i: int) -> str:
    return f"SELECT a.rec_id, min(b.row_id) AS row_id, {i} AS tier FROM (SELECT rec_id, {e} AS j FROM category_records) a JOIN (SELECT {e} AS j, min(row_id) AS row_id FROM receipts_master GROUP BY 1) b ON a.j = b.j AND a.j <> '' GROUP BY 1"


_NAME = "string_split(image_path, '/')[-1]"
SQL["resolved_images"] = "SELECT rec_id, row_id, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY tier, row_id) AS k FROM (" + " UNION ALL ".join([_tier("image_path", 1), _tier(f"lower({_NAME})", 2), _tier(rf"regexp_extract({_NAME}, '(\d{{6,}})', 1)", 3)]) + ")) WHERE k = 1"


def unresolved_images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "category_records").join(table(spark, d, "receipts_master").select("image_path").where("image_path IS NOT NULL"), "image_path", "left_anti").select("rec_id", "image_path")


SQL["unresolved_images"] = "SELECT rec_id, image_path FROM category_records c WHERE NOT EXISTS (SELECT 1 FROM receipts_master r WHERE r.image_path = c.image_path)"


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its lines packed in one text, orders without lines included."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))
    return table(spark, d, "orders").join(lines, _C("o_orderkey") == _C("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("parts", F.lit("")).alias("parts"))


SQL["order_lines"] = "SELECT o_orderkey, coalesce(n, 0) AS n_lines, coalesce(parts, '') AS parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"


def spend_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Receipts ten times over the median of the user's last fifty, with their log ratio."""
    rows = windows.trailing_median(_receipts(spark, d), "user_id", ["created_at", "export_id"], "total", default=100.0)
    return rows.select("export_id", "user_id", "n_before", F.round("reference", 6).alias("reference"), F.round(windows.log_ratio(_C("total"), _C("reference")), 6).alias("log_ratio"), (_C("total") > 10 * _C("reference")).alias("is_anomaly"))


SQL["spend_anomalies"] = f"""
WITH r AS (SELECT * FROM ({_OWN}) WHERE total > 0), w AS (SELECT *, count(total) OVER p AS n_before, median(total) OVER p AS m FROM r WINDOW p AS (PARTITION BY user_id ORDER BY created_at, export_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN n_before >= 5 THEN m ELSE 100.0::DOUBLE END AS ref FROM w)
SELECT export_id, user_id, n_before, round(ref, 6) AS reference, round(ln(1 + greatest(total, 0.0::DOUBLE)) - ln(1 + greatest(ref, 1e-9::DOUBLE)), 6) AS log_ratio, total > 10 * ref AS is_anomaly FROM x"""


def interest_vectors(spark: SparkSession, d: str) -> DataFrame:
    return windows.decayed_interest(_receipts(spark, d), "user_id", "category", [_C("created_at"), _C("export_id")], "total")


SQL["interest_vectors"] = f"""
WITH r AS (SELECT user_id, category, pow(0.98::DOUBLE, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, export_id DESC) - 1) * ln(1 + greatest(total, 0.0::DOUBLE)) AS w FROM ({_OWN})),
s AS (SELECT user_id, category, sum(w) AS weight FROM r GROUP BY 1, 2)
SELECT user_id, category, round(weight, 4) AS weight, round(CASE WHEN t > 0 THEN weight / t ELSE 0.0::DOUBLE END, 4) AS share FROM (SELECT *, sum(weight) OVER (PARTITION BY user_id) AS t FROM s)"""


def recent_merchants(spark: SparkSession, d: str) -> DataFrame:
    return windows.recent_values(table(spark, d, "firestore_receipts").where("user_id IS NOT NULL"), "user_id", "merchant", [_C("created_at"), _C("export_id")])


SQL["recent_merchants"] = "SELECT user_id, string_agg(substr(merchant, 1, 80), '|' ORDER BY k DESC) AS recent FROM (SELECT user_id, merchant, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, export_id DESC) AS k FROM firestore_receipts WHERE user_id IS NOT NULL AND length(merchant) > 0) WHERE k <= 10 GROUP BY 1"


def latest_users(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest_users(table(spark, d, "firestore_receipts").where("user_id IS NOT NULL"), "user_id", "created_at", 50).select("user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


SQL["latest_users"] = "SELECT user_id, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM firestore_receipts WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY max(created_at) DESC, user_id LIMIT 50"


def value_ranks(spark: SparkSession, d: str) -> DataFrame:
    return windows.average_rank(table(spark, d, "events").select("event_id", "event_type", "value"), "value", "r", ["event_type"]).select("event_id", F.round("r", 1).alias("avg_rank"))


SQL["value_ranks"] = "SELECT event_id, round(rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE, 1) AS avg_rank FROM events WHERE value IS NOT NULL"


def value_jumps(spark: SparkSession, d: str) -> DataFrame:
    return windows.jumps(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 100.0)


SQL["value_jumps"] = "SELECT user_id, count(*) FILTER (WHERE d > 100) AS n_jumps FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) GROUP BY 1"


def dealt_modes(spark: SparkSession, d: str) -> DataFrame:
    return windows.dealt(table(spark, d, "fraud_manifest").select("manifest_id", "labelled_by"), ["labelled_by"], ["manifest_id"], 4).select("manifest_id", "mode")


SQL["dealt_modes"] = "SELECT manifest_id, CAST((row_number() OVER (PARTITION BY labelled_by ORDER BY manifest_id) - 1) % 4 AS INTEGER) AS mode FROM fraud_manifest"


def stop_points(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy("event_type", F.dayofyear("ts").alias("step")).agg(F.round(F.avg("value"), 6).alias("score"))
    return windows.stop_points(daily, "event_type", "step", "score", 5)


SQL["stop_points"] = """
WITH s AS (SELECT event_type, dayofyear(ts) AS step, round(avg(value), 6) AS score FROM events GROUP BY 1, 2),
b AS (SELECT *, max(score) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
m AS (SELECT *, max(CASE WHEN before IS NULL OR score > before THEN step END) OVER (PARTITION BY event_type ORDER BY step) AS best_step FROM b),
e AS (SELECT event_type, coalesce(min(CASE WHEN step - best_step >= 5 THEN step END), max(step)) AS stop_step FROM m GROUP BY 1)
SELECT e.event_type, CAST(m.best_step AS INTEGER) AS best_step, CAST(e.stop_step AS INTEGER) AS stop_step FROM e JOIN m ON e.event_type = m.event_type AND e.stop_step = m.step"""


def running_balances(spark: SparkSession, d: str) -> DataFrame:
    return windows.balances(_receipts(spark, d), "user_id", ["created_at", "export_id"], "points").select("export_id", "balance")


SQL["running_balances"] = f"SELECT export_id, CAST(sum(points) OVER (PARTITION BY user_id ORDER BY created_at, export_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance FROM ({_OWN})"


def upload_order(spark: SparkSession, d: str) -> DataFrame:
    return dedup.running_first(table(spark, d, "firestore_receipts").select("export_id", "merchant", "created_at"), ["merchant"], [_C("created_at"), _C("export_id")]).select("export_id", "nth")


SQL["upload_order"] = "SELECT export_id, CAST(row_number() OVER (PARTITION BY merchant ORDER BY created_at, export_id) AS INTEGER) AS nth FROM firestore_receipts"

ALL = [
    user_analytics, category_share, other_bucket, top_category, label_counts, category_by_source, missing_rates, missing_by_source, distinct_counts, repeated_rows, conflicting_labels, readable_by_source,
    spend_moments, value_histogram, dominant_bins, median_by_category, exact_duplicates, first_of_each, seen_before, fuzzy_duplicates, claimed_by_others, near_hashes, near_hash_links, near_hashes_recent, nearest_reference, resolved_images,
    unresolved_images, order_lines, spend_anomalies, interest_vectors, recent_merchants, latest_users, value_ranks, value_jumps, dealt_modes, stop_points, running_balances, upload_order,
]


def queries():
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
