"""Queries of scalar functions, projections and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..session import table

SQL: dict[str, str] = {}
_C = F.col


def text_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    m = _C("merchant")
    return table(spark, d, "receipts_master").select("row_id", text.merchant_key(m).alias("merchant_key"), text.merchant_words(m).alias("merchant_words"), text.clean_text(m).alias("clean"), text.document_id(m).alias("doc_key"))


SQL["text_normal_forms"] = r"""
SELECT row_id,
  trim(regexp_replace(regexp_replace(lower(merchant), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS merchant_key,
  trim(regexp_replace(lower(merchant), '[^\p{L}\p{N}]+', ' ', 'g')) AS merchant_words,
  trim(regexp_replace(merchant, '\s+', ' ', 'g')) AS clean,
  CASE WHEN NOT regexp_matches(substr(regexp_replace(merchant, '[^a-zA-Z0-9]', '_', 'g'), 1, 100), '[a-zA-Z0-9]')
         OR regexp_matches(substr(regexp_replace(merchant, '[^a-zA-Z0-9]', '_', 'g'), 1, 100), '^__.*__$')
       THEN 'm_' || substr(sha256(merchant), 1, 16)
       ELSE substr(regexp_replace(merchant, '[^a-zA-Z0-9]', '_', 'g'), 1, 100) END AS doc_key
FROM receipts_master"""


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "firestore_receipts").select("export_id", text.fingerprint(_C("merchant"), _C("date"), _C("total")).alias("fingerprint"))


_FP = "sha256(lower(trim(coalesce(merchant, ''))) || '|' || trim(coalesce(date, '')) || '|' || CAST(coalesce(CAST(total AS DECIMAL(18,2)), 0.00) AS VARCHAR))"
SQL["fingerprints"] = f"SELECT export_id, {_FP} AS fingerprint FROM firestore_receipts"


def category_mappings(spark: SparkSession, d: str) -> DataFrame:
    c = _C("category")
    spend, fraud = text.split_category(c)
    return table(spark, d, "category_records").select("rec_id", text.spend_class(_C("text")).alias("spend_class"), text.category_family(c).alias("family"), text.category_code(c).alias("code"), spend.alias("spend"), fraud.alias("fraud"))


_T = "lower(trim(coalesce(category, '')))"
SQL["category_mappings"] = f"""
SELECT rec_id,
  CASE WHEN regexp_matches(' ' || lower(coalesce(text, '')) || ' ', '{"|".join(text.FOOD_WORDS)}') THEN 'Food & Beverage'
       WHEN regexp_matches(' ' || lower(coalesce(text, '')) || ' ', '{"|".join(text.GROCERY_WORDS)}') THEN 'Supermarket / Grocery' ELSE 'General Retail' END AS spend_class,
  CASE WHEN regexp_matches({_T}, 'grocery|supermarket') THEN 'grocery' WHEN regexp_matches({_T}, 'food|beverage|restaurant') THEN 'food' WHEN regexp_matches({_T}, 'retail|shopping') THEN 'retail' ELSE 'general' END AS family,
  CAST(CASE WHEN contains({_T}, 'grocery') THEN 0 WHEN contains({_T}, 'food') THEN 1 WHEN contains({_T}, 'retail') THEN 2 WHEN contains({_T}, 'restaurant') THEN 1 ELSE 3 END AS INTEGER) AS code,
  CASE WHEN {_T} IN ('retail', 'restaurant') THEN {_T} ELSE '' END AS spend,
  CASE WHEN {_T} IN ('genuine', 'tampered', 'multi_bill', 'handwritten') THEN {_T} ELSE '' END AS fraud
FROM category_records"""


def total_readings(spark: SparkSession, d: str) -> DataFrame:
    t = _C("total")
    return table(spark, d, "receipts_master").select("row_id", money.repaired_total(t, _C("source")).alias("repaired"), money.legacy_total(t).alias("legacy"), money.plain_number(t).alias("plain"), money.normal_total(t).cast("double").alias("normal"), money.cleaned_currency(t).alias("cleaned"))


SQL["total_readings"] = r"""
WITH p AS (SELECT *, rtrim(list_extract(regexp_extract_all(coalesce(total, ''), '(\d[\d.,]*)', 1), -1), '.,') AS token,
  replace(regexp_replace(coalesce(total, ''), '[^0-9.,]', '', 'g'), ',', '') AS kept FROM receipts_master),
q AS (SELECT *, string_split(kept, '.') AS parts FROM p)
SELECT row_id,
  CASE WHEN source = 'CORD' THEN try_cast(regexp_replace(token, '[.,]', '', 'g') AS DOUBLE) ELSE try_cast(replace(token, ',', '') AS DOUBLE) END AS repaired,
  coalesce(CAST(try_cast(CASE WHEN len(parts) > 2 THEN array_to_string(parts[1:len(parts)-1], '') || '.' || parts[len(parts)] ELSE kept END AS DECIMAL(18,2)) AS VARCHAR), '') AS legacy,
  try_cast(trim(total) AS DOUBLE) AS plain,
  CAST(round_even(coalesce(try_cast(trim(total) AS DECIMAL(28,8)), 0), 2) AS DOUBLE) AS normal,
  coalesce(try_cast(regexp_extract(regexp_replace(regexp_replace(total, '(?i)rs\.?|inr', '', 'g'), '[₹$€£,\s]', '', 'g'), '^([+-]?(?:\d+\.?\d*|\.\d+))', 1) AS DOUBLE), 0.0) AS cleaned
FROM q"""


def day_readings(spark: SparkSession, d: str) -> DataFrame:
    t = _C("date")
    day = dates.strict_day(t)
    dom, dow = dates.day_parts(day)
    return table(spark, d, "receipts_master").select("row_id", dates.receipt_day(t).alias("receipt_day"), day.cast("string").alias("strict_day"), dom.alias("day_of_month"), dow.alias("weekday"))


_MON = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr({}, 1, 3)))"
_DMY, _MDY = r"^(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})$", r"^([A-Za-z]{3,})\s+(\d{1,2}),?\s+(\d{4})$"


def _iso(p: str, y: str, m: str, dd: str) -> str:
    return f"lpad({y}, 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({dd}, 2, '0')"


def _g(p: str, i: int) -> str:
    return f"regexp_extract(t, '{p}', {i})"


_F4, _F2 = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})$"
SQL["day_readings"] = rf"""
WITH p AS (SELECT row_id, trim(date) AS t FROM receipts_master),
q AS (SELECT row_id, t,
  CASE WHEN regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN t
       WHEN regexp_matches(t, '{_F4}') THEN {_iso('', _g(_F4, 3), _g(_F4, 2), _g(_F4, 1))}
       WHEN regexp_matches(t, '{_F2}') THEN CAST(CASE WHEN try_cast({_g(_F2, 3)} AS INTEGER) > 50 THEN 1900 ELSE 2000 END + try_cast({_g(_F2, 3)} AS INTEGER) AS VARCHAR) || '-' || lpad({_g(_F2, 2)}, 2, '0') || '-' || lpad({_g(_F2, 1)}, 2, '0')
       WHEN regexp_matches(t, '{_DMY}') AND {_MON.format(_g(_DMY, 2))} > 0 THEN {_iso('', _g(_DMY, 3), _MON.format(_g(_DMY, 2)), _g(_DMY, 1))}
       WHEN regexp_matches(t, '{_MDY}') AND {_MON.format(_g(_MDY, 1))} > 0 THEN {_iso('', _g(_MDY, 3), _MON.format(_g(_MDY, 1)), _g(_MDY, 2))} END AS receipt_day,
  CAST(CASE WHEN regexp_matches(t, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN try_strptime(t, '%d/%m/%Y')
       WHEN regexp_matches(t, '^\d{{1,2}}-\d{{1,2}}-\d{{4}}$') THEN try_strptime(t, '%d-%m-%Y')
       WHEN regexp_matches(t, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN try_strptime(t, '%Y-%m-%d')
       WHEN regexp_matches(t, '^\d{{1,2}}/\d{{1,2}}/\d{{2}}$') THEN try_strptime(t, '%d/%m/%y')
       WHEN regexp_matches(t, '(?i)^\d{{1,2}} [a-z]{{3}} \d{{4}}$') THEN try_strptime(t, '%d %b %Y')
       WHEN regexp_matches(t, '(?i)^\d{{1,2}} [a-z]{{4,}} \d{{4}}$') THEN try_strptime(t, '%d %B %Y') END AS DATE) AS sd
  FROM p)
SELECT row_id, receipt_day, CAST(sd AS VARCHAR) AS strict_day, CAST(coalesce(day(sd), 1) AS INTEGER) AS day_of_month, CAST(coalesce(isodow(sd) - 1, 0) AS INTEGER) AS weekday FROM q"""


def path_columns(spark: SparkSession, d: str) -> DataFrame:
    p = text.path_parts(_C("image_path"))
    return table(spark, d, "fraud_manifest").select("manifest_id", p["name"].alias("name"), p["stem"].alias("stem"), p["ext"].alias("ext"), p["parent"].alias("parent"), p["depth"].alias("depth"), text.receipt_group(_C("image_path")).alias("receipt_group"), text.first_number(p["name"]).alias("receipt_number"))


SQL["path_columns"] = r"""
WITH p AS (SELECT manifest_id, image_path, string_split(image_path, '/') AS a FROM fraud_manifest),
q AS (SELECT manifest_id, a, a[-1] AS name, CAST(len(a) AS INTEGER) AS depth FROM p)
SELECT manifest_id, name, regexp_replace(name, '\.[^.]+$', '') AS stem, lower(regexp_extract(name, '\.([^.]+)$', 1)) AS ext,
  CASE WHEN depth > 1 THEN a[-2] ELSE name END AS parent, depth,
  lower(trim(regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '_tampered(_v\d+)?$', ''))) AS receipt_group, nullif(regexp_extract(name, '(\d+)', 1), '') AS receipt_number
FROM q"""


def name_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Each export row's merchant against the one of the same user's row before it, by normal form."""
    from pyspark.sql.window import Window

    rows = table(spark, d, "firestore_receipts").select("export_id", "user_id", text.merchant_key(F.coalesce("merchant", F.lit(""))).alias("a"))
    rows = rows.withColumn("b", F.coalesce(F.lag("a").over(Window.partitionBy("user_id").orderBy("export_id")), F.lit("")))
    return rows.select("export_id", F.round(text.name_similarity(_C("a"), _C("b")), 6).alias("similarity"), F.round(text.token_jaccard(_C("a"), _C("b")), 6).alias("overlap"), F.round(text.edit_distance_share(_C("a"), _C("b")), 6).alias("edit_share"))


_KEY = "trim(regexp_replace(regexp_replace(lower({}), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
SQL["name_similarities"] = rf"""
WITH r AS (SELECT export_id, user_id, {_KEY.format("coalesce(merchant, '')")} AS a FROM firestore_receipts),
s AS (SELECT export_id, a, coalesce(lag(a) OVER (PARTITION BY user_id ORDER BY export_id), '') AS b FROM r),
w AS (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS wa, list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) AS wb FROM s),
j AS (SELECT *, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(wa, wb))::DOUBLE / len(list_distinct(list_concat(wa, wb))) END AS o FROM w)
SELECT export_id, round(CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN a = b THEN 1.0::DOUBLE ELSE greatest(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), o) END, 6) AS similarity,
  round(o, 6) AS overlap, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0::DOUBLE ELSE levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS edit_share
FROM j"""


def field_errors(spark: SparkSession, d: str) -> DataFrame:
    m, t, dt = _C("merchant"), _C("total"), _C("date")
    errors = text.missing_fields({"missing merchant name": m.isNull() | (F.trim(m) == ""), "missing or bad total": t.isNull() | (t <= 0), "missing date": dt.isNull() | (F.trim(dt) == "")})
    return table(spark, d, "firestore_receipts").select("export_id", errors.alias("errors")).where("errors <> ''")


SQL["field_errors"] = """
SELECT export_id, errors FROM (SELECT export_id, array_to_string(list_filter([
  CASE WHEN merchant IS NULL OR trim(merchant) = '' THEN 'missing merchant name' END,
  CASE WHEN total IS NULL OR total <= 0 THEN 'missing or bad total' END,
  CASE WHEN date IS NULL OR trim(date) = '' THEN 'missing date' END], lambda x: x IS NOT NULL), '; ') AS errors FROM firestore_receipts) WHERE errors <> ''"""


def history_search(spark: SparkSession, d: str, term: str = "mini") -> DataFrame:
    has = lambda c: F.lower(F.coalesce(_C(c), F.lit(""))).contains(term)
    return table(spark, d, "firestore_receipts").where((has("merchant") | has("date") | has("category")) & F.lower(F.coalesce("category", F.lit(""))).contains("g")).select("export_id", "merchant", "category", "date")


SQL["history_search"] = """
SELECT export_id, merchant, category, date FROM firestore_receipts
WHERE (contains(lower(coalesce(merchant, '')), 'mini') OR contains(lower(coalesce(date, '')), 'mini') OR contains(lower(coalesce(category, '')), 'mini')) AND contains(lower(coalesce(category, '')), 'g')"""


def master_derived(spark: SparkSession, d: str) -> DataFrame:
    """Derived columns by source: currency looked up, amount read, address or items routed, spend category filled."""
    src = _C("source")
    cur = table(spark, d, "source_profile").select(F.col("source").alias("_s"), "currency")
    rows = table(spark, d, "receipts_master").join(cur, src == _C("_s"), "left")
    spend, _ = text.split_category(_C("category"))
    return rows.select("row_id", money.repaired_total(_C("total"), src).alias("total_parsed"), F.coalesce("currency", F.lit("")).alias("currency"), F.when(src == "SROIE", F.coalesce("items_text", F.lit(""))).otherwise("").alias("address"), F.when(src == "SROIE", F.lit("")).otherwise(F.coalesce("items_text", F.lit(""))).alias("items"), spend.alias("spend"))


SQL["master_derived"] = r"""
WITH p AS (SELECT m.*, s.currency, rtrim(list_extract(regexp_extract_all(coalesce(m.total, ''), '(\d[\d.,]*)', 1), -1), '.,') AS token FROM receipts_master m LEFT JOIN source_profile s ON m.source = s.source)
SELECT row_id, CASE WHEN source = 'CORD' THEN try_cast(regexp_replace(token, '[.,]', '', 'g') AS DOUBLE) ELSE try_cast(replace(token, ',', '') AS DOUBLE) END AS total_parsed,
  coalesce(currency, '') AS currency, CASE WHEN source = 'SROIE' THEN coalesce(items_text, '') ELSE '' END AS address, CASE WHEN source = 'SROIE' THEN '' ELSE coalesce(items_text, '') END AS items,
  CASE WHEN lower(trim(coalesce(category, ''))) IN ('retail', 'restaurant') THEN lower(trim(coalesce(category, ''))) ELSE '' END AS spend FROM p"""


def manifest_flags(spark: SparkSession, d: str) -> DataFrame:
    """Binary columns of the manifest; whether an image is there comes from a join with the other table's paths."""
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    seen = table(spark, d, "category_records").select(F.col("image_path").alias("_p")).where("_p IS NOT NULL").distinct()
    rows = table(spark, d, "fraud_manifest").join(seen, _C("image_path") == _C("_p"), "left")
    return rows.select("manifest_id", (label == "tampered").cast("int").alias("tampered"), label.isin("genuine", "tampered").cast("int").alias("eligible"), F.lower("image_path").endswith(".pdf").cast("int").alias("is_pdf"), _C("_p").isNotNull().cast("int").alias("listed"))


SQL["manifest_flags"] = """
SELECT manifest_id, CAST(lower(trim(coalesce(label, ''))) = 'tampered' AS INTEGER) AS tampered, CAST(lower(trim(coalesce(label, ''))) IN ('genuine', 'tampered') AS INTEGER) AS eligible,
  CAST(ends_with(lower(image_path), '.pdf') AS INTEGER) AS is_pdf, CAST(image_path IN (SELECT image_path FROM category_records WHERE image_path IS NOT NULL) AS INTEGER) AS listed FROM fraud_manifest"""


def items_total_gap(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines don't add up to the total within 15 per cent; orders without lines never count."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("items_sum"))
    o = table(spark, d, "orders").join(lines, _C("o_orderkey") == _C("l_orderkey"))
    return o.where((_C("items_sum") > 0) & (F.abs(_C("o_totalprice") - _C("items_sum")) / _C("o_totalprice") > 0.15)).select("o_orderkey", "items_sum")


SQL["items_total_gap"] = """
SELECT o_orderkey, items_sum FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS items_sum FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
WHERE items_sum > 0 AND abs(o_totalprice - items_sum) / o_totalprice > 0.15::DOUBLE"""


def json_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


SQL["json_properties"] = "SELECT event_type, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"


def signal_score(spark: SparkSession, d: str) -> DataFrame:
    """A weighted mean of three signals, the similarity only above a threshold, and the sum of fixed steps capped at one."""
    dup, hand, pdf = (_C(x).cast("double") for x in ("is_tampered", "binary_eligible", "needs_pdf_conversion"))
    sim = F.pmod(_C("manifest_id"), F.lit(101)) / 100.0
    ramp = F.greatest(F.lit(0.0), (sim - 0.9) / 0.1)
    weighted = F.round((0.5 * dup + 0.3 * ramp + 0.2 * pdf) / (0.5 + 0.3 + 0.2), 4)
    steps = F.least(F.lit(1.0), F.round(0.05 + 0.5 * dup + 0.1 * pdf + 0.3 * hand, 4))
    return table(spark, d, "fraud_manifest").select("manifest_id", weighted.alias("weighted"), steps.alias("stepped"))


SQL["signal_score"] = """
SELECT manifest_id, round((0.5::DOUBLE * is_tampered + 0.3::DOUBLE * greatest(0.0::DOUBLE, ((manifest_id % 101) / 100.0::DOUBLE - 0.9::DOUBLE) / 0.1::DOUBLE) + 0.2::DOUBLE * needs_pdf_conversion) / (0.5::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE), 4) AS weighted,
  least(1.0::DOUBLE, round(0.05::DOUBLE + 0.5::DOUBLE * is_tampered + 0.1::DOUBLE * needs_pdf_conversion + 0.3::DOUBLE * binary_eligible, 4)) AS stepped FROM fraud_manifest"""

ALL = [text_normal_forms, fingerprints, category_mappings, total_readings, day_readings, path_columns, name_similarities, field_errors, history_search, master_derived, manifest_flags, items_total_gap, json_properties, signal_score]


def queries():
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
