"""Queries that filter, look up, enrich, rank and report records over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, scores, text
from ..operators import dedup, evaluation, sampling, windows
from ..session import run_dir, table
from ..sources import readers, writers
from .analytics import _KEY, _OWN, _receipts

SQL: dict[str, str] = {}
_C = F.col
_DRAW = "CAST(('0x' || substr(md5({} || ':42'), 1, 7)) AS BIGINT)"


def kept_records(spark: SparkSession, d: str) -> DataFrame:
    """Per source: rows, those without text, and those kept, after one source was put into quarantine."""
    rows = table(spark, d, "category_records").where("source IS NULL OR source <> 'CORD'")
    empty = F.length(F.trim(F.coalesce("items_text", F.lit("")))) == 0
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(empty).alias("n_empty"), F.count_if(~empty).alias("n_kept"))


SQL["kept_records"] = "SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE length(trim(coalesce(items_text, ''))) = 0) AS n_empty, count(*) FILTER (WHERE length(trim(coalesce(items_text, ''))) > 0) AS n_kept FROM category_records WHERE source IS NULL OR source <> 'CORD' GROUP BY 1"


def pooled_splits(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "category_records").select("rec_id", "split", "category_3class")
    return r.where("split = 'train'").union(r.where("split = 'val'")).select("rec_id", "category_3class")


SQL["pooled_splits"] = "SELECT rec_id, category_3class FROM category_records WHERE split IN ('train', 'val')"


def binary_rows(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows with one of two labels, however it is spelt."""
    label = F.lower(F.trim("label"))
    return table(spark, d, "fraud_manifest").where(label.isin("genuine", "tampered")).select("manifest_id", label.alias("label"))


SQL["binary_rows"] = "SELECT manifest_id, lower(trim(label)) AS label FROM fraud_manifest WHERE lower(trim(label)) IN ('genuine', 'tampered')"
_STEM = r"lower(regexp_replace(string_split(image_path, '/')[-1], '\.[^.]+$', ''))"


def repeated_stems(spark: SparkSession, d: str) -> DataFrame:
    stem = F.lower(text.path_parts(_C("image_path"))["stem"])
    return table(spark, d, "fraud_manifest").where("image_path IS NOT NULL").groupBy(stem.alias("stem")).agg(F.count("*").alias("n")).where("n > 1").orderBy("stem")


SQL["repeated_stems"] = f"SELECT {_STEM} AS stem, count(*) AS n FROM fraud_manifest WHERE image_path IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the file, the first row of data being line 2, that repeat merchant, date and total, by group."""
    rows = table(spark, d, "receipts_master").select("row_id", *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("merchant", "date", "total")])
    placed = windows.numbered(rows, [], ["row_id"], "line").withColumn("line", _C("line") + 1)
    return dedup.listed_groups(placed, ["merchant", "date", "total"], "line")


SQL["duplicate_lines"] = """
WITH r AS (SELECT row_number() OVER (ORDER BY row_id) + 1 AS line, trim(coalesce(merchant, '')) AS merchant, trim(coalesce(date, '')) AS date, trim(coalesce(total, '')) AS total FROM receipts_master),
g AS (SELECT *, count(*) OVER (PARTITION BY merchant, date, total) AS n_rows, row_number() OVER (PARTITION BY merchant, date, total ORDER BY line) AS nth FROM r) SELECT merchant, date, total, line, nth, n_rows FROM g WHERE n_rows > 1"""


def history_in_category(spark: SparkSession, d: str) -> DataFrame:
    """A search of every category ('all') beside one of a category, told apart by a column."""
    r = table(spark, d, "firestore_receipts").select("export_id", "merchant", "category", "date")
    found = text.search(r, "an", ["merchant", "category", "date"])
    return text.in_category(found, "category", "all").withColumn("chosen", F.lit("all")).union(text.in_category(found, "category", "grocery").withColumn("chosen", F.lit("grocery")))


_FOUND = "SELECT export_id, merchant, category, date FROM firestore_receipts WHERE contains(lower(coalesce(merchant, '')), 'an') OR contains(lower(coalesce(category, '')), 'an') OR contains(lower(coalesce(date, '')), 'an')"
SQL["history_in_category"] = f"SELECT *, 'all' AS chosen FROM ({_FOUND}) UNION ALL SELECT *, 'grocery' FROM ({_FOUND}) WHERE contains(lower(coalesce(category, '')), 'grocery')"


def field_error_rows(spark: SparkSession, d: str) -> DataFrame:
    """The messages of a row as an array, one row a message here."""
    m, t, dt = _C("merchant"), _C("total"), _C("date")
    errors = text.field_messages({"missing merchant name": m.isNull() | (F.trim(m) == ""), "missing or bad total": t.isNull() | (t <= 0), "missing date": dt.isNull() | (F.trim(dt) == "")})
    return table(spark, d, "firestore_receipts").select("export_id", F.posexplode(errors).alias("pos", "error"))


SQL["field_error_rows"] = """
SELECT export_id, CAST(row_number() OVER (PARTITION BY export_id ORDER BY i) - 1 AS INTEGER) AS pos, error FROM (
SELECT export_id, 1 AS i, 'missing merchant name' AS error FROM firestore_receipts WHERE merchant IS NULL OR trim(merchant) = '' UNION ALL
SELECT export_id, 2, 'missing or bad total' FROM firestore_receipts WHERE total IS NULL OR total <= 0 UNION ALL SELECT export_id, 3, 'missing date' FROM firestore_receipts WHERE date IS NULL OR trim(date) = '')"""


def fuzzy_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of one user and day with amounts within 2 and merchants that are alike."""
    rows = table(spark, d, "firestore_receipts").where("user_id IS NOT NULL AND date IS NOT NULL")
    return dedup.fuzzy_pairs(rows, "export_id", ["user_id", "date"], "total", text.merchant_key(_C("merchant")), text.name_similarity)


SQL["fuzzy_by_day"] = f"""
WITH r AS (SELECT export_id, user_id, date, total, {_KEY} AS m FROM firestore_receipts WHERE user_id IS NOT NULL AND date IS NOT NULL AND total IS NOT NULL AND merchant IS NOT NULL),
p AS (SELECT x.export_id AS a, y.export_id AS b, x.m AS ma, y.m AS mb, list_filter(string_split(x.m, ' '), lambda z: z <> '') AS wa, list_filter(string_split(y.m, ' '), lambda z: z <> '') AS wb FROM r x JOIN r y ON x.user_id = y.user_id AND x.date = y.date AND x.export_id < y.export_id AND abs(x.total - y.total) <= 2.0::DOUBLE),
j AS (SELECT a, b, ma, mb, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(list_intersect(wa, wb)))::DOUBLE / len(list_distinct(list_concat(wa, wb))) END AS o FROM p),
s AS (SELECT a, b, round(CASE WHEN ma = '' OR mb = '' THEN 0.0::DOUBLE WHEN ma = mb THEN 1.0::DOUBLE ELSE greatest(1 - levenshtein(ma, mb)::DOUBLE / greatest(length(ma), length(mb)), o) END, 6) AS score FROM j)
SELECT a, b, score FROM s WHERE score >= 0.84::DOUBLE"""


def blocked_claims(spark: SparkSession, d: str) -> DataFrame:
    """Uploads whose merchant, day and amount another user had first; the audit carries the winning receipt and user."""
    fp = F.concat_ws("|", text.merchant_key(F.coalesce("merchant", F.lit(""))), F.coalesce("date", F.lit("")), F.coalesce(_C("total").cast("decimal(18,2)").cast("string"), F.lit("")))
    return dedup.first_claims(table(spark, d, "firestore_receipts"), "export_id", "user_id", fp, "created_at")


SQL["blocked_claims"] = f"""
WITH r AS (SELECT export_id, user_id, created_at, coalesce({_KEY}, '') || '|' || coalesce(date, '') || '|' || coalesce(CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR), '') AS fp FROM firestore_receipts WHERE user_id IS NOT NULL),
f AS (SELECT *, first_value(export_id) OVER w AS fk, first_value(user_id) OVER w AS fo FROM r WINDOW w AS (PARTITION BY fp ORDER BY created_at, export_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT export_id, fk AS first_key, fo AS first_owner FROM f WHERE fo <> user_id"""


def matched_images(spark: SparkSession, d: str) -> DataFrame:
    """Category records to master rows: by file name, else by number, extension and the marks for a second version and for tampering."""
    parts = text.path_parts(_C("image_path"))
    name = F.lower(parts["name"])
    number = F.regexp_extract(name, r"(\d{6,})", 1)
    key = F.when(number != "", F.concat_ws("|", number, parts["ext"], name.contains("_v2").cast("string"), name.contains("tampered").cast("string")))
    return dedup.in_tiers(table(spark, d, "category_records"), table(spark, d, "receipts_master"), [(name, name), (key, key)], "rec_id", "row_id")


_NAME = "lower(string_split(image_path, '/')[-1])"
_NUMKEY = rf"CASE WHEN regexp_extract({_NAME}, '(\d{{6,}})', 1) <> '' THEN regexp_extract({_NAME}, '(\d{{6,}})', 1) || '|' || lower(regexp_extract(string_split(image_path, '/')[-1], '\.([^.]+)$', 1)) || '|' || CAST(contains({_NAME}, '_v2') AS VARCHAR) || '|' || CAST(contains({_NAME}, 'tampered') AS VARCHAR) END"


def _tier(e: str, i: int) -> str:
    return f"SELECT a.rec_id, min(b.row_id) AS row_id, {i} AS tier FROM (SELECT rec_id, {e} AS j FROM category_records) a JOIN (SELECT {e} AS j, min(row_id) AS row_id FROM receipts_master GROUP BY 1) b ON a.j = b.j AND a.j <> '' GROUP BY 1"


SQL["matched_images"] = f"SELECT rec_id, row_id, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY tier, row_id) AS k FROM ({_tier(_NAME, 1)} UNION ALL {_tier(_NUMKEY, 2)})) WHERE k = 1"


def present_images(spark: SparkSession, d: str) -> DataFrame:
    """Labels with whether their file is in the listing: per label how many are and how many aren't."""
    listed = table(spark, d, "category_records").select(_C("image_path").alias("_p")).where("_p IS NOT NULL").distinct()
    rows = table(spark, d, "receipts_master").join(listed, _C("image_path") == _C("_p"), "left")
    return rows.groupBy("source").agg(F.count_if(_C("_p").isNotNull()).alias("n_present"), F.count_if(_C("_p").isNull()).alias("n_missing"))


SQL["present_images"] = "SELECT source, count(*) FILTER (WHERE p) AS n_present, count(*) FILTER (WHERE NOT p) AS n_missing FROM (SELECT source, coalesce(image_path IN (SELECT image_path FROM category_records WHERE image_path IS NOT NULL), false) AS p FROM receipts_master) GROUP BY 1"


def reference_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each amount by the median of its category's early receipts; a category without one counts as 1."""
    r = _receipts(spark, d).where("total > 0")
    median = r.where("created_at < '2022-01-01'").groupBy(_C("category").alias("_g")).agg(F.median("total").alias("m"))
    return r.join(median, _C("category") == _C("_g"), "left").select("export_id", F.round(_C("total") / F.coalesce("m", F.lit(1.0)), 6).alias("ratio"))


SQL["reference_ratio"] = f"WITH r AS (SELECT * FROM ({_OWN}) WHERE total > 0), m AS (SELECT category AS g, median(total) AS m FROM r WHERE created_at < '2022-01-01' GROUP BY 1) SELECT export_id, round(total / coalesce(m, 1.0::DOUBLE), 6) AS ratio FROM r LEFT JOIN m ON category = g"


def ratings_or_zero(spark: SparkSession, d: str) -> DataFrame:
    """Every user with each of the categories and its rating, 0 where there is none."""
    r = _receipts(spark, d)
    rated = r.groupBy("user_id", "category").agg(F.least(F.count("*"), F.lit(5)).cast("double").alias("rating"))
    wanted = r.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, ("grocery", "General", "restaurant")))).alias("category"))
    return wanted.join(rated, ["user_id", "category"], "left").select("user_id", "category", F.coalesce("rating", F.lit(0.0)).alias("rating"))


SQL["ratings_or_zero"] = f"""WITH r AS ({_OWN}), g AS (SELECT user_id, category, least(count(*), 5)::DOUBLE AS rating FROM r GROUP BY 1, 2), w AS (SELECT user_id, unnest(['grocery', 'General', 'restaurant']) AS category FROM (SELECT DISTINCT user_id FROM r))
SELECT w.user_id, w.category, coalesce(rating, 0.0::DOUBLE) AS rating FROM w LEFT JOIN g ON w.user_id = g.user_id AND w.category = g.category"""


def unclaimed(spark: SparkSession, d: str) -> DataFrame:
    """Users and categories of the documents' users that the export has no claim of."""
    claims = table(spark, d, "firestore_receipts").where("user_id IS NOT NULL AND category IS NOT NULL").select("user_id", F.lower("category").alias("title")).distinct()
    wanted = table(spark, d, "documents").where("user_id IS NOT NULL").select("user_id", F.explode(F.array(F.lit("grocery"), F.lit("retail"))).alias("title")).distinct()
    return wanted.join(claims, ["user_id", "title"], "left_anti")


SQL["unclaimed"] = "SELECT DISTINCT user_id, title FROM (SELECT user_id, unnest(['grocery', 'retail']) AS title FROM documents WHERE user_id IS NOT NULL) w WHERE NOT EXISTS (SELECT 1 FROM firestore_receipts f WHERE f.user_id = w.user_id AND lower(f.category) = w.title)"


def score_disagreement(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("n_chars IS NOT NULL").select(_C("n_chars").cast("double").alias("a"), F.pmod("n_chars", F.lit(97)).cast("double").alias("b"))
    return evaluation.disagreement(s, "a", "b", 300.0, 48.0)


SQL["score_disagreement"] = "SELECT count(*) AS n, round(avg(CASE WHEN (n_chars >= 300) <> (n_chars % 97 >= 48) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS disagreement FROM documents WHERE n_chars IS NOT NULL"


def category_recall(spark: SparkSession, d: str) -> DataFrame:
    """Which of a user's frequent categories the best three merchants cover."""
    per = _receipts(spark, d).groupBy("user_id", "category", "merchant").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("s"))
    return evaluation.group_recall(per, "user_id", [F.desc("s"), _C("merchant"), _C("category")], "category", _C("n") >= 2, 3)


SQL["category_recall"] = f"""
WITH p AS (SELECT user_id, category, merchant, count(*) AS n, round(sum(total), 2) AS s FROM ({_OWN}) GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, merchant, category) AS r FROM p),
g AS (SELECT user_id, category, max(CAST(n >= 2 AS INTEGER)) AS rel, max(CAST(r <= 3 AS INTEGER)) AS top FROM k GROUP BY 1, 2), u AS (SELECT user_id, count(*) FILTER (WHERE rel = 1 AND top = 1) AS covered, count(*) FILTER (WHERE rel = 1) AS wanted FROM g GROUP BY 1)
SELECT user_id, covered, wanted, round(CASE WHEN wanted > 0 THEN covered::DOUBLE / wanted ELSE 0.0::DOUBLE END, 6) AS recall FROM u"""


def module_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of modules and how many sub-checks are suspicious, with their names in one text."""
    m = table(spark, d, "fraud_manifest")
    checks = F.array_compact(F.array(F.when(_C("is_tampered") == 1, "visual"), F.when(_C("needs_pdf_conversion") == 1, "paper"), F.when(_C("image_present") == 0, "metadata")))
    score = scores.fused([(F.lit(100.0) - 25 * _C("is_tampered"), 0.2), (F.lit(100.0) - 25 * _C("needs_pdf_conversion"), 0.15), (100.0 * _C("image_present"), 0.05)])
    flags = F.flatten(F.array(checks, F.when(_C("binary_eligible") == 0, F.array(F.lit("label"))).otherwise(F.array().cast("array<string>"))))
    return m.select("manifest_id", F.round(score, 4).alias("score"), F.size(checks).alias("n_suspicious"), F.array_join(flags, ",").alias("flags"))


SQL["module_scores"] = """
SELECT manifest_id, round(((100 - 25 * is_tampered) * 0.2::DOUBLE + (100 - 25 * needs_pdf_conversion) * 0.15::DOUBLE + 100 * image_present * 0.05::DOUBLE) / 0.4::DOUBLE, 4) AS score,
  CAST((is_tampered = 1)::INTEGER + (needs_pdf_conversion = 1)::INTEGER + (image_present = 0)::INTEGER AS INTEGER) AS n_suspicious,
  array_to_string(list_filter([CASE WHEN is_tampered = 1 THEN 'visual' END, CASE WHEN needs_pdf_conversion = 1 THEN 'paper' END, CASE WHEN image_present = 0 THEN 'metadata' END, CASE WHEN binary_eligible = 0 THEN 'label' END], lambda x: x IS NOT NULL), ',') AS flags FROM fraud_manifest"""


def newest_first(spark: SparkSession, d: str) -> DataFrame:
    """The 300 newest entities by the day read from their text; a text that is no date counts as the first day of 1970."""
    day = F.coalesce(dates.strict_day(_C("date")), F.lit("1970-01-01").cast("date"))
    return table(spark, d, "sroie_entities").select("entity_id", F.unix_date(day).alias("day")).orderBy(F.desc("day"), "entity_id").limit(300)


_STRICT = r"""CASE WHEN regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(t, '%d/%m/%Y') WHEN regexp_matches(t, '^\d{1,2}-\d{1,2}-\d{4}$') THEN try_strptime(t, '%d-%m-%Y') WHEN regexp_matches(t, '^\d{4}-\d{1,2}-\d{1,2}$') THEN try_strptime(t, '%Y-%m-%d')
 WHEN regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{2}$') THEN try_strptime(t, '%d/%m/%y') WHEN regexp_matches(t, '(?i)^\d{1,2} [a-z]{3} \d{4}$') THEN try_strptime(t, '%d %b %Y') WHEN regexp_matches(t, '(?i)^\d{1,2} [a-z]{4,} \d{4}$') THEN try_strptime(t, '%d %B %Y') END"""
SQL["newest_first"] = f"SELECT entity_id, CAST(date_diff('day', DATE '1970-01-01', coalesce(CAST(d AS DATE), DATE '1970-01-01')) AS INTEGER) AS day FROM (SELECT entity_id, {_STRICT} AS d FROM (SELECT entity_id, trim(date) AS t FROM sroie_entities)) ORDER BY day DESC, entity_id LIMIT 300"


def clamped_top(spark: SparkSession, d: str) -> DataFrame:
    """The best merchants of each user, as many as its points say, within 1 and the merchants it has; 5 where that is nothing."""
    sums = _receipts(spark, d).groupBy("user_id", "merchant").agg(F.round(F.sum("total"), 2).alias("amount"), F.max("points").alias("p"))
    user = sums.groupBy("user_id").agg(F.count("*").alias("size"), F.nullif(F.max("p"), F.lit(0)).alias("n")).select("user_id", scores.clamped(_C("n"), _C("size")).alias("top_n"))
    place = F.row_number().over(windows.Window.partitionBy("user_id").orderBy(F.desc("amount"), "merchant"))
    return sums.withColumn("place", place).join(user, "user_id").where("place <= top_n").select("user_id", "merchant", "place", "top_n")


SQL["clamped_top"] = f"""WITH s AS (SELECT user_id, merchant, round(sum(total), 2) AS amount, max(points) AS p FROM ({_OWN}) GROUP BY 1, 2), u AS (SELECT user_id, CAST(least(count(*), greatest(1, coalesce(nullif(max(p), 0), 5))) AS INTEGER) AS top_n FROM s GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, merchant) AS place FROM s) SELECT k.user_id, merchant, CAST(place AS INTEGER) AS place, top_n FROM k JOIN u ON k.user_id = u.user_id WHERE place <= top_n"""
_FOLDS = [("a", 100.0), ("b", 200.0), ("c", 300.0), ("d", 400.0)]


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Four detectors of receipts by length, with their recall and false alarms."""
    docs = table(spark, d, "documents").where("n_chars IS NOT NULL AND doc_type IS NOT NULL").select((_C("doc_type") == "receipt").cast("int").alias("y"), _C("n_chars").cast("double").alias("s"))
    points = evaluation.operating_points(docs, "y", "s", [t for _, t in _FOLDS])
    name = F.lit(None).cast("string")
    for m, t in _FOLDS:
        name = F.when(_C("threshold") == t, F.lit(m)).otherwise(name)
    return points.select(name.alias("model"), "recall", "fpr")


_MODELS = " UNION ALL ".join(f"SELECT '{m}' AS model, round(count(*) FILTER (WHERE doc_type = 'receipt' AND n_chars >= {t})::DOUBLE / greatest(count(*) FILTER (WHERE doc_type = 'receipt'), 1), 6) AS recall, round(count(*) FILTER (WHERE doc_type <> 'receipt' AND n_chars >= {t})::DOUBLE / greatest(count(*) FILTER (WHERE doc_type <> 'receipt'), 1), 6) AS fpr FROM documents WHERE n_chars IS NOT NULL AND doc_type IS NOT NULL" for m, t in _FOLDS)


def model_table(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d).orderBy(F.desc("recall"), "model")


SQL["model_table"] = f"SELECT * FROM ({_MODELS}) ORDER BY recall DESC, model"


def chosen_model(spark: SparkSession, d: str) -> DataFrame:
    """The model chosen by few false alarms first, then recall."""
    return evaluation.best_of(_models(spark, d), 0.6)


SQL["chosen_model"] = f"SELECT model, fpr, recall FROM ({_MODELS}) ORDER BY fpr < 0.6::DOUBLE DESC, CASE WHEN fpr < 0.6::DOUBLE THEN recall END DESC NULLS LAST, fpr, recall DESC, model DESC LIMIT 1"


def lowest_totals(spark: SparkSession, d: str) -> DataFrame:
    """The ten lowest scores with what they belong to, as a gate is calibrated by."""
    return table(spark, d, "firestore_receipts").where("total IS NOT NULL").select("export_id", "total").orderBy("total", "export_id").limit(10)


SQL["lowest_totals"] = "SELECT export_id, total FROM firestore_receipts WHERE total IS NOT NULL ORDER BY total, export_id LIMIT 10"


def weighted_picks(spark: SparkSession, d: str) -> DataFrame:
    """One category for each user, drawn with odds by what was spent on it."""
    per = _receipts(spark, d).groupBy("user_id", "category").agg(F.round(F.sum("total"), 2).alias("w"))
    return sampling.weighted_pick(per, "user_id", "category", "w")


SQL["weighted_picks"] = f"""WITH p AS (SELECT user_id, category, round(sum(total), 2) AS w FROM ({_OWN}) GROUP BY 1, 2), t AS (SELECT *, -ln(({_DRAW.format("user_id || '|' || category")} + 0.5::DOUBLE) / {float(16**7)}::DOUBLE) / w AS t FROM p WHERE w > 0)
SELECT user_id, category FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, category) AS k FROM t) WHERE k = 1"""


def text_findings(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, dates, amounts and words in the texts of receipts."""
    f = text.found_in_text(_C("text"))
    return table(spark, d, "documents").where("doc_type = 'receipt'").select("doc_id", *[c.alias(k) for k, c in f.items()])


SQL["text_findings"] = r"""SELECT doc_id, nullif(regexp_extract(t, '(?:receipt|invoice|bill|inv|ref|no)\.?\s*(?:no\.?|#|:)?\s*([a-z]*\d[a-z\d-]{2,})', 1), '') AS number, CAST(len(regexp_extract_all(t, '(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})', 1)) AS INTEGER) AS n_dates,
 CAST(len(regexp_extract_all(t, '(\d+\.\d{2})', 1)) AS INTEGER) AS n_amounts, CAST(len(regexp_extract_all(t, '([a-z]{3,})', 1)) AS INTEGER) AS n_words FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents WHERE doc_type = 'receipt')"""


def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """E-mail, fence, list in words, share of known words, error class and digits in lakhs of made-up texts of real values."""
    r = table(spark, d, "firestore_receipts")
    mail = text.normal_email(F.concat(F.lit("  "), F.coalesce("user_id", F.lit("x")), F.lit("@Mail.COM ")))
    fenced = text.without_fence(F.concat(F.lit("```json\n{\"m\": "), F.coalesce("date", F.lit("")), F.lit("}\n```")))
    listed = text.sentence_list(F.array_compact(F.array("category", "merchant", "date")))
    known = F.round(text.words_share(F.coalesce("merchant", F.lit("")), ["cafe", "bakery", "mini", "market", "restoran", "kedai"]), 6)
    message = F.element_at(F.array(*map(F.lit, ("503 Service Unavailable", "Quota exceeded", "model not found", "bad key"))), (F.pmod("export_id", F.lit(4)) + 1).cast("int"))
    return r.select("export_id", mail.alias("mail"), fenced.alias("body"), listed.alias("listed"), known.alias("known_share"), text.error_class(message).alias("error"), text.lakh_grouped(_C("export_id") * 98765).alias("lakhs"))


SQL["text_helpers"] = r"""
WITH r AS (SELECT *, list_filter([category, merchant, date], lambda x: x IS NOT NULL) AS l, regexp_extract_all(lower(coalesce(merchant, '')), '([a-z]{3,})', 1) AS w, CAST(export_id * 98765 AS VARCHAR) AS n FROM firestore_receipts)
SELECT export_id, lower(trim(coalesce(user_id, 'x') || '@Mail.COM')) AS mail, '{"m": ' || coalesce(date, '') || '}' AS body,
  CASE len(l) WHEN 0 THEN '' WHEN 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS listed,
  round(len(list_filter(w, lambda x: x IN ('cafe', 'bakery', 'mini', 'market', 'restoran', 'kedai')))::DOUBLE / greatest(len(w), 1), 6) AS known_share,
  CASE export_id % 4 WHEN 0 THEN 'transient' WHEN 1 THEN 'quota' WHEN 2 THEN 'unsupported' ELSE 'permanent' END AS error,
  CASE WHEN length(n) > 3 THEN ltrim(reverse(regexp_replace(reverse(left(n, -3)), '(\d\d)', '\1,', 'g')), ',') || ',' || right(n, 3) ELSE n END AS lakhs FROM r"""


def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.trailing_median(_receipts(spark, d), "user_id", ["created_at", "export_id"], "total", default=100.0)
    ratio = F.round(windows.log_ratio(_C("total"), _C("reference")), 6)
    score, flag = scores.anomaly_score(F.lit(0.2) - ratio / 10, ratio, _C("total"), F.pmod("export_id", F.lit(10)) != 0)
    return rows.select("export_id", score.alias("score"), flag.alias("is_anomaly"))


SQL["anomaly_scores"] = f"""
WITH w AS (SELECT *, count(total) OVER p AS nb, median(total) OVER p AS m FROM (SELECT * FROM ({_OWN}) WHERE total > 0) WINDOW p AS (PARTITION BY user_id ORDER BY created_at, export_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
x AS (SELECT export_id, round(ln(1 + total) - ln(1 + greatest(CASE WHEN nb >= 5 THEN m ELSE 100.0::DOUBLE END, 1e-9::DOUBLE)), 6) AS r FROM w), y AS (SELECT *, 0.2::DOUBLE - r / 10 AS d, export_id % 10 <> 0 AS ready FROM x)
SELECT export_id, round(CASE WHEN NOT ready THEN 0.05::DOUBLE WHEN r <= 0 THEN least(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE - d)), 0.05::DOUBLE) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE - d)) END, 4) AS score, ready AND r > 0 AND d < 0 AS is_anomaly FROM y"""


def compared_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each receipt held against the user's next one: the one that scores lower by more than ten, and whether it is suspicious at all."""
    w = windows.Window.partitionBy("user_id").orderBy("created_at", "export_id")
    r = _receipts(spark, d).select("export_id", "user_id", _C("points").cast("double").alias("a"), F.lead(_C("points").cast("double")).over(w).alias("b"))
    return r.where("b IS NOT NULL").select("export_id", scores.lower_is_fake(_C("a"), _C("b")).alias("fake"), (_C("a") < 50).alias("suspicious"))


SQL["compared_batches"] = f"SELECT export_id, CASE WHEN a < b - 10 THEN 'a' WHEN b < a - 10 THEN 'b' END AS fake, a < 50 AS suspicious FROM (SELECT export_id, points::DOUBLE AS a, lead(points::DOUBLE) OVER (PARTITION BY user_id ORDER BY created_at, export_id) AS b FROM ({_OWN})) WHERE b IS NOT NULL"


def instants_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps as ISO text and back in milliseconds, 0 where there is none; and the time of the run, which must be later than all."""
    iso = dates.iso_instant(_C("created_at"))
    return table(spark, d, "firestore_receipts").select("export_id", iso.alias("iso"), dates.millis_or_zero(iso).alias("millis"), (dates.now_iso() > F.coalesce(iso, F.lit(""))).alias("past"))


SQL["instants_as_text"] = "SELECT export_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, coalesce(epoch_us(created_at) // 1000, 0) AS millis, true AS past FROM firestore_receipts"


def priced_lines(spark: SparkSession, d: str) -> DataFrame:
    """Prices within a list of lines transformed in place, and the names of the signals that hold."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(_C("l_linenumber").alias("n"), F.floor(_C("l_extendedprice") * 100 + 0.5).alias("cents")))).alias("items"))
    net = F.transform("items", lambda x: F.struct(x["n"].alias("n"), (x["cents"] * 9).alias("mills")))
    signals = F.map_from_arrays(F.array(F.lit("many"), F.lit("dear"), F.lit("single")), F.array(F.size("items") > 4, F.exists("items", lambda x: x["cents"] > 9_000_000), F.size("items") == 1))
    return lines.select("l_orderkey", F.aggregate(net, F.lit(0).cast("bigint"), lambda s, x: s + x["mills"]).alias("net_mills"), F.array_join(F.map_keys(F.map_filter(signals, lambda k, v: v)), ",").alias("signals"))


SQL["priced_lines"] = """SELECT l_orderkey, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * 9) AS BIGINT) AS net_mills,
 array_to_string(list_filter([CASE WHEN count(*) > 4 THEN 'many' END, CASE WHEN max(floor(l_extendedprice * 100 + 0.5)) > 9000000 THEN 'dear' END, CASE WHEN count(*) = 1 THEN 'single' END], lambda x: x IS NOT NULL), ',') AS signals FROM lineitem GROUP BY 1"""


def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers in JSON with defaults where a field isn't there; broken ones have all defaults."""
    k = _C("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('{"handwritten_present": true, "handwritten_text": "'), _C("event_type"), F.lit('"}'))).when(k == 1, F.lit("{}")).otherwise(F.lit("{broken"))
    got = F.from_json(raw, "handwritten_present boolean, handwritten_text string")
    back = F.to_json(F.struct(F.coalesce(got["handwritten_present"], F.lit(False)).alias("handwritten_present"), F.coalesce(got["handwritten_text"], F.lit("")).alias("handwritten_text")))
    return table(spark, d, "events").select("event_id", back.alias("answer"))


SQL["parsed_answers"] = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"handwritten_present":true,"handwritten_text":"' || event_type || '"}' ELSE '{"handwritten_present":false,"handwritten_text":""}' END AS answer FROM events"""


def shown_scores(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a response with its score rounded."""
    per = _receipts(spark, d).groupBy("user_id", "category").agg(F.avg("total").alias("score"))
    return per.select("user_id", "category", F.round("score", 3).alias("score"))


SQL["shown_scores"] = f"SELECT user_id, category, round(avg(total), 3) AS score FROM ({_OWN}) GROUP BY 1, 2"


def detector_columns(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows with what a detector said of their file; rows without a file or an answer get fixed values."""
    m = table(spark, d, "fraud_manifest").select("manifest_id", "image_path", "image_present")
    said = table(spark, d, "fraud_manifest").where("image_path IS NOT NULL AND binary_eligible = 1").groupBy(_C("image_path").alias("_p")).agg(F.round(F.avg(_C("is_tampered").cast("double")) * 100, 2).alias("s"), F.max("is_tampered").alias("t"))
    j = m.join(said, _C("image_path") == _C("_p"), "left")
    gone = _C("image_path").isNull() | (_C("image_present") == 0)
    verdict = F.when(gone, "FILE_MISSING").when(_C("_p").isNull(), "ERROR").when(_C("t") == 1, "FAKE").otherwise("GENUINE")
    return j.select("manifest_id", verdict.alias("verdict"), F.when(gone | _C("_p").isNull(), 0.0).otherwise(_C("s")).alias("score"))


SQL["detector_columns"] = """WITH s AS (SELECT image_path AS p, round(avg(is_tampered) * 100, 2) AS s, max(is_tampered) AS t FROM fraud_manifest WHERE image_path IS NOT NULL AND binary_eligible = 1 GROUP BY 1)
SELECT manifest_id, CASE WHEN image_path IS NULL OR image_present = 0 THEN 'FILE_MISSING' WHEN p IS NULL THEN 'ERROR' WHEN t = 1 THEN 'FAKE' ELSE 'GENUINE' END AS verdict, CASE WHEN image_path IS NULL OR image_present = 0 OR p IS NULL THEN 0.0::DOUBLE ELSE s END AS score FROM fraud_manifest LEFT JOIN s ON image_path = p"""


def read_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of two models written as files, read back by key, and aligned; a missing key or another label would fail."""
    m = table(spark, d, "fraud_manifest").select("manifest_id", "is_tampered", F.round(F.pmod("manifest_id", F.lit(97)) / 97.0, 6).alias("a"), F.round(F.pmod("manifest_id", F.lit(89)) / 89.0, 6).alias("b"))
    parts = {}
    for name in ("a", "b"):
        cols = ["manifest_id", "is_tampered", name]
        path = writers.csv_out(m, writers.scratch(spark, name), cols)
        parts[name] = readers.keyed(spark, path, cols, "predictions").select(_C("manifest_id").cast("bigint").alias("manifest_id"), _C("is_tampered").cast("int").alias("is_tampered"), _C(name).cast("double").alias("p"))
    return readers.aligned(parts, "manifest_id", "is_tampered", "p")


SQL["read_predictions"] = "SELECT manifest_id, is_tampered, round((manifest_id % 97) / 97.0::DOUBLE, 6) AS a, round((manifest_id % 89) / 89.0::DOUBLE, 6) AS b FROM fraud_manifest"


def fused_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two models' scores fused seven to three and by their mean."""
    m = read_predictions(spark, d)
    return m.select("manifest_id", F.round(scores.fused([(_C("a"), 0.7), (_C("b"), 0.3)]), 8).alias("weighted"), F.round(scores.fused([(_C("a"), 1.0), (_C("b"), 1.0)]), 8).alias("mean"))


SQL["fused_scores"] = f"SELECT manifest_id, round(a * 0.7::DOUBLE + b * 0.3::DOUBLE, 8) AS weighted, round(a * 0.5::DOUBLE + b * 0.5::DOUBLE, 8) AS mean FROM ({SQL['read_predictions']})"


def cached_features(spark: SparkSession, d: str) -> DataFrame:
    """Features from a cache that lacks keys, and so are computed anew, beside those from one that has all."""
    m = table(spark, d, "fraud_manifest").select("manifest_id", "image_path")
    compute = lambda rows: rows.select("manifest_id", F.coalesce(F.length("image_path"), F.lit(0)).alias("f"))
    some, whole = m.where("manifest_id % 7 <> 0").select("manifest_id", F.lit(-1).alias("f")), compute(m)
    a, from_some = readers.covered_or(m, some, "manifest_id", compute)
    b, from_whole = readers.covered_or(m, whole, "manifest_id", compute)
    return a.withColumn("cached", F.lit(from_some)).union(b.withColumn("cached", F.lit(from_whole)))


SQL["cached_features"] = "SELECT manifest_id, coalesce(length(image_path), 0) AS f, unnest([false, true]) AS cached FROM fraud_manifest"


def stored_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles from a store of JSON lines, some of which are broken; a missing store is empty."""
    path = writers.scratch(spark, "profiles")
    line = F.to_json(F.struct("user_id", _C("n").alias("receipts")))
    per = _receipts(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    per.select(F.when(_C("n") % 3 == 0, F.concat(F.lit("{oops "), line)).otherwise(line).alias("value")).write.text(path)
    schema = "user_id string, receipts long"
    return readers.store(spark, path, schema).union(readers.store(spark, f"{run_dir(spark)}/none", schema))


SQL["stored_profiles"] = f"SELECT user_id, count(*) AS receipts FROM ({_OWN}) GROUP BY 1 HAVING count(*) % 3 <> 0"


def rewritten_twice(spark: SparkSession, d: str) -> DataFrame:
    """A table rewritten in place twice from the copy that was kept of it."""
    path = writers.scratch(spark, "master")
    cols = {"total_parsed": money.repaired_total(_C("total"), _C("source"))}
    rows = table(spark, d, "receipts_master").select("row_id", "total", "source")
    writers.rewritten_once(rows, path, cols)
    return writers.rewritten_once(rows, path, cols).select("row_id", "total_parsed")


SQL["rewritten_twice"] = r"SELECT row_id, CASE WHEN source = 'CORD' THEN try_cast(regexp_replace(token, '[.,]', '', 'g') AS DOUBLE) ELSE try_cast(replace(token, ',', '') AS DOUBLE) END AS total_parsed FROM (SELECT *, rtrim(list_extract(regexp_extract_all(coalesce(total, ''), '(\d[\d.,]*)', 1), -1), '.,') AS token FROM receipts_master)"


def audited_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Accepted uploads and, in the audit beside them, those of a user that came before with the same merchant, day and amount; then both
    tables are emptied, which is checked, so that the last column is always 0."""
    rows = table(spark, d, "firestore_receipts").where("user_id IS NOT NULL").select("export_id", "user_id", "merchant", "total", "date", "created_at")
    nth = dedup.running_first(rows, ["user_id", "merchant", "total", "date"], [_C("created_at"), _C("export_id")])
    root = writers.scratch(spark, "uploads")
    paths = writers.audited(nth.where("nth = 1").select("export_id"), nth.where("nth > 1").select("export_id"), f"{root}/rows", f"{root}/audit")
    both = spark.read.parquet(paths[0]).withColumn("blocked", F.lit(False)).union(spark.read.parquet(paths[1]).withColumn("blocked", F.lit(True)))
    kept = spark.read.parquet(writers.replaced(both, f"{root}/both"))
    return kept.withColumn("left_over", F.lit(writers.truncated(spark, list(paths))))


SQL["audited_uploads"] = "SELECT export_id, row_number() OVER (PARTITION BY user_id, merchant, total, date ORDER BY created_at, export_id) > 1 AS blocked, 0 AS left_over FROM firestore_receipts WHERE user_id IS NOT NULL"


def rated_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue written in the program with the mean amount of its category, 0 where none was spent."""
    cat = readers.constant(spark, [("c1", "grocery"), ("c2", "General"), ("c3", "pets")], "offer string, category string")
    mean = _receipts(spark, d).groupBy("category").agg(F.round(F.avg("total"), 4).alias("m"))
    return cat.join(mean, "category", "left").select("offer", "category", F.coalesce("m", F.lit(0.0)).alias("mean_total"))


SQL["rated_catalogue"] = f"SELECT offer, c.category, coalesce(m, 0.0::DOUBLE) AS mean_total FROM (VALUES ('c1', 'grocery'), ('c2', 'General'), ('c3', 'pets')) c(offer, category) LEFT JOIN (SELECT category, round(avg(total), 4) AS m FROM ({_OWN}) GROUP BY 1) g ON c.category = g.category"


def made_up_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of made-up users, as many as the export has."""
    n = table(spark, d, "firestore_receipts").agg(F.count_distinct("user_id")).first()[0]
    return sampling.synthetic_ratings(n, ["food", "grocery", "retail"], 12, spark)


def _pick(name: str, n: int) -> str:
    return _DRAW.format(f"'{name}|' || CAST(u AS VARCHAR) || '|' || CAST(k AS VARCHAR)") + f" % {n}"


SQL["made_up_ratings"] = f"""WITH r AS (SELECT u, unnest(range(1, 13)) AS k FROM (SELECT unnest(range((SELECT count(DISTINCT user_id) FROM firestore_receipts))) AS u)),
p AS (SELECT u, k, {_DRAW.format("'own|' || CAST(u AS VARCHAR)")} % 3 AS own, {_pick('like', 100)} AS l, {_pick('other', 3)} AS o, {_pick('noise', 3)} AS z FROM r), q AS (SELECT *, CASE WHEN l < 60 THEN own ELSE o END AS c FROM p)
SELECT u AS "user", CAST(k AS INTEGER) AS nth, ['food', 'grocery', 'retail'][CAST(c AS INTEGER) + 1] AS category, CAST(greatest(1, least(5, CASE WHEN c = own THEN 4 ELSE 3 END + z - 1)) AS INTEGER) AS rating FROM q"""


def balanced_group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups of images to five folds, each with its share of every label."""
    return sampling.stratified_group_folds(table(spark, d, "fraud_manifest"), text.receipt_group(_C("image_path")), "label", 5)


_GRP = r"lower(trim(regexp_replace(regexp_replace(string_split(image_path, '/')[-1], '\.[^.]+$', ''), '_tampered(_v\d+)?$', '')))"
SQL["balanced_group_folds"] = f"""WITH r AS (SELECT {_GRP} AS grp, coalesce(label, '') AS label FROM fraud_manifest WHERE image_path IS NOT NULL), n AS (SELECT grp, label, count(*) AS n FROM r GROUP BY 1, 2),
m AS (SELECT grp, label FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, label) AS k FROM n) WHERE k = 1) SELECT grp, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_DRAW.format('grp')}, grp) - 1) % 5 AS INTEGER) AS fold FROM m"""


def flagged_amounts(spark: SparkSession, d: str) -> DataFrame:
    """The 12 of 100 receipts whose log ratio to the user's median is highest, cut at the exact percentile."""
    from ..operators.learning import flagged_share

    rows = windows.trailing_median(_receipts(spark, d), "user_id", ["created_at", "export_id"], "total", default=100.0)
    return flagged_share(rows.select("export_id", F.round(windows.log_ratio(_C("total"), _C("reference")), 6).alias("ratio")), "ratio", 0.12)


SQL["flagged_amounts"] = f"""
WITH w AS (SELECT *, count(total) OVER p AS nb, median(total) OVER p AS m FROM (SELECT * FROM ({_OWN}) WHERE total > 0) WINDOW p AS (PARTITION BY user_id ORDER BY created_at, export_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
x AS (SELECT export_id, round(ln(1 + total) - ln(1 + greatest(CASE WHEN nb >= 5 THEN m ELSE 100.0::DOUBLE END, 1e-9::DOUBLE)), 6) AS ratio FROM w)
SELECT export_id, ratio, ratio > (SELECT quantile_cont(ratio, 0.88) FROM x) AS flagged FROM x"""

ALL = [
    kept_records, pooled_splits, binary_rows, repeated_stems, duplicate_lines, history_in_category, field_error_rows, fuzzy_by_day, blocked_claims, matched_images, present_images, reference_ratio, ratings_or_zero, unclaimed,
    score_disagreement, category_recall, module_scores, newest_first, clamped_top, model_table, chosen_model, lowest_totals, weighted_picks, text_findings, text_helpers, anomaly_scores, compared_batches, instants_as_text,
    priced_lines, parsed_answers, shown_scores, detector_columns, read_predictions, fused_scores, cached_features, stored_profiles, rewritten_twice, audited_uploads, rated_catalogue, made_up_ratings, balanced_group_folds, flagged_amounts,
]


def queries():
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
