"""Queries of the operators for text corpora and entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import addresses, names, overlap, packing, splits, tokens, truncation


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.pairs(splits.image_groups(table(spark, d, "fraud_manifest"), "manifest_id", "image_path"), "manifest_id")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.image_splits(table(spark, d, "fraud_manifest"), "manifest_id", "image_path", "label")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return p1_splits(spark, d).groupBy("split", "label").agg(F.count("*").alias("n_rows"), F.countDistinct("grp").alias("n_groups"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows, _, names = overlap.image_overlaps(table(spark, d, "category_records"))
    return overlap.overlapping_pairs(rows, names).select("rec_id_a", "rec_id_b")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    rows, _, names = overlap.image_overlaps(table(spark, d, "category_records"))
    return overlap.overlap_report(rows, names)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.pairs(addresses.places(table(spark, d, "sroie_entities")))


def p5_places(spark: SparkSession, d: str) -> DataFrame:
    return addresses.places(table(spark, d, "sroie_entities"))


def _organisations(spark: SparkSession, d: str) -> DataFrame:
    return names.organisations(names.names_of(table(spark, d, "receipts_master").select("merchant"), table(spark, d, "sroie_entities").select("company")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(_organisations(spark, d))


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    return _organisations(spark, d)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("source", "text", tokens.token_ids("text").alias("ids")).select("source", "text", "ids", tokens.decoded("ids").alias("back"))
    return got.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.sum(F.when(F.col("back") == F.coalesce("text", F.lit("")), 1).otherwise(0)).alias("n_same"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), "doc_id", tokens.token_count("text"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p9_packed(spark, d))


def p9_tiers(spark: SparkSession, d: str) -> DataFrame:
    return packing.tier_report(p9_packed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.endings(table(spark, d, "documents")).where("cut").select("doc_id")


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    return truncation.evidence(truncation.endings(table(spark, d, "documents")))


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(truncation.endings(table(spark, d, "documents")))


def _checks(spark: SparkSession, **values: int) -> DataFrame:
    return spark.createDataFrame([(k, int(v or 0)) for k, v in values.items()], "check string, n long")


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every image has one split and no group has two; a path is never in two groups."""
    m = table(spark, d, "fraud_manifest")
    s = cut(p1_splits(spark, d), "checked")
    paths = s.join(m.select("manifest_id", "image_path"), "manifest_id").where("length(trim(image_path)) > 0")
    return _checks(
        spark, rows=s.count(), images=s.select("manifest_id").distinct().count(), groups_in_two_splits=s.groupBy("grp").agg(F.count_distinct("split").alias("n")).where("n > 1").count(),
        paths_in_two_groups=paths.groupBy("image_path").agg(F.count_distinct("grp").alias("n")).where("n > 1").count(),
    )


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """No pair lies within train or within what is evaluated, none comes twice, and equal paths of one source are all found."""
    r = table(spark, d, "category_records")
    p = cut(p4_found(spark, d), "checked")
    both = p.join(r.select(F.col("rec_id").alias("rec_id_a"), F.col("split").alias("sa"), F.col("image_path").alias("pa"), F.col("source").alias("oa")), "rec_id_a").join(r.select(F.col("rec_id").alias("rec_id_b"), F.col("split").alias("sb"), F.col("image_path").alias("pb"), F.col("source").alias("ob")), "rec_id_b")
    return _checks(spark, same_side=both.where("(sa = 'train') = (sb = 'train')").count(), repeated=p.count() - p.distinct().count(), equal_paths=both.where("pa = pb AND oa = ob").count())


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every row with an address has one place, and equal addresses have the same."""
    p = cut(p5_places(spark, d), "checked")
    texts = p.join(table(spark, d, "sroie_entities").select("entity_id", "address"), "entity_id").groupBy("address").agg(F.count_distinct("place").alias("n"))
    return _checks(spark, rows=p.count(), texts=texts.count(), texts_in_two_places=texts.where("n > 1").count())


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every name has one organisation."""
    p = cut(p6_members(spark, d), "checked")
    return _checks(spark, names=p.count(), distinct_names=p.select("name").distinct().count())


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Texts by source and how many of them decoding gives back: all."""
    return p8_round_trip(spark, d).select("source", "n_docs", "n_same")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, tokens over a container's capacity, items that overlap, documents split though they fit."""
    p = cut(p9_packed(spark, d), "checked")
    fill = p.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.max(F.col("start") + F.col("n_tokens")).alias("e"))
    split = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    return _checks(spark, documents=split.count(), over_capacity=fill.where(F.col("e") > packing.CAPACITY).count(), overlapping=fill.where("t > e").count(), split_though_fitting=split.where((F.col("k") > 1) & (F.col("t") <= packing.CAPACITY)).count())


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, blank ones among them, and blank ones held to be cut: none."""
    e = truncation.endings(table(spark, d, "documents").withColumn("_b", F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).withColumn("doc_id", F.struct("doc_id", "_b")))
    return e.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("doc_id._b")).alias("n_blank"), F.count_if(F.col("doc_id._b") & F.col("cut")).alias("n_blank_cut"))


def _rows(**values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", CAST(({v}) AS BIGINT) AS n" for k, v in values.items())


SQL = {
    "p1_checks": _rows(rows="SELECT count(DISTINCT manifest_id) FROM fraud_manifest", images="SELECT count(DISTINCT manifest_id) FROM fraud_manifest", groups_in_two_splits="0", paths_in_two_groups="0"),
    "p4_checks": _rows(
        same_side="0", repeated="0",
        equal_paths="SELECT count(*) FROM category_records a JOIN category_records b ON a.image_path = b.image_path AND a.source = b.source AND a.rec_id < b.rec_id WHERE (a.split = 'train') <> (b.split = 'train') AND length(trim(a.image_path)) > 0",
    ),
    "p5_checks": _rows(rows="SELECT count(*) FROM sroie_entities WHERE length(trim(address)) > 0", texts="SELECT count(DISTINCT address) FROM sroie_entities WHERE length(trim(address)) > 0", texts_in_two_places="0"),
    "p6_checks": _rows(**dict.fromkeys(("names", "distinct_names"), "SELECT count(*) FROM (SELECT merchant AS m FROM receipts_master UNION SELECT company FROM sroie_entities) WHERE length(trim(m)) > 0 AND upper(trim(m)) <> 'UNKNOWN'")),
    "p8_checks": "SELECT source, count(*) AS n_docs, count(*) AS n_same FROM documents GROUP BY 1",
    "p9_checks": _rows(documents="SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0", over_capacity="0", overlapping="0", split_though_fitting="0"),
    "p10_checks": "SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS n_blank, 0 AS n_blank_cut FROM documents GROUP BY 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_splits, p1_report, p4_found, p4_report, p5_found, p5_places, p6_found, p6_members, p8_ids, p8_round_trip, p9_packed, p9_report, p9_tiers, p10_found, p10_evidence, p10_report]
    return {f.__name__: f for f in [*found, p1_checks, p4_checks, p5_checks, p6_checks, p8_checks, p9_checks, p10_checks]}


def oracle_sql() -> dict[str, str]:
    """What must hold of the results whatever the data, where SQL can't give the results themselves."""
    return dict(SQL)
