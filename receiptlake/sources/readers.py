"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("company", "date", "address", "total")])
MASTER = ["image_path", "merchant", "date", "total", "category", "items_text", "source"]
_MENU = T.ArrayType(T.StructType([T.StructField("nm", T.StringType()), T.StructField("cnt", T.StringType())]))
_GOLD = T.StructType(
    [
        T.StructField("gt_parse", T.StructType([T.StructField("total", T.StructType([T.StructField("total_price", T.StringType())])), T.StructField("sub_total", T.StructType([T.StructField("subtotal_price", T.StringType())])), T.StructField("menu", T.StringType())])),
        T.StructField("meta", T.StructType([T.StructField("image_id", T.StringType())])),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def entity_files(spark: SparkSession, folder: str, image_folder: str = "dataset/temp_sroie/image") -> DataFrame:
    """One row for each file of one JSON object: the master columns. Files that aren't JSON are left out; a missing company is UNKNOWN."""
    raw = spark.read.schema(T.StructType([*ENTITY.fields, T.StructField("_corrupt_record", T.StringType())])).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    rows = raw.select("*", F.col("_metadata.file_name").alias("f")).where("_corrupt_record IS NULL")
    stem = F.regexp_replace("f", r"\.[^.]+$", "")
    company = F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("UNKNOWN"))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(F.concat(F.lit(image_folder + "/"), stem, F.lit(".jpg")).alias("image_path"), company.alias("merchant"), none("date").alias("date"), none("total").alias("total"), F.lit("retail").alias("category"), none("address").alias("items_text"), F.lit("SROIE").alias("source"))


def menu_text(menu: Column) -> Column:
    """``name (count), name`` of a menu in JSON; empty if it isn't a list."""
    items = F.coalesce(F.from_json(menu, _MENU), F.from_json(F.lit("[]"), _MENU))
    named = F.filter(items, lambda x: F.length(F.trim(F.coalesce(x["nm"], F.lit("")))) > 0)
    return F.array_join(F.transform(named, lambda x: F.when(F.length(F.coalesce(x["cnt"], F.lit(""))) > 0, F.concat(x["nm"], F.lit(" ("), x["cnt"], F.lit(")"))).otherwise(x["nm"])), ", ")


def annotation_rows(df: DataFrame, payload: str) -> DataFrame:
    """Master columns from annotations in nested JSON; the total falls back to the subtotal."""
    j = df.select(F.from_json(F.col(payload), _GOLD).alias("j")).where("j IS NOT NULL")
    total = F.coalesce(F.col("j.gt_parse.total.total_price"), F.col("j.gt_parse.sub_total.subtotal_price"), F.lit(""))
    image = F.concat(F.lit("dataset/temp_cord/image/receipt_"), F.coalesce("j.meta.image_id", F.lit("")), F.lit(".png"))
    return j.select(image.alias("image_path"), F.lit("").alias("merchant"), F.lit("").alias("date"), total.alias("total"), F.lit("restaurant").alias("category"), menu_text(F.col("j.gt_parse.menu")).alias("items_text"), F.lit("CORD").alias("source"))


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; a missing file is an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def images(spark: SparkSession, folder: str, extensions: str = "{jpg,jpeg,png,JPG,JPEG,PNG}", nested: bool = False) -> DataFrame:
    """path, width, height, channels and pixels of the images that can be decoded."""
    r = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", f"*.{extensions}")
    if nested:
        r = r.option("recursiveFileLookup", True)
    i = r.load(folder)
    return i.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, depth below the folder and bytes of the files of a folder and those below, the deepest first."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    base = F.lit(len(folder.rstrip("/").removeprefix("file://").strip("/").split("/")))
    parts = F.size(F.filter(F.split(F.regexp_replace("path", "^[a-z]+:/+", ""), "/"), lambda x: x != ""))
    return f.select("path", (parts - base).alias("depth"), "length").orderBy(F.desc("depth"), "path")


def decoded_payload(c: Column) -> Column:
    """Bytes of a base64 text, with or without its data URI head; null if it isn't base64."""
    return F.try_to_binary(F.regexp_replace(c, "^data:[^,]*,", ""), F.lit("base64"))


def image_kind(data: Column) -> Column:
    """jpeg, png, webp or heic by the first bytes; null for others."""
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").when(F.substring(h, 9, 8) == "66747970", "heic")


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows with the given values; filters reach the Parquet scan."""
    for c, v in values.items():
        df = df.where(F.col(c) == v)
    return df


def latest(df: DataFrame, at: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(at), tie).limit(n)


def store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store of JSON lines; one that is missing is empty, and lines that can't be read are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    got = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    return got.where("_corrupt IS NULL").drop("_corrupt")


def keyed(spark: SparkSession, path: str, columns: list[str], what: str) -> DataFrame:
    """A table of predictions by key; a missing one is an error that says what is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{what} are not at {path}")
    return csv_strings(spark, path, columns)


def covered_or(rows: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, bool]:
    """(features of rows, whether they came from the cache): the cache only counts if it has all keys of rows; else compute(rows)."""
    if rows.select(key).join(cache.select(key), key, "left_anti").isEmpty():
        return rows.select(key).distinct().join(cache, key), True
    return compute(rows), False


def aligned(parts: dict[str, DataFrame], key: str, label: str, score: str) -> DataFrame:
    """(key, label, one column a part) of predictions by several models; an error if a key is missing in one or labels disagree."""
    out = None
    for name, df in parts.items():
        one = df.select(F.col(key), F.col(label).alias(f"_l_{name}"), F.col(score).alias(name))
        out = one if out is None else out.join(one, key, "full")
    first = next(iter(parts))
    bad = F.lit(False)
    for name in parts:
        bad = bad | F.col(f"_l_{name}").isNull() | (F.col(f"_l_{name}") != F.col(f"_l_{first}"))
    bad = F.coalesce(bad, F.lit(True))
    checked = out.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit("predictions disagree on "), F.col(key).cast("string")))).otherwise(F.lit(1)))
    return checked.where("_ok = 1").select(key, F.col(f"_l_{first}").alias(label), *parts)


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A relation written in the program, such as a catalogue."""
    return spark.createDataFrame(rows, schema)


def first_images(spark: SparkSession, folder: str, n: int | None = None, extensions: str = "{jpg,jpeg,png,JPG,JPEG,PNG}") -> DataFrame:
    """path and bytes of the image files of a folder, sorted by path, the first n of them if asked."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extensions}").load(folder).select("path", "length").orderBy("path")
    return f if n is None else f.limit(n)
