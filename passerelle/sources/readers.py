"""Readers of exports, lists and captures. Every schema is stated; missing or broken exports give empty tables where noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from passerelle.functions.text import strip_newlines

ENTRIES = "id string, name string, type string, slug string"
COMPOSITIONS = "id string, name string, pattern boolean"
NODES = "path string, compositionId string"
REDIRECTS = "redirect struct<sourceUrl string>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; empty if the file is missing or broken."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return df


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, ENTRIES)


def read_compositions(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, COMPOSITIONS)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, NODES).select("path", F.col("compositionId").alias("composition_id"))


def read_redirects(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """source_url of all rules; `limit` keeps the first so many, as paged exports do."""
    df = _json(spark, path, REDIRECTS).select(F.col("redirect.sourceUrl").alias("source_url"))
    return df if limit is None else df.limit(limit)


def combine_api_pages(pages: DataFrame, items: str, page_size: int, offset: str = "page_offset") -> DataFrame:
    """The items of an export's pages up to the first that isn't full, with `pos` in their page; names lose their newlines."""
    short = pages.agg(F.min(F.when(F.size(items) != page_size, F.col(offset))).alias("_short"))
    kept = pages.crossJoin(F.broadcast(short)).where(F.col("_short").isNull() | (F.col(offset) <= F.col("_short")))  # one row
    out = kept.select(F.col(offset), F.posexplode(items).alias("pos", "item")).select(offset, "pos", "item.*")
    return out.withColumn("name", strip_newlines("name")) if "name" in out.columns else out


def sitemap_locs(text: Column) -> Column:
    """All <loc> contents; a dot doesn't cross lines, and entities stay as they are."""
    return F.regexp_extract_all(text, F.lit("<loc>(.*?)</loc>"), F.lit(1))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(sitemap_locs(F.col("value"))).alias("loc"))


def url_list(texts: DataFrame, column: str = "value") -> DataFrame:
    """pos, value (VARIANT) and kind of each element of JSON arrays; anything but an array is an error."""
    return texts.select(F.when(F.schema_of_variant(F.parse_json(column)).startswith("ARRAY"), F.parse_json(column)).otherwise(F.raise_error(F.lit("the list isn't a JSON array"))).alias("v")).lateralJoin(
        texts.sparkSession.tvf.variant_explode(F.col("v").outer())
    ).select("pos", "value", F.schema_of_variant("value").alias("kind"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_list(spark.read.text(path, wholetext=True))


def choose_inventory(urls: DataFrame, sitemap: DataFrame, use_sitemap: bool) -> DataFrame:
    return sitemap if use_sitemap else urls


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def image_height(content: Column) -> Column:
    """The height in a PNG's header; 0 for anything else."""
    png = F.substring(F.hex(content), 1, 16) == "89504E470D0A1A0A"
    height = F.conv(F.substring(F.hex(F.substring(content, 1, 24)), 41, 8), 16, 10).cast("int")
    return F.coalesce(F.when(png, height), F.lit(0))


def read_component_captures(spark: SparkSession, root: str) -> DataFrame:
    """side, folder, component, path, height of <root>/{prod,migrated}/<folder>/<name>_{prod,migrated}.png; no rows without files."""
    pattern = r"/(prod|migrated)/([^/]+)/([^/]+)_(prod|migrated)\.png\z"
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(root)
    except AnalysisException:
        return spark.createDataFrame([], "side string, folder string, component string, path string, height int")
    at = lambda k: F.regexp_extract("path", pattern, k)
    return files.where(F.col("path").rlike(pattern) & (at(1) == at(4))).select(at(1).alias("side"), at(2).alias("folder"), at(3).alias("component"), "path", image_height(F.col("content")).alias("height"))


def final_urls(tasks: DataFrame, redirects: DataFrame) -> DataFrame:
    """tasks (side, url, requested) with final_url: what redirect.txt says, trimmed, else what was requested."""
    return tasks.join(redirects.select("side", "url", F.regexp_replace("value", r"(?U)^\s+|\s+\z", "").alias("_final")), ["side", "url"], "left").withColumn("final_url", F.coalesce("_final", "requested")).drop("_final")


def read_final_urls(spark: SparkSession, root: str, tasks: DataFrame) -> DataFrame:
    """tasks (side, url, folder, requested) with final_url from <root>/<side>/<folder>/redirect.txt."""
    try:
        texts = spark.read.option("pathGlobFilter", "redirect.txt").option("recursiveFileLookup", True).text(root, wholetext=True)
        found = texts.select(*[F.regexp_extract("_metadata.file_path", r"/(prod|migrated)/([^/]+)/redirect\.txt\z", k).alias(c) for k, c in ((1, "side"), (2, "folder"))], "value")
    except AnalysisException:
        found = spark.createDataFrame([], "side string, folder string, value string")
    named = tasks.select("side", "url", "folder").join(found, ["side", "folder"]).select("side", "url", "value")
    return final_urls(tasks, named)


def media_lines(text: Column) -> Column:
    """The trimmed lines of a list, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def read_blocked_media(spark: SparkSession, root: str, tasks: DataFrame) -> DataFrame:
    """side, url, existed, media_url of <root>/<side>/<folder>/blocked-urls.txt for tasks (side, url, folder); a null media_url where there is none."""
    try:
        texts = spark.read.option("pathGlobFilter", "blocked-urls.txt").option("recursiveFileLookup", True).text(root, wholetext=True)
        found = texts.select(*[F.regexp_extract("_metadata.file_path", r"/(prod|migrated)/([^/]+)/blocked-urls\.txt\z", k).alias(c) for k, c in ((1, "side"), (2, "folder"))], media_lines(F.col("value")).alias("lines"))
    except AnalysisException:
        found = spark.createDataFrame([], "side string, folder string, lines array<string>")
    return tasks.join(found, ["side", "folder"], "left").select("side", "url", F.col("lines").isNotNull().alias("existed"), F.explode_outer("lines").alias("media_url"))


def ignore_rules(texts: DataFrame, column: str = "value") -> DataFrame:
    """url, component, percents (double) of JSON arrays of rules; what isn't an array of objects gives none, null elements are skipped."""
    v = F.try_parse_json(column)
    rules = texts.select(F.when(F.schema_of_variant(v).startswith("ARRAY"), v).alias("v")).where("v is not null").lateralJoin(texts.sparkSession.tvf.variant_explode(F.col("v").outer()))
    get = lambda k: F.try_variant_get("value", f"$.{k}", "string")
    return rules.where(~F.is_variant_null("value")).select(get("url").alias("url"), get("component").alias("component"), get("percents").try_cast("double").alias("percents"))


def read_ignore_rules(spark: SparkSession, json_text: str | None) -> DataFrame:
    return ignore_rules(spark.createDataFrame([(json_text,)], "value string"))
