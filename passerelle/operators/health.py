"""Link health: which pages and links are broken, by status or by what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passerelle.functions.text import PHRASES_404, PHRASES_500, contains_any
from passerelle.functions.urls import absolute_url, resolve_url, url_origin

CHECK = ("url", "ok", "status", "reason")
#: fixed values
SOFT_404 = "soft 404: visible page text contains 404-like content"
SOFT_500 = "soft 500: visible page text contains 500-like error content"
#: hrefs that are no links
SKIPPED = r"^(#|mailto:|tel:|javascript:)"


def validate_list(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a list's VARIANT values: strings that aren't blank, trimmed, as `url`; the others as check results."""
    text = F.try_variant_get("value", "$", "string")
    is_text = (F.schema_of_variant("value") == "STRING") & (F.trim(text) != "")
    good = values.where(is_text).select(F.trim(text).alias("url"))
    bad = values.where(~F.coalesce(is_text, F.lit(False))).select(F.coalesce(text, F.lit("null")).alias("url"), F.lit(False).alias("ok"), F.lit(0).alias("status"), F.lit("non-string or empty value in sitemap file").alias("reason"))
    return good, bad


def validate_urls(urls: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): resolved against the base; what can't be is a check result."""
    df = urls.withColumn("_u", resolve_url("url", F.lit(base)))
    good = df.where("_u is not null").select(F.col("_u").alias("url"))
    bad = df.where("_u is null").select("url", F.lit(False).alias("ok"), F.lit(0).alias("status"), F.lit("invalid URL value in sitemap file").alias("reason"))
    return good, bad


def distinct_pages(urls: DataFrame) -> DataFrame:
    return urls.dropDuplicates(["url"])


def page_links(links: DataFrame) -> DataFrame:
    """page, link: a page's distinct internal links, resolved against it, from (page_url, href). Queries and fragments count."""
    href = F.trim("href")
    df = links.where((href != "") & ~href.rlike(SKIPPED)).select(absolute_url("page_url").alias("page"), resolve_url(href, "page_url").alias("link"))
    return df.where(F.col("link").rlike("^https?://") & (url_origin("link") == url_origin("page"))).dropDuplicates(["page", "link"])


def check_targets(pages: DataFrame, links: DataFrame) -> DataFrame:
    """url, role (page or link): every listed page and one hop of links, each once; a page that is also a link is a page."""
    both = pages.select("url", F.lit("page").alias("role")).unionByName(links.select(F.col("link").alias("url"), F.lit("link").alias("role")))
    return both.groupBy("url").agg(F.max("role").alias("role"))


def resolve_attempts(log: DataFrame, retryable: Column, max_attempts: int, key: str = "url", order: tuple[str, ...] = ("ts", "attempt_id")) -> DataFrame:
    """The attempt that decides for each key, with `attempt` (from 1): the first that isn't retried, or the last that the policy allows.

    A log that ends before that gives its last attempt. No more than max_attempts rows of a key pass the shuffle
    from each task, so a key with very many attempts is no burden.
    """
    w = Window.partitionBy(key).orderBy(*order)
    first = log.withColumn("_again", F.coalesce(retryable, F.lit(False))).withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= max_attempts)
    row = F.struct(*[c for c in first.columns if c != "_again"])
    ended = ~F.col("_again") | (F.col("attempt") == max_attempts)
    best = first.groupBy(key).agg(F.coalesce(F.min_by(F.when(ended, row), F.when(ended, F.col("attempt"))), F.max_by(row, "attempt")).alias("_r"))
    return best.select("_r.*")


def resolve_http502(log: DataFrame) -> DataFrame:
    """Only status 502 is tried again, three times at most."""
    return resolve_attempts(log, F.col("status") == 502, 4)


def resolve_timeouts(log: DataFrame, error: str = "error") -> DataFrame:
    """Only timeouts, told by their message, are tried again, once."""
    return resolve_attempts(log, F.contains(F.lower(F.col(error)), F.lit("timeout")), 2)


def attempt_stats(log: DataFrame, ts: str = "ts") -> DataFrame:
    """url, attempts, microseconds from the first to the last, and the last one's status."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return log.groupBy("url").agg(
        F.count("*").alias("attempts"), (F.max(micros) - F.min(micros)).alias("micros"), F.max_by("status", F.struct(ts, "attempt_id")).alias("last_status")
    )


def classify_status(df: DataFrame) -> DataFrame:
    """df with ok and reason: below 400 is ok, 0 is a network error with its message."""
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    ok = (F.col("status") > 0) & (F.col("status") < 400)
    reason = F.when(ok, F.lit("")).when(F.col("status") == 0, F.coalesce(error, F.lit("network error"))).otherwise(F.concat(F.lit("HTTP status "), F.col("status").cast("string")))
    return df.withColumns({"ok": ok, "reason": reason})


def soft_errors(df: DataFrame) -> DataFrame:
    """Check results with pages that say 404 or 500 at status 200 marked as bad; needs ok, reason and visible_text."""
    seen = F.col("status") == 200
    soft = F.when(seen & contains_any("visible_text", PHRASES_404), F.lit(SOFT_404)).when(seen & contains_any("visible_text", PHRASES_500), F.lit(SOFT_500))
    return df.withColumns({"ok": F.col("ok") & soft.isNull(), "reason": F.coalesce(soft, "reason")})


def check_pages(captures: DataFrame) -> DataFrame:
    """url, ok, status, reason of captured pages (url, html, status)."""
    from passerelle.functions.text import parse_pages

    return soft_errors(classify_status(parse_pages(captures).drop("links"))).select(*CHECK)


def invalid_urls(checks: DataFrame) -> DataFrame:
    """url, status, reason of bad checks; a page that couldn't be reached has a second row for the fetch of its links."""
    bad = checks.where(~F.col("ok")).select("url", "status", "reason")
    if "role" not in checks.columns:
        return bad
    again = checks.where((F.col("role") == "page") & (F.col("status") == 0)).select("url", "status", F.concat(F.lit("failed to fetch page: "), F.col("reason")).alias("reason"))
    return bad.unionByName(again)


def health_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_distinct("url").alias("urls"), F.count_if(~F.col("ok")).alias("invalid"))
