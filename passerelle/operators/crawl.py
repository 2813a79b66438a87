"""The crawl closure over a captured link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from passerelle.functions.text import parse_pages
from passerelle.functions.urls import resolve_url, strip_qf, url_pathname
from passerelle.sources.shared import shared_dir, written


def anchor_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """page_url, pos, href of every a[href] in document order."""
    return parse_pages(pages.select(F.col(url).alias("page_url"), html), html).select("page_url", F.posexplode("links").alias("pos", "href"))


def crawl_links(links: DataFrame, origin: str) -> DataFrame:
    """links with target: the href against the site's origin, without query and fragment; null if malformed."""
    return links.withColumn("target", strip_qf(resolve_url("href", F.lit(origin))))


def same_site(c: Column, origin: str, strict: bool = False) -> Column:
    """By prefix of the origin, with or without www. strict: the host must end there, which the prefix test doesn't ask."""
    www = origin.replace("://", "://www.", 1)
    if not strict:
        return c.startswith(origin) | c.startswith(www)
    return F.regexp_extract(c, r"^(https?://[^/?#]*)", 1).isin(origin, www)


def truncate_at_malformed(links: DataFrame) -> DataFrame:
    """Of each page the links before its first malformed one."""
    first = F.min(F.when(F.col("target").isNull(), F.col("pos"))).over(Window.partitionBy("page_url"))
    return links.withColumn("_bad", first).where(F.col("_bad").isNull() | (F.col("pos") < F.col("_bad"))).drop("_bad")


def edges(links: DataFrame, origin: str, strict: bool = False) -> DataFrame:
    """page_url, target: the distinct same-site links that a crawl follows."""
    kept = truncate_at_malformed(crawl_links(links, origin))
    return kept.where(same_site(F.col("target"), origin, strict)).select("page_url", "target").distinct()


def merged(df: DataFrame) -> DataFrame:
    """df for a join that sorts and merges at any size: broadcasts of each round would add up in the driver."""
    return df.hint("merge")


class UnfinishedCrawl(RuntimeError):
    """The rounds that were allowed are over; the state goes on from there."""


ROUND = "url string, linked boolean, new boolean, todo boolean"


def _rounds(spark: SparkSession, state: str) -> list[int]:
    """The rounds that were finished: a round's marker is written after its rows."""
    try:
        return sorted(r[0] for r in spark.read.schema("number int").option("recursiveFileLookup", True).parquet(f"{state}/done").select("number").distinct().collect())
    except AnalysisException:
        return []


def _kept(spark: SparkSession, state: str, rounds: list[int]) -> DataFrame:
    return spark.read.schema(ROUND).parquet(*[f"{state}/rounds/{n}" for n in rounds])


def chains(reach: DataFrame, starts: DataFrame, most_rounds: int = 40) -> DataFrame:
    """head, url: pages that only one page leads to, which leads nowhere else, and the page at the front of such a chain.

    Who visits the head visits all of them. starts (url) are never inside a chain, as crawls begin there. What a page is behind doubles each round,
    so a chain of length n takes log n joins; rings that nothing leads into have no head and are left out.
    """
    leads = reach.groupBy("page_url").agg(F.max("target").alias("url"), F.count("*").alias("n")).where("n = 1").select(F.col("page_url").alias("head"), "url")
    led = reach.groupBy("target").agg(F.count("*").alias("n")).where("n = 1").select(F.col("target").alias("url"))
    links = written(leads.where("head <> url").join(merged(led), "url").join(merged(starts), "url", "left_anti").select("head", "url"), "chains")
    if not links.head(1):
        return links
    for _ in range(most_rounds):
        ahead = links.select(F.col("head").alias("_head"), F.col("url").alias("head"))
        step = links.join(merged(ahead), "head", "left")
        links = written(step.select(F.coalesce("_head", "head").alias("head"), "url", F.col("_head").isNotNull().alias("moved")), "chains")
        if not links.where("moved").head(1):
            break
        links = links.drop("moved")
    return links.join(merged(links.select(F.col("url").alias("head"))), "head", "left_anti").select("head", "url")


def crawl_closure(links: DataFrame, seed: str, origin: str | None = None, state: str | None = None, strict: bool = False, most_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(urls, visited): what is reachable from the seed within `origin`, which is the seed itself if not given.

    Each round visits a whole frontier, and the chains behind it; order doesn't change the closure. Pages that weren't captured are visited and have no
    links. urls holds link targets, so the seed only if something links to it. A round is one table below `state`, a shared folder (a new one if
    not given), and then its marker; a later call with the same `state` goes on after the last finished round, wherever the crawl was stopped.
    After 2, 8, 32 and more rounds, links to and from what is done are dropped and the chains of the rest found anew: so links are read less and
    less, and pages that lead on and to a menu only are a chain once the menu is visited.
    """
    spark = links.sparkSession
    state = (state or shared_dir(spark, "crawl")).rstrip("/")
    reach = written(edges(links, (origin or seed).rstrip("/"), strict), "edges")
    rounds = _rounds(spark, state)

    def put(df: DataFrame) -> None:
        number = rounds[-1] + 1 if rounds else 0
        df.write.mode("overwrite").parquet(f"{state}/rounds/{number}")
        spark.range(1, numPartitions=1).select(F.lit(number).alias("number")).write.mode("overwrite").parquet(f"{state}/done/{number}")
        rounds.append(number)

    if not rounds:
        put(spark.createDataFrame([(seed, False, True, True)], ROUND).coalesce(1))
    behind, compact = None, 2
    for number in range(most_rounds):
        frontier = _kept(spark, state, rounds[-1:]).where("todo").select("url")
        if not frontier.head(1):
            break
        visited = _kept(spark, state, rounds).where("new").select("url")
        if number == compact:
            compact *= 4
            done = visited.join(merged(frontier), "url", "left_anti").select(F.col("url").alias("page_url"))
            known = _kept(spark, state, rounds).where("linked").select(F.col("url").alias("target"))
            reach = written(reach.join(merged(done), "page_url", "left_anti").join(merged(known), "target", "left_anti").select("page_url", "target"), "edges")
            behind = written(chains(reach, visited.distinct()), "behind")
            behind = behind if behind.head(1) else None
        pages, inner = frontier, None
        if behind is not None:
            inner = behind.join(merged(frontier.select(F.col("url").alias("head"))), "head", "left_semi").select("url", F.lit(True).alias("_inner"))
            pages = frontier.unionByName(inner.select("url"))
        found = reach.join(merged(pages), reach["page_url"] == pages["url"], "left_semi").select(F.col("target").alias("url")).distinct()
        found = found.join(merged(visited.select("url", F.lit(True).alias("_old"))), "url", "left")
        found = found.join(merged(inner), "url", "left") if inner is not None else found.withColumn("_inner", F.lit(None).cast("boolean"))
        put(found.select("url", F.lit(True).alias("linked"), F.col("_old").isNull().alias("new"), (F.col("_old").isNull() & F.col("_inner").isNull()).alias("todo")))
    else:
        raise UnfinishedCrawl(f"the crawl didn't end in {most_rounds} rounds")
    seen = _kept(spark, state, rounds)
    return seen.where("linked").select("url").distinct(), seen.where("new").select("url")


def crawl_errors(visited: DataFrame, pages: DataFrame) -> DataFrame:
    """url, error of visited pages that weren't captured or failed."""
    failed = pages.where("error is not null").select("url", "error")
    absent = visited.join(merged(pages.select("url")), "url", "left_anti").withColumn("error", F.lit("not captured"))
    return absent.unionByName(visited.join(merged(failed), "url").select("url", "error")).distinct()


def crawl_inventory(urls: DataFrame, relativize: bool = False) -> DataFrame:
    """The distinct URLs, sorted; relativize leaves their paths, for use on another host."""
    return urls.select((url_pathname("url") if relativize else F.col("url")).alias("url")).distinct().orderBy("url")
