"""URL inventories: expanding site routes, reading sitemaps, and the difference of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passerelle.functions.urls import normalize_loc, replace_first, resolve_url, search_url, url_pathname

#: fixed values: which entry type fills a route parameter
TYPE_OF = (
    ("articles", "articleDetail"),
    ("conference", "conferencesDetail"),
    ("od-ls", "onlineTrainingDetail"),
    ("webinars", "webinarsDetail"),
    ("od-ls-watch-page", "onlineTrainingDetail"),
    ("hardGoodDetail", "hardGoodDetail"),
    ("speaker", "personDetail"),
)
PRODUCT = "HardGoodDetail"


def composed_nodes(nodes: DataFrame) -> DataFrame:
    """path of the nodes that have a composition."""
    return nodes.where(F.col("composition_id").isNotNull() & (F.col("composition_id") != "")).select("path")


def drop_redirected(paths: DataFrame, redirects: DataFrame) -> DataFrame:
    """Paths that are no redirect's source."""
    return paths.join(redirects.select(F.col("source_url").alias("path")), "path", "left_anti")


def route_param(path: Column) -> Column:
    """What follows the last colon, without one trailing slash."""
    return F.regexp_replace(F.substring_index(path, ":", -1), r"/\z", "")


def classify_routes(paths: DataFrame) -> DataFrame:
    """path, route (without the first /:locale), dynamic, param."""
    route = replace_first("path", "/:locale", "")
    return paths.select("path", route.alias("route"), F.contains(route, F.lit(":")).alias("dynamic"), route_param(F.col("path")).alias("param"))


def expand_routes(routes: DataFrame, entries: DataFrame, type_map: DataFrame, missing_slug: str | None = None) -> DataFrame:
    """A row per dynamic route and entry of its parameter's type, with `url`: the slug stands for the first :param.

    A parameter that the map lacks takes the entries without a type. Entries without a slug are dropped, or get `missing_slug`.
    """
    typed = routes.where("dynamic").join(F.broadcast(type_map.withColumnRenamed("type", "_type")), "param", "left")
    found = typed.join(entries.select("type", "slug"), typed["_type"].eqNullSafe(entries["type"]))
    slug = F.coalesce("slug", F.lit(missing_slug)) if missing_slug is not None else F.col("slug")
    return found.withColumn("url", replace_first("route", F.concat(F.lit(":"), F.col("param")), slug)).where("url is not null").select("path", "url")


def product_search_urls(entries: DataFrame, base: str) -> DataFrame:
    return entries.where((F.col("type") == PRODUCT) & F.col("slug").isNotNull()).select(search_url(base, "slug").alias("href"))


def build_inventory(nodes: DataFrame, redirects: DataFrame, entries: DataFrame, type_map: DataFrame, base: str) -> DataFrame:
    """url: the paths of all distinct addresses, static, expanded and product searches. A bag: addresses may share a path."""
    routes = classify_routes(drop_redirected(composed_nodes(nodes), redirects))
    of = lambda df, c: df.select(resolve_url(c, F.lit(base)).alias("href"))
    hrefs = of(routes.where("not dynamic"), "route").unionByName(of(expand_routes(routes, entries, type_map), "url")).unionByName(product_search_urls(entries, base))
    return hrefs.where("href is not null").distinct().select(url_pathname("href").alias("url"))


def inventory_counts(nodes: DataFrame, redirects: DataFrame, entries: DataFrame, type_map: DataFrame, base: str) -> DataFrame:
    """what, n: entries, paths, valid paths, products, urls, and entries of each type."""
    paths = composed_nodes(nodes)
    parts = {
        "entries": entries,
        "paths": paths,
        "valid paths": drop_redirected(paths, redirects),
        "products": product_search_urls(entries, base),
        "urls": build_inventory(nodes, redirects, entries, type_map, base),
    }
    out = entries.groupBy(F.concat(F.lit("type "), F.coalesce("type", F.lit("none"))).alias("what")).agg(F.count("*").alias("n"))
    for name, df in parts.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n"))
    return out


def sitemap_inventory(locs: DataFrame) -> DataFrame:
    """url of each loc, as a bag; / is added if no loc gives it."""
    urls = locs.select(url_pathname(normalize_loc("loc")).alias("url"))
    root = locs.sparkSession.range(1).select(F.lit("/").alias("url"))
    return urls.unionByName(root.join(urls.where("url = '/'"), "url", "left_anti"))


def inventory_diff(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("urls.json", "urls-sitemap.json")) -> DataFrame:
    """url, source: rows of one inventory that the other lacks, repeats kept."""
    only = lambda x, y, name: x.select("url").join(y.select("url").distinct(), "url", "left_anti").select("url", F.lit(name).alias("source"))
    return only(a, b, names[0]).unionByName(only(b, a, names[1]))


def order_diff(df: DataFrame) -> DataFrame:
    """By source, length and url, in the order of the root locale."""
    return df.orderBy(F.collate("source", "UNICODE"), F.length("url"), F.collate("url", "UNICODE"))
