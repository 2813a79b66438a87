"""Choosing comparable components from a table of DOM nodes.

Nodes: page, side, node_id, parent_id, ord (document order), tag, dom_id, classes (array), text, display, visibility, opacity,
position, width, height, and what with_intervals() adds: pre, the node's place in its page, and last, that of the last node below it.
So what is below a node has its places between these two, and whether something above a node has a property is a running maximum of
`last` in order of places: no pairs of nodes and ancestors are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from passerelle.functions.text import clean_text, component_name
from passerelle.sources.shared import written

PAGE = ["page", "side"]
#: fixed values
MEDIA = ("img", "video", "iframe", "canvas", "picture", "object", "embed", "input", "textarea", "select")
SHOEHORN = "full-width-shoehorn"


def intervals(nodes: DataFrame, root: int = 0, shown: bool = False) -> DataFrame:
    """nodes with pre and last, from parent_id, which is `root` or null at the top; with `shown` also `full`: whether a component of that node shows anything.

    One pass over the nodes of a page from its last to its first, so that whatever is below a node has come before it: of that only what its open parents need
    is kept, so memory is bounded by a tree's depth. Python gets numbers alone, and its rows stay in place: nothing is joined. A page whose nodes don't
    all meet their parent is an error: ord isn't document order, or a parent is missing.
    full: there is media that isn't hidden or text whose parent isn't below the node's first component-content child, or below the node if it has none.
    """
    flag = lambda c, bit: F.when(c, F.lit(bit)).otherwise(F.lit(0))
    marks = F.lit(0)
    if shown:
        text, media = F.when(F.col("tag") == "#text", clean_text("text") != ""), (F.col("tag") != "#text") & F.col("tag").isin(*MEDIA) & ~hidden()
        marks = flag(text, 1) + flag(media, 2) + flag(hidden(), 4) + flag(has_class("component-content"), 8)

    @F.pandas_udf(LongType())
    def ends(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        # of each parent that is still to come: its id, last, whether something shows below its children, whether one is text, whether the first content child shows, a child
        open_: list[list] = []
        for part in parts:
            done = []
            for at, node, parent, mark in zip(*[c.tolist() for c in part], strict=True):
                last, below, content = at, False, None
                if open_ and open_[-1][0] == node:
                    _, last, below, text, content, _ = open_.pop()
                    below = below or text and not mark & 4
                done.append(2 * last + (below if content is None else content))
                if not open_ or open_[-1][0] != parent:
                    open_.append([parent, last, False, False, None, node])
                if mark or below:
                    own = open_[-1]
                    own[2] = own[2] or below or bool(mark & 2)
                    own[3] = own[3] or bool(mark & 1)
                    if mark & 8:
                        own[4] = below
                if at == 0:
                    for p, *_, child in open_:
                        if p != root:
                            raise ValueError(f"node {child} stands before or without its parent {p}")
                    open_ = []
            yield pd.Series(done, dtype="int64")

    pre = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord", "node_id")) - 1
    placed = nodes.repartition(*PAGE).withColumns({"pre": pre.cast("long"), "_marks": marks}).sortWithinPartitions(*PAGE, F.desc("pre"))
    end = ends.asNondeterministic()("pre", "node_id", F.coalesce("parent_id", F.lit(root)), "_marks")
    out = placed.withColumn("_end", end).withColumn("last", F.shiftright("_end", 1))
    if shown:
        out = out.withColumn("full", F.col("_end") % 2 == 1)
    return out.drop("_end", "_marks")


def with_intervals(nodes: DataFrame, root: int = 0) -> DataFrame:
    """nodes with pre and last. Written once: every later step reads them."""
    return written(intervals(nodes, root), "nodes")


def inside(what: Column) -> Column:
    """Whether the node is below one that `what` holds for."""
    before = Window.partitionBy(*PAGE).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(what, F.col("last"))).over(before) >= F.col("pre"), F.lit(False))


def around(what: Column) -> Column:
    """Whether a node below this one is such that `what` holds for it."""
    behind = Window.partitionBy(*PAGE).orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.min(F.when(what, F.col("pre"))).over(behind) <= F.col("last"), F.lit(False))


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains("classes", name), F.lit(False))


def is_component() -> Column:
    return (F.col("tag") == "div") & has_class("component")


def drop_subtree(nodes: DataFrame, dom_id: str = SHOEHORN) -> DataFrame:
    """Without the nodes of that id and everything below them."""
    gone = F.coalesce(F.col("dom_id") == dom_id, F.lit(False))
    return nodes.withColumn("_gone", gone | inside(gone)).where("not _gone").drop("_gone")


def pick_scope(nodes: DataFrame) -> DataFrame:
    """page, side, scope, pre, last: the node in main (else body) where components are looked for; the sides prefer different ones."""
    own = F.struct("node_id", "pre", "last")
    main = nodes.where(F.col("tag").isin("main", "body")).groupBy(*PAGE).agg(F.min_by(own, F.struct((F.col("tag") != "main"), "ord")).alias("main"))
    row = has_class("row") & inside(F.coalesce(F.col("dom_id") == "content", F.lit(False)))
    kind = F.when(F.col("_row"), "row").when(F.col("dom_id") == "content", "content").when(F.col("dom_id") == "content-shoehorned", "shoehorned")
    rank = F.when(F.col("side") == "stage", F.when(kind == "row", 0).when(kind == "content", 1).when(kind == "shoehorned", 2)).otherwise(F.when(kind == "shoehorned", 0).when(kind == "row", 1).when(kind == "content", 2))
    ranked = nodes.withColumn("_row", row).withColumn("_rank", rank).where("_rank is not null").join(main, PAGE).where("pre > main.pre and pre <= main.last")
    best = ranked.groupBy(*PAGE).agg(F.min_by(own, F.struct("_rank", "ord")).alias("best"))
    chosen = F.coalesce("best", "main")
    return main.join(best, PAGE, "left").select(*PAGE, chosen["node_id"].alias("scope"), chosen["pre"].alias("pre"), chosen["last"].alias("last"))


def candidates(nodes: DataFrame, scope: DataFrame) -> DataFrame:
    """Components in scope: direct children on stage, all descendants on prod."""
    of = scope.select(*PAGE, "scope", F.col("pre").alias("_from"), F.col("last").alias("_to"))
    comps = nodes.where(is_component()).join(of, PAGE)
    here = F.when(F.col("side") == "stage", F.col("parent_id") == F.col("scope")).otherwise((F.col("pre") > F.col("_from")) & (F.col("pre") <= F.col("_to")))
    return comps.where(here).drop("scope", "_from", "_to")


def top_level(cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates without a component above them, in scope or not."""
    comps = nodes.where(is_component()).select(*PAGE, "node_id", "pre", "last").withColumn("_nested", inside(F.lit(True)))
    return cands.join(comps.where("_nested").select(*PAGE, "node_id"), [*PAGE, "node_id"], "left_anti")


def hidden() -> Column:
    """By the node's own style alone."""
    return F.coalesce((F.col("display") == "none") | (F.col("visibility") == "hidden") | (F.col("opacity") == 0), F.lit(False))


def meaningful(nodes: DataFrame, cands: DataFrame) -> DataFrame:
    """page, side, node_id of candidates that show media or text below their content."""
    inner = nodes.where(has_class("component-content")).select(*PAGE, F.col("parent_id").alias("node_id"), F.struct("ord", F.col("node_id").alias("id")).alias("c"))
    first = cands.select(*PAGE, "node_id").join(inner, [*PAGE, "node_id"], "left").groupBy(*PAGE, "node_id").agg(F.min("c")["id"].alias("content"))
    root = first.select(*PAGE, "node_id", F.coalesce("content", "node_id").alias("root"))
    parents = nodes.where(hidden()).select(*PAGE, F.col("node_id").alias("parent_id"), F.lit(True).alias("_off"))
    seen = F.when(F.col("tag") == "#text", (clean_text("text") != "") & F.col("_off").isNull()).otherwise(F.col("tag").isin(*MEDIA) & ~hidden())
    shows = nodes.join(parents, [*PAGE, "parent_id"], "left").select(*PAGE, F.col("node_id").alias("root"), "pre", "last", F.coalesce(seen, F.lit(False)).alias("_seen")).withColumn("_shows", around(F.col("_seen")))
    return root.join(shows.where("_shows").select(*PAGE, "root"), [*PAGE, "root"], "left_semi").select(*PAGE, "node_id")


def classify_components(cands: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """cands with `state`: hidden, fixed, invisible, empty or kept, the first that holds. full: what meaningful() gives; without it cands have it as a column."""
    if full is None:
        df = cands.withColumn("_full", F.when(F.col("full"), F.lit(True)))
    else:
        df = cands.join(full.withColumn("_full", F.lit(True)), [*PAGE, "node_id"], "left")
    state = (
        F.when((F.col("display") == "none") | (F.col("visibility") == "hidden"), "hidden")
        .when(F.col("position") == "fixed", "fixed")
        .when((F.col("width") == 0) | (F.col("height") == 0), "invisible")
        .when(F.col("_full").isNull(), "empty")
        .otherwise("kept")
    )
    return df.withColumn("state", state).drop("_full")


def classified(nodes: DataFrame) -> DataFrame:
    """All components of a page that have none above them, classified. nodes: of intervals() with `shown`. Components alone are shuffled, nothing is joined."""
    comps = nodes.where(is_component()).withColumn("_nested", inside(F.lit(True)))
    return classify_components(comps.where("not _nested").drop("_nested"))


def name_components(classified: DataFrame) -> DataFrame:
    """The kept ones with `component`, numbered from 0 in document order."""
    w = Window.partitionBy(*PAGE).orderBy("ord", "node_id")
    return classified.where("state = 'kept'").withColumn("component", component_name(F.row_number().over(w) - 1))


def component_stats(classified: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """page, side and the counters; total is what is left once nested ones are gone."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    out = classified.groupBy(*PAGE).agg(F.count("*").alias("total"), *[count(s) for s in ("hidden", "fixed", "invisible", "empty", "kept")])
    if nested is None:
        return out
    return out.join(nested.groupBy(*PAGE).agg(F.count("*").alias("nested")), PAGE, "full").na.fill(0)


def pages_without_components(nodes: DataFrame) -> DataFrame:
    """page, side without a main element or without a candidate in scope, nested ones counted."""
    pages = nodes.select(*PAGE).distinct()
    ready = candidates(nodes, pick_scope(nodes)).join(nodes.where("tag = 'main'").select(*PAGE).distinct(), PAGE, "left_semi").select(*PAGE).distinct()
    return pages.join(ready, PAGE, "left_anti")
