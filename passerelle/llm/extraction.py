"""The main text of web pages, by their mark-up and by a style tree of each host.

A page's elements are named by their path of tags, classes and ids. What its mark-up calls a menu, footer, advert, form or comment goes, and where
there are article or main elements only these stay. The rest of all pages of a host is merged to one tree by these paths. A node's content importance is
1 less the mean entropy of its texts over the pages, its presentation importance the entropy of the sequences of its child elements; what each page
has alike is of no importance. A branch that holds nothing of importance, on enough different pages, is removed from each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from passerelle.functions.tree import CLOSE_P, HEADINGS, TABLE_PARTS, Node, Tree
from passerelle.llm.common import read, row_key, shared_dir, written

#: A branch goes if no node in it reaches LOW; nodes that stand on fewer than PAGES different pages of a host tell nothing.
LOW, PAGES = 0.25, 5
BLOCK = CLOSE_P | TABLE_PARTS | frozenset("body button caption fieldset figcaption html iframe legend optgroup option select textarea".split())
#: fixed values: elements and the words of classes, ids and roles that aren't the article
UNSEEN = frozenset("aside button canvas dialog embed footer form head iframe input menu nav noscript object script select style svg template textarea".split())
CHROME = frozenset(
    """ad ads adsense advert adverts advertisement advertising adslot alert banner billboard breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright
    dialog discussion disqus dropdown feedback footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall
    popup promo promoted promotion reactions recommended related replies reply respond search share sharing sidebar signin signup skip skyscraper social sponsor sponsored subscribe subscription toast toolbar widget widgets""".split()
)
MAIN = frozenset(("article", "main"))
WORD = r"[A-Z]?[a-z]+|[A-Z]+"


@lru_cache(10_000)
def named(tag: str, classes: str, own_id: str, role: str) -> tuple[str, bool]:
    """(the name of an element in its path, whether it is named as no part of the article).

    The name has the tag, classes and id, without an id's digits and numbers of three digits and more, which tell pages apart and not their parts.
    """
    style = " ".join(sorted(re.sub(r"\d{3,}", "", classes).split())) + re.sub(r"\d+", "", own_id)
    words = {w.lower() for w in re.findall(WORD, f"{classes} {own_id} {role}")}
    return f"{tag}.{style}", tag not in ("html", "body") and not words.isdisjoint(CHROME)


@lru_cache(100_000)
def key_of(above: int, name: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{above}/{name}") - (1 << 63)


class Article(Tree):
    """The blocks of a page with the paths that they stand on. An element's mark: (key of its path, whether it is plain mark-up, whether it is no part of the article)."""

    def insert(self, tag: str, attrs: dict[str, str | None], inside: bool = False) -> Node:
        node = super().insert(tag, attrs, inside)
        if tag == "br":
            self.put(" ")
        elif tag in BLOCK:
            self.pieces.append([node, None])
        return node

    def mark(self, parent: Node | None, tag: str, attrs: dict[str, str | None]) -> tuple[int, bool, bool]:
        above, plain, _ = parent.mark if parent is not None else (0, True, False)
        if not attrs:
            return key_of(above, tag), plain, tag in UNSEEN
        name, chrome = named(tag, attrs.get("class") or "", attrs.get("id") or "", attrs.get("role") or "")
        style = (attrs.get("style") or "").replace(" ", "").lower()
        off = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        return key_of(above, name), plain and (tag in MAIN or name == f"{tag}."), chrome or off or tag in UNSEEN

    def is_main(self, node: Node) -> bool:
        return (node.tag in MAIN or node.attrs.get("role") == "main" or node.attrs.get("itemprop") == "articleBody") and not node.mark[2]

    def chains(self) -> dict[Node, list[Node]]:
        """Each element that holds text, and each above it, with the elements from the root down to it."""
        found: dict[Node, list[Node]] = {}
        for node, _ in self.pieces:
            todo = []
            while node is not None and node not in found:
                todo.append(node)
                node = node.parent
            for x in reversed(todo):
                found[x] = (found[x.parent] if x.parent is not None else []) + [x]
        return found

    def around_main(self, chains: dict[Node, list[Node]]) -> tuple[bool, set[int]]:
        """(Whether there are main elements with text, the numbers of the longest one and what it is in). Else of the title that the fewest names surround."""
        mains = {node: [x for x in chain if self.is_main(x)] for node, chain in chains.items()}
        sizes: dict[Node, int] = {}
        for node, text in self.pieces:
            for x in mains[node] if text else ():
                sizes[x] = sizes.get(x, 0) + len(text)
        if sizes:
            return True, {x.number for x in chains[max(sizes, key=lambda n: (sizes[n], -n.number))]}
        titles = [c for n, c in chains.items() if n.tag in HEADINGS and not any(x.tag in UNSEEN or x.tag == "header" for x in c)]
        return False, {x.number for x in min(titles, key=lambda c: sum(x.mark[2] for x in c), default=[])}

    def staying(self, chains: dict[Node, list[Node]]) -> set[Node]:
        """The elements that are in nothing that is no part of the article; a header is part of one if it has its title."""
        has_main, around = self.around_main(chains)
        titled = {x for node, chain in chains.items() if node.tag in ("h1", "h2") for x in chain}
        state: dict[Node, tuple[bool, bool]] = {}  # in a main element, gone
        for node in chains:
            main, gone = state[node.parent] if node.parent is not None else (False, False)
            main = main or self.is_main(node)
            if not gone and node.mark[2]:
                gone = node.number not in around or node.tag in UNSEEN
            if not gone and node.tag == "header":
                gone = node.number not in around and not (main and node in titled)
            state[node] = main, gone
        return {node for node, (main, gone) in state.items() if not gone and (main or not has_main)}

    def blocks(self) -> tuple[list[tuple[list[int], str]], list[tuple[list[int], int, bool]]]:
        """([(path, text)], [(path, digest of the child elements, plain)]) of what the mark-up leaves."""
        import xxhash

        chains = self.chains()
        stay = self.staying(chains)
        found: list[tuple[Node, list[str]]] = []
        kids: dict[Node, list[int]] = {}
        last = None  # the element that the block at hand is in
        for node, text in self.pieces:
            block = node
            while block.tag not in BLOCK:
                block = block.parent
            if node not in stay:
                if text is None or block is node:
                    last = None
                continue
            new = []
            x = node
            while x is not None and x not in kids:
                new.append(x)
                x = x.parent
            for x in reversed(new):
                kids[x] = []
                if x.parent is not None:
                    kids[x.parent].append(x.mark[0])
            if text is None:
                last = None
            elif last == block.number:
                found[-1][1].append(text)
            else:
                found.append((block, [text]))
                last = block.number
        path = lambda node: [x.mark[0] for x in chains[node]]
        texts = [(path(block), t) for block, parts in found if (t := " ".join("".join(parts).split()))]
        styles: dict[int, tuple[list[int], int, bool]] = {}
        for node, own in kids.items():
            if node.mark[0] not in styles:
                shape = [k for k, _ in groupby(own)]
                styles[node.mark[0]] = (path(node), xxhash.xxh64_intdigest(repr(shape)) - (1 << 63), node.mark[1])
        return texts, list(styles.values())


PATH = StructField("path", ArrayType(LongType()))
BLOCKS = ArrayType(StructType([PATH, StructField("text", StringType())]))
NODES = ArrayType(StructType([PATH, StructField("style", LongType()), StructField("plain", BooleanType())]))


@F.pandas_udf(StructType([StructField("blocks", BLOCKS), StructField("nodes", NODES)]))
def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for html in part:
            page = Article()
            page.feed(html or "")
            page.close()
            texts, nodes = page.blocks()
            rows.append(([{"path": p, "text": t} for p, t in texts], [{"path": p, "style": s, "plain": plain} for p, s, plain in nodes]))
        yield pd.DataFrame(rows, columns=["blocks", "nodes"])


def unimportant(pages: DataFrame, low: float = LOW, least: int = PAGES) -> DataFrame:
    """host, node: the branches of each host's style tree without a node of importance `low`. pages: host, blocks, nodes; null hosts have no tree.

    Pages of a host with the same blocks count once. Counts by (host, node, text) and (host, node, style) are made before the shuffle, so that a
    host with any number of pages is spread over tasks.
    """
    features = F.array_distinct(F.transform("blocks", lambda b: F.struct(F.element_at(b["path"], -1).alias("node"), F.xxhash64(b["text"]).alias("text"))))
    once = pages.where("host is not null").select("host", F.xxhash64("blocks").alias("digest"), features.alias("texts"), "nodes")
    once = written(once.groupBy("host", "digest").agg(F.first("texts").alias("texts"), F.first("nodes").alias("nodes")).drop("digest"), "different-pages")
    nodes = once.select("host", F.explode("nodes").alias("n")).select("host", F.element_at("n.path", -1).alias("node"), "n.path", "n.style", "n.plain")
    styles = nodes.groupBy("host", "node", "style").agg(F.count("*").alias("k"), F.first("path").alias("path"), F.bool_or("plain").alias("plain"))
    total = F.sum("k")
    presented = styles.groupBy("host", "node").agg(total.alias("m"), F.first("path").alias("path"), F.bool_or("plain").alias("plain"), (F.log(total) - F.sum(F.col("k") * F.log("k")) / total).alias("spread"))
    texts = once.select("host", F.explode("texts").alias("t")).groupBy("host", "t.node", "t.text").agg(F.count("*").alias("k"))
    held = texts.groupBy("host", "node").agg(F.avg(F.log("k")).alias("alike"))
    rated = presented.join(held, ["host", "node"], "left")
    several = F.col("m") > 1
    importance = F.when(F.col("plain") | ~several, F.lit(1.0)).otherwise(F.greatest(F.col("spread") / F.log("m"), F.coalesce(1 - F.col("alike") / F.log("m"), F.lit(0.0))))
    rated = written(rated.select("host", "node", "m", "path", importance.alias("importance")), "style-tree")
    branches = rated.select("host", F.explode("path").alias("node"), "importance").groupBy("host", "node").agg(F.max("importance").alias("most"))
    return branches.where(F.col("most") < low).join(rated.where(F.col("m") >= least).select("host", "node"), ["host", "node"], "left_semi").select("host", "node")


def packed(df: DataFrame) -> DataFrame:
    """df as Parquet with Zstandard in the shared folder: texts, so that size matters."""
    path = shared_dir(df.sparkSession, "blocks")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", low: float = LOW, least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each row: its blocks in page order, joined by two line ends.

    Null and empty html have an empty text, and so have pages without any text. Rows with a null url, or one without host, have no style tree and keep all
    that their mark-up leaves; a page of which the style tree would leave nothing keeps all of it too. Repeated rows have the same text. Other
    columns are not read.
    """
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.when(host != "", host).alias("host"), row_key(page_id, url, html).alias("key"), parsed(F.col(html)).alias("p"))
    own = packed(own.select("page_id", "url", "host", "key", "p.blocks", "p.nodes"))
    low_ = unimportant(own, low, least)
    gone = own.where("host is not null").select("host", "key", F.explode("nodes").alias("n")).select("host", "key", F.element_at("n.path", -1).alias("node"))
    gone = written(gone.join(low_, ["host", "node"]).groupBy("key").agg(F.collect_set("node").alias("gone")), "gone")  # so that its size decides how it is joined
    left = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.arrays_overlap(b["path"], F.col("gone"))))
    out = own.drop("nodes").join(gone, "key", "left").withColumn("left", left)
    kept = F.when(F.size("left") > 0, F.col("left")).otherwise(F.col("blocks"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
