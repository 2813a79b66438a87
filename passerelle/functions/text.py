"""Text, number and label columns, and the one Python step that reads HTML."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passerelle.functions.tree import Node, Tree

Str = Column | str
#: fixed values
PHRASES_404 = ("404 error", "not found", "page not found", "page you are looking for")
PHRASES_500 = ("500 error", "internal server error", "server error")
WARNING, ERROR = "rgb(250, 204, 21)", "rgb(217, 83, 79)"
RANKS = {"critical-diff": 7, "major-diff": 6, "medium-diff": 5, "minor-diff": 4, "extra-in-migrated": 3, "ignored-diff": 2, "not compared": 1}
UNSEEN = ("script", "style", "noscript", "template", "iframe", "svg", "canvas")
#: Pages that a Python worker has as objects at a time.
ROWS = 64
HIDING = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")


def col(c: Str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c: Str) -> Column:
    """Each run of white space, Unicode's too, is one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)[\s﻿]+", " "))


def clean_text(c: Str) -> Column:
    """Without zero-width characters, with plain spaces, trimmed."""
    bare = F.replace(F.regexp_replace(col(c), "[​-‍﻿]", ""), F.lit(" "), F.lit(" "))
    return F.regexp_replace(bare, r"(?U)^\s+|\s+\z", "")


def strip_newlines(c: Str) -> Column:
    return F.translate(col(c), "\n", "")


def contains_any(c: Str, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases occurs, case aside; null is false."""
    low = F.lower(col(c))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p.lower()))
    return F.coalesce(out, F.lit(False))


def last_integer(c: Str) -> Column:
    """The last run of digits as a number; null without one."""
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(r"[0-9]+"), F.lit(0)), F.lit(-1)).try_cast("int")


def case_title(prefix: str, index: Str, name: Str, item_id: Str) -> Column:
    return F.concat(F.lit(f"{prefix}#"), col(index).cast("string"), F.lit(": "), col(name), F.lit(", "), col(item_id))


def parse_case_title(c: Str) -> Column:
    """struct(name, id) of a title; null where it doesn't fit, an empty name included."""
    ok, pattern = col(c).rlike(r": .+, .+"), r": (.+), (.+)"
    return F.when(ok, F.struct(F.regexp_extract(col(c), pattern, 1).alias("name"), F.regexp_extract(col(c), pattern, 2).alias("id")))


def severity_from_color(c: Str) -> Column:
    """warning or error; `unexpected` for any other colour; null for none."""
    c = col(c)
    return F.when(c == WARNING, "warning").when(c == ERROR, "error").when(c.isNotNull(), "unexpected")


def diff_tag(c: Str) -> Column:
    """The class of a mismatch in percent; NaN counts as critical."""
    c = col(c)
    return F.when(c.isNull(), "not compared").when(c == 0, "perfect-match").when(c <= 1, "minor-diff").when(c <= 5, "medium-diff").when(c <= 20, "major-diff").otherwise("critical-diff")


def tag_rank(c: Str) -> Column:
    """How bad a tag is; unknown ones are 0."""
    ranks = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.lower(col(c))), F.lit(0))


def to_fixed2(c: Str) -> Column:
    """Two decimals of the exact binary value, ties away from zero, as text; null and NaN give `NaN`.

    100 * x is taken with its rounding error (Veltkamp's and Dekker's exact product), which tells values below a tie from those on it.
    Values of 2^45 and more have no third decimal.
    """
    value = col(c).cast("double")
    x = F.abs(value)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * 100.0
    error = (high * 100.0 - product) + (x - high) * 100.0
    part = product - F.floor(product)
    n = F.floor(product) + F.when((part > 0.5) | ((part == 0.5) & (error >= 0)), 1).otherwise(0)
    digits = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(value.isNull() | F.isnan(value), F.lit("NaN")).when(x >= float(1 << 45), F.format_string("%.2f", value)).otherwise(digits)


def reported(c: Str) -> Column:
    """A number as reports give it: the value of its two decimals; null stays null, and NaN."""
    value = col(c).cast("double")
    return F.when(F.isnan(value), value).otherwise(F.when(value.isNotNull(), to_fixed2(value).cast("double")))


def component_role(c: Str) -> Column:
    """struct(header, footer): both may hold."""
    low = F.lower(col(c))
    return F.struct(F.contains(low, F.lit("header")).alias("header"), F.contains(low, F.lit("footer")).alias("footer"))


def crop_height(c: Str, most: int = 9000) -> Column:
    return F.least(col(c), F.lit(most))


def component_name(i: Str) -> Column:
    """component-00, component-01, ... component-100: padded, never cut."""
    return F.format_string("component-%02d", col(i))


def detail_line(component: Str, mismatch: Str, tag: Str) -> Column:
    m = F.when(col(mismatch).isNull(), F.lit("N/A")).otherwise(F.concat(to_fixed2(mismatch), F.lit("%")))
    t = F.when(F.coalesce(col(tag), F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("["), col(tag), F.lit("]")))
    return F.concat(F.lit("• "), col(component), F.lit(": "), m, F.lit(" "), t)


class Page(Tree):
    """The visible text and the links of a page, in one pass. Elements are marked as hidden if they or one above them are."""

    def __init__(self) -> None:
        super().__init__()
        self.links: list[str] = []

    def mark(self, parent: Node | None, tag: str, attrs: dict[str, str | None]) -> bool:
        style = attrs.get("style") or ""
        off = tag in UNSEEN or tag == "head" or attrs.get("aria-hidden") == "true" or "hidden" in attrs or attrs.get("type") == "hidden" or any(h in style for h in HIDING)
        return off or parent is not None and bool(parent.mark)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(reversed(attrs))
        if tag == "a" and "href" in a:
            self.links.append(a["href"] or "")
        super().handle_starttag(tag, attrs)

    def visible_text(self) -> str:
        return "".join(text for node, text in self.pieces if not node.mark)


def read_pages(parts: Iterator[pa.Array], rows: int = ROWS) -> Iterator[pa.Array]:
    """visible_text and links of pages, `rows` at a time: of a batch only these are Python objects. Trees are cycles, so they are collected after each lot."""
    for part in parts:
        for at in range(0, len(part), rows):
            texts, links = [], []
            for html in part.slice(at, rows).to_pylist():
                page = Page()
                page.feed(html or "")
                page.close()
                texts.append(" ".join(page.visible_text().replace("\ufeff", " ").split()))
                links.append(page.links)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(links, pa.list_(pa.string()))], names=["visible_text", "links"])
            page = html = None
            gc.collect()


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with visible_text and links (array of hrefs in document order). A null html has neither."""

    @F.arrow_udf("visible_text string, links array<string>")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return read_pages(parts)

    keep = [c for c in pages.columns if c not in ("visible_text", "links")]
    return pages.withColumn("_page", of(F.col(html))).select(*keep, "_page.*")


def visible_text(pages: DataFrame, html: str = "html") -> DataFrame:
    return parse_pages(pages, html).drop("links").withColumnRenamed("visible_text", "text")
