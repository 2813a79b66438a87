"""Pairing captures of both sides, scoring differences, ignore rules, redirects and media sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passerelle.functions.text import diff_tag, reported, tag_rank
from passerelle.functions.urls import capture_key, resolve_url, strip_domain
from passerelle.sources.shared import written


def capture_tasks(urls: DataFrame, prod: str, stage: str, sides: tuple[str, ...] = ("prod", "migrated")) -> DataFrame:
    """url, side, requested, folder: what to capture."""
    bases = {"prod": prod, "migrated": stage}
    parts = [urls.select("url", F.lit(s).alias("side"), resolve_url("url", F.lit(bases[s])).alias("requested"), capture_key("url", "joined").alias("folder")) for s in sides]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_components(prod: DataFrame, stage: DataFrame, *more: str) -> DataFrame:
    """url, component, prod_height, stage_height, has_prod, has_stage, ord: prod's components first, by name, then those of stage only. more: columns of prod to keep."""
    a = prod.select("url", "component", F.col("height").alias("prod_height"), F.lit(True).alias("has_prod"), *more)
    b = stage.select("url", "component", F.col("height").alias("stage_height"), F.lit(True).alias("has_stage"))
    df = a.join(b, ["url", "component"], "full_outer").na.fill(False, ["has_prod", "has_stage"])
    return df.withColumn("ord", F.row_number().over(Window.partitionBy("url").orderBy(~F.col("has_prod"), "component")))


def presence_class(pairs: DataFrame) -> DataFrame:
    """pairs with match, mismatch, tag and height (the weight): of one side only, or as `mismatch` says for both.

    The mismatch of both counts as it is reported, with two decimals; one that is null or NaN, as of a comparison that failed, is 100.
    """
    both = F.col("has_prod") & F.col("has_stage")
    extra = F.col("has_stage") & ~F.col("has_prod")
    own = F.col("mismatch").cast("double")
    m = F.when(extra, F.lit(100.0)).when(both, F.when(own.isNull() | F.isnan(own), F.lit(100.0)).otherwise(reported(own)))
    return pairs.withColumns(
        {
            "match": F.when(both, F.coalesce(m == 0, F.lit(False))).otherwise(F.lit(False)),
            "mismatch": m,
            "tag": F.when(extra, "extra-in-migrated").when(~both, "missing-in-migrated").otherwise(diff_tag(m)),
            "height": F.when(extra, F.col("stage_height")).when(both, F.col("prod_height")),
        }
    )


#: The edge of the squares of pixels that are compared by digests first.
TILE = 64
PLACE = ["pair", "tile_x", "tile_y"]


def tiled(pixels: DataFrame, channels: tuple[str, ...], tile: int = TILE) -> DataFrame:
    """pair, tile_x, tile_y, x, y and the channels."""
    return pixels.select("pair", F.floor(F.col("x") / tile).alias("tile_x"), F.floor(F.col("y") / tile).alias("tile_y"), "x", "y", *channels)


def tile_digests(prod: DataFrame, stage: DataFrame, channels: tuple[str, ...], tile: int = TILE) -> DataFrame:
    """pair, tile_x, tile_y, n_prod, n_stage (pixels), equal: whether the sides have the same pixels there.

    A side's digest is the number of its pixels and the sums of both halves of their hashes, whatever their order; they are added up before the shuffle.
    """
    h = F.xxhash64("x", "y", *channels)
    rows = [tiled(df, channels, tile).select(*PLACE, F.lit(i).alias("side"), h.alias("h")) for i, df in enumerate((prod, stage))]
    low, high = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftright("h", 32)
    own = lambda i: F.col("side") == i
    total = lambda c, i: F.sum(F.when(own(i), c).otherwise(F.lit(0).cast("long")))
    sums = [x.alias(f"_{k}{i}") for i in (0, 1) for k, x in (("low", total(low, i)), ("high", total(high, i)))]
    out = rows[0].unionByName(rows[1]).groupBy(*PLACE).agg(F.count_if(own(0)).alias("n_prod"), F.count_if(own(1)).alias("n_stage"), *sums)
    same = (F.col("n_prod") == F.col("n_stage")) & (F.col("_low0") == F.col("_low1")) & (F.col("_high0") == F.col("_high1"))
    return out.select(*PLACE, "n_prod", "n_stage", same.alias("equal"))


def _joined(prod: DataFrame, stage: DataFrame, channels: tuple[str, ...], tol: int) -> DataFrame:
    """Tiled pixels of both sides by position, p and s their channels, with `differs`."""
    a = prod.select(*PLACE, "x", "y", F.struct(*channels).alias("p"))
    b = stage.select(*PLACE, "x", "y", F.struct(*channels).alias("s"))
    same = F.lit(True)
    for c in channels:
        same = same & (F.abs(F.col(f"p.{c}") - F.col(f"s.{c}")) <= tol)
    return a.join(b, [*PLACE, "x", "y"], "full_outer").withColumn("differs", ~F.coalesce(same, F.lit(False)))


def _counted(prod: DataFrame, stage: DataFrame, channels: tuple[str, ...], tol: int, tile: int, digests: DataFrame) -> DataFrame:
    """pair, positions, differing. Only pixels of tiles that aren't equal are joined."""
    unequal = digests.where("not equal").select(*PLACE)
    sides = [tiled(df, channels, tile).join(unequal, PLACE, "left_semi") for df in (prod, stage)]
    parts = _joined(*sides, channels, tol).groupBy("pair").agg(F.count("*").alias("n"), F.count_if("differs").alias("d"))
    alike = digests.where("equal").groupBy("pair").agg(F.sum("n_prod").alias("n"), F.lit(0).cast("long").alias("d"))
    return parts.unionByName(alike).groupBy("pair").agg(F.sum("n").alias("positions"), F.sum("d").alias("differing"))


def pixel_mismatch(prod: DataFrame, stage: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a"), tol: int = 0, tile: int = TILE) -> DataFrame:
    """pair, mismatch in percent of all positions, unrounded; one that only a side has differs. Pairs without any pixel have no row.

    Tiles whose digests agree are done; the pixels of the others are joined by position. Sums are made before the shuffle by pair.
    """
    digests = written(tile_digests(prod, stage, channels, tile), "tiles")
    return _counted(prod, stage, channels, tol, tile, digests).select("pair", (100.0 * F.col("differing") / F.col("positions")).alias("mismatch"))


def image_outcomes(images: DataFrame) -> DataFrame:
    """pair, error: of each pair whether it can be compared. images: pair, side (prod or stage), readable, pixels (their number).

    error is `unreadable` if a side is, else `empty` if a side has no pixels, else null.
    """
    state = F.when(~F.coalesce("readable", F.lit(False)), 2).when(F.coalesce("pixels", F.lit(0)) == 0, 1).otherwise(0)
    worst = images.groupBy("pair").agg(F.max(state).alias("state"))
    return worst.select("pair", F.when(F.col("state") == 2, "unreadable").when(F.col("state") == 1, "empty").alias("error"))


def compare_images(outcomes: DataFrame, prod: DataFrame, stage: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a"), tol: int = 0, tile: int = TILE) -> DataFrame:
    """pair, mismatch (two decimals, as reported), match (that it is 0), error: a row for each pair of image_outcomes().

    Pairs with an error are 100, and so are those whose share can't be told (NaN, or no pixels at all).
    """
    share = pixel_mismatch(prod, stage, channels, tol, tile)
    df = outcomes.join(share, "pair", "left")
    failed = F.col("error").isNotNull() | F.col("mismatch").isNull() | F.isnan("mismatch")
    m = F.when(failed, F.lit(100.0)).otherwise(reported("mismatch"))
    return df.select("pair", m.alias("mismatch"), (m == 0).alias("match"), "error")


def diff_pixels(prod: DataFrame, stage: DataFrame, tol: int = 0, tile: int = TILE) -> DataFrame:
    """pair, x, y, r, g, b, a of pairs that don't match as reported: what differs is red, the rest faint. Equal tiles are painted without a join."""
    channels = ("r", "g", "b", "a")
    digests = written(tile_digests(prod, stage, channels, tile), "tiles")
    counted = _counted(prod, stage, channels, tol, tile, digests)
    failing = written(counted.where(reported(100.0 * F.col("differing") / F.col("positions")) > 0).select("pair"), "failing")
    shown = digests.join(failing, "pair", "left_semi")
    unequal, alike = shown.where("not equal").select(*PLACE), shown.where("equal").select(*PLACE)
    sides = [tiled(df, channels, tile).join(unequal, PLACE, "left_semi") for df in (prod, stage)]
    same = tiled(prod, channels, tile).join(alike, PLACE, "left_semi").select("pair", "x", "y", F.struct(*channels).alias("p"), F.lit(False).alias("differs"))
    df = _joined(*sides, channels, tol).select("pair", "x", "y", F.coalesce("p", "s").alias("p"), "differs").unionByName(same)
    paint = lambda c, v: F.when(F.col("differs"), F.lit(v)).otherwise(F.col(f"p.{c}")).alias(c)
    alpha = F.when(F.col("differs"), F.lit(255.0)).otherwise(F.col("p.a") * 0.3).alias("a")
    return df.select("pair", "x", "y", paint("r", 255), paint("g", 0), paint("b", 0), alpha)


def apply_ignore(components: DataFrame, rules: DataFrame, scope: str = "page") -> DataFrame:
    """components with `ignored`: paired ones whose url, component and mismatch (as reported) a rule names.

    scope page marks every component of a page with a hit, as the whole page then leaves the reports; scope component
    turns just the hit into a match without a mismatch.
    """
    hits = components.where(F.col("has_prod") & F.col("has_stage") & F.col("mismatch").isNotNull()).join(
        rules.select("url", "component", F.col("percents").cast("double").alias("mismatch")),
        ["url", "component", "mismatch"],
        "left_semi",
    )
    if scope == "page":
        pages = hits.select("url").distinct().withColumn("ignored", F.lit(True))
        return components.join(pages, "url", "left").na.fill(False, ["ignored"])
    if scope != "component":
        raise ValueError(f"unknown scope {scope}")
    df = components.join(hits.select("url", "component", F.lit(True).alias("ignored")), ["url", "component"], "left").na.fill(False, ["ignored"])
    return df.withColumns({"match": F.col("match") | F.col("ignored"), "mismatch": F.when(~F.col("ignored"), F.col("mismatch"))})


def _scored() -> list[Column]:
    """Aggregates of a page's components: the unrounded score and their number."""
    counts = F.col("mismatch").isNotNull() & (F.col("height") > 0)
    weight = F.sum(F.when(counts, F.col("height")))
    return [(F.sum(F.when(counts, F.col("mismatch") * F.col("height"))) / weight).alias("score"), F.count("*").alias("n_components")]


def page_score(components: DataFrame) -> DataFrame:
    """url, score (mismatch weighted by height, with two decimals as reported) and the tag of the unrounded score."""
    out = components.groupBy("url").agg(*_scored())
    return out.select("url", reported("score").alias("score"), diff_tag("score").alias("tag"))


def redirect_mismatch(finals: DataFrame) -> DataFrame:
    """Pages (url, prod_final, stage_final; each falls back to its requested URL) whose final paths differ."""
    df = finals.withColumns({"prod_path": strip_domain(F.coalesce("prod_final", "url")), "stage_path": strip_domain(F.coalesce("stage_final", "url"))})
    return df.where("prod_path <> stage_path").drop("prod_path", "stage_path")


def compare_pages(tasks: DataFrame, components: DataFrame, finals: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, components). pages: url, mismatch, tag, n_components of every task.

    Redirects that part decide first and skip all else; pages that an ignore rule hits have no url left and are
    counted as ignored; the rest get their score; pages without captures are `not compared`.

    The components are written first, since their hits and their scores read them; a page's score, count and hits are one aggregation.
    """
    parted = redirect_mismatch(finals).select("url").distinct()
    urls = tasks.select("url").distinct()
    marked = apply_ignore(written(components, "components"), rules)
    per = marked.groupBy("url").agg(*_scored(), F.bool_or("ignored").alias("ignored"))
    df = urls.join(parted.withColumn("parted", F.lit(True)), "url", "left").join(per, "url", "left")
    moved, hit = F.col("parted").isNotNull(), F.coalesce("ignored", F.lit(False))
    pages = df.select(
        F.when(moved | ~hit, F.col("url")).alias("url"),
        F.when(moved, F.lit(100.0)).when(~hit, reported("score")).alias("mismatch"),
        F.when(moved, "redirect-url-mismatch").when(hit, "ignored-diff").otherwise(diff_tag("score")).alias("tag"),
        F.when(moved | hit, F.lit(0).cast("long")).otherwise(F.coalesce("n_components", F.lit(0))).alias("n_components"),
    )
    shown = marked.where("not ignored").drop("ignored").join(parted, "url", "left_anti")
    return pages, shown.join(urls, "url", "left_semi")


def is_failing() -> Column:
    return ~F.col("match") | (F.coalesce("mismatch", F.lit(0.0)) > 0)


def worst_tag(tag: str = "tag", ord_: str = "ord") -> Column:
    """An aggregate: the tag of the highest rank, the first of equals; `unknown` for none."""
    return F.coalesce(F.max_by(tag, F.struct(tag_rank(tag), -F.col(ord_))), F.lit("unknown"))


def media_set_diff(names: DataFrame, pages: DataFrame) -> DataFrame:
    """url, missing, extra, mismatch, match, tag, log of every page; names: url, name, sides, as of blocked_sides().

    Names are counted by the sides that have them. Only those that one side lacks are listed.
    """
    has = lambda sides: F.col("name").isNotNull() & (F.col("sides") == sides)
    listed = lambda sides: F.sort_array(F.collect_list(F.when(has(sides), F.col("name"))))
    per = names.groupBy("url").agg(F.bit_or("sides").alias("files"), F.count_if(has(3)).alias("both"), listed(1).alias("missing"), listed(2).alias("extra"))
    none = F.array().cast("array<string>")
    df = pages.select("url").distinct().join(per, "url", "left").withColumns({"files": F.coalesce("files", F.lit(0)), "both": F.coalesce("both", F.lit(0)), "missing": F.coalesce("missing", none), "extra": F.coalesce("extra", none)})
    missing, extra = F.col("missing"), F.col("extra")
    count = F.size(missing) + F.size(extra)
    shown = lambda label, a: F.concat(F.lit(f"  {label} in migrated ("), F.size(a).cast("string"), F.lit("): "), F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise(F.lit("-")))
    lines = F.array(
        F.concat(F.lit("URL: "), F.col("url")),
        F.when(F.col("files").bitwiseAND(1) == 0, F.lit("prod/blocked-urls.txt: not found")),
        F.when(F.col("files").bitwiseAND(2) == 0, F.lit("migrated/blocked-urls.txt: not found")),
        F.when(count == 0, F.concat(F.lit("Media filenames match ("), F.col("both").cast("string"), F.lit(")"))),
        F.when(count > 0, F.lit("Media filenames differ")),
        F.when(count > 0, shown("Missing", missing)),
        F.when(count > 0, shown("Extra", extra)),
    )
    total = count + F.col("both")
    return df.select(
        "url",
        "missing",
        "extra",
        F.when(total > 0, 100.0 * count / total).otherwise(F.lit(0.0)).alias("mismatch"),
        (count == 0).alias("match"),
        F.when(count == 0, "perfect-match").otherwise("minor-diff").alias("tag"),
        F.array_join(F.array_compact(lines), "\n").alias("log"),
    )


def run_flags(pages: DataFrame) -> DataFrame:
    """same, different: pages whose mismatch is 0 as reported, and the others."""
    same = F.coalesce(F.col("mismatch") == 0, F.lit(False))
    return pages.agg(F.count_if(same).alias("same"), F.count_if(~same).alias("different"))
