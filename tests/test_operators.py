import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passerelle.functions import text as T
from passerelle.operators import compare, crawl, dom, health, inventory, validate
from passerelle.plans import reports
from passerelle.sources import readers, sinks


@pytest.mark.parametrize(
    ("m", "tag"), [(None, "not compared"), (0.0, "perfect-match"), (0.004, "minor-diff"), (1.0, "minor-diff"), (1.01, "medium-diff"), (5.0, "medium-diff"), (20.0, "major-diff"), (20.01, "critical-diff"), (float("nan"), "critical-diff")]
)
def test_diff_tag(spark, m, tag):
    assert spark.createDataFrame([(m,)], "m double").select(T.diff_tag("m")).head()[0] == tag


def test_numbers(spark):
    df = spark.createDataFrame([(1.005, 100), (0.125, 7), (None, 0)], "m double, i int")
    rows = df.select(T.to_fixed2("m"), T.component_name("i")).collect()
    assert [tuple(r) for r in rows] == [("1.00", "component-100"), ("0.13", "component-07"), ("NaN", "component-00")]


def test_text(spark):
    df = spark.createDataFrame([(" a  b﻿ ",), (None,)], "t string")
    rows = df.select(T.collapse_ws("t"), T.clean_text("t"), T.contains_any("t", ("A",)), T.last_integer("t")).collect()
    assert rows[0][0] == "a b" and rows[0][2] is True and rows[0][3] is None
    assert rows[1][0] is None and rows[1][2] is False


def test_visible_text(spark):
    html = "<body><p>A<script>no</script><span hidden>no</span><b style='display:none'>no</b><input type='hidden'> b&amp;c</p><a href='/x'>L</a><a>none</a><div aria-hidden='true'><a href='y'>no</a></div></body>"
    row = T.parse_pages(spark.createDataFrame([(1, html), (2, None)], "id int, html string")).orderBy("id").collect()
    assert row[0]["visible_text"] == "A b&cLnone" and row[0]["links"] == ["/x", "y"]
    assert row[1]["visible_text"] == "" and row[1]["links"] == []


@pytest.mark.parametrize(("path", "param"), [("/:locale", "locale"), ("/articles/:articles/", "articles"), ("/a/:b/:webinars", "webinars"), ("/a/:a/:locale", "locale")])
def test_route_param(spark, path, param):
    assert spark.range(1).select(inventory.route_param(F.lit(path))).head()[0] == param


def test_unmapped_parameters_take_entries_without_a_type(spark):
    routes = inventory.classify_routes(spark.createDataFrame([("/m/:none",), ("/a/:articles",)], "path string"))
    entries = spark.createDataFrame([(None, "x"), ("articleDetail", "y"), ("articleDetail", None)], "type string, slug string")
    types = spark.createDataFrame(list(inventory.TYPE_OF), "param string, type string")
    assert sorted(r["url"] for r in inventory.expand_routes(routes, entries, types).collect()) == ["/a/y", "/m/x"]
    assert sorted(r["url"] for r in inventory.expand_routes(routes, entries, types, "undefined").collect()) == ["/a/undefined", "/a/y", "/m/x"]


def test_difference_keeps_repeats(spark):
    a = spark.createDataFrame([("/a",), ("/a",), ("/b",)], "url string")
    b = spark.createDataFrame([("/b",), ("/c",)], "url string")
    rows = [tuple(r) for r in inventory.order_diff(inventory.inventory_diff(a, b)).collect()]
    assert rows == [("/c", "urls-sitemap.json"), ("/a", "urls.json"), ("/a", "urls.json")]


def test_order_of_the_locale(spark):
    df = spark.createDataFrame([("/b", "s"), ("/A", "s"), ("/a", "s"), ("/aa", "s")], "url string, source string")
    assert [r["url"] for r in inventory.order_diff(df).collect()] == ["/a", "/A", "/b", "/aa"]


LINKS = [("https://s.example/", 0, "/a"), ("https://s.example/a", 0, "/b?x#y"), ("https://s.example/a", 1, "http://"), ("https://s.example/a", 2, "/lost"), ("https://s.example/b", 0, "/"), ("https://s.example/b", 1, "https://s.example.evil/x"), ("https://s.example/b", 2, "https://www.s.example/w")]


def test_crawl_and_its_state(spark, tmp_path):
    links = spark.createDataFrame(LINKS, "page_url string, pos int, href string")
    get = lambda df: sorted(r["url"] for r in df.collect())
    urls, visited = crawl.crawl_closure(links, "https://s.example/", "https://s.example", state=str(tmp_path / "s"))
    assert get(visited) == ["https://s.example.evil/x", "https://s.example/", "https://s.example/a", "https://s.example/b", "https://www.s.example/w"]
    again = crawl.crawl_closure(links, "https://s.example/", "https://s.example", state=str(tmp_path / "s"))
    assert get(again[1]) == get(visited) and get(again[0]) == get(urls)
    strict = crawl.crawl_closure(links, "https://s.example/", "https://s.example", strict=True)
    assert get(strict[1]) == ["https://s.example/", "https://s.example/a", "https://s.example/b", "https://www.s.example/w"]


def test_a_crawl_goes_on_from_any_stop(spark, tmp_path, monkeypatch):
    """A stop before each write of each round; the next crawl with this state ends with all pages."""
    from pyspark.sql import DataFrameWriter

    links = spark.createDataFrame(LINKS, "page_url string, pos int, href string")
    get = lambda df: sorted(r["url"] for r in df.collect())
    want = tuple(map(get, crawl.crawl_closure(links, "https://s.example/", "https://s.example")))
    write, seen = DataFrameWriter.parquet, []

    def stopping(at):
        def parquet(self, path, *more, **options):
            if "/state" in path:
                seen.append(path)
                if len(seen) == at:
                    raise KeyboardInterrupt
            return write(self, path, *more, **options)

        return parquet

    for at in range(1, 100):
        seen.clear()
        state = str(tmp_path / f"state{at}")
        monkeypatch.setattr(DataFrameWriter, "parquet", stopping(at))
        try:
            crawl.crawl_closure(links, "https://s.example/", "https://s.example", state=state)
            break
        except KeyboardInterrupt:
            monkeypatch.setattr(DataFrameWriter, "parquet", write)
            assert tuple(map(get, crawl.crawl_closure(links, "https://s.example/", "https://s.example", state=state))) == want
    assert at > 6


def test_chains(spark):
    """A chain of 1,000 pages that also link home, one that branches, and a ring that only its entry leads to."""
    origin = "https://s.example"
    page = lambda i: f"{origin}/{i}"
    rows = [(f"{origin}/", 0, "/1"), (f"{origin}/", 1, "/ring1")]
    rows += [(page(i), 0, f"/{i + 1}") for i in range(1, 1000)] + [(page(i), 1, "/") for i in range(1, 1000)]
    rows += [(page(500), 2, "/a"), (page("a"), 0, "/b"), (page("b"), 0, "/c"), (page("b"), 1, "/d"), (page("lost"), 0, "/lost2"), (page("lost2"), 0, "/lost")]
    rows += [(page(f"ring{i}"), 0, f"/ring{i % 5 + 1}") for i in range(1, 6)]
    links = spark.createDataFrame(rows, "page_url string, pos int, href string")
    state = crawl.shared_dir(spark, "chains")
    urls, visited = crawl.crawl_closure(links, f"{origin}/", origin, state=state)
    want = {f"{origin}/"} | {page(x) for x in [*range(1, 1001), "a", "b", "c", "d", *(f"ring{i}" for i in range(1, 6))]}
    got = [r["url"] for r in visited.collect()]
    assert len(got) == len(want) and set(got) == want == {r["url"] for r in urls.collect()}
    assert len(crawl._rounds(spark, state)) < 12
    assert crawl.chains(spark.createDataFrame([("x", "y"), ("y", "x")], "page_url string, target string"), spark.createDataFrame([], "url string")).count() == 0


def test_exact_decimals(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from passerelle.functions.text import to_fixed2

    values = [1.005, 2.675, 0.125, 0.375, 1.115, 0.285, 99.995, 1e-9, 0.0, 8.345, 1.255, 33.335, 100.0, 12345.675, 1e12 + 0.125, -1.005, -0.125, 0.005, 0.015, 2.5]
    values += [k / 1000 for k in range(5, 20_000, 10)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(to_fixed2("v")).collect()]
    assert got == [str(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]
    assert got[0] == "1.00" and got[1] == "2.67"
    assert [r[0] for r in spark.createDataFrame([(None,), (float("nan"),)], "v double").select(to_fixed2("v")).collect()] == ["NaN", "NaN"]


def test_end_tags_that_may_be_left_out(spark):
    from passerelle.functions.text import visible_text

    pages = [
        ("<ul><li hidden>x<li>Page not found</ul><p hidden>y<p>shown", "Page not foundshown"),
        ("<dl><dt hidden>a<dd>b<dt>c</dl><select><option hidden>d<option>e</select>", "bce"),
        ("<table><tr hidden><td>a<td>b<tr><td>c</table>", "c"),
        ("<ul><li hidden><ul><li>in</ul>still<li>out</ul>", "out"),
        ("<p hidden>a<span>b</span><div>c</div>", "c"),
        ("<p hidden><button><p>in</button>x</p>y", "y"),
        ("<div hidden><p>a</div>b</p>c", "bc"),
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, s struct<html:string,want:string>").select("i", "s.*")
    assert all(r["text"] == r["want"] for r in visible_text(df).collect())


def test_attempts(spark):
    log = spark.createDataFrame([("a", i, 502) for i in range(6)] + [("b", 0, 502), ("b", 1, 200), ("b", 2, 404), ("c", 0, 502)], "url string, attempt_id int, status int").withColumn("ts", F.col("attempt_id"))
    rows = {r["url"]: (r["attempt"], r["status"]) for r in health.resolve_http502(log).collect()}
    assert rows == {"a": (4, 502), "b": (2, 200), "c": (1, 502)}


def test_page_links(spark):
    rows = [(h,) for h in ("", "#x", "mailto:a", " /a ", "//h.example/x", "../y", "?q=1", "http://", "/a#x", "/a")]
    links = spark.createDataFrame(rows, "href string").withColumn("page_url", F.lit("https://h.example/d/p"))
    got = sorted(r["link"] for r in health.page_links(links).collect())
    assert got == ["https://h.example/a", "https://h.example/a#x", "https://h.example/d/p?q=1", "https://h.example/x", "https://h.example/y"]


NODE = "page string, side string, node_id bigint, parent_id bigint, ord int, tag string, dom_id string, classes array<string>, text string, display string, visibility string, opacity double, position string, width double, height double"


def node(side, i, parent, tag="div", dom_id=None, classes=(), text=None, display="block", visibility="visible", opacity=1.0, position="static", width=1.0, height=1.0):
    return ("/", side, i, parent, i, tag, dom_id, list(classes), text, display, visibility, opacity, position, width, height)


def in_order(rows):
    """The rows with ord as a document has them: a parent, then all below it, in order of node_id."""
    at = [f.strip().split()[0] for f in NODE.split(",")]
    side, key, parent, ord_ = (at.index(c) for c in ("side", "node_id", "parent_id", "ord"))
    below, out = {}, []
    for r in sorted(rows, key=lambda r: r[key]):
        below.setdefault((r[side], r[parent]), []).append(list(r))

    def walk(r):
        out.append([*r[:ord_], len(out), *r[ord_ + 1 :]])
        for x in below.get((r[side], r[key]), []):
            walk(x)

    for (_, p), tops in list(below.items()):
        for r in tops if p == 0 else []:
            walk(r)
    return [tuple(r) for r in out]


def test_intervals(spark):
    """Relations by intervals against ancestors, on trees that reach over many batches; a page in the wrong order is an error."""
    rng = random.Random(1)
    rows, parent = [], {}
    for page in ("/a", "/b", "/c"):
        open_ = [0]
        for i in range(1, 400):
            del open_[rng.randrange(1, len(open_) + 1) if page == "/a" else max(1, len(open_) - rng.randrange(3)) :]
            parent[page, i] = open_[-1]
            rows.append((page, "prod", i, open_[-1] if open_[-1] or rng.random() < 0.5 else None, i, rng.choice("xyz")))
            open_.append(i)

    def above(page, i):
        while (i := parent[page, i]) != 0:
            yield i

    df = spark.createDataFrame(rows, "page string, side string, node_id long, parent_id long, ord int, tag string")
    got = dom.with_intervals(df.repartition(5)).withColumns({"in_x": dom.inside(F.col("tag") == "x"), "has_y": dom.around(F.col("tag") == "y")}).collect()
    tags = {(r[0], r[2]): r[5] for r in rows}
    holds = {(p, a) for p, i in tags for a in above(p, i) if tags[p, i] == "y"}
    assert len(got) == len(rows)
    for r in got:
        assert r.pre == r.node_id - 1 and r.last == max([i for p, i in tags if p == r.page and r.node_id in above(p, i)], default=r.node_id) - 1
        assert r.in_x == any(tags[r.page, a] == "x" for a in above(r.page, r.node_id)) and r.has_y == ((r.page, r.node_id) in holds)
    with pytest.raises(Exception, match="without its parent"):
        dom.with_intervals(df.where("page <> '/a' or node_id <> parent_id").where("not (page = '/b' and node_id = 1)")).count()


def test_components(spark):
    rows = []
    for side in ("prod", "stage"):
        rows += [
            node(side, 1, 0, "main"),
            node(side, 2, 1, dom_id="content"),
            node(side, 3, 2, classes=["row"]),
            node(side, 4, 1, dom_id="content-shoehorned"),
            node(side, 5, 1, dom_id="full-width-shoehorn"),
            node(side, 6, 5, classes=["component"]),
        ]
        at = 3 if side == "stage" else 4
        for i, more in ((10, {}), (20, {"display": "none"}), (30, {"position": "fixed"}), (40, {"width": 0.0}), (50, {}), (60, {"opacity": 0.0})):
            rows.append(node(side, i, at, classes=["component"], **more))
        rows += [node(side, 11, 10, classes=["component-content"]), node(side, 12, 11, "#text", text="​ x"), node(side, 13, 11, classes=["component"]), node(side, 51, 50, "#text", text=" "), node(side, 61, 60, "img")]
    nodes = dom.drop_subtree(dom.with_intervals(spark.createDataFrame(in_order(rows), NODE)))
    assert nodes.where("node_id in (5, 6)").count() == 0
    assert {(r["side"], r["scope"]) for r in dom.pick_scope(nodes).collect()} == {("prod", 4), ("stage", 3)}
    cands = dom.candidates(nodes, dom.pick_scope(nodes))
    top = dom.top_level(cands, nodes)
    done = dom.classify_components(top, dom.meaningful(nodes, top))
    assert {r["node_id"]: r["state"] for r in done.where("side = 'prod'").collect()} == {10: "kept", 20: "hidden", 30: "fixed", 40: "invisible", 50: "empty", 60: "kept"}
    assert [r["component"] for r in dom.name_components(done).where("side = 'stage'").orderBy("ord").collect()] == ["component-00", "component-01"]
    for r in dom.component_stats(done, cands.join(top, ["page", "side", "node_id"], "left_anti")).collect():
        assert r["total"] == r["kept"] + r["hidden"] + r["fixed"] + r["invisible"] + r["empty"] == 6
        assert r["nested"] == (1 if r["side"] == "prod" else 0)
    assert dom.pages_without_components(nodes).count() == 0
    assert dom.pages_without_components(nodes.where("tag <> 'main'")).count() == 2


def test_ignoring_a_component_or_its_page(spark):
    comps = spark.createDataFrame([("/a", "c", True, True, False, 2.0), ("/a", "d", True, True, False, 3.0), ("/b", "c", True, False, False, None)], "url string, component string, has_prod boolean, has_stage boolean, match boolean, mismatch double")
    rules = readers.read_ignore_rules(spark, '[null, {"url": "/a", "component": "c", "percents": "2"}, {"url": "/b", "component": "c", "percents": null}]')
    assert sorted(r["component"] for r in compare.apply_ignore(comps, rules).where("ignored").collect()) == ["c", "d"]
    one = compare.apply_ignore(comps, rules, "component").where("ignored").collect()
    assert [(r["component"], r["match"], r["mismatch"]) for r in one] == [("c", True, None)]
    assert readers.read_ignore_rules(spark, "{broken").count() == readers.read_ignore_rules(spark, None).count() == readers.read_ignore_rules(spark, '{"a": 1}').count() == 0


def test_worst_tag_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("missing-in-migrated", 1), ("perfect-match", 2)], "tag string, ord int")
    assert df.agg(compare.worst_tag()).head()[0] == "missing-in-migrated"
    assert df.where("false").agg(compare.worst_tag()).head()[0] == "unknown"


def test_validation_modes(spark):
    df = spark.createDataFrame([("rgb(250, 204, 21)", "<b>2</b>"), ("rgb(217, 83, 79)", "x"), ("rgb(0, 0, 0)", "0"), (None, "9"), ("rgb(217, 83, 79)", "0")], "color string, html string").withColumn("name", F.lit("n"))
    assert [r["verdict"] for r in validate.validate_content(df, "errors").collect()] == ["pass", "fail", "fail", "pass", "pass"]
    assert [r["verdict"] for r in validate.validate_content(df, "all").collect()] == ["fail", "fail", "fail", "pass", "pass"]
    with pytest.raises(ValueError, match="mode"):
        validate.validate_content(df, "some")


def test_readers(spark, tmp_path):
    assert readers.read_entries(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "e.json").write_text('[{"id": "1", "name": "n", "type": "t", "slug": "s"}, {"id": "2", "name": "m"}]')
    assert readers.read_entries(spark, str(tmp_path / "e.json")).where("type is null").count() == 1
    (tmp_path / "r.json").write_text('[{"redirect": {"sourceUrl": "/a"}}, {"redirect": {"sourceUrl": "/b"}}]')
    assert readers.read_redirects(spark, str(tmp_path / "r.json"), limit=1).count() == 1
    (tmp_path / "s.xml").write_text("<loc>a</loc><loc>b\n</loc><loc>c</loc>")
    assert [r["loc"] for r in readers.read_sitemap(spark, str(tmp_path / "s.xml")).collect()] == ["a", "c"]
    (tmp_path / "l.json").write_text('["a", null, 3]')
    assert [r["pos"] for r in readers.read_url_list(spark, str(tmp_path / "l.json")).collect()] == [0, 1, 2]
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="array"):
        readers.read_url_list(spark, str(tmp_path / "o.json")).collect()


def test_captures(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"rest"
    for side, body in (("prod", png), ("migrated", b"no image")):
        folder = tmp_path / side / "a_b"
        folder.mkdir(parents=True)
        (folder / f"component-00_{side}.png").write_bytes(body)
    (tmp_path / "prod/a_b/redirect.txt").write_text(" https://h/x \n".strip(" \n") + " ")
    (tmp_path / "prod/a_b/blocked-urls.txt").write_text("https://h/a.gif\r\n\r\n https://h/b.gif \n")
    rows = {(r["side"], r["component"]): r["height"] for r in readers.read_component_captures(spark, str(tmp_path)).collect()}
    assert rows == {("prod", "component-00"): 480, ("migrated", "component-00"): 0}
    tasks = spark.createDataFrame([("prod", "/a/b", "a_b", "https://p/a/b"), ("migrated", "/a/b", "a_b", "https://m/a/b")], "side string, url string, folder string, requested string")
    assert {r["side"]: r["final_url"] for r in readers.read_final_urls(spark, str(tmp_path), tasks).collect()} == {"prod": "https://h/x", "migrated": "https://m/a/b"}
    media = readers.read_blocked_media(spark, str(tmp_path), tasks)
    assert sorted((r["side"], r["existed"], r["media_url"] or "") for r in media.collect()) == [("migrated", False, ""), ("prod", True, "https://h/a.gif"), ("prod", True, "https://h/b.gif")]


def test_suites_without_cases(spark, tmp_path):
    comps = spark.createDataFrame([("/a", "Site-Header", True, 0.0, "perfect-match", 1), ("/a", "footer_main", False, None, "missing-in-migrated", 2), ("/a", "component-99", False, 3.0, "medium-diff", 3)], "url string, component string, match boolean, mismatch double, tag string, ord int")
    cases = reports.body_cases(comps).unionByName(reports.role_cases(comps, "header")).unionByName(reports.role_cases(comps, "footer"))
    totals = {r["suite"]: (r["tests"], r["failures"]) for r in reports.suite_totals(cases).collect()}
    assert [totals[s] for s in reports.SUITES] == [(1, 1), (1, 0), (1, 1), (0, 0), (0, 0)]
    sinks.write_junit(cases, str(tmp_path / "x"))
    back = spark.read.format("xml").option("rowTag", "testcase").option("attributePrefix", "@").load(str(tmp_path / "x"))
    assert back.count() == 3
    heads = spark.read.format("xml").option("rowTag", "testsuite").option("attributePrefix", "@").option("recursiveFileLookup", True).load(str(tmp_path / "x"))
    assert sorted({(r["@name"], r["@tests"], r["@failures"]) for r in heads.collect()}) == sorted([(reports.BODY, 1, 1), (reports.HEADER, 1, 0), (reports.FOOTER, 1, 1)])
    sinks.write_inventory(comps.select("url"), str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "i")).count() == 3
    sinks.write_diff(comps.select("url").where("false"), str(tmp_path / "d"))
    assert sinks.quality_gate(comps.where("false")).head()["passed"]


def images(spark):
    """Pairs: 1 alike, 2 one of 25,600 pixels, 3 a third, 4 unreadable, 5 empty, 6 stage only has a row more, 7 without a side's pixels."""
    px = spark.range(25_600).select((F.col("id") % 160).alias("x"), F.floor(F.col("id") / 160).alias("y"), (F.col("id") % 7).alias("v"))
    of = lambda pair, df: df.withColumn("pair", F.lit(pair).cast("long"))
    small = px.where("x < 3 and y < 4")
    prod = [of(1, px), of(2, px), of(3, small), of(6, small), of(7, small)]
    stage = [of(1, px), of(2, px.withColumn("v", F.when(F.expr("x = 100 and y = 100"), 9).otherwise(F.col("v")))), of(3, small.withColumn("v", F.when(F.expr("x = 0"), 9).otherwise(F.col("v")))), of(6, small.unionByName(px.where("x < 3 and y = 4")))]
    rows = [(p, s, not (p == 4 and s == "stage"), 0 if p == 5 else 12) for p in range(1, 8) for s in ("prod", "stage")]
    outcomes = compare.image_outcomes(spark.createDataFrame(rows, "pair long, side string, readable boolean, pixels long"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return outcomes, union(prod), union(stage)


@pytest.mark.parametrize("tile", [1, 2, 64, 100_000])
def test_images_are_compared_by_tiles(spark, tile):
    got = {r.pair: (r.mismatch, r.match, r.error) for r in compare.compare_images(*images(spark), ("v",), tile=tile).collect()}
    assert got == {
        1: (0.0, True, None), 2: (0.0, True, None), 3: (33.33, False, None), 4: (100.0, False, "unreadable"), 5: (100.0, False, "empty"), 6: (20.0, False, None), 7: (100.0, False, None)
    }


def test_equal_tiles_are_not_joined(spark):
    outcomes, prod, stage = images(spark)
    digests = compare.tile_digests(prod, stage, ("v",))
    assert digests.where("not equal and pair in (1, 2)").count() == 1
    assert digests.where("pair = 2").count() == 9


def test_failed_comparisons_are_100(spark):
    rows = [("/a", c, m, 10) for c, m in (("component-00", float("nan")), ("component-01", None), ("component-02", 0.004), ("component-03", 33.333))]
    df = spark.createDataFrame(rows, "url string, component string, mismatch double, height int")
    pairs = compare.pair_components(df, df).join(df.select("url", "component", "mismatch"), ["url", "component"])
    classed = compare.presence_class(pairs)
    got = {r.component[-1]: (r.mismatch, r.match, r.tag) for r in classed.collect()}
    assert got == {"0": (100.0, False, "critical-diff"), "1": (100.0, False, "critical-diff"), "2": (0.0, True, "perfect-match"), "3": (33.33, False, "critical-diff")}
    rules = spark.createDataFrame([("/a", "component-03", "33.33")], "url string, component string, percents string")
    assert compare.apply_ignore(classed, rules).where("ignored").count() == 4
    assert compare.page_score(classed).collect()[0].score == 58.33


def test_pages_round_behind_their_tag(spark):
    df = spark.createDataFrame([("/a", "c", 1.0, 1), ("/a", "d", 0.0, 299), ("/b", "c", 1.0, 200), ("/b", "d", 1.01, 1)], "url string, component string, mismatch double, height int")
    got = {r.url: (r.score, r.tag) for r in compare.page_score(df).collect()}
    assert got == {"/a": (0.0, "minor-diff"), "/b": (1.0, "medium-diff")}
    flags = compare.run_flags(compare.page_score(df).select("url", F.col("score").alias("mismatch"))).collect()[0]
    assert (flags.same, flags.different) == (1, 1)


def test_crawl_broadcasts_nothing(spark):
    """Rounds of small tables too: what each of them broadcasts would add up in the driver."""
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    links = spark.createDataFrame([(f"https://s.example.com/p/{i}", k, f"/p/{3 * i + k}") for i in range(1, 200) for k in range(3)], "page_url string, pos int, href string")
    _, visited = crawl.crawl_closure(links, "https://s.example.com/p/1", "https://s.example.com")
    assert visited.count() > 100
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_pages_are_read_in_small_lots():
    html = ["<a href='/x'>one</a>", None] * 75
    lots = list(T.read_pages(iter([T.pa.array(html, T.pa.string()), T.pa.array([], T.pa.string())])))
    assert [len(x) for x in lots] == [64, 64, 22]
    rows = [r for x in lots for r in x.to_pylist()]
    assert rows == [{"visible_text": "one", "links": ["/x"]}, {"visible_text": "", "links": []}] * 75


def test_classified_in_one_pass(spark):
    """On random trees with content children, hidden parents, media and texts: what the single steps give together."""
    rng, rows = random.Random(3), []
    for page in range(30):
        open_ = [0]
        for i in range(1, 80):
            del open_[max(1, len(open_) - rng.randrange(4)) :]
            tag = rng.choice(["div", "div", "div", "#text", "img"])
            classes = rng.choice([["component"], ["component-content"], []]) if tag == "div" else []
            more = {"display": rng.choice(["none", "block", "block", None]), "position": rng.choice(["fixed", "static"]), "height": float(rng.randrange(3)), "text": rng.choice(["", "​ ", "x", None])}
            rows.append({"page": f"/{page}", "side": "prod", "node_id": i, "parent_id": open_[-1], "ord": i, "tag": tag, "dom_id": None, "classes": classes, "visibility": "visible", "opacity": 1.0, "width": 1.0} | more)
            open_.append(i)
    types = "page string, side string, node_id long, parent_id long, ord int, tag string, dom_id string, classes array<string>, text string, display string, visibility string, opacity double, position string, width double, height double"
    df = spark.createDataFrame(rows, types)
    nodes = dom.with_intervals(df)
    top = dom.top_level(nodes.where(dom.is_component()), nodes)
    states = lambda d: {(r.page, r.node_id): r.state for r in d.collect()}
    want = states(dom.classify_components(top, dom.meaningful(nodes, top)))
    assert set(want.values()) == {"hidden", "fixed", "invisible", "empty", "kept"}
    assert states(dom.classified(dom.intervals(df, shown=True))) == want
    plan = dom.classified(dom.intervals(df, shown=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # all nodes, then components alone


def test_pages_read_their_components_once(spark):
    """Parted, ignored, scored and uncaptured pages; a parted page with a hit is parted. A page's aggregates are one, and a score comes with the pair."""
    comps = [("/a", "c0", 2.0, 10), ("/a", "c1", 4.0, 30), ("/b", "c0", 0.0, 10), ("/b", "c1", 9.0, 10), ("/c", "c0", 0.0, 10), ("/null", "c0", None, 10)]
    df = spark.createDataFrame(comps, "url string, component string, mismatch double, height int")
    pairs = compare.presence_class(compare.pair_components(df, df, "mismatch"))
    finals = spark.createDataFrame([("/a", None, None), ("/a", None, None), ("/b", None, None), ("/c", "https://p.x/1", None), ("/d", None, None)], "url string, prod_final string, stage_final string")
    rules = spark.createDataFrame([("/b", "c0", 0.0), ("/c", "c0", 0.0)], "url string, component string, percents double")
    pages, shown = compare.compare_pages(finals.select("url"), pairs, finals, rules)
    key = lambda r: str(r)
    want = [("/a", 3.5, "medium-diff", 2), (None, None, "ignored-diff", 0), ("/c", 100.0, "redirect-url-mismatch", 0), ("/d", None, "not compared", 0)]
    assert sorted(map(tuple, pages.collect()), key=key) == sorted(want, key=key)
    assert {(r.url, r.component) for r in shown.collect()} == {("/a", "c0"), ("/a", "c1")}
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/components-") <= 2 and "Window" not in plan  # pairs are made before
