"""Main text: pages with known articles, and the style tree against brute force."""

import math
import random
from html import escape

import pytest
from pyspark.sql import functions as F

from passerelle.llm import extraction

SCHEMA = "page_id long, url string, html string"


def text_of(html):
    page = extraction.Article()
    page.feed(html)
    page.close()
    return [t for _, t in page.blocks()[0]]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n two<br>three<p><b>x</b>y &#8212; z&nbsp;&eacute;</article>", ["A & B", "one two three", "xy — z é"]),
        ("<nav>m</nav><header>h</header><main><header><h1>T</h1></header>a<div>b</div>c</main><footer>f</footer>", ["T", "a", "b", "c"]),
        ("<article>a<div class=ad>x</div>b<aside>y</aside><form>z</form><script>var a='<p>';</script><style>p{}</style>c</article>", ["a", "b", "c"]),
        ("<article><p>a</article><section id=comments><article class=comment>c</article><article>d</article></section>", ["a"]),
        ("<article><p>a<div class='comment-list'><p>c</div></article>", ["a"]),
        ("<div class='page has-sidebar'><div class=sidebar>s</div><div id=content><h1>T</h1><p>a</div></div>", ["T", "a"]),
        ("<div class=cookieNotice>c</div><div class=text><p>a<div hidden>h</div><div style='display: none'>n</div></div>", ["a"]),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e\n  f</pre></article>", ["a", "b", "c", "d", "e f"]),
        ("<body>a<!-- <p>x</p> -->b<p></p>c", ["ab", "c"]),
        ("", []),
        ("<nav>only a menu</nav>", []),
        ("<p>" + "w " * 50_000, ["w " * 49_999 + "w"]),
    ],
)
def test_blocks(html, blocks):
    assert text_of(html) == blocks


def site(rng, n, host="s.example.com", extra=""):
    """Pages of one template without telling names: a bar, articles of their own, a box that only some have."""
    rows = []
    for i in range(n):
        own = [" ".join(f"{host[:1]}{i}w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(3)]
        box = "<div class=x9><p>Offer of the day</p><a href=/o>Buy now</a></div>" if i % 2 else ""
        html = f"<div class=x1><p>Our site since 1990</p></div><div class=x2><h1>{own[0]}</h1><p>{own[1]}</p>{box}<p>{escape(own[2])}</p></div><div class=x3>All rights{extra}</div>"
        rows.append((i, f"https://{host}/p/{i}", html, own))
    return rows


def test_style_tree_removes_what_pages_have_alike(spark):
    rows = site(random.Random(1), 30)
    df = spark.createDataFrame([r[:3] for r in rows], SCHEMA).withColumn("text", F.lit("clash")).withColumn("host", F.lit("h"))
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.main_text(df).collect()}
    assert got == {i: ("\n\n".join(own), len("\n\n".join(own))) for i, _, _, own in rows}


def test_small_sites_and_copies_keep_their_text(spark):
    few = site(random.Random(2), 4, "few.example.com")
    copies = [(100 + i, f"https://copies.example.com/{i}", "<div class=a><p>the same</p></div>", None) for i in range(40)]
    nobody = [(200 + i, url, h, None) for i, url in enumerate([None, "", "/relative", "mailto:x"]) for h in ["<div class=a>x</div>"]]
    rows = few + copies + nobody + [(300, "https://few.example.com/n", None, None), (301, None, "", None)]
    got = {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame([r[:3] for r in rows], SCHEMA)).collect()}
    assert all("Our site since 1990" in got[i] for i in range(4))
    assert {got[100 + i] for i in range(40)} == {"the same"} and {got[200 + i] for i in range(4)} == {"x"}
    assert got[300] == got[301] == ""


def test_repeated_rows_and_no_rows(spark):
    rows = site(random.Random(3), 8)
    df = spark.createDataFrame([r[:3] for r in rows + rows[:2]] + [(None, r[1], r[2]) for r in rows[:1]], SCHEMA)
    out = extraction.main_text(df).collect()
    assert len(out) == 11 and sorted(r.text for r in out if r.page_id == 0 or r.page_id is None) == ["\n\n".join(rows[0][3])] * 3
    assert extraction.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_importance_is_that_of_brute_force(spark):
    """Entropies computed page by page; pages with the same blocks count once."""
    rng = random.Random(4)
    pages = []
    for i in range(25):
        blocks = [((1, 2), f"own {i}"), ((1, 3), "alike"), ((1, 4), rng.choice("abc")), ((1, 5, 6), rng.choice(["u", "v"]))]
        blocks = [b for b in blocks if rng.random() < 0.9] + [((1, 2), f"more {i}")]
        nodes = sorted({p[:k] for p, _ in blocks for k in range(1, len(p) + 1)})
        pages.append(("h" if i % 5 else "g", blocks, [(p, rng.choice([7, 7, 7, 8]), p == (1,)) for p in nodes]))
    pages += pages[:3]
    schema = "host string, blocks array<struct<path array<long>, text string>>, nodes array<struct<path array<long>, style long, plain boolean>>"
    got = {tuple(r) for r in extraction.unimportant(spark.createDataFrame(pages, schema), 0.4, 5).collect()}
    want = set()
    for host in "gh":
        own = {repr(p[1]): p for p in pages if p[0] == host}.values()
        rated, count = {}, {}
        for node in {n[0] for p in own for n in p[2]}:
            having = [p for p in own if any(n[0] == node for n in p[2])]
            m = count[node] = len(having)
            styles = [n[1] for p in having for n in p[2] if n[0] == node]
            texts = [{t for q, t in p[1] if q == node} for p in having]
            entropy = lambda shares: -sum(s * math.log(s, m) for s in shares)  # noqa: B023, E731
            if m == 1 or node == (1,):
                rated[node] = 1.0
                continue
            presented = entropy([styles.count(s) / m for s in set(styles)])
            held = [sum(t in x for x in texts) for t in set().union(*texts)]
            rated[node] = max(presented, 1 - sum(entropy([1 / k] * k) for k in held) / len(held) if held else 0)
        want |= {(host, node[-1]) for node in rated if count[node] >= 5 and max(v for n, v in rated.items() if n[: len(node)] == node) < 0.4}
    assert got == want and want
