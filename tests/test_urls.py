import pytest
from pyspark.sql import functions as F

from passerelle.functions import urls as U


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).head()[0]


BASE = "https://h.example/a/b?x=1#f"


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("", "https://h.example/a/b?x=1"),
        ("#x", "https://h.example/a/b?x=1#x"),
        ("?q=1", "https://h.example/a/b?q=1"),
        (" /a ", "https://h.example/a"),
        ("//o.example/x", "https://o.example/x"),
        ("../y", "https://h.example/y"),
        ("../../../y/./z/..", "https://h.example/y/"),
        ("c d", "https://h.example/a/c%20d"),
        ("/ü|{", "https://h.example/%C3%BC|%7B"),
        ("mailto:a", "mailto:a"),
        ("http://", None),
        ("HTTPS://H.Example:443/X", "https://h.example/X"),
        ("http://h.example:8080", "http://h.example:8080/"),
        ("https://ho st/", None),
    ],
)
def test_resolve(spark, ref, want):
    assert one(spark, U.resolve_url("r", "b"), r=ref, b=BASE) == want


def test_resolve_needs_a_base(spark):
    assert one(spark, U.resolve_url("r", "b"), r="/a", b="nowhere") is None


@pytest.mark.parametrize(
    ("loc", "want"), [("https://h/home/x", "https://h//x"), ("https://h/home/", "https://h/"), ("https://h/homes/", "https://h/homes"), ("https://h/home/home", "https://h//home"), ("https://h/a\n", "https://h/a\n")]
)
def test_normalize_loc(spark, loc, want):
    assert one(spark, U.normalize_loc("c"), c=loc) == want


def test_replace_first_is_literal(spark):
    assert one(spark, U.replace_first("c", "/:p", "$1"), c="/a/:p/:p") == "/a$1/:p"
    assert one(spark, U.replace_first("c", "zz", "x"), c="/a") == "/a"


@pytest.mark.parametrize(
    ("url", "style", "want"),
    [
        ("https://h/a//b/", "joined", "a_b"),
        ("https://h/a//b/", "joined_hex", "a__b"),
        ("https://h/", "joined", "index"),
        ("/x:y/z", "joined", "xy_z"),
        ("/x:y/z", "joined_hex", "x%3ay_z"),
        ("https://p.example/x/y", "hex", "x%2fy"),
        ("https://p.example", "hex", "index"),
    ],
)
def test_capture_key(spark, url, style, want):
    assert one(spark, U.capture_key("c", style, ("https://s.example", "https://p.example")), c=url) == want


def test_capture_key_style():
    with pytest.raises(ValueError, match="style"):
        U.capture_key("c", "other")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://h/_next/image?url=%252Fa.GIF&w=1", "https://h/a.GIF"),
        ("https://h/p?img=&file=b.gif", "https://h/b.gif"),
        ("https://h/x?u=a%2Bb", "https://h/a+b"),
        ("no url at all", "no url at all"),
        ("see https://h/x) there", "https://h/x"),
        (None, None),
    ],
)
def test_candidate(spark, url, want):
    assert spark.range(1).select(U.extract_candidate_url(F.lit(url).cast("string")).alias("x")).head()[0] == want


def test_media(spark):
    assert one(spark, U.is_video("c"), c="/v.mp4?x=.gif")
    assert not one(spark, U.is_gif("c"), c="/v.mp4?x=.gif")
    assert one(spark, U.is_gif("c"), c="/A.GIF#t")
    assert one(spark, U.is_allowed_media("c"), c="https://c.clarity.ms/c.gif?x")
    assert not one(spark, U.is_allowed_media("c"), c="https://evil.example/c.gif")
    assert one(spark, U.media_filename("c", "a.example"), c="https://img.a.example/p/ab1-Clip.GIF") == "clip.gif"
    assert one(spark, U.media_filename("c", "a.example"), c="https://b.example/p/ab1-Clip.GIF") == "ab1-clip.gif"
    assert one(spark, U.media_filename("c", "a.example"), c="%%%") is None


def test_pathname_keeps_what_is_malformed(spark):
    assert one(spark, U.url_pathname("c"), c="/just/a/path?x") == "/just/a/path?x"
    assert one(spark, U.url_pathname("c"), c="https://h.example?x=1") == "/"
    assert one(spark, U.strip_domain("c"), c="https://h.example/a?x=1#y") == "/a?x=1#y"


def test_plain_urls_are_what_the_long_way_gives(spark):
    """What the two patterns let pass is what taking apart and putting together gives, and they let plain URLs pass."""
    parts = ["a", "A", ".", "..", "%2e", "%2E.", "b.c", "é", " ", "{x}", "x'y", '"', "|", "%41", "~!$&()*+,;=:@-_", "", "^", "`", "\\", "[1]"]
    tails = [f"/{x}/{y}" for x in parts for y in parts] + [f"/p{s}{x}" for s in "?#" for x in parts] + ["", "/", "?", "/#", "/a?", "/a?b#", "/.?a", "/..#b", "/a/./?x=/../y"]
    hosts = ["https://a.example.com", "http://a.example:80", "https://A.example", "https://u@a.example", "ftp://a.example", "https://a_b.example", "//a.example", ""]
    rows = [(h + t,) for h in hosts for t in tails]
    df = spark.createDataFrame(rows, "u string")
    long = U.let(U.col("u"), lambda u: F.concat(F.lit(" "), u))  # a space in front isn't plain, and trimmed
    base = F.lit("https://s.example.com/x/y?z")
    far = F.concat(F.lit(" "), base)
    got = df.select("u", U.is_plain(F.col("u")).alias("plain"), U.absolute_url("u").alias("a"), U.absolute_url(long).alias("b"), U.resolve_url("u", base).alias("c"), U.resolve_url(long, far).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
    assert sum(r.plain for r in got) > 100 and all(r.a == r.u for r in got if r.plain)


def test_media_filename_does_not_repeat_its_url(spark):
    plan = spark.range(1).select(U.media_filename(F.concat(F.lit("https://h/"), F.col("id").cast("string")), "assets.example.com"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(U.PLAIN_TAIL) <= 2
