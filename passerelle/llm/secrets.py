"""Secrets by pattern and by a battery of randomness tests. Native columns only.

Patterns give the base spans. Other runs of encoding characters are tested: their encoding is inferred from the classes of
characters present, and chi-squared against its alphabet, a runs test and the serial correlation must not speak against uniform
draws. How far the same three lie from what the corpus's own runs of this encoding show gives a p-value each against
"ordinary text", and the three are combined. A weighted Benjamini-Hochberg step over all candidates, with weights by length
because short ones tell little, bounds the share of false discoveries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passerelle.llm.common import read, row_key, written

#: kind, pattern, and the group that has to be at least `least` long
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What is tested: shorter runs hold too little to tell.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
DIGITS, UPPERS, LOWERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: encoding, what its runs look like, alphabet, and the share of turns between the alphabet's halves that text shows at most; the first that fits
ENCODINGS = (
    ("digits", r"^[0-9]+$", DIGITS, 0.45),
    ("hex", r"^[0-9a-f]+$", DIGITS + LOWERS[:6], 0.45),
    ("hex_upper", r"^[0-9A-F]+$", DIGITS + UPPERS[:6], 0.45),
    ("upper", r"^[A-Z]+$", UPPERS, 0.45),
    ("lower", r"^[a-z]+$", LOWERS, 0.45),
    ("base32", r"^[A-Z2-7]+$", UPPERS + DIGITS[2:8], 0.45),
    ("upper_digits", r"^[0-9A-Z]+$", DIGITS + UPPERS, 0.45),
    ("lower_digits", r"^[0-9a-z]+$", DIGITS + LOWERS, 0.45),
    ("letters", r"^[A-Za-z]+$", UPPERS + LOWERS, 0.25),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + UPPERS + LOWERS, 0.25),
    ("base64", r"", DIGITS + UPPERS + LOWERS + "+/", 0.25),
)
SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"
#: Code points of a piece of text: a position is found within one piece instead of the whole text.
PIECE = 512


def doubles() -> Column:
    return F.array(*[F.lit(1 << k) for k in range(31)])


def running(values: Column, of) -> Column:
    """Running totals of an array by `of` (plus, greatest): spans double, so n values take log n passes and no list grows within a pass."""
    start = values.cast("array<int>")
    steps = F.filter(doubles(), lambda p: p < F.size(values))
    return F.aggregate(steps, start, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, of(x, F.get(acc, i - p))).otherwise(x)))


def with_matches(df: DataFrame, text: str, out: str, pattern: str, group: int = 0) -> DataFrame:
    """df with `out`: (start, end, n, token) of every match, in code points; n is the length of the group."""
    has = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    every = lambda g: F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(g))).otherwise(none)
    df = df.withColumns({"_got": every(0), "_part": every(group), "_gaps": F.when(has, F.split(text, pattern, -1)).otherwise(none)})
    ends = running(F.zip_with(F.slice("_gaps", F.lit(1), F.size("_got")), "_got", lambda gap, got: F.length(gap) + F.length(got)), lambda x, y: x + y)
    of = lambda m: F.struct((m["end"] - F.length(m["_got"])).alias("start"), m["end"], F.length(m["_part"]).alias("n"), m["_got"].alias("token"))
    return df.withColumn("_ends", ends).withColumn(out, F.transform(F.arrays_zip(F.col("_ends").alias("end"), "_got", "_part"), of)).drop("_got", "_part", "_gaps", "_ends")


def with_base(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: the base spans of a text, sorted."""
    def spans(k: int, kind: str, least: int) -> Column:
        one = lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("ord"), F.lit(kind).alias("kind"), m["end"].alias("end"))
        return F.transform(F.filter(f"_m{k}", lambda m: m["n"] >= least), one)

    for k, (_, pattern, group, _) in enumerate(BASE):
        df = with_matches(df, text, f"_m{k}", pattern, group)
    parts = [spans(k, kind, least) for k, (kind, _, _, least) in enumerate(BASE)]
    return df.withColumn(out, F.sort_array(F.concat(*parts))).drop(*[f"_m{k}" for k in range(len(BASE))])


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def battery(tokens: DataFrame) -> DataFrame:
    """tokens with enc, n, size (of the alphabet), most_turns, pairs (of equal characters), turns (between the alphabet's halves), serial, chi, turns_z and serial_z."""
    df = tokens.withColumn("bare", F.translate(F.regexp_replace("token", "=+$", ""), "-_", "+/")).withColumn("n", F.length("bare"))
    own = F.struct(*[F.lit(v).alias(k) for k, v in zip(("enc", "letters", "most_turns"), (ENCODINGS[-1][0], ENCODINGS[-1][2], ENCODINGS[-1][3]), strict=True)])
    for enc, pattern, letters, most in reversed(ENCODINGS[:-1]):
        own = F.when(F.col("bare").rlike(pattern), F.struct(F.lit(enc).alias("enc"), F.lit(letters).alias("letters"), F.lit(most).alias("most_turns"))).otherwise(own)
    df = df.withColumn("own", own).withColumn("size", F.length("own.letters"))
    df = df.withColumn("v", F.transform(F.split("bare", ""), lambda c: (F.instr(F.col("own.letters"), c) - 1).cast("double")))
    # squares of the counts: the r-th of equal values adds 2r - 1
    zero = F.struct(F.lit(-1.0).alias("was"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def count(acc: Column, x: Column) -> Column:
        run = F.when(acc["was"] == x, acc["run"] + 1.0).otherwise(F.lit(1.0))
        return F.struct(x.alias("was"), run.alias("run"), (acc["sum"] + 2 * run - 1.0).alias("sum"))

    df = df.withColumn("square", F.aggregate(F.sort_array("v"), zero, count, lambda acc: acc["sum"]))
    df = df.withColumn("half", F.array_join(F.transform("v", lambda x: F.when(x * 2 < F.col("size"), F.lit("0")).otherwise(F.lit("1"))), ""))
    df = df.withColumn("ones", F.length(F.replace(F.col("half"), F.lit("0"), F.lit("")))).withColumn("turns", F.size(F.regexp_extract_all("half", F.lit("0+|1+"), F.lit(0))) - 1)
    df = df.withColumn("mean", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    var = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    lag = F.aggregate(F.zip_with(F.slice("v", F.lit(1), F.col("n") - 1), F.slice("v", F.lit(2), F.col("n") - 1), lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))), F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("serial", F.coalesce(F.try_divide(lag, var), F.lit(1.0)))
    n = F.col("n").cast("double")
    expected = 2 * F.col("ones") * (n - F.col("ones")) / n
    spread = F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(0.25)))
    return df.select(
        *tokens.columns,
        "own.enc",
        "n",
        "size",
        "own.most_turns",
        "turns",
        (F.col("square") - n).alias("pairs"),
        "serial",
        ((F.col("square") * F.col("size") / n - n - (F.col("size") - 1)) / F.sqrt(2.0 * (F.col("size") - 1))).alias("chi"),
        ((F.col("turns") - expected) / spread).alias("turns_z"),
        ((F.col("serial") + 1 / n) * F.sqrt(n)).alias("serial_z"),
    )


def tail(z: Column) -> Column:
    """An upper bound of the normal distribution's upper tail, 1 at most."""
    return F.when(z <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(-z * z / 2) / (1 + z) * 1.2))


def discoveries(tested: DataFrame, rate: float, random_z: float) -> DataFrame:
    """The rows of `tested` that are secrets at a false-discovery rate of `rate`."""
    # what repeats, turns and correlation are usual, over all candidates of an encoding: a row for each encoding
    usual = tested.groupBy("enc").agg(
        F.try_divide(F.sum("pairs"), F.sum(F.col("n") * (F.col("n") - 1.0))).alias("kappa"),
        F.try_divide(F.sum("turns"), F.sum(F.col("n") - 1.0)).alias("turn"),
        F.avg("serial").alias("usual_serial"),
        F.coalesce(F.stddev(F.col("serial") * F.sqrt(F.col("n").cast("double"))), F.lit(1.0)).alias("serial_sd"),
        F.avg("n").alias("mean_n"),
    )
    df = tested.join(F.broadcast(usual), "enc")
    n = F.col("n").cast("double")
    # bounds for text, where secrets or junk are most of an encoding's candidates: more repeats than uniform draws have, and fewer turns
    least = F.greatest(F.lit(0.065), 1.7 / F.col("size"))
    kappa = F.least(F.greatest(F.col("kappa"), least), 1.3 * least)
    turn = F.greatest(F.least("turn", "most_turns"), F.lit(0.02))
    few = (n * (n - 1) * (kappa - 1.0 / F.col("size")) - (F.col("pairs") - n * (n - 1) / F.col("size"))) / F.sqrt(2 * n * (n - 1) * kappa)
    many = (F.col("turns") - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn))
    loose = (F.abs("usual_serial") - F.abs("serial")) * F.sqrt(n) / F.greatest(F.col("serial_sd"), F.lit(1.0))
    x = -F.log(tail(few)) - F.log(tail(many)) - F.log(tail(loose))
    p = F.exp(-x) * (1 + x + x * x / 2)  # Fisher's combination of three
    df = df.withColumn("log_p", F.log10(F.greatest(p, F.lit(1e-30))) - F.log10(n / F.col("mean_n")))
    fits = (F.col("chi") <= random_z) & (F.abs("turns_z") <= random_z) & (F.abs("serial_z") <= random_z)
    bins = df.groupBy(F.ceil(F.col("log_p") * 50).alias("b")).count().orderBy("b").collect()  # at most some 1,700 bins
    total, seen, best = sum(r["count"] for r in bins), 0, None
    for r in bins:
        seen += r["count"]
        if r["b"] / 50 <= math.log10(rate * seen / total):
            best = r["b"]
    return df.where(fits & (F.ceil(F.col("log_p") * 50) <= best)) if best is not None else df.where("false")


def below(sorted_spans: str, bound: Column) -> Column:
    """How many of the spans start below the bound: a binary search."""
    steps = F.reverse(F.filter(doubles(), lambda p: p <= F.size(sorted_spans)))
    return F.aggregate(steps, F.lit(0), lambda n, p: F.when(F.coalesce(F.get(sorted_spans, n + p - 1)["start"] < bound, F.lit(False)), n + p).otherwise(n))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = 1e-3, random_z: float = 4.0) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base (spans) and found (spans): arrays of (start, ord, kind, end), sorted.

    Spans are in code points, end exclusive. found has every base span and those of kind `random`, which overlap no
    base span. A null text counts as empty and has none. Repeated rows get equal results. Columns of the added names
    in docs are replaced. Time grows as n log n with a text's matches.
    """
    names = ("n_assign", "n_access", "n_hex", "base", "found")
    keep = [c for c in docs.columns if c not in names]
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(*keep, body.alias("_text"), row_key(doc_id, text).alias("_key"))
    # explode_outer: from explode Spark infers a filter, which it pushes down to the text and evaluates by repeating all patterns there
    runs = with_matches(keyed.select("_key", "_text"), "_text", "_m", CANDIDATE).select("_key", F.explode_outer("_m").alias("m"))
    tokens = runs.where("m is not null").select("_key", "m.start", "m.end", "m.token").distinct()
    tested = written(battery(tokens).drop("token"), "tokens")
    random = discoveries(tested, rate, random_z).groupBy("_key").agg(F.collect_set(F.struct("start", F.lit(len(BASE)).alias("ord"), F.lit("random").alias("kind"), "end")).alias("_more"))
    base = with_base(keyed, "_text", "base").drop("_text")
    out = base.join(random, "_key", "left").withColumn("_reach", running(F.transform("base", lambda s: s["end"]), lambda x, y: F.greatest(x, y)))
    # the furthest end of the base spans that start before it ends
    free = F.filter(F.coalesce("_more", F.array().cast(SPANS)), lambda r: ~F.coalesce(F.get("_reach", below("base", r["end"]) - 1) > r["start"], F.lit(False)))
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return out.select(*keep, *[count(k).alias(f"n_{b[0]}") for k, b in enumerate(BASE)], "base", F.sort_array(F.concat("base", free)).alias("found"))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span (overlapping ones together) replaced by the mark. Texts are cut into pieces first, so that no gap is sought from the text's start."""
    none = F.array().cast("array<string>")
    parts = F.struct(
        F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), none).alias("pieces"),
        F.sort_array(spans).alias("spans"),
        running(F.transform(F.sort_array(spans), lambda s: s["end"]), lambda x, y: F.greatest(x, y)).alias("reach"),
        F.length(text).alias("n"),
    )

    def put(p: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            near = F.array_join(F.slice(p["pieces"], first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
            return F.substring(near, a - first * PIECE + 1, b - a)

        def gap(s: Column, i: Column) -> Column:
            was = F.coalesce(F.get(p["reach"], i - 1), F.lit(0))
            return F.when((s["start"] >= was), between(was, s["start"]))

        end = F.coalesce(F.get(p["reach"], F.size(p["reach"]) - 1), F.lit(0))
        return F.array_join(F.concat(F.transform(p["spans"], gap), F.array(between(end, F.greatest(end, p["n"])))), mark)

    return F.element_at(F.transform(F.array(parts), put), 1)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
