"""URL columns: parsing, resolving, keys and media tests, all as native expressions.

`parse_url` isn't used: it gives null for a space in a path, where browsers percent-encode, and an empty path for `/`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Str = Column | str
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: fixed values: characters that a file name can't have, with their hex codes
ILLEGAL = ("<", ">", ":", '"', "/", "\\", "|", "?", "*")
#: fixed values: parameters that carry a URL, in order of preference
URL_PARAMETERS = ("url", "u", "src", "image", "img", "filename", "file")
#: fixed values: video suffixes
VIDEO = ("mp4", "webm", "m4v", "mov", "ogv", "m3u8", "mpd", "ts")

#: What the URL standard leaves as it is: a lower-case host without port or user, and no character that it would encode.
PLAIN_TAIL = r"/[\x21\x24-\x3B\x3D\x40-\x5B\x5D-\x5F\x61-\x7A\x7C\x7E]*(?:\?[\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E]+)?(?:#[\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7E]+)?\z"
PLAIN_HOST = r"^https?://[a-z0-9.-]+"
DOTS = r"^[^?#]*/(?:\.|%2[eE]){1,2}(?:[/?#]|\z)"


def col(c: Str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once: what is built from a URL's parts would else repeat them many times over."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _escape(c: Column, unsafe: str) -> Column:
    """Percent-encodes non-ASCII and unsafe characters; other text is passed through untouched."""
    found = f"[{unsafe}]|[^\\x21-\\x7E]"
    one = lambda x: F.when(x.rlike(found), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)
    return let(c, lambda c: F.when(c.rlike(found), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c))


def remove_dots(path: Column) -> Column:
    """The path without `.` and `..` segments; one at the end leaves a slash."""
    dot, up = r"^(\.|%2[eE])$", r"^(\.|%2[eE]){2}$"
    start = F.array().cast("array<string>")
    # the first element is what stands before the leading slash
    step = lambda acc, s: F.when(s.rlike(up), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(s.rlike(dot), acc).otherwise(F.concat(acc, F.array(s)))
    ended = lambda p: F.when(p.rlike(r"(?i)/(\.|%2e){1,2}\z"), F.concat(p, F.lit("/"))).otherwise(p)
    return let(path, lambda p: F.when(p.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|\z)"), F.array_join(F.aggregate(F.split(ended(p), "/"), start, step), "/")).otherwise(p))


def _authority(scheme: Column, raw: Column) -> Column:
    """Lower-cased host with a port that isn't the default; null if there is no valid host."""
    parts = lambda raw: F.struct(F.lower(F.regexp_extract(raw, r"^(?:.*@)?([^:]*|\[[^\]]*\])(?::\d*)?\z", 1)).alias("host"), F.regexp_extract(raw, r":(\d*)\z", 1).alias("port"))

    def use(p: Column) -> Column:
        default = (p["port"] == "") | ((scheme == "http") & (p["port"] == "80")) | ((scheme == "https") & (p["port"] == "443"))
        named = F.concat(p["host"], F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), p["port"])))
        return F.when((p["host"] != "") & ~p["host"].rlike(r"[\s<>|^\\%]"), named)

    return let(let(raw, parts), use)


def _built(scheme: Column, authority: Column, tail: Column) -> Column:
    def path_of(t: Column) -> Column:
        path = F.replace(F.regexp_extract(t, r"(?s)^([^?#]*)", 1), F.lit("\\"), F.lit("/"))
        return let(path, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))

    def use(t: Column) -> Column:
        query = F.regexp_extract(t, r"(?s)^[^?#]*(\?[^#]+)", 1)
        return F.concat(scheme, F.lit("://"), authority, _escape(remove_dots(path_of(t)), '"<>`{}'), _escape(query, "\"<>'"), _escape(F.regexp_extract(t, r"(?s)(#.+)", 1), '"<>`'))

    return let(tail, use)


def is_plain(c: Column) -> Column:
    """Whether a URL is absolute and already as a browser writes it, by two patterns; few URLs that are read aren't."""
    return c.rlike(PLAIN_HOST + PLAIN_TAIL) & ~c.rlike(DOTS)


def absolute_url(c: Str) -> Column:
    """The URL as a browser writes it; null if it isn't absolute and valid. Only http and https are taken apart, and only what isn't plain."""

    def use(c: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(c, SCHEME, ""), r"^[/\\]*", "")
        parts = F.struct(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"), F.regexp_extract(rest, r"^([^/?#\\]*)", 1).alias("at"), F.regexp_replace(rest, r"^[^/?#\\]*", "").alias("tail"))
        web = lambda p: _built(p["scheme"], _authority(p["scheme"], p["at"]), p["tail"])
        return let(parts, lambda p: F.when(p["scheme"].isin("http", "https"), web(p)).when(p["scheme"] != "", c))

    c = col(c)
    return F.when(is_plain(c), c).otherwise(let(_trimmed(c), use))


def _trimmed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\t\n\r]", ""))


def url_scheme(c: Str) -> Column:
    return F.regexp_extract(absolute_url(c), r"^([^:]*):", 1)


def url_host(c: Str) -> Column:
    """Host and port that isn't the default."""
    return F.regexp_extract(absolute_url(c), r"^https?://([^/?#]*)", 1)


def url_origin(c: Str) -> Column:
    return F.regexp_extract(absolute_url(c), r"^(https?://[^/?#]*)", 1)


def resolve_url(ref: Str, base: Str) -> Column:
    """ref against an absolute base, dot segments removed; null if either is malformed."""

    def of(base: Column) -> Column:
        path = F.regexp_extract(base, r"^https?://[^/?#]*([^?#]*)", 1)
        return F.struct(
            F.regexp_extract(base, r"^(https?)://", 1).alias("scheme"), F.regexp_extract(base, r"^https?://([^/?#]*)", 1).alias("at"), path.alias("path"), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query")
        )

    def use(p: Column) -> Column:
        ref, base = p["ref"], p["base"]
        tail = (
            F.when(ref == "", F.concat(base["path"], base["query"]))
            .when(ref.startswith("#"), F.concat(base["path"], base["query"], ref))
            .when(ref.startswith("?"), F.concat(base["path"], ref))
            .when(ref.rlike(r"^[/\\]"), ref)
            .otherwise(F.concat(F.regexp_extract(base["path"], r"^(.*/)", 1), ref))
        )
        whole = F.when(ref.rlike(SCHEME), ref).when(ref.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), ref))
        relative = F.when(base["scheme"] != "", _built(base["scheme"], base["at"], tail))
        return let(whole, lambda w: F.when(w.isNotNull(), absolute_url(w)).otherwise(relative))

    ref, base = col(ref), col(base)
    path = ref.rlike("^(?!//)" + PLAIN_TAIL) & ~ref.rlike(DOTS)
    plain = F.when(is_plain(ref), ref).when(path, F.concat(F.regexp_extract(base, f"({PLAIN_HOST})", 1), ref))
    full = let(F.struct(_trimmed(ref).alias("ref"), let(absolute_url(base), of).alias("base")), use)
    return F.when(is_plain(base), F.coalesce(plain, full)).otherwise(full)


def url_pathname(c: Str) -> Column:
    """The path alone; a malformed URL stays as it is."""
    return F.coalesce(F.regexp_extract(absolute_url(c), r"^[^:]*:(?://[^/?#]*)?([^?#]*)", 1), col(c))


def strip_domain(c: Str) -> Column:
    """Path, query and fragment; a malformed URL stays as it is."""
    return F.coalesce(F.regexp_extract(absolute_url(c), r"(?s)^[^:]*:(?://[^/?#]*)?(.*)", 1), col(c))


def strip_qf(c: Str) -> Column:
    """Cut at the first ?, then at the first #."""
    return F.substring_index(F.substring_index(col(c), "?", 1), "#", 1)


def normalize_loc(c: Str) -> Column:
    """One trailing slash less; then the first /home before a slash or the end becomes /, so /home/x gives //x."""
    return F.regexp_replace(F.regexp_replace(col(c), r"/\z", ""), r"(?s)^(.*?)/home(?=/|\z)", "$1/")


def replace_first(c: Str, needle: Str | Column, repl: Str | Column) -> Column:
    """Only the first occurrence, and everything literally."""
    c, needle = col(c), needle if isinstance(needle, Column) else F.lit(needle)
    repl = repl if isinstance(repl, Column) else F.lit(repl)
    at = F.instr(c, needle)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), repl, F.substring(c, at + F.length(needle), F.length(c)))).otherwise(c)


def capture_key(c: Str, style: str = "joined", bases: tuple[str, ...] = ()) -> Column:
    """A folder name for a URL: `joined`, `joined_hex` or `hex`, which also drops the first of `bases` it finds."""
    c = col(c)
    hexed = lambda c: reduce(lambda a, x: F.replace(a, F.lit(x), F.lit(f"%{ord(x):x}")), ILLEGAL, c)
    if style == "hex":
        for base in bases:
            c = replace_first(c, base, "")
        out = hexed(F.regexp_replace(c, "^/", ""))
    elif style == "joined":
        out = let(F.regexp_replace(url_pathname(c), "^/+|/+$", ""), lambda p: F.translate(F.array_join(F.filter(F.split(p, "/"), lambda s: s != ""), "_"), '<>:"\\|?*', ""))
    elif style == "joined_hex":
        out = hexed(F.replace(F.regexp_replace(url_pathname(c), "^/+|/+$", ""), F.lit("/"), F.lit("_")))
    else:
        raise ValueError(f"unknown style {style}")
    return let(out, lambda x: F.when(x == "", F.lit("index")).otherwise(x))


def query_param(c: Str, key: str) -> Column:
    """The first value of a query parameter, decoded; null if absent or empty."""
    return F.nullif(F.try_url_decode(F.regexp_extract(col(c), rf"^[^?#]*\?(?:[^#]*&)?{key}=([^&#]*)", 1)), F.lit(""))


def iterated_decode(c: Str, n: int = 3) -> Column:
    """Percent-decoded up to n times, until it stays the same or is malformed; + stays +."""
    c = col(c)
    for _ in range(n):
        c = let(c, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))
    return c


def extract_candidate_url(c: Str) -> Column:
    """The URL that a request is about: of an image proxy's or another known parameter, else the first one in the text."""

    def use(p: Column) -> Column:
        raw, url = p["raw"], p["url"]
        image = F.when(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1) == "/_next/image", query_param(url, "url"))
        found = F.nullif(F.regexp_extract(raw, r"""(?i)(https?://[^)"'\s]+)""", 1), F.lit(""))
        inner = iterated_decode(F.coalesce(image, *[query_param(url, k) for k in URL_PARAMETERS], found))
        return F.when(url.isNull(), F.coalesce(found, raw)).otherwise(let(inner, lambda d: F.coalesce(resolve_url(d, raw), d, raw)))

    return let(F.struct(col(c).alias("raw"), absolute_url(c).alias("url")), use)


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?s)^([^?#]*)", 1))


def is_gif(c: Str) -> Column:
    return F.coalesce(_bare(col(c)).endswith(".gif"), F.lit(False))


def is_video(c: Str, resource_type: Column | None = None) -> Column:
    suffix = F.coalesce(_bare(col(c)).rlike(rf"\.({'|'.join(VIDEO)})\z"), F.lit(False))
    return suffix if resource_type is None else F.coalesce(resource_type == "media", F.lit(False)) | suffix


def is_allowed_media(c: Str, allow: tuple[tuple[str, str], ...] = (("c.clarity.ms", "/c.gif"),)) -> Column:
    """Whether host and path suffix are on the list."""
    c = absolute_url(c)
    host, path = F.regexp_extract(c, r"^https?://([^/?#:]*)", 1), F.regexp_extract(c, r"^https?://[^/?#]*([^?#]*)", 1)
    any_ = F.lit(False)
    for h, p in allow:
        any_ = any_ | ((host == h) & path.endswith(p))
    return F.coalesce(any_, F.lit(False))


def media_filename(c: Str, asset_host: str) -> Column:
    """The last path segment, decoded and lower-cased; on asset hosts without its prefix up to the first `-`. Null if malformed."""

    def parts(url: Column) -> Column:
        raw = F.regexp_extract(url, r"^https?://[^/?#]*+/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|\z)", 1)
        name = let(raw, lambda n: F.when(F.contains(n, F.lit("%")), F.try_url_decode(F.replace(n, F.lit("+"), F.lit("%2B")))).otherwise(n))
        return F.struct(url.alias("url"), F.regexp_extract(url, r"^https?://([^/?#:]*)", 1).alias("host"), name.alias("name"))

    def use(p: Column) -> Column:
        host, name = p["host"], p["name"]
        at = F.instr(name, F.lit("-"))
        rest = F.substring(name, at + 1, F.length(name))
        asset = (host == asset_host) | host.endswith(f".{asset_host}")
        cut = asset & (at > 1) & (at < F.length(name)) & F.contains(rest, F.lit("."))
        return F.when(p["url"].isNotNull(), F.lower(F.when(cut, rest).otherwise(name)))

    return let(let(absolute_url(c), parts), use)


def editor_url(kind: str, item_id: Str, project: Str, base: str = "https://editor.example.com") -> Column:
    """The page on which an entry or a composition is edited."""
    if kind not in ("entry", "composition"):
        raise ValueError(f"unknown kind {kind}")
    folder = {"entry": "entries", "composition": "edit"}[kind]
    return F.concat(F.lit(f"{base}/projects/"), col(project), F.lit(f"/dashboards/canvas/{folder}/"), col(item_id))


def search_url(base: str, slug: Str) -> Column:
    return F.concat(F.lit(f"{base}search?searchTerm="), col(slug))
