"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

A monolithic archive is one gzip stream around all records, so nothing in it can be sought. The normaliser inflates
such a stream once, front to back in bounded memory, rewrites each record as a gzip member of its own, and leaves a
sidecar index of offsets and lengths. Readers then seek single records. Files lie in a folder that driver and executors
share; a task names its files anew at each attempt, and only those of the attempt that ended are listed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passerelle.llm.common import hot_join, read, shared_dir, written

GZIP, STEP = 31, 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"
INDEX = "path string, offset long, length long"


def opened(uri: str, mode: str):
    """A stream of the file: `w` writes, `r` reads onwards, `s` can seek."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        files.create_dir(path.rpartition("/")[0], recursive=True)
        return files.open_output_stream(path, compression=None)
    return files.open_input_stream(path, compression=None) if mode == "r" else files.open_input_file(path)


def line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def coded(key: str) -> str:
    """A key as a header's value: percent-encoded but for letters, digits and -._~, so that unquote() gives exactly the key, spaces and line ends too."""
    return quote(key, safe="")


def urn(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def record(kind: str, page: str | None, url: str | None, payload: bytes, digest: str, refers: str | None, date: str) -> bytes:
    """A WARC/1.1 record; a revisit has the payload's digest and length and its response's record ID, but no block.

    IDs are those of page and payload (and URL, for revisits), so rows that repeat are the same record again.
    """
    own = urn(kind, page, digest) if kind == "response" else urn(kind, page, url, digest)
    block, head = b"", ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += [f"{name}: {value}" for name, value in (("WARC-Target-URI", url and line(url)), ("X-Page-Id", page and coded(page))) if value is not None]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {urn('response', refers, digest)}", f"X-Refers-To-Page: {coded(refers or '')}"]
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        head += ["Content-Type: application/http;msgtype=response"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(head: bytes) -> dict[str, str]:
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest if x)}


class Inflated:
    """Reads what a gzip stream of one or more members inflates to, a step at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.inflate, self.held, self.at, self.raw = stream, zlib.decompressobj(GZIP), b"", 0, b""

    def more(self) -> bool:
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(GZIP)
        data = self.inflate.unconsumed_tail or self.raw or self.stream.read(STEP)
        self.raw = b""
        if not data:
            return False
        self.held, self.at = self.held[self.at :] + self.inflate.decompress(data, STEP), 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, and drops both; None at the end."""
        while (found := self.held.find(mark, self.at)) < 0:
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError("the archive ends within a record's header")
                return None
        out, self.at = self.held[self.at : found], found + len(mark)
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            part = self.held[self.at : self.at + n]
            if not part and not self.more():
                raise ValueError("the archive ends within a record")
            self.at, n = self.at + len(part), n - len(part)
            if part:
                yield part


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", most: int = 64 << 20, level: int = 6) -> DataFrame:
    """Monolithic archives of rows (page, url, html, digest, kind, refers), `most` bytes of records each or one larger record."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, done, n, size = None, [], 0, 0

        def close() -> None:
            nonlocal out
            out.write(squeeze.flush())
            out.close()
            done.append((path, n))
            out = None

        for part in parts:
            for r in part.itertuples(index=False):
                if out is None:
                    path, squeeze, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, wbits=GZIP), 0, 0
                    out = opened(path, "w")
                data = record(r.kind, r.page, r.url, (r.html or "").encode(), r.digest, r.refers, date)
                out.write(squeeze.compress(data))
                n, size = n + 1, size + len(data)
                if size >= most:
                    close()
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records"])

    return written(records.mapInPandas(of, MANIFEST), "archives")


def normalise(archives: DataFrame, folder: str, level: int = 6, most_tasks: int = 20_000) -> DataFrame:
    """Each archive of the manifest anew, with a member per record, and beside it `.idx`: a JSON line (path, offset, length) per record.

    Inputs of several members are read as well. One that ends within a record, or holds something else, raises.
    """

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for source in part["path"]:
                path, offset, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with opened(source, "r") as stream, opened(path, "w") as out, opened(f"{path}.idx", "w") as index:
                    inflated = Inflated(stream)
                    while (head := inflated.until(b"\r\n\r\n")) is not None:
                        squeeze = zlib.compressobj(level, wbits=GZIP)
                        out.write(squeeze.compress(head + b"\r\n\r\n"))
                        for piece in inflated.take(int(parsed(head)["content-length"]) + 4):
                            out.write(squeeze.compress(piece))
                        out.write(squeeze.flush())
                        end = out.tell()
                        index.write((json.dumps({"path": path, "offset": offset, "length": end - offset}) + "\n").encode())
                        offset, n = end, n + 1
                yield pd.DataFrame([(path, n)], columns=["path", "records"])

    spread = archives.repartition(max(1, min(most_tasks, archives.count())), "path")
    return written(spread.mapInPandas(of, MANIFEST), "normalised")


def read_records(archives: DataFrame, most_tasks: int = 20_000) -> DataFrame:
    """A row per record of normalised archives, each sought by its index entry: page, kind, refers, payload_bytes, payload_digest, stored (the payload; null in revisits)."""
    spark = archives.sparkSession

    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                with opened(f"{path}.idx", "r") as stream:
                    lines = stream.read().decode().splitlines()
                yield pd.DataFrame([json.loads(x) for x in lines], columns=["path", "offset", "length"])

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, own in part.groupby("path", sort=False):
                with opened(path, "s") as file:
                    for offset, length in zip(own["offset"].tolist(), own["length"].tolist(), strict=True):
                        file.seek(offset)
                        head, _, block = zlib.decompress(file.read(length), GZIP).partition(b"\r\n\r\n")
                        fields = parsed(head)
                        page, refers = (unquote(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page"))
                        kind = fields["warc-type"]
                        if kind == "revisit":
                            rows.append((page, kind, refers, int(fields["x-payload-length"]), fields["warc-payload-digest"].rpartition(":")[2], None))
                        else:
                            payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
                            rows.append((page, kind, None, len(payload), hashlib.sha256(payload).hexdigest(), payload))
            yield pd.DataFrame(rows, columns=["page", "kind", "refers", "payload_bytes", "payload_digest", "stored"])

    index = archives.select("path").repartition(max(1, min(most_tasks, archives.count())), "path").mapInPandas(entries, INDEX)
    return index.mapInPandas(of, "page string, kind string, refers string, payload_bytes long, payload_digest string, stored binary")


def archive_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """What to write: page, url, html, digest, kind, refers.

    Of equal payloads of `least` bytes or more the smallest page_id is the response, and the others revisit it; rows
    that repeat this page_id are responses too. A null html is an empty payload. Rows with a null page_id revisit a
    response that has one, else are responses.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    long = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    out = hot_join(rows, long, ["digest"], "n", F.xxhash64("id"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return out.select(F.col("id").cast("string").alias("page"), "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first").cast("string")).alias("refers"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    archives = write_archives(archive_records(pages), shared_dir(spark, "warc"))
    records = read_records(normalise(archives, shared_dir(spark, "warc-members")))
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))
