"""WARC archives: writing pages, reading records, and assembling transactions.

A capture is written as a request, a response (or a revisit of an equal payload) and a metadata record, the first
and the last of which name the second in WARC-Concurrent-To. Archives are read record by record, in parallel over
files; the records are joined through these identifiers into one nested row per capture. Payloads of any length are
written and read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import parallelism, record_batch, scratch_dir, slices, stored, utf8, view

FILE_BYTES = 128 << 20
READ_BYTES = 1 << 20
MIN_REVISIT = 1000
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORDS = pa.schema([
    ("file", pa.string()), ("place", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()),
    ("payload_digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http", pa.string()), ("payload", pa.binary()),
])
_RECORDS_DDL = "file string, place long, type string, record_id string, concurrent_to array<string>, target_uri string, date string, payload_digest string, headers map<string,string>, http string, payload binary"


# one record


def record(kind: str, record_id: str, block: bytes, headers: list[tuple[str, str | None]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def uri(url: str | None) -> str | None:
    """What may stand in a header: control characters and spaces are percent-encoded."""
    return quote(url, safe="".join(map(chr, range(33, 127)))) if url else None


def capture(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int, str | None] | None) -> list[bytes]:
    """The three records of a page. refers: the page that holds the same payload, and its url."""
    own, target = f"<urn:uuid:{uuid.uuid4()}>", uri(url)
    labelled = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    parts = urlsplit(target or "/")
    ask = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    fields = [("page_id", page_id), ("refers_to_page_id", refers[0] if refers else None)]
    common = [("WARC-Target-URI", target), ("WARC-Payload-Digest", labelled), ("Content-Type", "application/http; msgtype=response")]
    main = record("revisit", own, http, [*common, ("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", uri(refers[1])), ("WARC-Refers-To-Date", DATE)]) if refers else record("response", own, http + payload, common)
    other = lambda kind, block, mime: record(kind, f"<urn:uuid:{uuid.uuid4()}>", block, [("WARC-Target-URI", target), ("WARC-Concurrent-To", own), ("Content-Type", mime)])
    return [other("request", ask, "application/http; msgtype=request"), main, other("metadata", "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode(), "application/warc-fields")]


# writing


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes .warc.gz files (one gzip member a record) below folder; returns a row per page: file, page_id.

    Of equal payloads of at least min_revisit bytes the one of the largest id is a response and the others revisit
    it; rows that repeat that id as well are responses too, as are all others. Null html is an empty payload, a null url
    leaves the header out, and a null id is smaller than any other. A task that is repeated writes files of other
    names, and only those of the attempt whose rows were committed are named in the result.
    """
    rows = view(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "check": F.xxhash64("html"), "size": F.octet_length("html")})
    key = ["digest", "check", "size"]
    again = rows.filter(F.col("size") >= min_revisit).groupBy(*key).agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = stored(again, "repeated").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    matched = salted.join(again, [*key, "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    matched = matched.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    schema = pa.schema([("file", pa.string()), ("page_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path)
        out, ids, size, name = None, [], 0, ""

        def pressed(data: bytes) -> bytes:
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            return z.compress(data) + z.flush()

        def close() -> pa.RecordBatch:
            out.close()
            return record_batch(schema, {"file": [f"{folder}/{name}"] * len(ids), "page_id": ids})

        for batch in slices(batches, 512):
            payloads = utf8(batch["html"])
            for i, url, payload, digest, again, first_id, first_url in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), payloads, *(batch[c].to_pylist() for c in ("digest", "revisit", "first_id", "first_url"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, ids, size = fs.open_output_stream(f"{path}/{name}", compression=None), [], 0
                    data = pressed(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"software: lamella\r\nformat: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")]))
                    out.write(data)
                data = b"".join(map(pressed, capture(i, url, payload, digest, (first_id, first_url) if again else None)))
                out.write(data)
                ids.append(i)
                size += len(data)
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return stored(matched.mapInArrow(run, "file string, page_id long"), "written")


# reading


class _Stream:
    """The plain bytes of an archive, compressed (any number of gzip members) or not, read piece by piece."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.have, self.raw = file, bytearray(), file.read(READ_BYTES)
        self.gzip = self.raw[:2] == b"\x1f\x8b"
        self.z = zlib.decompressobj(31) if self.gzip else None

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(READ_BYTES)
            if not self.raw:
                return False
        if not self.gzip:
            self.have += self.raw
            self.raw = b""
            return True
        self.have += self.z.decompress(self.raw)
        self.raw = self.z.unused_data
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is passed over; None at the end of the file."""
        at = 0
        while (k := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.have[:k])
        del self.have[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def skip_blank(self) -> bool:
        """Passes over line ends; false at the end of the file."""
        while True:
            k = 0
            while k < len(self.have) and self.have[k] in b"\r\n":
                k += 1
            del self.have[:k]
            if self.have:
                return True
            if not self.more():
                return False


def _folded(head: bytes) -> list[tuple[str, str]]:
    """The headers; a line that begins with a space goes on with the one before."""
    text = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace"))
    return [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in re.split(r"\r?\n", text)) if c]


def records(file: pa.NativeFile) -> Iterator[dict]:
    """The records of an archive, as rows of read_warc without the file."""
    stream, place = _Stream(file), 0
    while stream.skip_blank():
        head = stream.until(b"\r\n\r\n")
        if head is None:
            raise ValueError("an archive ends within a record")
        if not head.startswith(b"WARC/"):
            raise ValueError("this isn't a WARC archive")
        fields = _folded(head.split(b"\n", 1)[1] if b"\n" in head else b"")
        named = {k.lower(): v for k, v in fields}
        if not named.get("content-length", "").isdecimal():
            raise ValueError("a record has no Content-Length")
        block = stream.take(int(named["content-length"]))
        http, payload = None, block
        if named.get("content-type", "").startswith("application/http") and b"\r\n\r\n" in block:
            h, _, payload = block.partition(b"\r\n\r\n")
            http = h.decode("utf-8", "replace")
        yield {
            "place": place, "type": named.get("warc-type"), "record_id": named.get("warc-record-id"), "concurrent_to": [v for k, v in fields if k.lower() == "warc-concurrent-to"], "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"),
            "payload_digest": named.get("warc-payload-digest"), "headers": list(named.items()), "http": http, "payload": payload,
        }
        place += 1


def read_warc(files: DataFrame) -> DataFrame:
    """One row per record of the archives (a DataFrame with the column file): file, place, type, record_id,
    concurrent_to, target_uri, date, payload_digest, headers (names in lower case), http, payload, and payload_bytes and payload_sha1. Records of any length are read whole. What isn't an archive, ends within a
    record, or has a record without a Content-Length raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["file"].to_pylist():
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(path, compression=None) as f:
                    held, size = [], 0
                    for r in records(f):
                        held.append(r | {"file": name})
                        size += len(r["payload"])
                        if len(held) >= 1024 or size > 8 << 20:
                            yield record_batch(_RECORDS, {c: [r[c] for r in held] for c in _RECORDS.names})
                            held, size = [], 0
                    if held:
                        yield record_batch(_RECORDS, {c: [r[c] for r in held] for c in _RECORDS.names})

    # a fixed number of tasks: rows that name files are small, and adaptive execution would read all files in one task
    return files.repartition(parallelism(files)).mapInArrow(run, _RECORDS_DDL).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})


def _attached(mains: DataFrame, others: DataFrame, kind: str) -> DataFrame:
    """capture, and the array of the records of a kind that are concurrent to it, whichever of the two says so."""
    rows = others.filter(F.col("type") == kind).select(F.col("record_id").alias("other"), F.col("concurrent_to").alias("to"), F.struct("record_id", "http", "payload").alias("r"))
    named = rows.select(F.explode("to").alias("capture"), "r")
    naming = mains.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other")).join(rows.drop("to"), "other").select("capture", "r")
    # as many as name one capture: one or two
    return named.unionByName(naming).groupBy("capture").agg(F.array_sort(F.array_distinct(F.collect_list("r"))).alias(kind))


def transactions(found: DataFrame) -> DataFrame:
    """One nested row per capture of read_warc's records: capture (its record id), kind (response or revisit),
    target_uri, date, payload_digest, headers, http, payload, payload_bytes, payload_sha1, and request and metadata, arrays of record_id, http and payload.

    A capture without a request or metadata has a null there; those that name no capture are in no row. Archives in
    which two captures have the same record id aren't valid: both get the records that name it.
    """
    mains = found.filter(F.col("type").isin("response", "revisit"))
    rows = mains.select(F.col("record_id").alias("capture"), F.col("type").alias("kind"), "target_uri", "date", "payload_digest", "headers", "http", "payload", "payload_bytes", "payload_sha1")
    for kind in ("request", "metadata"):
        rows = rows.join(_attached(mains, found, kind), "capture", "left")
    return rows


def sha1_hex(label: Column) -> Column:
    """The bare hex of a payload digest: sha1:BASE32 or sha1:HEX."""
    bare = F.regexp_replace(label, "^(?i)sha1:", "")
    bits = F.concat(*[F.lpad(F.bin(F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.substring(bare, k, 1)).cast("long") - 1), 5, "0") for k in range(1, 33)])
    hexed = F.lower(F.concat(*[F.lpad(F.conv(F.substring(bits, 1 + 40 * k, 40), 2, 16), 10, "0") for k in range(4)]))
    return F.when(F.length(bare) == 32, hexed).otherwise(F.lower(bare))


def _field(name: str) -> Column:
    """A whole number from the first metadata record."""
    return F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), rf"(?m)^{name}: (-?\d+)", 1).try_cast("long")


def archived_pages(files: DataFrame) -> DataFrame:
    """One row per page of archives that write_warc wrote: page_id, payload_bytes, payload_digest, record_type and
    refers_to. Bytes and digest are computed from the payload read; those of a revisit from that of the response it
    refers to, which is found by page id and labelled digest. A revisit whose response isn't in these archives has its
    labelled digest and null payload_bytes. A payload that doesn't have its labelled digest raises."""
    found = read_warc(files)
    found = stored(found.withColumn("payload", F.when(F.col("type").isin("request", "metadata"), F.col("payload"))), "records")  # what is joined has no pages in it
    rows = transactions(found).select(
        _field("page_id").alias("page_id"), _field("refers_to_page_id").alias("refers_to"), "kind", sha1_hex(F.col("payload_digest")).alias("label"),
        F.col("payload_bytes").alias("n"), F.col("payload_sha1").alias("digest"),
    )
    rows = stored(rows, "captures")
    responses = rows.filter("kind = 'response'")
    origins = rows.filter("kind = 'revisit'").select(F.col("refers_to").alias("page_id"), "label").distinct().join(responses.select("page_id", "label", "n", "digest").distinct(), ["page_id", "label"])
    origins = origins.select(F.col("page_id").alias("refers_to"), "label", "n", "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    revisits = rows.filter("kind = 'revisit'").drop("n", "digest").withColumn("salt", salt).join(origins, ["refers_to", "label", "salt"], "left").withColumn("digest", F.coalesce("digest", "label"))
    both = responses.unionByName(revisits.drop("salt"))
    right = F.when(F.col("digest") == F.col("label"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("the payload isn't that of its digest: page "), F.col("page_id").cast("string"))))
    return both.select("page_id", F.col("n").alias("payload_bytes"), right.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/warc"
    written = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return archived_pages(written.select("file").distinct())


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
m AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""
