"""WARC archives: writing, and a splittable reader (operator 5).

Archives are files of gzip members, a record each, so that a reader may begin at any member.  Reading tasks
own byte ranges: each scans its range for the gzip magic, takes a place for a member's start only if it
decodes there to a header of a WARC record, and owns the records that start inside its range, reading past
its end for the last.  A range's first candidate is taken only if its member ends where another one begins or the
file ends: a payload may hold a whole archive.  No index and no order of records is needed.

Payloads of equal bytes, of at least LEAST_BYTES, are stored once: by the record of the smallest page_id.
The others are revisit records that refer to it and have no payload; a header carries its length, as
WARC-Payload-Digest carries the SHA-256 of the full payload.

Null html is an empty payload, null urls are the empty URI of no target; a null page_id is written as such
and comes back as null; its record is never a revisit nor referred to.  Rows of one page_id and one payload
are records of their own, of which one is the response if they are the group's smallest.
An empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.common import bounded, commit_file, shared_dir, store

LEAST_BYTES, MAGIC, RANGE = 100, b"\x1f\x8b\x08", 16 << 20
#: Ranges beyond which they grow: the driver lists them.
MOST_RANGES = 100_000
#: Read at once while scanning, and enough of a member to hold a record's headers.
CHUNK, HEAD = 1 << 20, 1 << 16
#: Copies that the row of a repeated payload is dealt to, so that a payload of very many pages is joined by many tasks.
SALTS = 16
LEVEL = 3
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    kind = "response" if refers_to is None else "revisit"
    name = lambda n: f"<urn:page:{'null' if n is None else n}>"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(37) + '/:?#[]@!$&()*+,;=-._~')}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-cased name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("record cut short")
    return fields, rest[:n]


class Stream:
    """A file read onwards from a place, by look-ahead."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.held = file, at, size, b""
        file.seek(at)

    def want(self, n: int) -> bytes:
        """The next n bytes at least, or all that are left."""
        while len(self.held) < n and (got := self.file.read(max(CHUNK, n - len(self.held)))):
            self.held += got
        return self.held

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def take(self) -> bytes:
        """What is held, or else the next bytes; none at the end."""
        data = self.held or self.file.read(CHUNK)
        self.held, self.at = b"", self.at + len(data)
        return data

    def give_back(self, data: bytes) -> None:
        self.held, self.at = data + self.held, self.at - len(data)


def starts_here(data: bytes) -> bool:
    """Whether a member of a WARC record begins here: it decodes, to such a header."""
    try:
        out = zlib.decompressobj(31).decompress(data[:HEAD], 64)
    except zlib.error:
        return False
    return re.match(rb"WARC/\d+\.\d+\r\n", out) is not None


def records(file, lo: int, hi: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in bytes lo to hi."""
    s, sure = Stream(file, lo, size), lo == 0
    while s.at < hi:
        data = s.want(HEAD)
        if not data:
            return
        k = data.find(MAGIC, 0, min(len(data), hi - s.at + len(MAGIC) - 1))
        if k < 0:
            s.drop(max(1, min(len(data) - len(MAGIC) + 1, hi - s.at)))
            if len(data) < len(MAGIC):
                return
            continue
        s.drop(k)
        if s.at >= hi:
            return
        if not starts_here(s.want(HEAD)):
            s.drop(1)
            continue
        start, z, out = s.at, zlib.decompressobj(31), []
        try:
            while not z.eof:  # through the member, which may be longer than what is held
                if not (data := s.take()):
                    raise ValueError(f"member at {start} is cut short")
                out.append(z.decompress(data))
            s.give_back(z.unused_data)
            sure = sure or not s.want(1) or starts_here(s.want(HEAD))
        except (ValueError, zlib.error):
            if sure:
                raise
        if not sure:  # part of a payload, not a record
            s = Stream(file, start + 1, size)
            continue
        yield parse(b"".join(out))


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to.  Every page is joined by its digest, with a row for each repeated payload."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    firsts = rows.where((F.octet_length("html") >= LEAST_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write an archive for each partition; one row for each: uri, records and bytes."""
    bounded(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, uri = 0, f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz"

        def fill(out) -> None:
            nonlocal n
            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    page_id, url, html, digest, refers_to = r
                    out.write(member(record(page_id, url, html.encode(), digest, refers_to)))
                    n += 1

        size = commit_file(uri, fill)
        yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [n], "bytes": [size]})

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "uri string, records long, bytes long")


def read(spark: SparkSession, archives: list, size: int = RANGE) -> DataFrame:
    """The records of archives (uri, bytes): page_id, url, payload (null in revisits), and what ROWS has.

    payload_digest is of the payload where there is one, and must be what its header says.
    """
    size = max(size, sum(a["bytes"] for a in archives) // MOST_RANGES)
    tasks = [(a["uri"], lo, min(lo + size, a["bytes"]), a["bytes"]) for a in archives for lo in range(0, a["bytes"], size)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: None if s is None or "null" in s else int(s.rpartition(":")[2].rstrip(">"))
        for batch in batches:
            for t in batch.to_pylist():
                disk, path = store(t["uri"])
                rows, held = [], 0
                with disk.open_input_file(path) as file:
                    for fields, block in records(file, t["lo"], t["hi"], t["bytes"]):
                        kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(block).hexdigest() != said:
                            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                        n = len(block) if kind == "response" else int(fields["warc-payload-length"])
                        rows.append((number(fields["warc-record-id"]), n, said, kind, number(fields.get("warc-refers-to")), fields["warc-target-uri"], block if kind == "response" else None))
                        held += len(block)
                        if held > CHUNK:
                            yield as_batch(rows)
                            rows, held = [], 0
                yield as_batch(rows)

    frame = spark.createDataFrame(tasks, "uri string, lo long, hi long, bytes long").repartition(max(1, min(len(tasks), 10_000)))
    return frame.mapInArrow(run, ROWS + ", url string, payload binary")


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    cols = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write(with_references(pages), shared_dir(spark, "warc")).collect()
    return read(spark, archives).select(*[c.split()[0] for c in ROWS.split(", ")])


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
