"""Exact removal of repeated passages, found by recompression (operator 7).

A window of WINDOW words whose sequence starts anywhere else as well is a repeat, and every word that such a
window covers is removed.  Texts are compressed into symbols with consistent names (see recompression), and
every window is filed under its anchor, a symbol inside it that equal windows share.  Neighbouring windows
with one anchor are an occurrence, a row: the anchor, a hash of the whole span that the occurrence's windows
cover, place and number.

1. Anchors with two occurrences or more are kept: only there can windows repeat.
2. Occurrences of one anchor and one span hash are copies, and all their windows repeat.
3. Where an anchor has several spans, one occurrence of each is opened: its windows are hashed one by one
   and counted by anchor and hash, a span of several copies counting as often.
4. The places of repeats go back to their texts.

Windows of one word repeated, as in a run of it, are one occurrence that counts each.  Anchor and hash
together have 128 bits.  Counts are pre-aggregated before each shuffle, and the joins that hand results
back can be split where a passage is very frequent, so no task holds all occurrences of one.  Texts are
shuffled twice: to open spans, and to remove words.

Words are separated by ASCII white space and compared as they are.  A null text has no words and stays
null; texts of fewer words than a window are left alone.  Rows are told apart by doc_id and a 64-bit
hash of their text, so null and repeated doc_ids are allowed; repeated rows repeat each other's windows.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowsmith.llm.common import column, discard, documents, per_batch, settle, sweep, texts
from rowsmith.llm.recompression import Spans, anchors, hashes

WINDOW = 35
#: Bytes of text that a task compresses at once.
AT_ONCE = 1 << 20
KEY = ["doc_id", "th"]


def split(batch: list[str | None]) -> tuple[list[list[bytes]], np.ndarray]:
    """Words of each text, and the place of each text's first word among all."""
    words = [t.encode().split() if t else [] for t in batch]
    return words, np.cumsum([0, *map(len, words)])


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    """a, s, key, w0, n and weight of every occurrence: n windows from word w0 on, which count as weight."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at = split(texts(batch))
        h = hashes([w for ws in words for w in ws])
        m = np.maximum(np.diff(at) - window + 1, 0)
        doc = np.repeat(np.arange(len(m)), m)
        first = at[doc] + np.arange(len(doc)) - (np.cumsum(m) - m)[doc]
        name, place = anchors(h, window, first)
        spans = Spans(h)
        each = spans.hash(first, first + window)
        near = np.zeros(len(first), bool)  # to the window before: in the same text
        near[1:] = doc[1:] == doc[:-1]
        same, run_of = near.copy(), near.copy()
        run_of[1:] &= each[1:] == each[:-1]
        ahead = np.concatenate([run_of[1:], [False]])
        same[1:] &= (place[1:] == place[:-1]) & (name[1:] == name[:-1]) & ~run_of[:-1] & ~ahead[1:]
        begins = np.flatnonzero(~(run_of | same))
        n = np.diff(np.concatenate([begins, [len(first)]])) if len(first) else np.zeros(0, np.int64)
        in_run = ahead[begins]
        lo = first[begins]
        hi = np.where(in_run, lo + window, lo + n + window - 1)
        s = spans.hash(lo, hi) + np.where(in_run, 0, place[begins] - lo).astype(np.uint64)
        # an anchor's place in a run depends on the run; it is the window's own there
        s = np.where(in_run | (n == 1), each[begins], s)
        of = pa.array(doc[begins])
        cols = [pa.array(name[begins].view(np.int64)), pa.array(s.view(np.int64)), column(batch, "doc_id").take(of), column(batch, "th").take(of), pa.array((lo - at[doc[begins]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.where(in_run, n, 1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["a", "s", "doc_id", "th", "w0", "n", "weight"])

    return per_batch(docs.select(*KEY, "text"), run, "a long, s long, doc_id long, th long, w0 int, n int, weight int", AT_ONCE)


def opened(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """a, h, key, w0 and c of every window of spans (a, key, w0, n, c), read from the texts."""
    by_doc = spans.groupBy(*KEY).agg(F.collect_list(F.struct("a", "w0", "n", "c")).alias("spans"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at = split(texts(batch))
        hashed = Spans(hashes([w for ws in words for w in ws]))
        lists = column(batch, "spans")
        of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        a, w0, n, c = (x.to_numpy() for x in lists.flatten().flatten())
        k = np.repeat(np.arange(len(n)), n)
        w = w0[k] + np.arange(len(k)) - (np.cumsum(n) - n)[k]
        first = at[of[k]] + w
        h, row = hashed.hash(first, first + window), pa.array(of[k])
        cols = [pa.array(a[k]), pa.array(h.view(np.int64)), column(batch, "doc_id").take(row), column(batch, "th").take(row), pa.array(w.astype(np.int32)), pa.array(c[k])]
        return pa.RecordBatch.from_arrays(cols, names=["a", "h", "doc_id", "th", "w0", "c"])

    return per_batch(with_key(docs, by_doc, "inner").select("doc_id", "th", "text", "spans"), run, "a long, h long, doc_id long, th long, w0 int, c long", AT_ONCE)


def with_key(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    other = by_doc.select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), *[c for c in by_doc.columns if c not in KEY])
    return docs.join(other, docs["doc_id"].eqNullSafe(other["_doc_id"]) & (docs["th"] == other["_th"]), how).drop("_doc_id", "_th")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, w0 and n of runs of repeated windows."""
    spark = docs.sparkSession
    every = settle(occurrences(docs, window), "occurrences")
    shared = settle(every.groupBy("a").agg(F.sum("weight").alias("c")).where("c > 1").select("a"), "anchors")
    some = settle(every.join(shared, "a", "left_semi"), "shared")
    discard(spark, every, shared)
    del every, shared
    sweep(spark)
    one = F.min(F.struct("doc_id", "th", "w0", "n"))
    spans = settle(some.groupBy("a", "s").agg(F.sum("weight").alias("c"), one.alias("one")), "spans")
    copied = some.join(spans.where("c > 1").select("a", "s"), ["a", "s"], "left_semi").select(*KEY, "w0", "n")
    copied = settle(copied, "copied")
    discard(spark, some)
    several = settle(spans.groupBy("a").count().where("count > 1").select("a"), "several")  # a shuffle of its own, so the join can be split
    to_open = spans.join(several, "a", "left_semi").select("a", "one.*", "c")
    to_open = settle(to_open, "to_open")
    del some
    windows = settle(opened(docs, to_open, window), "windows")
    discard(spark, spans, to_open, several)
    del spans, to_open
    sweep(spark)
    often = windows.groupBy("a", "h").agg(F.sum("c").alias("c")).where("c > 1").select("a", "h")
    single = windows.where("c = 1").join(settle(often, "often"), ["a", "h"], "left_semi").select(*KEY, "w0", F.lit(1).alias("n"))
    found = settle(copied.unionByName(single), "repeats")
    discard(spark, windows, copied)
    sweep(spark)
    return found


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of docs, as a struct `row`, with n_words, n_removed and kept, its other words joined by blanks.

    kept is null where nothing is removed; the text is then the row's own.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))
    found = repeats(rows.select(*KEY, "text"), window)
    by_doc = found.groupBy(*KEY).agg(F.collect_list(F.struct("w0", "n")).alias("runs"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, gone, kept = [], [], []
        for text, runs in zip(texts(batch), column(batch, "runs")):
            words = text.encode().split() if text else []
            count.append(len(words))
            if not runs.is_valid:
                gone.append(0)
                kept.append(None)
                continue
            w0, n = (x.to_numpy() for x in runs.values.flatten())
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, w0, 1)
            np.add.at(change, w0 + n + window - 1, -1)
            keep = np.cumsum(change[:-1]) == 0
            gone.append(int(len(words) - keep.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(keep)]).decode())
        return pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    joined = with_key(rows, by_doc, "left").select("row", "text", "runs")
    schema = StructType([joined.schema["row"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return per_batch(joined, run, schema, AT_ONCE)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, and the SHA-256 of the kept words joined by one blank."""
    rows = removed(docs.select("doc_id", "text"), window)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [hashlib.sha256(b" ".join((k if k is not None else t or "").encode().split())).hexdigest() for k, t in zip(texts(batch, "kept"), texts(batch))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return per_batch(rows.select("row.doc_id", "n_words", "n_removed", "kept", "row.text"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages removed from text, and n_chars, where there is one, counted anew."""
    rows = removed(docs, window)
    text = F.coalesce("kept", "row.text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM p),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM d, generate_series(0, 34) AS t(o)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
