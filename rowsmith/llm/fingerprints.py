"""Document fingerprints: a homomorphic multiset hash of paragraphs (operator 8).

A text is cut into pieces: paragraphs end at line breaks, and within a long paragraph a piece also ends at
blanks whose four preceding bytes say so, hence at places that do not depend on what stands further away.
Every piece is hashed with XXH3 (128 bits) into a vector of 128 lanes of +1 and -1 and two wide lanes of 64
bits.  A fingerprint is the sum of its pieces' vectors, the lanes modulo 2^16 and the wide lanes modulo
2^64.  Addition makes the order of pieces irrelevant, and inserting or deleting a piece adds or subtracts
one vector.  Equal multisets of pieces, so equal texts, have equal fingerprints; by the wide lanes
different ones do not, but for a chance of about 2^-128.

The likeness of two texts is 1 if their sums are equal, else the cosine of the sums' lanes before these are
reduced (at least 0, below 1), as lanes of very many equal pieces would change sign: the sum over the lanes of products estimates how many pieces both have, with a standard error near 1/11.
An empty text has no piece, the zero vector and likeness 0 to any other.

Null texts are empty.  Rows of one doc_id are taken in the order of their texts; null doc_ids come last in
descending order.  With one row, the next document is the row itself.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.common import bounded, column, documents, texts

LANES, WIDE = 128, 2
#: A blank ends a piece where the hash of the four bytes before it has these bits clear: about one in four.
CUT_MASK = 3
ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows of a range of neighbours, and the most ranges: beyond that, ranges grow.
RANGE_ROWS, MOST_RANGES = 4000, 65_536


def pieces(data: bytes) -> list[bytes]:
    """The pieces of a text in UTF-8; joined they are the text."""
    if not data:
        return []
    b = np.frombuffer(data, np.uint8)
    lines, blanks = np.flatnonzero(b == 10), np.flatnonzero(b == 32)
    near = np.zeros(len(blanks), dtype=np.uint32)
    for back in (4, 3, 2, 1):  # positions before the text count as its first byte
        near = (near + b[np.maximum(blanks - back, 0)] + np.uint32(1)) * np.uint32(0x9E3779B1)
    at = np.unique(np.concatenate([lines, blanks[(near >> np.uint32(20)) & np.uint32(CUT_MASK) == 0], [len(b) - 1]]) + 1).tolist()
    return [data[i:j] for i, j in zip([0, *at], at)]


def vector(parts: list[bytes]) -> np.ndarray:
    """The sum of the pieces' vectors: LANES of int64 (to be taken modulo 2^16) and WIDE of uint64."""
    out = np.zeros(LANES + WIDE, dtype=np.int64)
    if parts:
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in parts]), np.uint8).reshape(-1, 16)
        n = len(parts)
        out[:LANES] = 2 * np.unpackbits(digest, axis=1).sum(axis=0, dtype=np.int64) - n
        wide = digest.view(">u8").astype(np.uint64)
        mixed = (wide ^ (wide >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
        out[LANES:] = mixed.sum(axis=0, dtype=np.uint64).view(np.int64)
    return out


def combine(v: np.ndarray, added: list[bytes] = [], removed: list[bytes] = []) -> np.ndarray:  # noqa: B006
    """The vector of a text after pieces were added and removed."""
    with np.errstate(over="ignore"):
        return v + vector(added) - vector(removed)


def text_of(v: np.ndarray) -> str:
    """The fingerprint of a sum, its lanes taken modulo 2^16."""
    return v[:LANES].astype(">i2").tobytes().hex() + v[LANES:].astype(">i8").tobytes().hex()


def likeness(v: np.ndarray, w: np.ndarray) -> float:
    if np.array_equal(v, w):
        return 1.0
    a, b = v[:LANES].astype(float), w[:LANES].astype(float)
    size = float(np.sqrt((a @ a) * (b @ b)))
    return min(max(float(a @ b) / size, 0.0), 0.999999) if size else 0.0


def fingerprint(text: str | None) -> np.ndarray:
    """The sum itself, whose lanes are not reduced."""
    return vector(pieces((text or "").encode()))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first ones."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def ranges(docs: DataFrame) -> tuple[list[int], list[int | None], list[int]]:
    """Falling bounds between ranges of doc_id, each range's highest doc_id, and the range before each.

    All three are bounded by MOST_RANGES, whatever the number of rows.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    parts = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    found = ids.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({int(b) for b in found}, reverse=True)
    top: list[int | None] = [None] * (len(bounds) + 1)
    present = ids.select(part_of(bounds)("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()
    before = [-1] * len(top)
    for k, row in enumerate(present):
        top[row["part"]] = row["top"]
        before[row["part"]] = present[k - 1]["part"]  # the first range's head goes to the last one
    return bounds, top, before


def part_of(bounds: list[int]):
    """A function of doc_id: the number of bounds above it; null is below all."""
    rising = np.array(bounds[::-1], dtype=np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.full(len(ids), len(rising), dtype=np.int32)
        at[known] = len(rising) - np.searchsorted(rising, ids[known].astype("int64").to_numpy(), side="right")
        return pd.Series(at)

    return part


def with_neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """Texts dealt out once into ranges of descending doc_id, each range with a copy (head) of the row after it."""
    bounds, top, before = ranges(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part_of(bounds)("doc_id").alias("part"))
    tops, befores = F.lit(top if any(t is not None for t in top) else [0]).cast("array<bigint>"), F.lit(before).cast("array<int>")
    is_top = F.col("doc_id").eqNullSafe(F.get(tops, "part"))
    own = F.struct(F.col("part"), F.lit(False).alias("head"))
    copy = F.struct(F.get(befores, "part").alias("part"), F.lit(True).alias("head"))
    dealt = rows.select("doc_id", "text", F.inline(F.when(is_top, F.array(own, copy)).otherwise(F.array(own))))
    n = len(top)
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "head", F.desc_nulls_last("doc_id"), "text"), n


def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(doc_id, text, fingerprint, next text, next fingerprint) of each row, a batch at a time."""
    last, served = None, False
    for batch in batches:
        out = []
        for doc, text, head in zip(column(batch, "doc_id").to_pylist(), texts(batch), column(batch, "head").to_pylist()):
            if head and served:
                continue
            v = fingerprint(text)
            if last is not None:
                out.append((*last, text, v))
            last, served = (None, True) if head else ((doc, text, v), False)
        yield out


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's."""
    bounded(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in neighbours(batches):
            out = []
            for doc, text, v, following, w in rows:
                changed = edited(text, following)
                u = fingerprint(changed)
                out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), text_of(v), text_of(u), likeness(v, u), likeness(v, w)))
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in ROWS.split(", ")])

    dealt, _ = with_neighbours(docs.select("doc_id", "text"))
    return dealt.mapInArrow(run, ROWS)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
