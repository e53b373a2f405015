"""Toxicity by a factorization machine over hashed terms (operator 10).

A text's terms are its lower-cased words, stripped of signs at their ends, and the first three, four and
five letters of longer words; each is hashed (XXH64) to 19 bits.  Every slot of that space has a weight and a
vector.  The machine adds to the weights of the terms present the products of their vectors, so that two terms
may mean together what neither does alone.

No term is left out.  A term's value is not 1 but grows with what the labels say of it: with z, the distance of
its toxic rows from their expected number in standard deviations, it is tanh((z / 4)^2).  Ordinary words of a
long text so whisper, and telling ones speak; a term that no labelled row has is silent.

The labelled rows of the training folds are taken whole if they are at most TRAIN_ROWS, a documented bound of
the sample; of more, those whose hashed doc_id is below the matching threshold are, about as many.  Equal rows
count once.  Their terms are found on the executors; the driver gets them as packed numbers, and fits by AdaGrad
to the log loss, with both classes weighing as they come.

Null and empty texts have no terms and score the bias.  If there is nothing to learn from, or one class only,
every score is that class's smoothed share.  Rows with a null doc_id are scored, never learned from.  Where a
doc_id has several labels, toxic wins.  Repeated rows are scored alike.  An empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.common import bucket, column, discard, documents, per_batch, settle, texts

HASH_BITS, STEMS = 19, (3, 4, 5)
SLOTS = 1 << HASH_BITS
TRAIN_ROWS, FACTORS = 8000, 8
TELLING = 4.0
EPOCHS, BATCH, RATE, CALM, L2 = 12, 256, 0.15, 1.0, 1e-4
THRESHOLD, FOLDS, HELD_FOLD = 0.7, 3, 1
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…¿¡"
SEED = 20
#: Words that a worker remembers.
MEMORY = 250_000
#: Bytes of text that a task scores at once.
AT_ONCE = 1 << 20


def hashed(term: str) -> int:
    return xxhash.xxh64_intdigest(term, SEED) >> (64 - HASH_BITS)


def word_terms(word: str) -> bytes:
    """The hashed terms of a lower-cased word, as little-endian 32-bit numbers."""
    word = word.strip(SIGNS)
    if not word:
        return b""
    found = (hashed(word), *(hashed("^" + word[:k]) for k in STEMS if len(word) > k))
    return struct.pack(f"<{len(found)}i", *found)


class Terms:
    """Hashed terms of texts, each word being looked at once."""

    def __init__(self):
        self.seen: dict[str, bytes] = {}

    def of(self, text: str | None) -> np.ndarray:
        """The distinct terms of a text, rising."""
        if len(self.seen) > MEMORY:
            self.seen.clear()
        seen, out = self.seen, []
        for w in set((text or "").lower().split()):
            got = seen.get(w)
            if got is None:
                got = word_terms(w)
                if len(w) <= 64:
                    seen[w] = got
            out.append(got)
        return np.unique(np.frombuffer(b"".join(out), "<i4"))


class Machine:
    """A fitted factorization machine: of each slot its weight and its vector, both times the slot's value."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors
        self.own = (factors * factors).sum(1)

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        """Scores of documents, each given by its terms."""
        n = np.array([len(t) for t in found], np.int64)
        z = np.full(len(found), self.bias)
        some = np.flatnonzero(n)
        if len(some):
            ids = np.concatenate([found[i] for i in some])
            starts = np.cumsum(n[some]) - n[some]
            s = np.add.reduceat(self.factors[ids], starts, axis=0, dtype=float)
            z[some] += np.add.reduceat(self.weights[ids] - 0.5 * self.own[ids], starts, dtype=float) + 0.5 * (s * s).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, terms: list[int]) -> float:
        return float(self.scores([np.array(terms, np.int64)])[0])


def values(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Each slot's value: 0 of one never seen, towards 1 of one whose rows are toxic far more or less often than others."""
    n, k = np.zeros(SLOTS), np.zeros(SLOTS)
    for t, toxic in zip(x, y):
        n[t] += 1
        k[t] += toxic
    share = y.mean()
    z = (k - n * share) / np.sqrt(n * share * (1 - share) + 1)
    return np.tanh((z / TELLING) ** 2)


def fit(x: list[np.ndarray], y: np.ndarray, factors: int = FACTORS) -> Machine:
    """Fit to the terms of each document and 0/1 labels; the same input gives the same machine."""
    rng = np.random.default_rng(SEED)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Machine(bias, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, factors), np.float32))
    value = values(x, y).astype(np.float32)
    w, v = np.zeros(SLOTS, np.float32), rng.standard_normal((SLOTS, factors), np.float32) * np.float32(0.02)
    gb, gw, gv = 1e-8, np.full(SLOTS, CALM, np.float32), np.full((SLOTS, factors), CALM, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), BATCH):
            part = [i for i in order[lo : lo + BATCH] if len(x[i])]
            if not part:
                continue
            size = np.array([len(x[i]) for i in part])
            ids, doc, starts = np.concatenate([x[i] for i in part]), np.repeat(np.arange(len(part)), size), np.cumsum(size) - size
            used, at = np.unique(ids, return_inverse=True)
            u = value[used]
            vu = v[used] * u[:, None]
            s = np.add.reduceat(vu[at], starts, axis=0)
            own = np.add.reduceat((vu * vu).sum(1)[at], starts)
            z = bias + np.add.reduceat((w[used] * u)[at], starts) + 0.5 * ((s * s).sum(1) - own)
            err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]
            total = np.bincount(at, weights=err[doc], minlength=len(used))
            met = np.stack([np.bincount(at, weights=(err * s[:, j])[doc], minlength=len(used)) for j in range(factors)], axis=1)
            dw = total * u + L2 * len(part) * w[used]
            dv = (met - vu * total[:, None]) * u[:, None] + L2 * len(part) * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
            db = float(err.sum())
            gb += db * db
            bias -= 0.3 * RATE * db / np.sqrt(gb)
    return Machine(bias, (w * value).astype(np.float32), (v * value[:, None]).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on labels.toxic of the training folds."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where((bucket("doc_id", FOLDS) != HELD_FOLD) & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scale = 1 << 30
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * rows / n))
    few = n <= rows or known.count() <= 2 * rows  # as it is, but for chance: then texts need no shuffle
    texts_of = docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id")

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = terms()
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), pa.array([code.of(t).astype("<i4").tobytes() for t in texts(batch)], pa.binary())], names=["doc_id", "toxic", "x"])

    found = settle(per_batch(texts_of.select("doc_id", "text", "toxic"), find, "doc_id long, toxic int, x binary", AT_ONCE).distinct(), "terms")
    m = found.count()  # more than the labels if doc_ids repeat
    taken = found if m <= 2 * rows else found.where(F.pmod(F.xxhash64("x", "doc_id"), F.lit(scale)) < int(scale * rows / m))
    got = sorted((r["doc_id"], r["toxic"], bytes(r["x"])) for r in taken.toLocalIterator())  # a partition at a time in the JVM
    discard(docs.sparkSession, found)
    return fit([np.frombuffer(x, "<i4") for _, _, x in got], np.array([y for _, y, _ in got], float))


_TERMS: list[Terms] = []


def terms() -> Terms:
    """A worker's term finder."""
    if not _TERMS:
        _TERMS.append(Terms())
    return _TERMS[0]


def _scores(docs: DataFrame, machine: Machine):
    """A function from a batch of docs to its texts' scores."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # its size is that of the hash space, whatever the input's is
    return lambda batch: model.value.scores([terms().of(t) for t in texts(batch)])


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    scores = _scores(docs, machine)
    run = lambda batch: pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores(batch))], names=["doc_id", "score"])
    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, score double", AT_ONCE)


def harmless(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    scores = _scores(docs, machine)
    return per_batch(docs, lambda batch: batch.filter(pa.array(scores(batch) < threshold)), docs.schema, AT_ONCE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scored(docs, machine)
    return rows.select("doc_id", F.coalesce(bucket("doc_id", FOLDS) == HELD_FOLD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
