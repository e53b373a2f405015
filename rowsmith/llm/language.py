"""Language identification by interpolated Kneser-Ney character models (operator 1).

For each language a model of order 4 over lower-cased letters (all else is one blank) is kept in sorted
arrays: per order the n-grams' keys with their interpolated log probabilities, and the contexts' keys with
their back-off weights.  Below the single letters stands the uniform distribution over one alphabet that all
languages share, with one unknown sign, so that every language's probabilities are of the same events and sum
to one.  A key packs four 16-bit characters, so it is a hash without collisions; letters
beyond U+FFFF share one sign.  A text gets the language of the lowest cross-entropy per character.

The score is the probability that this is right, by a logistic curve in the margin to the next language
and the text's length, fitted on labelled rows kept apart.  A prediction is rejected (a further column)
where its score is below one half, or its cross-entropy is above nearly all that the language's own
calibration rows have.

Learning sees the text and lang of rows of the training folds only: about TRAIN_ROWS rows of each language
for its counts, and about CALIBRATION_ROWS for the curve, chosen by a hash of doc_id.  N-grams are counted
on the executors; the driver gets distinct 4-grams of that sample with their counts.

Null texts, and those without a letter, are `und` with score 0.  With no labelled rows all are `und`.
Rows with null lang are never learned from; rows with a null doc_id are predicted, not learned from.
Ties go to the language first in alphabetical order.  Repeated rows get equal results.  An empty table
gives no rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.common import bucket, column, documents, per_batch, texts

ORDER = 4
TRAIN_ROWS, CALIBRATION_ROWS = 2500, 800
FOLDS, HELD_FOLD, CALIBRATION_FOLD = 4, 2, 3
BLANK, OTHER = 32, 0xFFFE
#: Characters worked on at once, and the slots of a worker's memory of 4-grams (a power of two).
SPAN, SLOTS = 1 << 20, 1 << 20
#: Bytes of text that a task predicts at once.
AT_ONCE = 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """Each code point's sign: itself for letters, a blank for all else."""
    table = np.full(sys.maxunicode + 1, BLANK, np.uint16)
    for c in range(0xFFFE):
        if chr(c).isalpha():
            table[c] = c
    for c in range(0x10000, sys.maxunicode + 1):
        if chr(c).isalpha():
            table[c] = OTHER
    return table


_LETTERS: list[np.ndarray] = []


def signs(text: str) -> np.ndarray:
    """A text's letters with single blanks between and around them; empty if it has none."""
    if not _LETTERS:
        _LETTERS.append(letter_table())
    c = _LETTERS[0][np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    c = np.concatenate([[BLANK], c, [BLANK]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != BLANK) | (c[:-1] != BLANK)])]
    return c if len(c) > 1 else c[:0]


def grams(c: np.ndarray) -> np.ndarray:
    """The packed 4-gram ending at each sign but the first; before the text stand zeros."""
    p = np.concatenate([np.zeros(ORDER - 2, np.uint64), c])
    k = len(c) - 1
    out = np.zeros(k, np.uint64)
    for j in range(ORDER):
        out = out << np.uint64(16) | p[j : j + k]
    return out


def suffix(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << 16 * n) - 1)


def alphabet_size(keys: np.ndarray) -> int:
    """The signs that n-grams of all languages end in, and an unknown one."""
    return len(np.unique(suffix(keys, 1))) + 1


class Model:
    """One language: sorted keys with values, for n-grams and contexts of each order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        """alphabet: the number of signs that all languages share, an unknown one included."""
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        # counts by order: of tokens at the top, below it of distinct signs before
        by_order: list[tuple[np.ndarray, np.ndarray]] = [(keys, counts.astype(float))]
        for n in range(ORDER - 1, 0, -1):
            k, c = np.unique(suffix(by_order[-1][0], n), return_counts=True)
            by_order.append((k, c.astype(float)))
        for n in range(1, ORDER + 1):
            k, c = by_order[ORDER - n]
            ones, twos = float((c == 1).sum()), float((c == 2).sum())
            d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            context, at = np.unique(k >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(at, weights=c), np.bincount(at)
            rest = d * kinds / total
            if n == 1:  # what is held back goes to all signs alike, seen or not
                lower = np.full(len(k), 1 / alphabet)
                self.unseen = float(np.log(rest[0] / alphabet))
            else:
                lk, lp = self.grams[-1]
                lower = np.exp(lp[np.searchsorted(lk, suffix(k, n - 1))])
            p = np.maximum(c - d, 0) / total[at] + rest[at] * lower
            self.grams.append((k, np.log(p)))
            self.contexts.append((context, np.log(rest)))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of the last sign of each packed 4-gram, given those before."""
        k1, p1 = self.grams[0]
        out = self._look(k1, p1, suffix(keys, 1), self.unseen)
        for n in range(2, ORDER + 1):
            k, p = self.grams[n - 1]
            w, b = self.contexts[n - 1]
            gram = suffix(keys, n)
            found = self._look(k, p, gram, np.nan)
            out = np.where(np.isnan(found), self._look(w, b, gram >> np.uint64(16), 0.0) + out, found)
        return out

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], absent)


class Identifier:
    """Models of all languages, and a memory of the 4-grams' log probabilities under each."""

    def __init__(self, names: list[str], models: list[Model]):
        self.names, self.models = names, models
        self.curve, self.limits = np.array([0.0, 8.0, 0.0]), np.full(len(names), np.inf)
        self.memory: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": None}

    def values(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of 4-grams, a column for each language."""
        if self.memory is None:
            self.memory = np.zeros(SLOTS, np.uint64), np.zeros((SLOTS, len(self.names)), np.float32)
        known, value = self.memory
        slot = ((keys * MIX) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        if (miss := np.flatnonzero(known[slot] != keys)).size:
            new, first = np.unique(keys[miss], return_index=True)
            found = np.stack([m.log_probabilities(new) for m in self.models], axis=1).astype(np.float32)
            at = slot[miss[first]]
            known[at], value[at] = new, found
            out = value[slot]
            if (late := np.flatnonzero(known[slot] != keys)).size:  # two 4-grams of one slot
                out[late] = np.stack([m.log_probabilities(keys[late]) for m in self.models], axis=1)
            return out
        return value[slot]

    def entropies(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters and cross-entropies (nats a character) of each text; no characters if it has no letter."""
        n, out = np.zeros(len(batch), np.int64), np.zeros((len(batch), len(self.names)))
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def work() -> None:
            nonlocal size
            if held:
                v = self.values(np.concatenate([k for _, k in held]))
                starts = np.cumsum([0, *(len(k) for _, k in held[:-1])])
                sums = np.add.reduceat(v, starts, axis=0, dtype=np.float64)
                for (i, _), s in zip(held, sums):
                    out[i] -= s
                held.clear()
                size = 0

        for i, text in enumerate(batch):
            c = signs(text) if text else ()
            if len(c):
                keys = grams(c)
                n[i] = len(keys)
                for lo in range(0, len(keys), SPAN):
                    held.append((i, keys[lo : lo + SPAN]))
                    size += len(held[-1][1])
                    if size >= SPAN:
                        work()
        work()
        return n, out / np.maximum(n, 1)[:, None]

    def predict(self, batch: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cross-entropies and whether rejected."""
        if not self.names:
            return ["und"] * len(batch), np.zeros(len(batch)), np.zeros(len(batch)), np.ones(len(batch), bool)
        n, h = self.entropies(batch)
        best = h.argmin(axis=1)
        least = h[np.arange(len(batch)), best]
        score = np.where(n > 0, probability(self.curve, margin(h), n), 0.0)
        names = [self.names[b] if k else "und" for b, k in zip(best, n)]
        return names, score, least, (score < 0.5) | (least > self.limits[best])


def margin(h: np.ndarray) -> np.ndarray:
    """How much lower the lowest cross-entropy is than the next, at most 2."""
    if h.shape[1] < 2:
        return np.full(len(h), 2.0)
    two = np.partition(h, 1, axis=1)
    return np.minimum(two[:, 1] - two[:, 0], 2.0)


def _features(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(m)), m, np.minimum(m, 0.5) * np.log1p(n)], axis=1)


def probability(curve: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(m, n) @ curve, -30, 30)))


def fit_curve(m: np.ndarray, n: np.ndarray, right: np.ndarray, prior: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to `prior` by a weak penalty."""
    x, curve = _features(m, n), prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (p - right) + 0.1 * (curve - prior))
        curve = curve - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.array([curve[0], max(curve[1], 0.0), max(curve[2], 0.0)])


def _sample(docs: DataFrame, folds: list[int], rows: int) -> DataFrame:
    """About so many labelled rows of each language, from these folds, by a hash of doc_id and text, so that repeated ids are no more than others."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & bucket("doc_id", FOLDS).isin(folds))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return known.where("false")
    scale = 1 << 30
    limit = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(scale, int(scale * rows / n))))])
    return known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < F.try_element_at(limit, "lang"))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Identifier:
    """Count, build the models, and fit curve and limits on rows that were not counted."""
    docs = docs.select("doc_id", "text", "lang")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(texts(batch, "lang"), texts(batch)):
            if text and len(c := signs(text)):
                by.setdefault(lang, []).append(grams(c))
        langs, keys, counts = [], [], []
        for lang, found in by.items():
            k, n = np.unique(np.concatenate(found), return_counts=True)
            langs += [lang] * len(k)
            keys.append(k.view(np.int64))
            counts.append(n)
        empty = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(keys or empty)), pa.array(np.concatenate(counts or empty))], names=["lang", "gram", "n"])

    training = [f for f in range(FOLDS) if f not in (HELD_FOLD, CALIBRATION_FOLD)]
    counted = per_batch(_sample(docs, training, rows), count, "lang string, gram long, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    models, alphabet = {}, alphabet_size(table["gram"].to_numpy(np.int64).view(np.uint64))
    for lang, part in table.groupby("lang"):
        keys = part["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        models[lang] = Model(keys[order], part["n"].to_numpy()[order], alphabet)
    names = sorted(models)
    found = Identifier(names, [models[x] for x in names])
    if names:
        calibrate(found, docs, calibration_rows)
    return found


def calibrate(found: Identifier, docs: DataFrame, rows: int) -> None:
    model = docs.sparkSession.sparkContext.broadcast(found)

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, h = model.value.entropies(texts(batch))
        names = model.value.names
        right = [names[b] == lang for b, lang in zip(h.argmin(axis=1), texts(batch, "lang"))]
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(margin(h)), pa.array(h.min(axis=1)), pa.array(h.argmin(axis=1).astype(np.int32)), pa.array(right)], names=["n", "margin", "least", "best", "correct"])

    got = per_batch(_sample(docs, [CALIBRATION_FOLD], rows), look, "n long, margin double, least double, best int, correct boolean").toPandas()
    got = got[got["n"] > 0]
    if len(got) < 20:
        return
    found.curve = fit_curve(got["margin"].to_numpy(), got["n"].to_numpy(), got["correct"].to_numpy(float), found.curve)
    for b, part in got[got["correct"]].groupby("best"):
        if len(part) >= 20:
            found.limits[b] = part["least"].quantile(0.995) + 0.25


def identified(docs: DataFrame, found: Identifier) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of every row, from its text alone."""
    model = docs.sparkSession.sparkContext.broadcast(found)  # bounded by the sample that was counted

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, least, rejected = model.value.predict(texts(batch))
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(least), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean", AT_ONCE)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = identified(docs, train(docs))
    return rows.select("doc_id", F.coalesce(bucket("doc_id", FOLDS) == HELD_FOLD, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
