"""BPE encoding by forced boundaries, and decoding (operator 6).

A byte pair that stands inside no token of the vocabulary can never be merged across, so between its two
bytes every encoding has a boundary.  Texts are cut at such pairs, fragments are encoded independently and
their ids joined; equal fragments are encoded once.

Where a cut is also a boundary of the pre-tokenizer whatever stands around it (a space after another
character), texts are cut first; what is left goes through the pre-tokenizer's pattern, since a pair may be
allowed in a token and yet be parted by the pattern; then every remaining forced pair cuts.  A fragment is
merged lowest rank first.  Special tokens' strings become their ids, as in the library.

Null texts are empty (no ids).  Very long fragments are merged with a heap, in n log n steps.  The memory
of seen fragments is bounded.  Rows are independent: an empty table gives no rows, equal rows equal ones.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rowsmith.llm.common import column, documents, per_batch, texts
from rowsmith.llm.tokenizing import PRETOKEN, default_vocabulary, vocabulary

#: Fragments a worker remembers, at each of two grains.
MEMORY = 700_000
#: Bytes of text that a task encodes at once.
AT_ONCE = 4 << 20
#: Fragments of more bytes are merged with a heap.
LONG = 48
NONE = 1 << 40


class Forced:
    def __init__(self, path: str):
        self.token_ids, merges, self.special = vocabulary(path)
        self.byte_ids = [self.token_ids[bytes([b])] for b in range(256)]
        self.rank = {(self.token_ids[a], self.token_ids[b]): k for k, (a, b) in enumerate(merges)}
        self.made = [self.token_ids[a + b] for a, b in merges]
        self.bytes_of = {i: t for t, i in self.token_ids.items()} | {i: s.encode() for s, i in self.special.items()}
        inside = np.zeros(65536, dtype=bool)
        for t in self.token_ids:
            for a, b in zip(t, t[1:]):
                inside[a << 8 | b] = True
        self.inside = inside
        before = np.flatnonzero(inside.reshape(256, 256)[:, 32]).tolist()
        #: Before a space, all pairs but these are forced; they are looked for by their characters.
        self.unsure = ["  ", *(chr(b) + " " for b in before if b < 128 and b != 32)] if all(b < 128 or b >= 128 and b == 0xA0 for b in before) else [" "]
        if 0xA0 in before:
            self.unsure.append("\xa0 ")
        self.pattern = regex.compile(PRETOKEN)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.wide: dict[str, bytes] = {}
        self.narrow: dict[str, bytes] = {}

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: of all pairs the one of lowest rank is merged, leftmost first, until none is left."""
        ids, rank = [self.byte_ids[b] for b in fragment], self.rank
        if len(ids) > LONG:
            return self.merge_long(ids)
        ranks = [rank.get(pair, NONE) for pair in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < NONE:
            k, new = ranks.index(r), self.made[r]
            ids[k : k + 2] = [new]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get((ids[k - 1], new), NONE)
            if k < len(ranks):
                ranks[k] = rank.get((new, ids[k + 1]), NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            new = self.made[r]
            ids[k], ids[j] = new, -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := rank.get((new, ids[j]))) is not None:
                    heapq.heappush(heap, (r, k, new, ids[j]))
            if (j := before[k]) >= 0 and (r := rank.get((ids[j], new))) is not None:
                heapq.heappush(heap, (r, j, ids[j], new))
        return [i for i in ids if i >= 0]

    def fragments(self, word: bytes) -> list[bytes]:
        """The pieces between forced pairs."""
        if len(word) < 2:
            return [word]
        if len(word) <= LONG:
            inside = self.inside
            cuts = [k + 1 for k, (a, b) in enumerate(zip(word, word[1:])) if not inside[a << 8 | b]]
        else:
            w = np.frombuffer(word, np.uint8).astype(np.uint16)
            cuts = (np.flatnonzero(~self.inside[w[:-1] << 8 | w[1:]]) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def of_word(self, word: str) -> bytes:
        """Packed ids of what the pattern keeps together."""
        ids: list[int] = []
        for f in self.fragments(word.encode()):
            known = self.token_ids.get(f)
            if known is not None and len(f) < 3:
                ids.append(known)
            else:
                ids += self.merge(f)
        return struct.pack(f"<{len(ids)}I", *ids)

    def of_piece(self, piece: str) -> bytes:
        narrow, out = self.narrow, []
        for w in self.pattern.findall(piece):
            got = narrow.get(w)
            if got is None:
                got = self.of_word(w)
                if len(w) <= 64:
                    if len(narrow) > MEMORY:  # within one very long text too
                        narrow.clear()
                    narrow[w] = got
            out.append(got)
        return b"".join(out)

    def of_span(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        if any(u in text for u in self.unsure):
            return self.of_piece(text)
        first, *rest = text.split(" ")
        pieces, wide, out = [" " + r for r in rest], self.wide, []
        if first:
            pieces.insert(0, first)
        for p in pieces:
            got = wide.get(p)
            if got is None:
                got = self.of_piece(p)
                if len(p) <= 64:
                    if len(wide) > MEMORY:
                        wide.clear()
                    wide[p] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if not self.specials or not any(s in text for s in self.special):
            return self.of_span(text)
        return b"".join(struct.pack("<I", self.special[t]) if t in self.special else self.of_span(t) for t in self.specials.split(text) if t)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def forced(path: str) -> Forced:
    """One encoder for each vocabulary and worker process."""
    return Forced(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and packed ids of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = forced(path)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(map(code.encode, texts(batch)), pa.binary())], names=["doc_id", "ids"])

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, ids binary", AT_ONCE)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """What encode() and decode() give, as counts and hashes, in one pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, hashed = forced(path), lambda b: hashlib.sha256(b).hexdigest()
        n, ids, decoded = [], [], []
        for text in texts(batch):
            packed = code.encode(text)
            n.append(len(packed) // 4)
            ids.append(hashed(packed))
            decoded.append(hashed(code.decode(packed).encode()))
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", AT_ONCE)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), default_vocabulary())
