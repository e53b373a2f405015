"""Sum-of-squares online packing of token sequences (operator 9).

Documents are encoded, ended by an id and cut into runs of at most a window.  Full runs are sequences of
their own; the rest of each document is an item, put online into one of the open windows: of all fill
levels h with an open window that can take it, and an empty one, that is taken which makes the sum over
levels of the squared counts of windows at that level smallest.  The counts are an array over levels.
When a task has no more items, its open windows are emptied into one another, fullest first, by cutting
once more, so each task leaves one window at most that is not full.

Every task packs its own partition and keeps counts and open windows only; no row is shuffled.  A retried
task gives the same rows, and sequence ids carry the partition's number in their high bits.
Null texts are empty and give the end id alone; an empty table gives no rows; equal rows are packed apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from rowsmith.llm.common import bounded, column, documents, texts
from rowsmith.llm.tokenizing import default_vocabulary, encoder

WINDOW, END_ID = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Low bits of a sequence id, for the sequences of one partition.
PARTITION_BITS = 33
REPORT = "sequences long, ids long, padding_placed long, padding long"


class Packer:
    """Windows of one task.  Pieces are (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)  # open windows by fill level; empty and full ones do not count
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def padding(self) -> int:
        """What the windows that are open now lack to be full."""
        return int(((self.window - np.arange(self.window + 1)) * self.counts).sum())

    def level(self, n: int) -> int:
        """The fill level that takes an item of n ids at the smallest sum of squares; 0 is a new window."""
        c, w = self.counts, self.window
        if n >= w:
            return 0
        # moving a window from h to h+n: (c[h]-1)^2 - c[h]^2 + (c[h+n]+1)^2 - c[h+n]^2 = 2 (c[h+n] - c[h] + 1); full ones do not count
        gain = 2 * (c[n:w] - c[: w - n] + 1)
        gain[0] = 2 * c[n] + 1
        gain[1:][c[1 : w - n] == 0] = np.iinfo(np.int64).max
        best = int(gain.argmin())
        if c[w - n] > 0 and 1 - 2 * c[w - n] <= gain[best]:
            return w - n
        return best

    def put(self, piece: tuple) -> list | None:
        """Place an item; the window's pieces if that filled it."""
        n = len(piece[2])
        h = self.level(n)
        pieces = self.open[h].pop() if h else []
        self.counts[h] -= bool(h)
        pieces.append(piece)
        if h + n == self.window:
            return pieces
        self.open[h + n].append(pieces)
        self.counts[h + n] += 1
        return None

    def close(self) -> Iterator[list]:
        """Empty the open windows into one another, the emptiest into the fullest, cutting where one is full."""
        rest = [p for pieces in self.open for p in pieces]  # by rising level
        lo = 0
        while rest[lo:]:
            full, room = rest.pop(), 0
            room = self.window - sum(len(p[2]) for p in full)
            while room and rest[lo:]:
                doc, start, ids, total = rest[lo].pop()
                full.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest[lo].append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
                lo += not rest[lo]
            yield full


def pack(docs: DataFrame, path: str, end: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start and length in its document, crc32 of its ids, the document's
    ids, the sequence and its offset there."""
    bounded(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << PARTITION_BITS
        packer, code, done, rows = Packer(window), encoder(path), 0, []

        def give(pieces: list) -> None:
            nonlocal done
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids), total, base + done, at))
                at += len(ids)
            done += 1

        def batch_of_rows() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), code.encode(texts(batch), end)):
                cut = len(ids) - len(ids) % window
                for at in range(0, cut, window):
                    give([(doc, at, ids[at : at + window], len(ids))])
                if len(ids) > cut and (pieces := packer.put((doc, cut, ids[cut:].copy() if cut else ids, len(ids)))):
                    give(pieces)
            yield batch_of_rows()
        for pieces in packer.close():
            give(pieces)
        yield batch_of_rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def padding_report(docs: DataFrame, path: str, end: int = END_ID, window: int = WINDOW) -> DataFrame:
    """A row for each task: its sequences and ids, the padding that placing by sums of squares leaves, and that after the windows
    left open have been emptied into one another."""
    bounded(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, code, sequences, total = Packer(window), encoder(path), 0, 0
        for batch in batches:
            for ids in code.encode(texts(batch), end):
                total += len(ids)
                sequences += len(ids) // window
                rest = ids[len(ids) - len(ids) % window :]
                if len(rest):
                    sequences += packer.put((None, 0, rest, len(ids))) is not None
        placed = packer.padding()
        sequences += sum(1 for _ in packer.close())
        yield pa.RecordBatch.from_pydict({"sequences": [sequences], "ids": [total], "padding_placed": [placed], "padding": [sequences * window - total]})

    return docs.select("text").mapInArrow(run, REPORT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_vocabulary())
