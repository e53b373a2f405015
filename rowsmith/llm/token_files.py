"""Token ids in bit-packed binary files (operator 3).

A file holds the documents of one range of doc_id, in ascending order:

    magic, bits, ids per block, 0, 0                    header, 8s I I Q Q little-endian
    blocks                                              every id in `bits` bits, most significant first;
                                                        a block starts on a byte
    offset of each block                                Q each
    doc_id, validity, ids before it, ids of it          q, B, Q and Q columns
    magic, bits, ids per block, ids, documents          the header again, now with its counts
    place of the offsets                                Q, the file's last 8 bytes

`bits` is the least that holds the vocabulary.  As all blocks but the last have the same number of ids,
id k is in block k // block, and any range of ids is read by one seek and unpacked by numpy.

Files are written below the shared folder by the tasks of one range partitioning, under another name until
whole, so a retried task replaces its own file.  The driver sees one row for each file only.
Null texts are empty: such a document has its end id alone.  Null doc_ids sort first and are kept; rows
with one doc_id are all kept, in the order of their text's hash; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.common import bounded, column, commit_file, documents, shared_dir, store, texts
from rowsmith.llm.tokenizing import default_vocabulary, encoder

MAGIC, HEADER = b"RSTOKID1", struct.Struct("<8sIIQQ")
END_ID, BLOCK = 2, 4096
#: Ids that one reading task takes on, but for a longer document, and the tasks beyond which they take on more: the driver lists them.
READ_IDS, MOST_TASKS = 4_000_000, 100_000
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(each[:, 32 - bits :]).tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f">u{bits // 8}", count=n).astype("<u4")
    each = np.zeros((n, 32), dtype=np.uint8)
    each[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(each, axis=1).view(">u4").ravel().astype("<u4")


class Writer:
    """Writes one file to a stream, a block at a time."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.left, self.docs, self.offsets, self.n, self.at = [], [], [], 0, HEADER.size
        self.held = 0
        self.body: list[bytes] = []

    def open(self) -> None:
        self.out.write(HEADER.pack(MAGIC, self.bits, self.block, 0, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, self.n, len(ids)))
        self.left.append(ids)
        self.n += len(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.left) if self.left else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % self.block
        for lo in range(0, whole, self.block):
            data = pack_bits(ids[lo : min(lo + self.block, whole)], self.bits)
            self.offsets.append(self.at)
            self.at += len(data)
            self.out.write(data)
        self.left, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self.flush(True)
        ids, valid, before, of = zip(*self.docs) if self.docs else ((), (), (), ())
        place = self.at
        for kind, values in (("<u8", self.offsets), ("<i8", ids), ("u1", valid), ("<u8", before), ("<u8", of)):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(HEADER.pack(MAGIC, self.bits, self.block, self.n, len(self.docs)) + struct.pack("<Q", place))


class Reader:
    """Random access to a file: the table of documents and any range of ids."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 8 - HEADER.size)
        tail = file.read(8 + HEADER.size)
        magic, self.bits, self.block, self.n, self.n_docs = HEADER.unpack(tail[:-8])
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.place = struct.unpack("<Q", tail[-8:])[0]
        self.blocks = -(-self.n // self.block)

    def at(self, offset: int, kind: str, lo: int, hi: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        self.file.seek(self.place + offset + lo * width)
        return np.frombuffer(self.file.read((hi - lo) * width), dtype=kind)

    def documents(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, validity, ids before and ids of documents lo to hi."""
        first, n = 8 * self.blocks, self.n_docs
        return self.at(first, "<i8", lo, hi), self.at(first + 8 * n, "u1", lo, hi), self.at(first + 9 * n, "<u8", lo, hi), self.at(first + 17 * n, "<u8", lo, hi)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi, in one read."""
        if hi <= lo:
            return np.zeros(0, "<u4")
        first, last = lo // self.block, -(-hi // self.block)
        begin, end = self.at(0, "<u8", first, first + 1)[0], self.place if last == self.blocks else self.at(0, "<u8", last, last + 1)[0]
        self.file.seek(int(begin))
        data, out, at = self.file.read(int(end - begin)), [], 0
        for b in range(first, last):
            n = min(self.block, self.n - b * self.block)
            size = -(-n * self.bits // 8)
            out.append(unpack_bits(data[at : at + size], n, self.bits))
            at += size
        return np.concatenate(out)[lo - first * self.block : hi - first * self.block]


def write(docs: DataFrame, path: str, folder: str, end: int = END_ID) -> DataFrame:
    """Write the token files; one row for each: part, uri, documents, ids and bytes."""
    bounded(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path), TaskContext.get().partitionId()
        uri, of = f"{folder}/ids-{part:06d}.bin", {}

        def fill(out) -> None:
            w = Writer(out, bits_for(code.vocab_size))
            w.open()
            for batch in batches:
                for doc, ids in zip(column(batch, "doc_id").to_pylist(), code.encode(texts(batch), end)):
                    w.add(doc, ids)
            w.close()
            of.update(docs=len(w.docs), ids=w.n)

        size = commit_file(uri, fill)
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "docs": [of["docs"]], "ids": [of["ids"]], "bytes": [size]})

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ranged.mapInArrow(run, "part long, uri string, docs long, ids long, bytes long")


def read(spark: SparkSession, files: list, at_once: int = READ_IDS) -> DataFrame:
    """One row for each document of the files of write(), in any order."""
    tasks, base = [], 0
    at_once = max(at_once, sum(f["ids"] for f in files) // MOST_TASKS)
    for f in sorted(files, key=lambda f: f["part"]):
        step = max(1, int(f["docs"] * at_once / max(1, f["ids"])))
        tasks += [(f["uri"], f["bytes"], base, lo, min(lo + step, f["docs"])) for lo in range(0, f["docs"], step)]
        base += f["ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                disk, path = store(t["uri"])
                with disk.open_input_file(path) as file:
                    r = Reader(file, t["bytes"])
                    doc, valid, before, of = r.documents(t["lo"], t["hi"])
                    crc, k = np.zeros(len(doc), np.int64), 0
                    while k < len(doc):  # whole documents, up to a number of ids at once
                        to = max(k + 1, int(np.searchsorted(before, before[k] + (1 << 18), "right")) - 1)
                        lo, hi = int(before[k]), int(before[to - 1] + of[to - 1])
                        ids = r.ids(lo, hi)
                        for i in range(k, to):
                            crc[i] = zlib.crc32(ids[int(before[i]) - lo : int(before[i] + of[i]) - lo])
                        k = to
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=valid == 0), pa.array(before.astype(np.int64) + t["base"]), pa.array(of.astype(np.int64)), pa.array(crc)], names=[c.split()[0] for c in ROWS.split(", ")])

    frame = spark.createDataFrame(tasks, "uri string, bytes long, base long, lo long, hi long")
    return frame.repartition(max(1, min(len(tasks), 4096))).mapInArrow(run, ROWS)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    return read(spark, write(documents(spark, sf_dir), default_vocabulary(), folder).collect())
