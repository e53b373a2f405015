"""SimHash near-duplicates (operator 2).

Fingerprints: 64 bits from the XXH64 hashes of word shingles; a bit is set if it is in over half of them.

Links between fingerprints of at most 4 differing bits are found by a segment-popcount embedding.  The bit
counts of the 32 segments of two bits are a point of 32 coordinates, held in one long of two bits each.  The
Manhattan distance of two points never exceeds the number of differing bits, so the join is one of points at
most 4 apart, which are then verified on the bits themselves.

The range join runs on grids: the coordinates are dealt into B blocks, and of two points at most 4 apart at
least B - 4 blocks are equal.  Each choice of B - 4 blocks is a grid, a point's cell being its coordinates
there; points that share a cell are candidates, and each pair is kept in one grid only.  More blocks make more
grids with finer cells: B follows from the number of fingerprints, so that neither rows nor candidates grow
faster than they must.  Results do not depend on B.

A cell that holds more than CROWD points even so is a cluster, and is not joined with itself: two fingerprints
at most 4 bits apart have a point at most 2 bits from both, so its fingerprints are dealt to all points within
2 bits of them, 2081 each, and all that meet at a point are linked with the least one there: linear, exact,
and at most 2081 of them meet.

Equal fingerprints are one vertex, so groups of copies make no pairs.  Components come from star rounds.

Null and empty texts, and those without words, have fingerprint zero and are linked like any other.  Null
doc_ids are kept; they never are a component's id unless all of its ids are null.  Rows repeated are
kept.  An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import column, discard, documents, per_batch, scratch, settle, sweep, texts
from rowsmith.llm.components import components

SHINGLE, SEED, REACH, CROWD = 4, 42, 4, 1000
EVEN_BITS, SEGMENTS = 0x5555555555555555, 32
#: Numbers of blocks to choose from; a coordinate of a real corpus tells about so many bits, and a row costs as much as so many candidates.
BLOCKS, ENTROPY, ROW_COST = range(7, 17), 1.2, 20


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Grids:
    """The choices of all blocks but REACH: masks of their coordinates, and of each the earlier blocks that it leaves out."""

    def __init__(self, blocks: int):
        cuts = [round(SEGMENTS * k / blocks) for k in range(blocks + 1)]
        self.blocks = [sum(3 << 2 * s for s in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
        chosen = list(itertools.combinations(range(blocks), blocks - REACH))
        self.masks = [signed(sum(self.blocks[b] for b in c)) for c in chosen]
        self.left_out = [sum(1 << b for b in range(c[-1]) if b not in c) for c in chosen]


def blocks_for(n: int) -> int:
    """The number of blocks for n fingerprints: of least rows and candidates together."""

    def cost(b: int) -> float:
        cells = 2 ** (ENTROPY * SEGMENTS * (b - REACH) / b)
        return math.comb(b, REACH) * (1 + n / (2 * cells * ROW_COST))

    return min(BLOCKS, key=cost)


#: All changes of at most two bits.
NEAR = [signed(sum(1 << b for b in c)) for n in range(3) for c in itertools.combinations(range(64), n)]


def text_hash() -> Column:
    """With doc_id it tells rows apart."""
    return F.xxhash64("text")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as a signed number."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    return folded(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)], dtype=np.uint64))


def folded(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed number; no hashes give 0."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text) and fp, a long, of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([fingerprint(t, shingle) for t in texts(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "th"), fps], names=["doc_id", "th", "fp"])

    return per_batch(docs.select("doc_id", "text", text_hash().alias("th")), run, "doc_id long, th long, fp long")


def embedded(fp: Column) -> Column:
    """The bit counts of the 32 segments of two bits, two bits each."""
    low, high = fp.bitwiseAND(F.lit(EVEN_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # their sum, which as such could overflow


def manhattan(a: Column, b: Column) -> Column:
    """The distance of two points: a coordinate's two bits differ as 01 or 11 where it is one apart, as 10 where it is two."""
    differ = a.bitwiseXOR(b)
    one = differ.bitwiseAND(F.lit(EVEN_BITS))
    two = F.shiftrightunsigned(differ, 1).bitwiseAND(F.lit(EVEN_BITS)).bitwiseAND(F.bitwise_not(one))
    return F.bit_count(one) + 2 * F.bit_count(two)


def gridded(fps: DataFrame, grids: Grids) -> DataFrame:
    """grid, cell, fp and its point: a row for each point and grid."""
    points = fps.select("fp", embedded(F.col("fp")).alias("point"))
    return points.select("fp", "point", F.posexplode(F.transform(F.lit(grids.masks), lambda m: F.col("point").bitwiseAND(m))).alias("grid", "cell"))


def _kept_here(grid: Column, a: Column, b: Column, grids: Grids) -> Column:
    """Whether a grid is the first of a pair's: no block before its last one that it leaves out is equal."""
    differ = a.bitwiseXOR(b)
    equal = sum((F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, 1 << k).otherwise(0) for k, m in enumerate(grids.blocks)), F.lit(0))
    return equal.bitwiseAND(F.get(F.lit(grids.left_out), grid)) == 0


def links(fps: DataFrame, crowd: int = CROWD, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints: all links outside crowded cells, and enough in these to connect the same."""
    grids = Grids(blocks or blocks_for(fps.count()))
    rows = gridded(fps, grids)
    cell = F.xxhash64("grid", "cell")
    crowded = settle(rows.groupBy(cell.alias("key")).count().where(F.col("count") > crowd).select("key"), "cells")
    if crowded.isEmpty():
        calm, meet = rows, None
    else:
        calm = rows.withColumn("key", cell).join(crowded, "key", "left_anti").drop("key")
        inside = rows.withColumn("key", cell).join(crowded, "key", "left_semi").select("fp").distinct()
        dealt = inside.select("fp", F.explode(F.transform(F.lit(NEAR), lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
        meet = dealt.select(F.col("fp").alias("u"), F.min("fp").over(Window.partitionBy("at")).alias("v")).where("u <> v").distinct()
    a, b = calm.select("grid", "cell", "fp", "point").alias("a"), calm.select("grid", "cell", "fp", "point").alias("b")
    same = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell"))
    within = manhattan(F.col("a.point"), F.col("b.point")) <= REACH
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= REACH
    once = _kept_here(F.col("a.grid"), F.col("a.point"), F.col("b.point"), grids)
    # never broadcast: Spark sizes the rows of an explode like its input, here 35 times and more too low
    pairs = a.join(b.hint("merge"), same & (F.col("a.fp") < F.col("b.fp")) & within & near & once).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return pairs.unionByName(meet) if meet is not None else pairs


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) of every row."""
    return placed(docs, shingle, crowd, blocks).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def placed(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD, blocks: int | None = None) -> DataFrame:
    """doc_id, th (a hash of the text), fp, root (the component's least fingerprint) and component_id of every row."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        fps = settle(fingerprints(docs, shingle), "fingerprints")
        vertices = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "vertices")
        found = named(vertices, components(links(vertices.select("fp"), crowd, blocks)))
        keep += [fps, found]
    sweep(spark)
    return fps.join(found, "fp", "left")


def named(vertices: DataFrame, joined: DataFrame) -> DataFrame:
    """fp, root and component_id of vertices (fp, least): the least doc_id of each component, by way of its root in joined."""
    spark = vertices.sparkSession
    rooted = vertices.join(joined, vertices["fp"] == joined["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = settle(rooted, "rooted")
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = settle(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    discard(spark, vertices, rooted, least)
    return found


def representatives(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component."""
    return one_of_each(docs, placed(docs, shingle))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each root of groups (doc_id, th and root of all rows): of least doc_id, nulls last, then of least th.

    A row is told by its doc_id and th.  Where the chosen row comes several times, alike in both, one of them stays;
    rows of other components stay whatever doc_id they have.
    """
    found = settle(groups.select("doc_id", "th", "root"), "components")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r"), F.count("*").alias("n")).select("r.doc_id", "r.th", "n")
    first = settle(first.select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), "n"), "representatives")
    keyed = docs.withColumn("_rowsmith_th", text_hash())
    same = lambda other: keyed["doc_id"].eqNullSafe(other["_doc_id"]) & (keyed["_rowsmith_th"] == other["_th"])
    times = found.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    again = first.where("n > 1").join(times, F.col("_doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left_semi")
    again = settle(again.select("_doc_id", "_th"), "again")
    kept = keyed.join(first, same(first), "left_semi")
    if not again.isEmpty():
        several = kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "_rowsmith_th"])
        kept = kept.join(again, same(again), "left_anti").unionByName(several)
    return kept.drop("_rowsmith_th")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
