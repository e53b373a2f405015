"""Near-duplicates by shared word shingles: the pipeline's stage.

A text is the set of its shingles of five words, as 64-bit hashes; two texts are near-duplicates if their sets'
Jaccard similarity, exactly computed, is 0.8 or more.  Equal sets are one vertex.

Candidates come from operator 2's method first: the sets' 64-bit fingerprints, their segment popcounts, the range join of
these on grids under the Manhattan distance, and the bits.  Sets of one fingerprint are candidates with the least of
them, which stands for all in the join.  Every candidate is then verified on the sets.

That reaches 4 bits, while two texts of similarity 0.8 differ in about ten, give or take three, which no 64 bits tell
from less.  So what it leaves apart is searched further, with operator 2's embedding on the sets themselves: a set is
a sparse bitmap of 2^64 bits, its bits are counted in 32 segments, and the Manhattan distance of two sets' counts is at
most the number of shingles in which they differ, which is at most a ninth of both sizes for a near pair.  Shingles
that no other set has are counted apart, as they differ from everything.

These further candidates share a band: the minima of a set under ROWS of BANDS * ROWS permutations.  A pair of similarity s
shares none with chance (1 - s^ROWS)^BANDS, at 0.8 about 5e-9 and less above, so the candidate search is not exact
but all of that chance is in it.  No candidate is left out: of each band's members first one, then others are compared
with all (linear, and enough for most copies of one text; those that meet most others come first, as the text that
copies were made from does).  Then those that are not yet connected are range-joined within their bands under the
Manhattan distance, but for those with too many shingles of their own, and what remains is verified.

Texts without words are equal to each other.  Null doc_ids are kept; they never are a component's id unless all of
its ids are null.  Rows repeated are kept.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import column, discard, per_batch, scratch, settle, sweep, texts
from rowsmith.llm.components import components
from rowsmith.llm.simhash import SEED, folded, named, one_of_each, text_hash
from rowsmith.llm.simhash import links as fingerprint_links

SHINGLE, BANDS, ROWS, LEADERS = 5, 48, 5, 3
#: Shingles whose permutations are computed at once.
AT_ONCE = 512
_random = np.random.default_rng(SEED)
FLIPS, FACTORS = (_random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)], dtype=np.uint64))


def identity(found: np.ndarray) -> int:
    """A signed number that equal sets have in common; that of the empty set is 0."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64)) if len(found) else 0


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set; none of the empty set."""
    if not len(found):
        return np.empty(0, dtype=np.int64)
    parts = [((found[i : i + AT_ONCE] ^ FLIPS) * FACTORS).min(axis=1) for i in range(0, len(found), AT_ONCE)]
    least = np.minimum.reduce(parts).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[:, k]) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def counts(found: np.ndarray) -> np.ndarray:
    """The bit counts of a set's 32 segments, eight to a long; counts beyond 255 count as 255, which brings no two further apart."""
    n = np.minimum(np.bincount((found >> np.uint64(59)).astype(np.int64), minlength=32), 255)
    return n.astype(np.uint8).view(np.int64)


def manhattan(a: str, b: str) -> Column:
    """The distance of two sets' counts, the arrays `a` and `b`."""
    lane = lambda x, k, s: F.shiftrightunsigned(F.get(x, F.lit(k)), s).bitwiseAND(F.lit(255))
    return sum((F.abs(lane(a, k, s) - lane(b, k, s)) for k in range(4) for s in range(0, 64, 8)), F.lit(0))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp (the identity of the set), sim (its fingerprint) and keys (of its bands) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in texts(batch)]
        cols = [pa.array([f(s) for s in found], pa.int64()) for f in (identity, folded)] + [pa.array([bands(s) for s in found], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "th"), *cols], names=["doc_id", "th", "fp", "sim", "keys"])

    return per_batch(docs.select("doc_id", "text", text_hash().alias("th")), run, "doc_id long, th long, fp long, sim long, keys array<long>")


def ranged(vertices: DataFrame) -> DataFrame:
    """Candidates (u, v) by operator 2's range join of the fingerprints of vertices (fp, sim)."""
    firsts = settle(vertices.groupBy("sim").agg(F.min("fp").alias("first")), "firsts")
    alike = vertices.join(firsts, "sim").where("fp <> first").select(*_pair("fp", "first"))
    a, b = firsts.select(F.col("sim").alias("u"), F.col("first").alias("x")), firsts.select(F.col("sim").alias("v"), F.col("first").alias("y"))
    near = fingerprint_links(firsts.select(F.col("sim").alias("fp"))).join(a, "u").join(b, "v").select(*_pair("x", "y"))
    return settle(alike.unionByName(near).distinct(), "ranged")


def sets(docs: DataFrame, vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and its set, of the vertices wanted, each read from one of its documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([pa.array([identity(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["fp", "set"])

    ids = vertices.join(wanted, "fp", "left_semi").select(F.col("least").alias("_id")).distinct()
    chosen = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    return per_batch(chosen, run, "fp long, set array<long>").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of 0.8 or more."""
    a, b = known.select(F.col("fp").alias("u"), F.col("set").alias("a")), known.select(F.col("fp").alias("v"), F.col("set").alias("b"))
    m, n = F.size("a"), F.size("b")
    sizes = 5 * F.least(m, n) >= 4 * F.greatest(m, n)
    near = 9 * F.size(F.array_intersect("a", "b")) >= 4 * (m + n)  # i / (m + n - i) >= 4 / 5
    return pairs.join(b, "v").join(a, "u").where(sizes & near).select("u", "v")


def _pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _stars(roots: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what roots (u, root) say is connected."""
    return roots.select("u", F.col("root").alias("v"))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of bands that lie in several components, with their roots (u, root)."""
    placed = settle(members.join(roots, members["fp"] == roots["u"], "left").select("key", "fp", "degree", F.coalesce("root", "fp").alias("root")), "placed")
    several = settle(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "several")
    rest = settle(placed.join(several, "key", "left_semi"), "open")
    discard(placed.sparkSession, placed, several)
    return rest


def _possible(rest: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of rest that can have a near-duplicate in their band, with n, alone, room and counts.

    n is the size of the set, alone the number of its shingles that no other set in rest has, counts the embedding of
    the others.  Of sizes m and n a pair shares m - alone at most, so it is near only if 9 * (m - alone) >= 4 * (m + n):
    room, 5 * m - 9 * alone, is to be 4 * n at least.  No near pair is lost.
    """
    mine = known.join(rest.select("fp").distinct(), "fp", "left_semi")
    once = mine.select("fp", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("fp").alias("fp")).where("c = 1")
    lonely = once.groupBy("fp").agg(F.collect_list("h").alias("lonely"))  # of one set

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        every, own = (column(batch, c) for c in ("set", "lonely"))
        n, alone, of = [], [], []
        for a, b in zip(every, own):
            a = a.values.to_numpy()
            b = b.values.to_numpy() if b.is_valid else a[:0]
            n.append(len(a))
            alone.append(len(b))
            of.append(counts(np.setdiff1d(a, b).view(np.uint64)))
        return pa.RecordBatch.from_arrays([column(batch, "fp"), pa.array(n, pa.int32()), pa.array(alone, pa.int32()), pa.array(of, pa.list_(pa.int64()))], names=["fp", "n", "alone", "counts"])

    sized = per_batch(mine.join(lonely, "fp", "left").select("fp", "set", "lonely"), run, "fp long, n int, alone int, counts array<long>")
    sized = sized.withColumn("room", F.expr("5 * n - 9 * alone"))
    able = rest.join(settle(sized.where("5 * room >= 16 * n"), "sized"), "fp")  # the other has 0.8 * n at least
    able = settle(able, "able")
    least = settle(able.groupBy("key").agg(F.min("n").alias("least")), "least")
    return able.join(least, "key").where("room >= 4 * least").drop("least")


def links(docs: DataFrame, rows: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges (u, v) between near-duplicates among the candidates: enough to connect the same as all of them."""
    spark = docs.sparkSession
    keyed = rows.select("fp", F.explode("keys").alias("key"))
    shared = settle(keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("key"), "shared")
    alike = settle(keyed.join(shared, "key").select("key", "fp").distinct(), "alike")
    sweep(spark)
    sizes = settle(alike.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    degrees = settle(alike.join(sizes, "key").groupBy("fp").agg(F.sum("size").alias("degree")), "degrees")
    members = settle(alike.join(degrees, "fp"), "members")
    tried = ranged(vertices)
    wanted = degrees.select("fp").unionByName(tried.select(F.col("u").alias("fp"))).unionByName(tried.select(F.col("v").alias("fp"))).distinct()
    known = settle(sets(docs, vertices, wanted), "sets")
    roots, led = components(verified(tried, known)), None
    rest = _open(members, roots)
    sweep(spark)
    for _ in range(LEADERS):
        eligible = rest if led is None else rest.join(led, "fp", "left_anti")
        leaders = settle(eligible.groupBy("key").agg(F.max(F.struct("degree", "fp", "root")).alias("to")), "leaders")
        each = leaders.select("to.fp").distinct()
        led = settle(each if led is None else led.unionByName(each), "led")
        new = rest.join(leaders, "key").where("root <> to.root").select(*_pair("fp", "to.fp")).distinct()
        new = settle(new.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = tried.unionByName(new)
        roots = components(_stars(roots).unionByName(verified(new, known)))
        rest = _open(members, roots)
        sweep(spark)
    rest = settle(_possible(rest, known), "possible")
    side = lambda x: rest.select("key", *[F.col(c).alias(x + c) for c in ("fp", "root", "n", "alone", "room", "counts")])
    apart = F.col("xalone") + F.col("yalone") + manhattan("xcounts", "ycounts")  # at most what the sets differ in
    both = side("x").join(side("y"), "key").where("xfp > yfp AND xroot <> yroot AND xroom >= 4 * yn AND yroom >= 4 * xn").where(9 * apart <= F.col("xn") + F.col("yn"))
    new = settle(both.select(*_pair("xfp", "yfp")).distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
    return _stars(roots).unionByName(settle(verified(new, known), "near"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, root (the component's least identity) and component_id of every row."""
    with scratch(docs.sparkSession) as keep:
        rows = settle(signatures(docs), "signatures")
        vertices = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("sim").alias("sim")), "vertices")
        found = named(vertices, components(links(docs, rows, vertices)))
        keep += [rows, found]
    sweep(docs.sparkSession)
    return rows.select("doc_id", "th", "fp").join(found, "fp", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable) of every row."""
    return placed(docs).select("doc_id", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component."""
    return one_of_each(docs, placed(docs))
