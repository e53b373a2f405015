"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import collections
import hashlib
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark import SparkConf
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from rowsmith.llm import bpe, components, fingerprints, jaccard, language, packing, quality, recompression, simhash, substrings, token_files, toxicity, warc
from rowsmith.llm.common import scratch, settle, shared_dir
from rowsmith.llm.tokenizing import default_vocabulary, encoder, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STEMS = {"en": "the ing tion er and of ed th ha re".split(), "de": "sch der ung keit ein ver ich ge zu be".split(), "fr": "eau que oi le aux ment é tre la ou".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=120, seed=1):
    """Texts in three languages with copies, near copies, shared passages, runs, nulls and odd ones."""
    rng = random.Random(seed)
    shared = sentence(rng, "en", 60)
    rows = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        text = ".\n".join(sentence(rng, lang, rng.randint(5, 60)) for _ in range(rng.randint(1, 5)))
        if i % 6 == 1:
            text += " " + shared + " " + sentence(rng, lang, 8)
        if i % 10 == 3 and i > 10:
            text = rows[i - 7][1] or ""
        if i % 10 == 4 and i > 10:
            text = (rows[i - 8][1] or "") + " extra"
        rows.append((i, text, lang, "s", 0))
    odd = [None, "", "   ", "\n\t", "one", "a b c", "x " * 400, "<|endoftext|> don't  stop   'start", "é​漢字 😀 ½\x85\xa0 z", "w" * 5000, "A B A B A B " * 40, "### $$$ %%% " * 30]
    rows += [(1000 + i, t, None, "odd", 0) for i, t in enumerate(odd)]
    rows.append((1000, None, None, "odd", 0))
    rows.append((None, "no id at all", None, "odd", 0))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ["votes", "row", "words", "score", "_id", "fp", "kept", "n_words", "part"]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in clash}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall(t or "")


def library():
    return encoder(default_vocabulary()).whole


def test_engine_equals_library(rows):
    e, rng = encoder(default_vocabulary()), random.Random(3)
    signs = ["a", "B", " ", "  ", "\n", "\t", "'", "s", "'ll", "1", "é", "\x1c", "\x85", "　", "½", "!", "_", "漢", "😀", "<|endoftext|>"]
    texts = [t or "" for _, t, *_ in rows] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + [" " * 400_000]
    assert all(e.ids(t) == e.whole(t) for t in texts)


def test_engine_equals_library_around_every_sign():
    """White space of any kind before and after blanks, and all other signs, by the thousand in one batch."""
    e = encoder(default_vocabulary())
    points = [c for c in [*range(1, 0x3100), *range(0x3100, 0x110000, 37)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)} b{chr(c)}{chr(c)} {chr(c)}x {chr(c)}" for c in points]
    assert all(ids.tolist() == e.whole(t) for ids, t in zip(e.encode(texts), texts))


def test_vocabularies_that_change_texts_are_refused(tmp_path):
    import json

    with open(default_vocabulary(), encoding="utf-8") as f:
        j = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": j["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        (tmp_path / "v.json").write_text(json.dumps(j | change))
        with pytest.raises(ValueError):
            vocabulary.__wrapped__(str(tmp_path / "v.json"))


def test_bpe(docs, rows, none):
    whole = library()
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = np.array(whole(t or ""), "<u4").tobytes()
        want[(d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in bpe.digests(docs, default_vocabulary()).collect()) == want
    assert bpe.digests(none, default_vocabulary()).count() == 0
    code = bpe.forced(default_vocabulary())
    rng = random.Random(5)
    for _ in range(200):
        t = bytes(rng.choice(b"theing =-#") for _ in range(rng.randint(50, 300))).decode()
        assert np.frombuffer(code.encode(t), "<u4").tolist() == whole(t)
    assert code.decode(np.array([0x1F0, 220, 50256], "<u4").tobytes()).endswith("<|endoftext|>")


def test_token_files(spark, docs, rows, none):
    whole = library()
    folder = shared_dir(spark, "t")
    files = token_files.write(docs, default_vocabulary(), folder).collect()
    got = token_files.read(spark, files, 300).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([d for d, *_ in rows], key=lambda d: (d is not None, d))
    by, at = collections.defaultdict(list), 0
    for d, t, *_ in rows:
        ids = np.array([*whole(t or ""), 2], "<u4")
        by[d].append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in by[r["doc_id"]]
        at += r["n_tokens"]
    assert token_files.read(spark, token_files.write(none, default_vocabulary(), folder + "e").collect()).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_bit_packing(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (token_files.unpack_bits(data, len(ids), bits) == ids).all()
    path = tmp_path / "f"
    with open(path, "wb") as f:
        w = token_files.Writer(f, bits, 64)
        w.open()
        w.add(7, ids[:500])
        w.add(None, ids[500:])
        w.close()
    with open(path, "rb") as f:
        r = token_files.Reader(f, path.stat().st_size)
        for lo, hi in ((0, 1001), (63, 65), (500, 500), (1000, 1001)):
            assert (r.ids(lo, hi) == ids[lo:hi]).all()
        assert [x.tolist() for x in r.documents(0, 2)] == [[7, 0], [1, 0], [0, 500], [500, 501]]


def test_packing(docs, rows, none):
    whole = library()
    got = packing.pack(docs, default_vocabulary()).collect()
    want = collections.Counter()
    for d, t, *_ in rows:
        want[d] += len(whole(t or "")) + 1
    have, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        have[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in p) < 2048 for p in places.values()) <= 3  # one for each task
    ids = {d: np.array([*whole(t or ""), 1], "<u4") for d, t, *_ in rows if d is not None and d != 1000}
    for r in got:
        if r["doc_id"] in ids:
            assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert packing.pack(none, default_vocabulary()).count() == 0


def test_padding_is_reported(docs):
    """Placing alone leaves some padding, and the closing pass less than a window for each task."""
    found = packing.padding_report(docs, default_vocabulary()).collect()
    pieces = packing.pack(docs, default_vocabulary()).agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert (sum(r["sequences"] for r in found), sum(r["ids"] for r in found)) == tuple(pieces)
    assert all(0 <= r["padding"] < 2048 and r["padding"] <= r["padding_placed"] for r in found)


def test_sum_of_squares_choice():
    rng, p = np.random.default_rng(1), packing.Packer(50)
    for _ in range(500):
        n = int(rng.integers(1, 51))
        cost = {}
        for h in [0, *np.flatnonzero(p.counts)]:
            if h + n <= 50:
                c = p.counts.copy()
                c[h] -= bool(h)
                c[h + n] += h + n < 50
                cost[int(h)] = int((c[:50] ** 2).sum())
        assert cost[p.level(n)] == min(cost.values())
        p.put((0, 0, np.zeros(n, "<u4"), n))


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("crowd,blocks", [(1000, None), (1, 8), (1000, 11)])
def test_simhash(docs, rows, crowd, blocks):
    fps = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    nodes = sorted({f for _, f in fps})
    root = groups([(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4], nodes)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    got = collections.Counter(tuple(r) for r in simhash.near_duplicates(docs, crowd=crowd, blocks=blocks).collect())
    assert got == collections.Counter((d, f"{f:016x}", least.get(root[f])) for d, f in fps)
    assert len(set(least.values())) < len(nodes)


def one_kept_of_each(kept, all_rows, group_of):
    """Exactly one row of each group stays, of the least doc_id, nulls last."""
    left = collections.defaultdict(list)
    for r in kept.select("doc_id", "text").collect():
        left[group_of(r["text"])].append(r["doc_id"])
    want = {}
    for d, t, *_ in all_rows:
        g = group_of(t)
        want[g] = min(want.get(g, (True, 0)), (d is None, d or 0))
    assert {g: len(v) for g, v in left.items()} == dict.fromkeys(want, 1)
    assert all(v[0] == (None if want[g][0] else want[g][1]) for g, v in left.items())


#: Rows whose doc_ids are null or repeated, with equal and with different texts.
CLASHES = [(None, "alpha beta gamma delta epsilon"), (None, "one two three four five six"), (None, "one two three four five six"), (1, "red green blue white black"), (1, "up down left right over under"), (1, "up down left right over under"), (2, "up down left right over under"), (2, "north south"), (None, None), (None, ""), (7, None)]


def test_one_of_each_group_stays(spark, docs, rows, none):
    for given, frame in ((rows, docs), (CLASHES, spark.createDataFrame(CLASHES, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id()))):
        kept = simhash.representatives(frame)
        assert kept.columns == frame.columns
        nodes = sorted({brute_fingerprint(t) for _, t, *_ in given})
        root = groups([(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4], nodes)
        one_kept_of_each(kept, given, lambda t, root=root: root[brute_fingerprint(t)])
    assert simhash.representatives(none).count() == 0


@pytest.mark.parametrize("blocks", [7, 8, 12, 16])
def test_grids_never_miss_links(spark, blocks):
    """The embedding's distance is a lower bound, and a link is a candidate in one grid only."""
    rng, grids = random.Random(2), simhash.Grids(blocks)
    point = lambda x: [(x >> 2 * k & 3).bit_count() for k in range(32)]
    pairs = []
    for _ in range(300):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 9)):
            b ^= 1 << bit
        pairs.append((simhash.signed(a), simhash.signed(b), sum(abs(x - y) for x, y in zip(point(a), point(b))), (a ^ b).bit_count()))
    df = spark.createDataFrame(pairs, "a long, b long, want int, bits int")
    pa, pb = simhash.embedded(F.col("a")), simhash.embedded(F.col("b"))
    cells = [F.when((pa.bitwiseAND(m) == pb.bitwiseAND(m)) & simhash._kept_here(F.lit(g), pa, pb, grids), 1).otherwise(0) for g, m in enumerate(grids.masks[:40])]
    if blocks == 7:
        for r in df.select("want", "bits", simhash.manhattan(pa, pb).alias("got"), sum(cells).alias("times")).collect():
            assert r["got"] == r["want"] <= r["bits"] and (r["want"] > 4 or r["times"] == 1)
    for a, b, want, bits in pairs:
        if want <= 4:
            a, b = (sum(c << 2 * k for k, c in enumerate(point(x % (1 << 64)))) for x in (a, b))
            assert sum(a & (m % (1 << 64)) == b & (m % (1 << 64)) for m in grids.masks) >= 1
    assert simhash.blocks_for(10**3) == 7 < simhash.blocks_for(10**9) <= 16


def test_shared_folders(spark, tmp_path, monkeypatch):
    """A folder without a scheme belongs to the default file system; what a block settles goes, but for what it keeps."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert shared_dir(spark, "x").startswith("file:/")
    before, get = conf.get("fs.defaultFS"), type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: "/some/where" if key == "spark.checkpoint.dir" else get(self, key, *a))
    try:
        assert re.match(r"file:/+some/where/rowsmith/x-", shared_dir(spark, "x"))
        conf.set("fs.defaultFS", "viewfs://far/")
        conf.set("fs.viewfs.mounttable.far.link./some", f"file://{tmp_path}")
        assert shared_dir(spark, "x").startswith("viewfs://far/some/where/rowsmith/x-")
    finally:
        conf.set("fs.defaultFS", before or "file:///")
        monkeypatch.undo()
    monkeypatch.setattr(spark.sparkContext, "master", "spark://far:7077")
    monkeypatch.setattr(spark.sparkContext, "getConf", lambda: SparkConf(False))
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: a[0] if a else None)
    with pytest.raises(RuntimeError):
        shared_dir(spark, "x")
    monkeypatch.undo()
    with scratch(spark) as keep:
        a, b = settle(spark.range(3), "a"), settle(spark.range(4), "b")
        keep.append(b)
    paths = [f.inputFiles()[0].removeprefix("file://") for f in (a, b)]
    assert [os.path.exists(p) for p in paths] == [False, True] and b.count() == 4


def test_settled_folders_hold_parts_only(spark):
    """No mark of success: nothing reads it, and it costs helper processes of the driver."""
    folder = os.path.dirname(settle(spark.range(3), "parts").inputFiles()[0].removeprefix("file://"))
    assert all(re.match(r"\.?part-", f) for f in os.listdir(folder))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5)]
    want = groups(pairs, {x for p in pairs for x in p})
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_quality(t):
    w = words(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if c[(w[i], w[i + 1], w[i + 2])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, rows, none):
    got = quality.quality(docs).collect()
    want = collections.Counter((d, *brute_quality(t)) for d, t, *_ in rows)
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    assert quality.quality(none).count() == 0 and quality.keep(none).columns == none.columns
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_votes(t):
    """The eight rules on a text, from its words and lines."""
    n, chars, symbols, dups, repeats = brute_quality(t)
    t, w = t or "", words(t)
    if n < 50:
        return [0] * 8
    lines = [x for x in t.split("\n") if WORD.search(x)]
    ended = sum(x.rstrip(" ")[-1:] in list(".!?:\"”»)]") for x in lines)
    capitals, variety = len(re.findall("[A-Z]", t)), len(set(w)) / n**0.5
    bad = [symbols / n > 0.1, repeats / n > 0.4, dups / len(lines) > 0.4, capitals / chars > 0.4, not 2.5 <= chars / n <= 12, len(lines) >= 3 and ended / len(lines) < 0.1, variety < 3]
    prose = symbols / n < 0.02 and repeats / n < 0.3 and capitals / chars < 0.2 and 3 <= chars / n <= 9 and variety > 5
    return [-b for b in map(int, bad)] + [int(prose)]


def test_quality_verdicts_by_brute_force(docs, rows):
    """Votes, expectation-maximisation over the rows themselves, and posteriors, by plain loops."""
    votes = [brute_votes(t) for _, t, *_ in rows]
    accuracy = [0.75] * 8
    for _ in range(100):
        right, cast = [3.0] * 8, [4.0] * 8
        for v in votes:
            good = 1 / (1 + np.prod([(a / (1 - a)) ** -x for a, x in zip(accuracy, v)]))
            for j, x in enumerate(v):
                right[j] += abs(x) * (good if x > 0 else 1 - good)
                cast[j] += abs(x)
        accuracy = [min(0.999, r / c) for r, c in zip(right, cast)]
    want = collections.Counter()
    for (d, t, *_), v in zip(rows, votes):
        n, *_, repeats = brute_quality(t)
        good = 1 / (1 + np.prod([(a / (1 - a)) ** -x for a, x in zip(accuracy, v)]))
        want[(d, n >= 50 and 100 * repeats <= 50 * n and bool(good >= 0.5 - 1e-12))] += 1
    got = collections.Counter((r["doc_id"], r["kept"]) for r in quality.quality(docs).collect())
    assert got == want and len({k for _, k in got}) == 2 and any(any(v) for v in votes)


def test_quality_estimates():
    good, bad = [0] * 7 + [1], [-1, -1] + [0] * 6
    a = quality.estimate([(good, 900), (bad, 80), ([-1] + [0] * 7, 20)])
    assert quality.posterior(good, a) > 0.5 > quality.posterior([-1] + [0] * 7, a) > quality.posterior(bad, a) and quality.posterior([0] * 8, a) == 0.5


def test_repeats_by_the_windows_themselves(spark):
    df = spark.createDataFrame([(["a", "b", "c", "a", "b", "c"],), (["a"] * 5,), (["a", "b", "c"],)], "w array<string>")
    assert [r[0] for r in df.select(quality._exact(F.col("w"))).collect()] == [6, 5, 0]


def test_substrings(docs, rows, none):
    count = collections.Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t, *_ in rows) for i in range(len(w) - 34))
    want, gone = collections.Counter(), 0
    for d, t, *_ in rows:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        kept = [x for x, k in zip(w, keep) if k]
        gone += len(w) - len(kept)
        want[(d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in substrings.digests(docs).collect()) == want and gone > 1000
    assert substrings.digests(none).count() == 0
    clean = substrings.deduplicated(docs)
    assert clean.columns == docs.columns and clean.where("text IS NULL").count() == 2
    assert clean.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("size", [2, 5, 300])
def test_anchors_depend_on_the_window_alone(size):
    rng = np.random.default_rng(size)
    h = recompression.hashes([b"%d" % x for x in rng.integers(0, size, 4000)])
    first = np.arange(4000 - 34)
    name, place = recompression.anchors(h, 35, first)
    assert ((place >= first) & (place < first + 35)).all()
    for i in rng.integers(0, len(first), 60):
        alone, at = recompression.anchors(h[i : i + 35], 35, np.zeros(1, np.int64))
        assert alone[0] == name[i] and at[0] == place[i] - i


def test_fingerprints(docs, rows, none):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for k, (d, t, *_) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        want[(d, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.text_of(fingerprints.fingerprint(t)))] += 1
    got = fingerprints.fingerprints(docs).collect()
    assert collections.Counter(tuple(r)[:4] for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert np.mean([r["near_edited"] - r["near_next"] for r in got if r["n_chars"] > 300]) > 0.35
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(docs.where("doc_id = 5")).first()["near_next"] == 1.0


def brute_pieces(data):
    """By the words of the docstring: after line breaks, after blanks whose four bytes before say so, and at the end."""
    out, start = [], 0
    for i, b in enumerate(data):
        ends = b == 10
        if b == 32:
            h = 0
            for back in (4, 3, 2, 1):
                h = (h + data[max(i - back, 0)] + 1) * 0x9E3779B1 % (1 << 32)
            ends = (h >> 20) % 4 == 0
        if ends or i + 1 == len(data):
            out.append(data[start : i + 1])
            start = i + 1
    return out


def brute_sums(text):
    lanes, wide = [0] * 128, [0, 0]
    for p in brute_pieces(text.encode()):
        h = xxhash.xxh3_128_intdigest(p)
        for k in range(128):
            lanes[k] += 1 if h >> (127 - k) & 1 else -1
        for k, w in enumerate((h >> 64, h % (1 << 64))):
            wide[k] = (wide[k] + (w ^ w >> 29) * 0xBF58476D1CE4E5B9 + 1) % (1 << 64)
    return lanes, wide


def brute_likeness(a, b):
    if a == b:
        return 1.0
    dot, size = sum(x * y for x, y in zip(a[0], b[0])), sum(x * x for x in a[0]) * sum(x * x for x in b[0])
    return min(max(dot / size**0.5, 0.0), 0.999999) if size else 0.0


def test_fingerprints_by_their_definition(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    text_of = lambda s: "".join(f"{x % (1 << 16):04x}" for x in s[0]) + "".join(f"{x:016x}" for x in s[1])
    want = collections.Counter()
    for k, (d, t, *_) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        a, b, c = (brute_sums(x) for x in (t, t[: len(t) - len(t) // 3] + following[: len(t) // 3], following))
        want[(d, text_of(a), text_of(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9))] += 1
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.fingerprints(docs).collect())
    assert got == want


def test_fingerprint_ranges(docs, monkeypatch):
    whole = collections.Counter(tuple(r) for r in fingerprints.fingerprints(docs).collect())
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 9)
    assert collections.Counter(tuple(r) for r in fingerprints.fingerprints(docs).collect()) == whole


def test_fingerprints_are_homomorphic():
    parts = fingerprints.pieces(" ".join(f"word{i} other{i * 7}" for i in range(200)).encode())
    v = fingerprints.vector(parts)
    assert (v == fingerprints.vector(parts[::-1])).all() and (fingerprints.combine(fingerprints.vector(parts[3:]), added=parts[:3]) == v).all()
    assert (fingerprints.combine(v, removed=parts[5:9]) == fingerprints.vector(parts[:5] + parts[9:])).all()


def test_warc(spark, none):
    rng = random.Random(6)
    noise = bytes(rng.randint(0, 255) for _ in range(3000)).decode("latin-1")
    pages = [(i, f"http://x/{i}?q=ä b\n", rng.choice(["<p>" + "same " * 40, "short", None, "", noise, f"<b>{i}</b>" * 30]), "x") for i in range(90)] + [(None, None, "<p>" + "same " * 40, "x"), (3, "u", "short", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").withColumn("salt", F.lit(1)).repartition(3)
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = collections.Counter()
    for i, _, h, _ in pages:
        b = (h or "").encode()
        again = i is not None and len(b) >= 100 and i != first[h or ""]
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)] += 1
    archives = warc.write(warc.with_references(df), shared_dir(spark, "w")).collect()
    for size in (97, 4000, 1 << 24):
        got = warc.read(spark, archives, size)
        assert collections.Counter(tuple(r)[:5] for r in got.collect()) == want
    payloads = collections.Counter(bytes(r["payload"]) for r in got.where("record_type = 'response'").collect())
    assert sum(payloads.values()) == sum(n for k, n in want.items() if k[3] == "response") and noise.encode() in payloads
    empty = warc.write(warc.with_references(df.limit(0)), shared_dir(spark, "w")).collect()
    assert warc.read(spark, empty).count() == 0


def test_an_archive_inside_a_payload_is_no_record(tmp_path):
    """Wherever a range begins, also inside a stored payload that is an archive itself."""
    inner = warc.member(warc.record(9, "http://in", b"inner" * 9, "x", None))
    whole = warc.record(1, "http://out", b"<<" + inner + b">>" + bytes(200), "y", None)
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = c.compress(whole) + c.flush() + warc.member(warc.record(2, "http://next", b"z" * 500, "z", None))
    assert inner in data
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for step in (40, 97, 301, len(data)):
        found = []
        with open(path, "rb") as f:
            for lo in range(0, len(data), step):
                found += [r[0]["warc-target-uri"] for r in warc.records(f, lo, min(lo + step, len(data)), len(data))]
        assert found == ["http://out", "http://next"], step


def test_a_long_record_is_read_in_linear_time(tmp_path):
    payload = np.random.default_rng(1).integers(0, 256, 40_000_000, np.uint8).tobytes()
    path = tmp_path / "b.warc.gz"
    path.write_bytes(warc.member(warc.record(1, "u", payload, "y", None)))
    began = time.process_time()
    with open(path, "rb") as f:
        ((_, block),) = warc.records(f, 0, path.stat().st_size, path.stat().st_size)
    assert block == payload and time.process_time() - began < 5


def test_language(docs, rows, none):
    model = language.train(docs, 100, 60)
    assert model.names == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in language.identified(docs, model).collect()}
    right = [got[d]["lang_pred"] == lang for d, t, lang, *_ in rows if lang and len(t) > 40 and d % 10 not in (3, 4)]  # copies have the text of another row
    assert np.mean(right) > 0.9
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d, t, *_ in rows if not any(c.isalpha() for c in t or ""))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identified(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identified(docs, language.train(none)).collect()} == {"und"}


def test_language_of_held_out_rows(spark):
    """Rows of the held-out fold are predicted by models that have not seen them: other labels there change nothing."""
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    rng = random.Random(9)
    rows = [(i, sentence(rng, lang := rng.choice(list(STEMS)), rng.randint(6, 40)), lang, "s", 0) for i in range(600)]
    wrong = [(i, t, "xx" if held(i) else lang, s, n) for i, t, lang, s, n in rows]
    said = []
    for r in (rows, wrong):
        df = spark.createDataFrame(r, DOCS)
        said.append({x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identified(df, language.train(df)).collect()})
    assert said[0] == said[1]
    assert np.mean([said[0][i][0] == lang for i, _, lang, *_ in rows if held(i)]) > 0.98


def brute_kneser_ney(texts, alphabet):
    """Interpolated Kneser-Ney by its definition, over tuples; a function of a 4-gram."""
    top = collections.Counter(g for t in texts for g in padded(t))
    counts = {4: top}
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    discount, seen = {}, {}
    for n, c in counts.items():
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        seen[n] = collections.defaultdict(dict)
        for g, v in c.items():
            seen[n][g[:-1]][g[-1]] = v

    def p(g):
        if not g:
            return 1 / alphabet
        after = seen[len(g)].get(g[:-1])
        if after is None:
            return p(g[1:])
        total, d = sum(after.values()), discount[len(g)]
        return max(after.get(g[-1], 0) - d, 0) / total + d * len(after) / total * p(g[1:])

    return p


def padded(t):
    c = [0, 0, *language.signs(t).tolist()]
    return [tuple(c[i : i + 4]) for i in range(len(c) - 3)]


def test_kneser_ney_by_its_definition():
    rng = random.Random(11)
    learned = {lang: [sentence(rng, lang, 30) for _ in range(8)] for lang in STEMS}
    packed = {k: np.concatenate([language.grams(language.signs(t)) for t in v]) for k, v in learned.items()}
    alphabet = language.alphabet_size(np.concatenate(list(packed.values())))
    assert alphabet == len({g[-1] for v in learned.values() for t in v for g in padded(t)}) + 1
    names = sorted(learned)
    models = [language.Model(*np.unique(packed[k], return_counts=True), alphabet) for k in names]
    found = language.Identifier(names, models)
    tests = [sentence(rng, lang, 9) for lang in STEMS] + ["漢字 and ümläute", "x"]
    n, h = found.entropies(tests)
    for j, k in enumerate(names):
        p = brute_kneser_ney(learned[k], alphabet)
        for i, t in enumerate(tests):
            g = padded(t)
            assert n[i] == len(g) and abs(h[i, j] + sum(np.log(p(x)) for x in g) / len(g)) < 1e-5
        letters = np.append(np.unique(language.suffix(np.concatenate(list(packed.values())), 1)), np.uint64(0xABCD))  # and one unknown sign
        assert len(letters) == alphabet
        for context in [*(packed[k][::40] >> np.uint64(16)), np.uint64(0xABCDABCD)]:
            total = np.exp(models[j].log_probabilities((context << np.uint64(16)) | letters)).sum()
            assert abs(total - 1) < 1e-6


def test_toxicity(spark, none):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = [sentence(rng, "en", 1) for _ in range(40)] + (["idiot", "scum!"] if toxic else [])
        rng.shuffle(w)
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(2000, None, None, "s", 0), (2001, "", None, "s", 0), (None, "idiot", None, "s", 0)]
    df, lab = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.train(df, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, m).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(600)) and got[2000] == got[2001] < 0.5
    kept = toxicity.harmless(df, m)
    assert kept.columns == df.columns and kept.count() == sum(s < 0.7 for s in got.values())
    blank = toxicity.train(none, lab.limit(0))
    assert toxicity.scored(none, blank).count() == 0 and 0 < blank.score([]) < 1


def test_machine_learns_pairs():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    x = [np.array([10 * (k + 1) for k, on in enumerate(p) if on], np.int64) for p in zip(a, b)]
    m = toxicity.fit(x, (a & b).astype(float))
    assert m.score([10, 20]) > 0.9 and max(m.score([]), m.score([10]), m.score([20])) < 0.2


def test_scores_are_sums_over_terms_and_pairs():
    rng = np.random.default_rng(5)
    m = toxicity.Machine(-0.4, rng.normal(0, 0.3, toxicity.SLOTS).astype(np.float32), rng.normal(0, 0.2, (toxicity.SLOTS, 4)).astype(np.float32))
    code = toxicity.Terms()
    lots = ["you absolute fool, you", "", None, "Plain words. Stand here!", "x"]
    for got, text in zip(m.scores([code.of(t) for t in lots]), lots):
        plain = set()
        for w in (text or "").lower().split():
            w = w.strip(toxicity.SIGNS)
            plain |= {xxhash.xxh64_intdigest(t, 20) >> 45 for t in [w, *("^" + w[:k] for k in (3, 4, 5) if len(w) > k)] if w}
        z = -0.4 + sum(float(m.weights[t]) for t in plain)
        z += sum(float(sum(float(p) * float(q) for p, q in zip(m.factors[s], m.factors[t]))) for s, t in itertools.combinations(sorted(plain), 2))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-6


def test_toxicity_of_held_out_rows(spark):
    """Labels of the held-out fold change no score, and its toxic rows are found."""
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    rng, docs = random.Random(3), []
    insults = ["idiot", "scum!", "worthless", "filth"]
    for i in range(900):
        w = [sentence(rng, "en", 1) for _ in range(60)] + (rng.sample(insults, 2) if i % 5 == 0 else [])
        rng.shuffle(w)
        docs.append((i, " ".join(w), "en", "s", 0))
    df, said = spark.createDataFrame(docs, DOCS), []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1, int((i % 5 == 0) ^ (flip and held(i)))) for i in range(900)], "doc_id long, quality int, toxic int")
        said.append({r["doc_id"]: r["score"] for r in toxicity.scored(df, toxicity.train(df, labels)).collect()})
    assert said[0] == said[1]
    judged = [(said[0][i] >= 0.7, i % 5 == 0) for i in range(900) if held(i)]
    assert sum(p and t for p, t in judged) > 0.9 * sum(t for _, t in judged) and sum(p and not t for p, t in judged) <= 2


def test_toxicity_learns_a_bounded_number_of_rows(spark, monkeypatch):
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda x, y: seen.append(len(x)) or fit(x, y))
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(7, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, labels, 100)
    assert 50 < seen[0] < 200


def brute_shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edits(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows():
    """Copies of similarities on both sides of 0.8, one group with many members, short, empty and repeated rows."""
    rng, out = random.Random(5), [(1, None), (2, ""), (3, " \n"), (None, "no id here"), (None, None), (4, "three short words"), (5, "Three  short WORDS"), (6, "three short word")]
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 900]))]
        out += [(100 + 10 * g + k, edits(rng, words, len(words) * k // 80)) for k in range(6)]
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    out += [(1000 + k, edits(rng, words, rng.randrange(8))) for k in range(150)]
    return [*out, out[30], (out[30][0], out[40][1])]


def test_pipeline_near_duplicates_by_jaccard(spark, near_rows):
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").repartition(5)
    found = [(d, brute_shingles(t)) for d, t in near_rows]
    nodes = sorted({s for _, s in found}, key=sorted)
    place = {s: i for i, s in enumerate(nodes)}
    pairs = [(i, j) for i, a in enumerate(nodes) for j in range(i) if 5 * len(a & (b := nodes[j])) >= 4 * len(a | b)]
    root = groups(pairs, range(len(nodes)))
    least = {}
    for d, s in found:
        if d is not None:
            least[root[place[s]]] = min(least.get(root[place[s]], d), d)
    want = collections.Counter((d, least.get(root[place[s]])) for d, s in found)
    assert collections.Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == want
    kept = corpus_pipeline.near_deduplicated(spark, docs, "")
    assert kept.columns == docs.columns
    one_kept_of_each(kept, near_rows, lambda t: root[place[brute_shingles(t)]])
    odd = corpus_pipeline.near_deduplicated(spark, spark.createDataFrame(CLASHES, "doc_id long, text string"), "")
    one_kept_of_each(odd, CLASHES, brute_shingles)
    assert jaccard.representatives(docs.limit(0)).count() == 0


def test_pipeline_candidates_by_the_range_join(spark, near_rows, monkeypatch):
    """Without bands, near-duplicates are connected by operator 2's range join of the sets' fingerprints, and each link is verified."""
    docs, signatures = spark.createDataFrame(near_rows, "doc_id long, text string").repartition(5), jaccard.signatures
    monkeypatch.setattr(jaccard, "signatures", lambda docs: signatures(docs).withColumn("keys", F.array().cast("array<long>")))
    shingles = {t: brute_shingles(t) for _, t in near_rows}
    sims = {s: sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(b" ".join(x), 42) >> b & 1 for x in s) > len(s)) for s in shingles.values()}
    names = {brute_shingles(t): jaccard.identity(jaccard.shingles(t)) for _, t in near_rows}
    first = {}
    for s in sorted(names, key=names.get):
        first.setdefault(sims[s], s)
    pairs = [(s, first[f]) for s, f in sims.items()] + [(first[f], first[g]) for f in first for g in first if (f ^ g).bit_count() <= 4]
    near = [(names[a], names[b]) for a, b in pairs if 5 * len(a & b) >= 4 * len(a | b)]
    root = groups(near, names.values())
    least = {}
    for d, t in near_rows:
        if d is not None:
            r = root[names[shingles[t]]]
            least[r] = min(least.get(r, d), d)
    want = collections.Counter((d, least.get(root[names[shingles[t]]])) for d, t in near_rows)
    assert collections.Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == want
    assert len(set(root.values())) < len(first) <= len(names)


def test_counts_bound_the_difference(spark):
    rng = np.random.default_rng(4)
    pairs = []
    for n, m, k in ((100, 90, 80), (5000, 9000, 4000), (20_000, 20_000, 0), (1, 0, 0)):
        h = rng.integers(0, 1 << 64, n + m, np.uint64)
        a, b = h[:n], h[n - k : n - k + m]
        pairs.append((jaccard.counts(a).tolist(), jaccard.counts(b).tolist(), len(set(a) ^ set(b)), int(np.abs(jaccard.counts(a).view(np.uint8).astype(int) - jaccard.counts(b).view(np.uint8)).sum())))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, differ long, want long")
    for r in df.select("differ", "want", jaccard.manhattan("a", "b").alias("got")).collect():
        assert r["got"] == r["want"] <= r["differ"]


def test_chance_of_a_missed_candidate():
    assert (1 - 0.8**jaccard.ROWS) ** jaccard.BANDS < 1e-8
    rng, met = np.random.default_rng(3), 0
    for _ in range(200):
        a, b, c = np.split(rng.integers(0, 1 << 64, 200, np.uint64), [150, 175])
        met += bool((jaccard.bands(np.concatenate([a, b])) == jaccard.bands(np.concatenate([a, c]))).any())
    assert met == 200  # 150 of 200 hashes are shared: 0.75


def test_likeness_of_very_many_equal_lines(spark):
    docs = spark.createDataFrame([(2, "the same line\n" * 40_000), (1, "other words")], "doc_id long, text string")
    row = fingerprints.fingerprints(docs).where("doc_id = 2").first()
    assert row["near_edited"] > 0.99


#: The columns that the contract of each query names.
CONTRACT = {
    "op1_language": "doc_id held_out lang_pred score", "op2_simhash": "doc_id fingerprint component_id", "op3_token_files": "doc_id start n_tokens ids_crc32",
    "op4_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op7_substrings": "doc_id n_words n_removed kept_sha256",
    "op8_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10_toxicity": "doc_id held_out score predicted",
}


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """The three tables the queries read, with odd rows and columns of clashing names; and the same without rows."""
    folders = []
    for name in ("some", "none"):
        d = str(tmp_path_factory.mktemp(name))
        here = rows if name == "some" else []
        spark.createDataFrame(here, DOCS).withColumns({c: F.lit(1) for c in ("row", "x", "th", "root", "n_words", "_doc_id")}).repartition(3).write.parquet(f"{d}/documents.parquet")
        pages = [(i, f"http://h/{i}", t) for i, (_, t, *_) in enumerate(here)]
        spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
        labels = [(i, 1, int(i % 7 == 0)) for i, *_ in here if i is not None and i < 100]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        folders.append(d)
    return folders


@pytest.mark.parametrize("name", CONTRACT)
def test_queries_have_the_contract_s_columns_and_rows(spark, tables, rows, name):
    found = __spark_entry__.queries()
    some, none = (found[name](spark, d) for d in tables)
    assert set(CONTRACT[name].split()) <= set(some.columns)
    n = some.select("doc_id").distinct().count() if name == "op9_packing" else some.count()
    assert n == (len({d for d, *_ in rows}) if name == "op9_packing" else len(rows)) and none.count() == 0


def test_pipeline_end_to_end(spark, tables, rows):
    """Each stage against brute force on what the one before it kept, then the whole."""
    folder, empty = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "substring_dedup", "packing"]
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality.quality(docs).collect()}
    after = {}
    for name in list(stages)[:-1]:
        before, kept = kept, spark.createDataFrame(stages[name](spark, kept, folder).collect(), docs.schema)
        assert kept.columns == docs.columns
        after[name] = [(r["doc_id"], r["text"]) for r in kept.collect()]
        if name == "near_dedup":
            given = [(r["doc_id"], r["text"]) for r in before.collect()]
            nodes = sorted({brute_shingles(t) for _, t in given}, key=sorted)
            root = groups([(i, j) for i, a in enumerate(nodes) for j, b in enumerate(nodes[:i]) if 5 * len(a & b) >= 4 * len(a | b)], range(len(nodes)))
            place = {s: i for i, s in enumerate(nodes)}
            one_kept_of_each(kept, given, lambda t, root=root, place=place: root[place[brute_shingles(t)]])
    assert collections.Counter(d for d, _ in after["quality"]) == collections.Counter(d for d, t, *_ in rows if verdict[(d, len(words(t)))])
    count = collections.Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t in after["near_dedup"]) for i in range(len(w) - 34))
    left = collections.Counter()
    for d, t in after["near_dedup"]:
        w = words(t)
        keep = [not any(count[tuple(w[i : i + 35])] > 1 for i in range(max(0, k - 34), min(k, len(w) - 35) + 1)) for k in range(len(w))]
        left[(d, tuple(x for x, k in zip(w, keep) if k))] += 1
    assert left == collections.Counter((d, tuple(words(t))) for d, t in after["substring_dedup"])
    got, whole = collections.Counter(), library()
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] += r["length"]
    want = collections.Counter()
    for d, t in after["substring_dedup"]:
        want[d] += len(whole(t or "")) + 1
    assert got == want
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_points_on_grids_are_never_broadcast(spark):
    """Spark sizes a row for each grid like one row, so with its usual threshold 300,000 fingerprints were sent to the driver 35 times."""
    fps = spark.range(100).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
