"""Quality rules by weak supervision, in DataFrame functions only (operator 4).

Every rule looks at numbers of a text and votes on it or abstains: seven know a defect and vote bad (-1),
one knows running prose and votes good (1).  A text's votes are one of at most 2^8 patterns; their counts
over all documents are all that the driver sees.  From these, expectation-maximisation estimates how often
each rule is right (its accuracy).  A document's posterior probability of being good follows from its
votes and the accuracies of those that voted; documents of at least one half are kept, so those on which
all abstain too, unless they fail a base rule.

Numbers of a text: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
that equal an earlier line) and n_repeat_words (words in three-word windows that occur twice or more).  A
window is hashed to 43 bits beside its 21-bit position, sorted, and equal neighbours are compared word by
word; a text in which two different windows share a hash, or of over two million words, is worked out on
the windows themselves.

A null text has no words, so it fails the base rules; rules abstain on texts of fewer than 50 words.  Rows are
independent given the estimates; repeated rows weigh as often as they come.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.common import documents, settle

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_capitals", "n_distinct"]
POSITION_BITS = 21
POSITION = (1 << POSITION_BITS) - 1
MIN_WORDS = 50


def _ratio(a: str, b: str) -> Column:
    """A ratio of two numbers; null, so that rules abstain, in texts that fail the base rules as too short."""
    return F.when(F.col("n_words") >= MIN_WORDS, F.col(a) / F.greatest(F.col(b), F.lit(1)))


#: What speaks against a text.  Each votes bad or abstains.
DEFECTS: dict[str, Callable[[], Column]] = {
    "symbols": lambda: _ratio("n_symbols", "n_words") > 0.1,
    "repeated_words": lambda: _ratio("n_repeat_words", "n_words") > 0.4,
    "repeated_lines": lambda: _ratio("n_dup_lines", "n_lines") > 0.4,
    "capitals": lambda: _ratio("n_capitals", "word_chars") > 0.4,
    "word_length": lambda: ~_ratio("word_chars", "n_words").between(2.5, 12),
    "line_ends": lambda: (F.col("n_lines") >= 3) & (_ratio("n_ended", "n_lines") < 0.1),
    "variety": lambda: F.when(F.col("n_words") >= MIN_WORDS, F.col("n_distinct") / F.sqrt("n_words")) < 3,
}

#: What speaks for one: running prose, on all of these numbers.  It votes good or abstains.
PROSE: list[Callable[[], Column]] = [
    lambda: _ratio("n_symbols", "n_words") < 0.02,
    lambda: _ratio("n_repeat_words", "n_words") < 0.3,
    lambda: _ratio("n_capitals", "word_chars") < 0.2,
    lambda: _ratio("word_chars", "n_words").between(3, 9),
    lambda: F.when(F.col("n_words") >= MIN_WORDS, F.col("n_distinct") / F.sqrt("n_words")) > 5,
]
RULES = [*DEFECTS, "prose"]
#: The share of good documents that posteriors start from; votes alone decide.
SHARE = 0.5


def _votes() -> Column:
    prose = PROSE[0]()
    for part in PROSE[1:]:
        prose &= part()
    vote = lambda holds, v: F.when(F.coalesce(holds, F.lit(False)), v).otherwise(0).cast("byte")
    return F.array(*[vote(rule(), -1) for rule in DEFECTS.values()], vote(prose, 1))


def _covered(at: Column) -> Column:
    """Words covered by windows of three at the given rising positions."""
    each = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def _repeats(words: Column, packed: Column) -> Column:
    """Positions of windows that occur again, and -1 where two windows share a hash only, from sorted packed ones."""
    key = lambda x: F.shiftrightunsigned(x, POSITION_BITS)
    where = lambda x: x.bitwiseAND(F.lit(POSITION)).cast("int")

    def same(p: Column, q: Column) -> Column:
        return (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))

    def mark(x: Column, other: Column) -> Column:
        return F.when(key(x) == key(other), F.when(same(where(x), where(other)), where(x)).otherwise(-1))

    with_last = F.transform(packed, lambda x, k: mark(x, F.get(packed, k - 1)))
    with_next = F.transform(packed, lambda x, k: mark(x, F.get(packed, k + 1)))
    return F.array_compact(F.concat(with_last, with_next))


def _exact(words: Column) -> Column:
    """The same number from the windows' own words."""
    n = F.size(words) - 2
    windows = F.sort_array(F.transform(F.slice(words, 1, n), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))
    again = lambda x, k: (x["w"] == F.get(windows, k - 1)["w"]) | (x["w"] == F.get(windows, k + 1)["w"])
    at = F.transform(F.filter(windows, lambda x, k: F.coalesce(again(x, k), F.lit(False))), lambda x: x["i"])
    return _covered(F.sort_array(at))


def measured(docs: DataFrame) -> DataFrame:
    """Every row of docs, as a struct `row`, with the numbers of its text."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.select("row", F.array_remove(F.split(text, SPACE + "+"), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"), text.alias("t"))
    h = F.transform(F.slice("words", 1, F.size("words") - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    df = df.withColumn("h", F.when(F.size("words") > 2, h)).withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    packed = F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long"))))
    df = df.withColumn("packed", F.when(F.col("again") & (F.size("words") < POSITION), packed))
    words = F.col("words")
    df = df.withColumn("at", F.when(F.size("packed") > 0, F.sort_array(F.array_distinct(_repeats(words, F.col("packed"))))))
    hashed = F.when(~F.coalesce("again", F.lit(False)), 0).when(F.col("at").isNull() | (F.get("at", F.lit(0)) < 0), _exact(words)).when(F.size("at") == 0, 0).otherwise(_covered(F.col("at")))
    bare = F.col("t")
    for sign in SYMBOLS:
        bare = F.replace(bare, F.lit(sign), F.lit(""))
    return df.select(
        "row",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashed.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).rlike("[.!?:\"”»)]$"))).cast("long").alias("n_ended"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
    )


def voted(numbers: DataFrame) -> DataFrame:
    return numbers.withColumn("votes", _votes())


def estimate(patterns: list[tuple[list[int], int]], rounds: int = 100) -> list[float]:
    """Each rule's accuracy: how often what it votes is so, smoothed by four votes of accuracy 3/4."""
    accuracy = [0.75] * len(RULES)
    for _ in range(rounds):
        right, cast = [3.0] * len(RULES), [4.0] * len(RULES)
        for votes, n in patterns:
            good = posterior(votes, accuracy)
            for j, v in enumerate(votes):
                if v:
                    right[j] += n * (good if v > 0 else 1 - good)
                    cast[j] += n
        after = [min(0.999, r / c) for r, c in zip(right, cast)]
        moved = max(abs(a - b) for a, b in zip(after, accuracy))
        accuracy = after
        if moved < 1e-9:
            break
    return accuracy


def weights(accuracy: list[float]) -> list[float]:
    return [math.log(a / (1 - a)) for a in accuracy]


def posterior(votes: list[int], accuracy: list[float]) -> float:
    odds = math.log(SHARE / (1 - SHARE)) + sum(w * v for w, v in zip(weights(accuracy), votes))
    return 1 / (1 + math.exp(-odds))


def judged(numbers: DataFrame) -> DataFrame:
    """Adds base_failed, quality (the posterior) and kept to voted rows, which are read twice."""
    patterns = sorted(([*r["votes"]], r["count"]) for r in numbers.groupBy("votes").count().collect())
    odds = F.lit(math.log(SHARE / (1 - SHARE)))
    for j, w in enumerate(weights(estimate(patterns))):
        odds += F.lit(w) * F.get("votes", F.lit(j))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-odds))
    return numbers.withColumns({"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= 0.5)})


def quality(docs: DataFrame) -> DataFrame:
    """Numbers, base_failed, quality and kept of every document."""
    numbers = settle(voted(measured(docs.select("doc_id", "text"))).withColumn("doc_id", F.col("row.doc_id")).drop("row"), "quality")
    return judged(numbers).select("doc_id", *NUMBERS[:5], "base_failed", "kept", "quality")


def keep(docs: DataFrame) -> DataFrame:
    """The documents kept, with their own columns."""
    numbers = settle(voted(measured(docs)), "quality")
    return judged(numbers).where("kept").select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
