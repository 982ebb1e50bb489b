"""Quality rules judged together by an isolation forest on their statistics.

One pass over the whole texts yields the rule statistics of each document. Trees of random
splits are grown on a bounded sample of the statistics; a document that few splits isolate
is an anomaly. Its score is 2 ** -(mean path length / expected path length). The threshold
is the one that parts labelled bad from labelled good rows best, read from a histogram of
the scores of all labelled rows.

Cases: a null text has no words, statistics of 0 and fails the base rules, as does an empty
one; repeated rows get equal verdicts; without labelled rows of both kinds the threshold is
0.6; conflicting labels of an id are averaged, a tie is good; an empty table gives an empty
table; other columns are kept.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .rows import packed, row_key, same_key, text_or_empty, unpacked

TREES, TREE_ROWS = 100, 256
#: Documents whose statistics the trees are grown on, chosen by hash.
SAMPLE_ROWS = 8192
SEED, DEFAULT_THRESHOLD, BINS = 17, 0.6, 1000
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 5
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the trees split on, besides shares of the statistics above.
MORE = ["n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_short"]
FEATURES = [
    "log_words", "mean_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
    "digit_share", "mark_share", "short_share", "words_per_line",
]
CAPITALS, DIGITS, MARKS = bytes(range(65, 91)), b"0123456789", b".,;:!?"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside any window of so many words that is found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice))
    found = Counter(tuple(words[i : i + window]) for i in at.tolist())  # equal hashes may hide different windows
    inside = np.zeros(len(words), bool)
    for i in at.tolist():
        if found[tuple(words[i : i + window])] > 1:
            inside[i : i + window] = True
    return int(inside.sum())


def statistics(text: str) -> tuple[int, ...]:
    """STATISTICS, then MORE."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at ASCII white space, as bytes do
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(set(words)), without(CAPITALS), without(DIGITS), without(MARKS),
        sum(len(w) < 4 for w in words),
    )


def statistics_column(text: Column) -> Column:
    names = STATISTICS + MORE

    @F.pandas_udf(", ".join(f"{n} bigint" for n in names))
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=names, dtype="int64")

    return found(text)


def features(stats: pd.DataFrame) -> np.ndarray:
    """FEATURES of each row; shares of nothing are 0."""
    n, lines, chars = (np.maximum(stats[c].to_numpy(float), 1) for c in ("n_words", "n_lines", "word_chars"))
    return np.column_stack([
        np.log1p(stats.n_words), stats.word_chars / n, stats.n_symbols / n, stats.n_dup_lines / lines, stats.n_repeat_words / n,
        stats.n_distinct / n, stats.n_upper / chars, stats.n_digits / chars, stats.n_marks / n, stats.n_short / n, np.log1p(n / lines),
    ])


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes in arrays; a leaf has no feature (-1) and holds its whole path length."""

    feature: list[int] = field(default_factory=list)
    split: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    length: list[float] = field(default_factory=list)

    def grow(self, x: np.ndarray, depth: int, most: int, random: np.random.Generator) -> int:
        node = len(self.feature)
        for values, empty in ((self.feature, -1), (self.split, 0.0), (self.left, -1), (self.right, -1), (self.length, 0.0)):
            values.append(empty)
        varying = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 and depth < most else []
        if not len(varying):
            self.length[node] = depth + float(expected_path(len(x)))
            return node
        f = int(random.choice(varying))
        at = float(random.uniform(x[:, f].min(), x[:, f].max()))
        below = x[:, f] <= at
        if below.all():  # the largest value was drawn
            below = x[:, f] < x[:, f].max()
            at = float(x[below, f].max())
        self.feature[node], self.split[node] = f, at
        self.left[node] = self.grow(x[below], depth + 1, most, random)
        self.right[node] = self.grow(x[~below], depth + 1, most, random)
        return node

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        f, split, left, right, length = map(np.array, (self.feature, self.split, self.left, self.right, self.length))
        at = np.zeros(len(x), np.int64)
        while (inner := f[at] >= 0).any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = np.where(x[rows, f[here]] <= split[here], left[here], right[here])
        return length[at]


@dataclass
class Forest:
    trees: list[Tree]
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths, the higher."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        mean = np.mean([t.path_lengths(x) for t in self.trees], axis=0)
        return 2.0 ** (-mean / max(float(expected_path(self.rows)), 1.0))


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    random = np.random.default_rng(seed)
    rows = min(rows, len(x))
    grown = []
    for _ in range(trees if rows else 0):
        tree = Tree()
        tree.grow(x[random.choice(len(x), rows, replace=False)], 0, int(np.ceil(np.log2(max(rows, 2)))), random)
        grown.append(tree)
    return Forest(grown, rows)


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The score that parts labelled bad from good rows best (share caught minus share lost), good rows first on a tie."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id"))
    known = known.agg((F.avg(F.col("quality").cast("double")) < 0.5).alias("bad"))
    bins = F.floor(F.col("score") * BINS).cast("int").alias("bin")
    counted = scored.join(known, "id").groupBy(bins, "bad").agg(F.count("*").alias("n")).collect()  # two rows a bin at most
    bad, good = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in counted:
        (bad if r.bad else good)[r.bin] += r.n
    if not bad.sum() or not good.sum():
        return DEFAULT_THRESHOLD
    caught, lost = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (bad, good))
    gain = caught - lost
    return float(np.flatnonzero(gain == gain.max())[-1]) / BINS


def sample(rows: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """Of the different rows those with the smallest hashes, in their order.

    A share by hash goes first, about twice the sample, and equal rows fold on the map side, so
    that the one task that puts them in order is sent about that many, however many rows there are.
    """
    place = F.xxhash64(*rows.columns)
    different = rows.agg(F.approx_count_distinct(place)).first()[0]
    share = min(1.0, (2 * most + 64) / max(1, different))
    near = rows.where(place.cast("double") / 2.0**64 + 0.5 <= share).distinct()
    return near.orderBy(place, *rows.columns).limit(most)


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", *keys: Column) -> DataFrame:
    """Per row of ``docs``: id, the keys, the statistics, base_failed, score, kept."""
    names = STATISTICS + MORE
    rows = docs.select(F.col(id_column).alias("id"), *keys, statistics_column(text_or_empty()).alias("s"))
    rows = cut(rows.select(*[c for c in rows.columns if c != "s"], *[F.col(f"s.{n}") for n in names]), "statistics")
    forest = grow(features(sample(rows.select("id", *names)).select(*names).toPandas()))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scores(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.scores(features(stats)))

    scored = cut(rows.withColumn("score", scores(F.struct(*names))), "scores")
    limit = threshold(scored, labels)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") < limit))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the forest, unchanged."""
    verdicts = judged(docs, labels, "doc_id", *row_key()).where("kept").select("k_id", "k_hash", "k_len")
    keyed = packed(docs, *row_key()).alias("l")
    return unpacked(keyed.join(cut(verdicts, "kept").alias("r"), same_key(), "left_semi"), docs.columns)
