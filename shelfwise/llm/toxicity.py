"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed character n-gram in the text. Its value is the log
ratio of the n-gram's smoothed document shares in toxic and other texts, and a logistic
regression with an L2 penalty weighs these values. Labels come from a bounded sample of the
labelled rows; scoring is one pass over whole texts without a shuffle.

Cases: a null text is scored as empty; texts of any length are scored in steps; a row
without a label takes no part in fitting; labels of a repeated id are averaged, a tie is
not toxic; without labelled rows every score is 0.5, with one class alone the scores follow
its share; repeated rows get equal scores; an empty table gives an empty table; other
columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .rows import packed, text_or_empty, unpacked

ORDERS = (4, 5, 6)
BITS = 19
#: Labelled texts that the classifier is fitted on, chosen by a hash of id and text; more are left out. Parts of the hash.
SAMPLE_ROWS, SHARES = 12_000, 1 << 20
#: n-grams with a weight: those whose document shares differ most, by the chi-square statistic.
FEATURES = 4096
#: Texts that an n-gram must occur in to get a weight.
LEAST_TEXTS = 3
SMOOTHING, PENALTY, STEPS = 1.0, 1e-4, 300
#: Characters hashed at a time, so that a long text needs little memory.
SPAN = 1 << 18


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-case text with single spaces, in spans."""
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(1, len(codes) - ORDERS[0] + 1), SPAN):
        part = codes[at : at + SPAN + ORDERS[-1] - 1]
        mixed = np.zeros(len(part), np.uint32)
        for k in range(ORDERS[-1]):  # a longer n-gram's hash goes on from the shorter one's
            count = max(0, min(SPAN, len(part) - k))
            mixed = (mixed[:count] ^ part[k : k + count]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            if k + 1 in ORDERS:
                yield ((mixed + np.uint32(k)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def present(text: str, wanted: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text among the wanted ones (a mask over all buckets)."""
    found = [b[wanted[b]] for b in buckets(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    """Weight of each bucket (0 for most) and the bias."""

    weights: np.ndarray
    bias: float
    #: Whether both labels were there to learn from.
    fitted: bool = False

    def score(self, text: str) -> float:
        total = self.bias + float(self.weights[present(text, self.weights != 0)].astype(np.float64).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, id_column: str = "doc_id") -> DataFrame:
    """(text, label) of at most so many different labelled texts that are among the documents, written out.

    Of the different (id, text) with a label, those with the smallest hashes are taken; a
    share by hash goes first, so that no task is sent more than about twice the sample.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg((F.avg(F.col(label).cast("double")) > 0.5).cast("int").alias("label"))
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty().alias("text"))
    keyed = texts.withColumn("hash", F.xxhash64("text"))
    there = cut(keyed.select("id", "hash").distinct().join(known, "id"), "labelled")
    share = min(SHARES, math.ceil(2 * SHARES * rows / max(1, there.count())))
    place = F.xxhash64("id", "hash")
    chosen = there.where(F.pmod(place, F.lit(SHARES)) < share).orderBy(place, "id", "hash").limit(rows)
    found = keyed.join(F.broadcast(chosen), ["id", "hash"]).groupBy("id", "hash").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    return cut(found.select("text", "label"), "labelled")


def _shares(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per class: in how many texts each bucket occurs, and last the number of texts."""
    size = 1 << BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, size + 1), np.int64)
        everything = np.ones(size, bool)
        for batch in batches:
            for text, y in zip(batch.text, batch.label):
                seen[y, present(text, everything)] += 1
                seen[y, size] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"bucket": at, "clean": seen[0, at], "toxic": seen[1, at]})

    counted = labelled.mapInPandas(count, "bucket bigint, clean bigint, toxic bigint")
    summed = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # the last bucket holds the numbers of texts; buckets too rare to be chosen stay on the executors
    found = summed.where((F.col("clean") + F.col("toxic") >= LEAST_TEXTS) | (F.col("bucket") == size)).toArrow()
    clean, toxic = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    at = found["bucket"].to_numpy()
    clean[at], toxic[at] = found["clean"].to_numpy(), found["toxic"].to_numpy()
    return clean, toxic


def _strongest(clean: np.ndarray, toxic: np.ndarray, features: int) -> np.ndarray:
    a, b, n0, n1 = clean[:-1].astype(float), toxic[:-1].astype(float), clean[-1], toxic[-1]
    n = n0 + n1
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (b * (n0 - a) - a * (n1 - b)) ** 2 / ((a + b) * (n - a - b) * n0 * n1)
    chi = np.where((a + b) >= LEAST_TEXTS, np.nan_to_num(chi, nan=0.0, posinf=0.0), 0.0)
    order = np.argsort(-chi, kind="stable")[:features]
    return np.sort(order[chi[order] > 0])


def _logistic(row: np.ndarray, feature: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights on scaled 0/1 features and the bias, by accelerated gradient steps from zero.

    The features that are present come as pairs (row, feature); most rows have few of them.
    """
    n, k = len(y), len(scale)
    ahead_of = lambda v: np.bincount(row, (scale * v)[feature], n)
    back = lambda e: scale * np.bincount(feature, e[row], k)
    w, earlier = np.zeros(k + 1), np.zeros(k + 1)
    # the curvature is at most a quarter of the largest mean square norm, found by power iteration
    v, norm = np.ones(k), 0.0
    for _ in range(12):
        v = back(ahead_of(v)) / n
        norm = float(np.linalg.norm(v))
        v = v / (norm or 1.0)
    rate = 1 / (0.25 * (norm + 1.0) + PENALTY)
    for step in range(STEPS):
        ahead = w + (step / (step + 3)) * (w - earlier)
        error = 1 / (1 + np.exp(-np.clip(ahead_of(ahead[:-1]) + ahead[-1], -30, 30))) - y
        gradient = np.append(back(error) / n + PENALTY * ahead[:-1], error.mean())
        earlier, w = w, ahead - rate * gradient
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, features: int = FEATURES) -> Model:
    """Fits on (text, label). What reaches the driver is one number for each bucket and ``features`` bits for each row."""
    clean, toxic = _shares(labelled)
    weights = np.zeros(1 << BITS, np.float32)
    n0, n1 = int(clean[-1]), int(toxic[-1])
    if not n0 or not n1:
        return Model(weights, float(np.log((n1 + SMOOTHING) / (n0 + SMOOTHING))) if n0 + n1 else 0.0)
    chosen = _strongest(clean, toxic, features)
    if not len(chosen):
        return Model(weights, float(np.log(n1 / n0)))
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True

    @F.pandas_udf("binary")
    def marks(texts: pd.Series) -> pd.Series:
        def of(text: str) -> bytes:
            bits = np.zeros(len(chosen), np.uint8)
            bits[np.searchsorted(chosen, present(text, wanted))] = 1
            return np.packbits(bits).tobytes()

        return texts.map(of)

    rows = sorted((r.marks, r.label) for r in labelled.select(marks("text").alias("marks"), "label").collect())
    y = np.array([label for _, label in rows], float)
    found = [np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8))) for m, _ in rows]
    row, feature = np.repeat(np.arange(len(rows)), [len(f) for f in found]), np.concatenate(found)
    p, q = toxic[chosen] + SMOOTHING, clean[chosen] + SMOOTHING
    ratio = np.log((p / (n1 + 2 * SMOOTHING)) / (q / (n0 + 2 * SMOOTHING)))
    w, bias = _logistic(row, feature, y, ratio)
    weights[chosen] = (w * ratio).astype(np.float32)
    return Model(weights, bias, fitted=True)


def score(docs: DataFrame, model: Model, text: Column | None = None) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score).astype("float64")

    return scores(text_or_empty() if text is None else text)


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of the documents' own labels, without the held-out ids."""
    return fit(sample(docs, labels.where(~held_out()), rows=rows))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged; all of them where no label tells toxic from clean."""
    model = trained(docs, labels)
    if not model.fitted:
        return docs
    scored = packed(docs, score(docs, model).alias("score"))
    return unpacked(scored.where(F.col("score") < threshold), docs.columns)
