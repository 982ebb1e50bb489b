"""Selection of documents that resemble a target, by importance resampling.

Two generative models over hashed word n-grams (one word and two) are counted: one on all
documents, one on the labelled good ones. A document's log weight is the sum of the log
ratios of its n-grams under the two. Adding Gumbel noise to the log weights and taking the
k largest samples k documents without replacement in proportion to their weights. The k-th
largest is found by counting the keys in ranges, and again inside the range that holds it.

Cases: a null or empty text has log weight 0; the noise of a row hangs on its id and text
alone, so reruns agree and repeated rows share their fate; all rows that tie with the k-th
are taken; conflicting labels of an id are averaged, a tie is good; without labelled good
rows all log weights are 0; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .rows import packed, row_key, same_key, text_or_empty, unpacked

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Labels that may be broadcast, at some 50 bytes each; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Ranges counted at a time.
RANGES = 4096


def buckets(text: str) -> np.ndarray:
    """Hashed words and pairs of neighbouring words, lower case in A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    one = np.fromiter(map(crc32, words), np.uint32, len(words))
    two = (one[:-1] * np.uint32(0x9E3779B1) + one[1:]) * np.uint32(0x85EBCA6B) if len(words) > 1 else one[:0]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.concatenate([(one * np.uint32(0xC2B2AE35)) >> shift, two >> shift]).astype(np.int64)


def good_ids(labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id"))
    return known.agg(F.avg(F.col("quality").cast("double")).alias("q")).select("id", (F.col("q") >= 0.5).alias("good"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """For each bucket, log of its share in the good documents over its share in all of them."""
    known = cut(good_ids(labels), "known")
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    texts = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text"))
    texts = texts.join(known, "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, good in zip(batch.text, batch.good):
                found = np.bincount(buckets(text), minlength=BUCKETS)
                seen[0] += found
                if good:
                    seen[1] += found
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "n_all": seen[0], "n_good": seen[1]})

    counted = texts.mapInPandas(count, "bucket bigint, n_all bigint, n_good bigint")
    summed = counted.groupBy("bucket").agg(F.sum("n_all").alias("a"), F.sum("n_good").alias("g")).toPandas()
    a, g = np.zeros(BUCKETS), np.zeros(BUCKETS)
    a[summed.bucket], g[summed.bucket] = summed.a, summed.g
    if not g.sum():
        return np.zeros(BUCKETS)
    return np.log((g + SMOOTHING) / (g.sum() + SMOOTHING * BUCKETS)) - np.log((a + SMOOTHING) / (a.sum() + SMOOTHING * BUCKETS))


def log_weight(docs: DataFrame, ratios: np.ndarray) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("double")
    def weights(texts: pd.Series) -> pd.Series:
        return pd.Series([float(shared.value[buckets(t)].sum()) for t in texts], dtype="float64")

    return weights(text_or_empty())


def gumbel(*parts: Column) -> Column:
    """Gumbel noise that hangs on the given columns alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), *parts), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(frame: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a double column; None where there are fewer. Each round looks into one of many equal ranges."""
    if k <= 0:
        return None
    low, high, need = None, None, k
    for _ in range(64):
        part = frame if low is None else frame.where((F.col(key) >= low) & (F.col(key) <= high))
        least, most, n = part.agg(F.min(key), F.max(key), F.count("*")).first()
        if n < need:
            return None
        if least == most or n == need:
            return least
        width = (most - least) / RANGES
        slot = F.least(F.floor((F.col(key) - least) / width), F.lit(RANGES - 1)).cast("int")
        rows = part.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for r in sorted(rows.collect(), key=lambda r: -r.slot):  # RANGES rows at most
            if r.n >= need:
                low, high = r.lo, r.hi
                break
            need -= r.n
    return low


def sampled(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """Per row of ``docs``: k_id, k_hash, k_len, log_weight, key (with its noise), kept.

    Without k, as many documents are taken as the labelled rows' share of good ones says.
    """
    keys = row_key()
    rows = docs.select(*keys, log_weight(docs, log_ratios(docs, labels)).alias("log_weight"))
    rows = cut(rows.withColumn("key", F.col("log_weight") + gumbel(F.col("k_id"), F.col("k_hash"))), "weights")
    if k is None:
        share = good_ids(labels).agg(F.avg(F.col("good").cast("double"))).first()[0]
        k = round((1.0 if share is None else share) * rows.count())
    least = kth_largest(rows, "key", k)
    kept = F.lit(k > 0) if least is None else F.col("key") >= least
    return rows.withColumn("kept", kept)


def sample_documents(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The sampled rows of ``docs``, unchanged."""
    chosen = cut(sampled(docs, labels, k).where("kept").select("k_id", "k_hash", "k_len"), "sampled")
    return unpacked(packed(docs, *row_key()).alias("l").join(chosen.alias("r"), same_key(), "left_semi"), docs.columns)
