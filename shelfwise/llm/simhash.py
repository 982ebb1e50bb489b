"""Near copies by SimHash fingerprints within a Hamming distance.

Fingerprints that differ in at most three of 64 bits agree on at least two of five blocks.
Each distinct fingerprint is therefore filed under the ten pairs of blocks; fingerprints
under one key are compared, and only those within the distance are linked. A key with many
fingerprints is split into chunks, and each pair of chunks is a task of its own that
returns a spanning forest of its links, never all pairs. Exact copies share a fingerprint
and are folded before that.

Cases: a null text has no words; no words give fingerprint zero, which is linked like any
other; repeated rows get the same fingerprint and component; a component whose ids are all
null has a null component id; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .components import roots
from .rows import packed, row_key, same_key, text_or_empty, unpacked

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints of a key that one task compares with each other or with another chunk.
CHUNK = 1024
#: Shingles whose bits are counted at a time, so that a long text needs little memory.
STEP = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint; a bit is set if it is set in over half of the shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both work on ASCII alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n]
    ends = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        spans = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("bigint")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return fingerprints(text)


def _filed(prints: DataFrame, distance: int) -> DataFrame:
    """(key, fp) for every way to choose the blocks that a close pair must share."""
    blocks = distance + 2
    width, wider = divmod(64, blocks)
    sizes = [width + (i < wider) for i in range(blocks)]
    offsets = [sum(sizes[:i]) for i in range(blocks)]
    fp = F.col("fp")
    parts = [F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << s) - 1).cast("bigint")) for o, s in zip(offsets, sizes)]
    keys = []
    for table, (i, j) in enumerate(combinations(range(blocks), 2)):
        pair = F.shiftleft(parts[i], sizes[j]).bitwiseOR(parts[j])
        keys.append(pair.bitwiseOR(F.lit(table << (2 * max(sizes))).cast("bigint")))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that span the groups of close fingerprints; each found node looks once at those not yet found."""
    left = np.sort(fps)
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count(left.view(np.uint64) ^ todo.pop().view(np.uint64)) <= distance
            found, left = left[near], left[~near]
            for x in found:
                todo.append(x)
                yield int(x), int(root)


def _links_in_cells(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; the last cell of a batch may go on in the next."""
        names = ["key", "a", "b"]
        rest: list[np.ndarray] = [np.empty(0, np.int64)] * 4
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def done(columns: list[np.ndarray]) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            if len(columns[0]):
                cells = np.stack(columns[:3])
                new = np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1
                bounds = np.concatenate([[0], new, [len(columns[0])]])
                for i in np.flatnonzero(np.diff(bounds) > 1):
                    out.extend(_forest(columns[3][bounds[i] : bounds[i + 1]], distance))
            u, v = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in [*names, "fp"]]
            columns = [np.concatenate(x) for x in zip(rest, columns)]
            if not len(columns[0]):
                continue
            last = np.flatnonzero(np.logical_or.reduce([c[:-1] != c[-1] for c in columns[:3]]))
            split = last[-1] + 1 if len(last) else 0
            rest = [c[split:] for c in columns]
            if split:
                yield done([c[:split] for c in columns])
        yield done(rest)

    return link


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) that span every group of distinct fingerprints ``fp`` within the distance of each other."""
    filed = cut(_filed(prints, distance), "filed")
    crowded = cut(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    placed = (
        filed.join(crowded, "key")
        .select("key", "fp", chunks.alias("chunks"))
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .select("key", "fp", "c", F.explode(F.expr("sequence(0, chunks - 1)")).alias("o"))
        .select("key", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "fp")
    )
    cells = placed.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return cells.mapInArrow(_links_in_cells(distance), "u bigint, v bigint")


def grouped(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Adds ``component``, the smallest id in reach, to written rows (id, fp, ...)."""
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "prints")
    rooted = prints.join(roots(links(prints.select("fp"), distance)).withColumnRenamed("node", "fp"), "fp", "left")
    rooted = cut(rooted.withColumn("root", F.coalesce("root", "fp")), "rooted")
    names = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component")), "names")
    named = cut(rooted.join(names, "root").select("fp", "component", "root"), "named")
    return rows.join(named, "fp")


def components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id, fp (signed 64 bits), component (smallest id in reach), root (its smallest fp)."""
    text = text_or_empty()
    rows = docs.select(F.col(id_column).alias("id"), fingerprint_column(text, shingle).alias("fp"))
    return grouped(cut(rows, "fingerprints"), distance)


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: the one with the smallest id (nulls last), then by text; the row itself is unchanged."""
    rows = docs.select(F.col("doc_id").alias("id"), fingerprint_column(text_or_empty(), shingle).alias("fp"), *row_key())
    found = grouped(cut(rows, "fingerprints"), distance)
    order = F.struct(F.col("k_id").isNull(), "k_id", "k_hash", "k_len")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("first.k_id", "first.k_hash", "first.k_len")
    first = cut(first, "first")
    keyed = packed(docs, *row_key())
    kept = keyed.alias("l").join(first.alias("r"), same_key(), "left_semi")
    return unpacked(kept.dropDuplicates(["k_id", "k_hash", "k_len"]), docs.columns)
