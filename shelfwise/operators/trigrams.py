"""A stored index from three-character pieces of texts to what holds them.

A posting (gram, kind, ref) says that a text of this kind, of the thing ``ref``, has the gram.
Postings lie in folders by hash of the gram, so a term reads the folders of its own grams
and no others; what has all of them is a candidate, which the caller verifies against the
text. Things that come later are added as a further load; a load stored twice overwrites
itself. A term whose fixed parts are all shorter than a gram has no candidates to offer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BUCKETS = 3, 64
#: Tasks that the texts of one ref are spread over, at most.
PARTS = 4
POSTINGS = "gram string, kind string, ref string, load int, bucket int"


def _gatherer():
    """The different grams of runs of rows (kind, ref, texts) alike in kind and ref, as a closure that needs nothing of this package.

    Three code points of 21 bits make a number, so that numpy tells the different ones.
    """

    def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts in a row, and where each text ends."""
        each = [t.decode("utf-8", "replace") if t else "" for t in texts.cast(pa.binary()).to_pylist()]
        return np.frombuffer("".join(each).encode("utf-32-le"), "<u4").astype(np.int64), np.cumsum([len(t) for t in each], dtype=np.int64)

    def spelled(held: np.ndarray) -> pa.Array:
        points = np.stack([held >> 42, (held >> 21) & 0x1FFFFF, held & 0x1FFFFF], axis=1).astype("<u4")
        if points.max(initial=0) < 128:  # a byte each
            ends = np.arange(0, points.size + 1, 3, dtype=np.int32)
            return pa.StringArray.from_buffers(len(held), pa.py_buffer(ends), pa.py_buffer(points.astype(np.uint8).tobytes()))
        text = points.tobytes().decode("utf-32-le")
        return pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done, rows = None, [], [], 0

        def close() -> None:
            nonlocal rows
            done.append((at, np.unique(np.concatenate(held))))
            rows += len(done[-1][1])

        def emitted() -> pa.RecordBatch:
            of_row = np.repeat(np.arange(len(done)), [len(found) for _, found in done])
            kinds, refs = [pa.array([key[i] for key, _ in done], pa.string()).take(pa.array(of_row)) for i in (0, 1)]
            return pa.record_batch({"kind": kinds, "ref": refs, "gram": spelled(np.concatenate([found for _, found in done]))})

        for batch in batches:
            texts = batch.column("texts")
            points, ends = code_points(texts.flatten())
            of_row = np.concatenate([[0], np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))])
            limits = np.concatenate([[0], ends])[of_row]
            codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
            whole = np.ones(len(codes), bool)
            for over in (ends - 1, ends - 2):  # a window that starts there goes on in the next text
                whole[over[(over >= 0) & (over < len(codes))]] = False
            keys = list(zip(batch.column("kind").to_pylist(), batch.column("ref").to_pylist()))
            first = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[first]:
                    continue
                if keys[first] != at:
                    if at is not None:
                        close()
                    at, held = keys[first], []
                part = slice(limits[first], limits[i])
                held.append(np.unique(codes[part][whole[part]]))
                if len(held) == 64:
                    held = [np.unique(np.concatenate(held))]
                first = i
            if rows > 100_000:
                yield emitted()
                done, rows = [], 0
        if at is not None:
            close()
            yield emitted()

    return gather


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def term_grams(term: str, wildcards: bool = True) -> list[str]:
    """Grams that every match has: those of the parts between the wildcards % and _."""
    if wildcards and "\\" in term:  # an escape sign
        return []
    parts = re.split("[%_]", term) if wildcards else [term]
    return sorted({p[i : i + GRAM] for p in map(str.lower, parts) for i in range(len(p) - GRAM + 1)})


@dataclass(frozen=True)
class GramIndex:
    """Postings under a folder."""

    spark: SparkSession
    root: str

    def add(self, load: int, texts: DataFrame, kinds: dict[str, list[str]]) -> None:
        """Index rows of texts; ``kinds`` names, for each kind, its ref column and then its text columns.

        A ref's texts meet in up to ``PARTS`` tasks, so what is put together across tasks are a
        ref's different grams, not those of every text.
        """
        entries = [F.struct(F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref"), F.array(*[F.lower(c) for c in columns]).alias("texts")) for kind, (ref, *columns) in kinds.items()]
        rows = texts.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("ref IS NOT NULL")
        runs = rows.repartition("kind", "ref", F.pmod(F.xxhash64("texts"), F.lit(PARTS))).sortWithinPartitions("kind", "ref")
        found = runs.mapInArrow(_gatherer(), "kind string, ref string, gram string").distinct().select("gram", "kind", "ref", _bucket(F.col("gram")).alias("bucket"))
        found.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/load={load}")

    def candidates(self, term: str, wildcards: bool = True) -> DataFrame | None:
        """(kind, ref) of what has a text of all the term's grams; None where the term has no gram to look for."""
        grams = term_grams(term, wildcards)
        if not grams:
            return None
        wanted = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram")).alias("bucket")).distinct()
        buckets = [r.bucket for r in wanted.collect()]  # as many as the term has grams
        held = self.spark.read.schema(POSTINGS).parquet(self.root).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        return held.groupBy("kind", "ref").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("kind", "ref")
