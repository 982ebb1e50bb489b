"""Starting a stream, letting it read what is there, and keeping what it wrote."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import cut, work_path

#: Bytes of files that a micro-batch takes, whatever waits; a larger file is one by itself.
BYTES_PER_TRIGGER = 4 << 30
#: Files of a table that form a micro-batch; None leaves it to the bytes.
FILES_PER_TRIGGER: int | None = None
#: Parts that a stored table's keys are spread over; a micro-batch reads and writes those of its own keys.
BUCKETS = 32


def keyed_state(spark: SparkSession) -> None:
    """States live on disk with the executors and in the checkpoint, not in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def to_table(stream: DataFrame, root: str, once: bool = True):
    """Append a stream's rows to files under ``root``; every row is there once, also after a restart."""
    writer = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/progress")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def rows_of(stream: DataFrame, root: str) -> DataFrame:
    """What a stream has written under ``root``."""
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def put(spark: SparkSession, root: str, name: str, batch_id: int, rows: DataFrame) -> None:
    """Rows of one micro-batch under its number; if it runs again it overwrites them."""
    rows.write.mode("overwrite").parquet(f"{root}/{name}/v={batch_id}")


def all_of(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of every micro-batch so far."""
    return spark.read.parquet(f"{root}/{name}").drop("v")


@dataclass(frozen=True)
class KeyedTable:
    """A table that micro-batches change row by row, in files by bucket of its ``id``.

    Every row says which micro-batch wrote it and what it was before. A micro-batch that
    runs again after a failure, whatever buckets it had already replaced, sees the table as
    it was when it first started, so it changes the same rows to the same values again.
    """

    spark: SparkSession
    path: str
    columns: StructType

    def _stored(self) -> StructType:
        return StructType([*self.columns.fields]).add("_since", "long").add("_was", self.columns).add("bucket", "integer")

    def open(self, rows: DataFrame) -> None:
        whole = rows.select(*self.columns.names, F.lit(-1).cast("bigint").alias("_since"), F.lit(None).cast(self.columns).alias("_was"), bucket_of("id"))
        whole.write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def before(self, batch_id: int, touched: DataFrame | None = None) -> DataFrame:
        """The rows as a micro-batch finds them; with ``touched``, at least those with its ids, from their buckets alone."""
        held = self.spark.read.schema(self._stored()).parquet(self.path)
        if touched is not None:
            buckets = [r.bucket for r in touched.select(bucket_of("id")).distinct().collect()]  # BUCKETS at most
            held = held.where(F.col("bucket").isin(buckets))
        now = F.struct(*self.columns.names)
        row = F.when(F.col("_since") < batch_id, now).otherwise(F.col("_was"))
        return held.select(row.alias("row")).where("row IS NOT NULL").select("row.*")

    def change(self, batch_id: int, changed: DataFrame) -> None:
        """Put rows in the place of those with their ids, or add them; the buckets they are in are written anew."""
        changed = cut(changed.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in self.columns]), "changed")
        held = self.spark.read.schema(self._stored()).parquet(self.path)
        old = self.before(batch_id, changed).select(F.col("id").alias("_id"), F.struct(*self.columns.names).alias("_was"))
        new = changed.join(old, changed["id"] == old["_id"], "left").select(*self.columns.names, F.lit(batch_id).cast("bigint").alias("_since"), "_was", bucket_of("id"))
        buckets = [r.bucket for r in changed.select(bucket_of("id")).distinct().collect()]  # BUCKETS at most
        kept = held.where(F.col("bucket").isin(buckets)).join(changed.select("id"), "id", "left_anti")
        rows = cut(kept.select(*new.columns).unionByName(new), "buckets")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def bucket_of(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(BUCKETS)).cast("int").alias("bucket")


def changed_rows(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that ``old`` does not have just so."""
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in new.columns if c != key]
    on = F.col(f"n.{key}") == F.col(f"o.{key}")
    for condition in same:
        on = on & condition
    return new.alias("n").join(old.alias("o"), on, "left_anti")


def latest_groups(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an aggregation over everything available; each group as its last update left it."""
    spark = stream.sparkSession
    root = work_path(spark, label)
    progress = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/progress")
    progress.foreachBatch(lambda rows, n: put(spark, root, "groups", n, rows)).trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.schema(StructType([*stream.schema.fields]).add("v", "integer")).parquet(f"{root}/groups")
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "v").alias("_row")).select("_row.*")


def each_batch(stream: DataFrame, root: str, apply: Callable[[DataFrame, int], None], once: bool = True):
    """Run ``apply(rows, batch id)`` per micro-batch; progress is kept under ``root``."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/progress")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def last_batch(query) -> int:
    """Number of the last micro-batch that a finished query ran, -1 if there was none."""
    done = [p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0]
    return max(done, default=-1)


def table_stream(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    """One test table, a single file or a folder of files, as a stream of files."""
    source = spark.readStream.schema(columns).option("maxBytesPerTrigger", BYTES_PER_TRIGGER)
    if FILES_PER_TRIGGER:
        source = spark.readStream.schema(columns).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
    return source.parquet(f"{sf_dir}/{name}.parque[t]")  # a plain path must be a folder, a pattern may be either
