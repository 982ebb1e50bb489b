"""Writers of ledger rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Ledger rows that one task writes for one day; a larger day is spread over several.
ROWS_PER_FILE = 2_000_000


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append ledger rows, one folder per day so that period filters skip the others.

    A day is written by as many tasks as its number of rows asks for, and there are as
    many tasks as all days ask for.
    """
    days = cut(rows.withColumn("txn_day", F.to_date("txn_date")), "append")  # read twice: sizes, rows
    sizes = days.groupBy(F.col("txn_day").alias("_day")).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).alias("_files"))
    placed = days.join(sizes, F.col("txn_day").eqNullSafe(F.col("_day")))
    placed = placed.withColumn("_slice", F.pmod(F.xxhash64("txn_number"), F.col("_files")))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, sizes.agg(F.sum("_files")).first()[0] or 0)
    spread = placed.repartition(tasks, "txn_day", "_slice").drop("_day", "_files", "_slice")
    spread.write.mode("append").partitionBy("txn_day").parquet(path)


def write_csv(rows: DataFrame, path: str, *, quote_all: bool = False) -> None:
    """CSV with a header; quotes inside texts are doubled, zeros stay, missing values are empty."""
    (
        rows.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def quoted(rows: DataFrame) -> DataFrame:
    """Report rows as CSV text cells: every value quoted, quotes doubled, missing values blank."""
    def cell(c: str):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    return rows.select(F.concat_ws(",", *[cell(c) for c in rows.columns]).alias("line"))


def document(**parts: DataFrame) -> DataFrame:
    """One row that nests several small reports as arrays, in row order.

    For category-sized reports; product-sized ones are written as rows.
    """
    doc = None
    for name, rows in parts.items():
        nested = rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name))
        doc = nested if doc is None else doc.withColumn(name, nested.scalar())
    return doc
