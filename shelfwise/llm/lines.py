"""Removal of boilerplate lines by their frequency within a site.

For every host, the number of its pages that have a line is divided by the number of its
pages; a line above the ratio is dropped from all of the host's pages. A host's dropped
lines number at most (lines of a page, on average) / ratio, so they are carried as one
list for each host; a small table of them is broadcast by Spark, a large one joined by a
shuffle whose hot hosts Spark may split.

A line of several words does not come back by chance, so it has a lower ratio of its own,
taken over the different texts that have it: exact copies of one page, which are not a
reason to empty them all, count once there.

Cases: lines are compared without white space at their ends; blank lines stay; a line
counts once for each page; a null host is a host; a null text stays null; a text of
dropped lines alone becomes empty, its row stays; repeated rows are pages of their own; an
empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .rows import WORD, packed, unpacked

#: A line is boilerplate above this share of its host's pages, if it is on so many of them at least.
RATIO, LEAST_PAGES = 0.2, 5
#: The same for lines of so many words, by different texts; on so many of them at least as well.
LONG_RATIO, LONG_WORDS = 0.01, 8
BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
    long_ratio: float | None = LONG_RATIO, long_words: int = LONG_WORDS,
) -> DataFrame:
    """(host, line, pages, host_pages) of every line to be dropped; without a long_ratio all lines have one ratio."""
    pages = docs.select(F.col(host).alias("host"), F.col("text").cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    bare = F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _bare))).alias("line")
    if long_ratio is None:
        counted = pages.select("host", bare).where("line <> ''").groupBy("host", "line").agg(F.count("*").alias("pages"))
    else:
        lines = pages.select("host", F.xxhash64("text").alias("hash"), bare).where("line <> ''")
        each = F.when(F.regexp_count("line", F.lit(WORD)) >= long_words, F.col("hash"))
        alike = lines.groupBy("host", "line", each.alias("hash")).agg(F.count("*").alias("n"))
        counted = alike.groupBy("host", "line").agg(F.sum("n").alias("pages"), F.count("hash").alias("texts"))  # 0 texts of a short line
    joined = counted.where(F.col("pages") >= least_pages).alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    above = F.col("pages") > ratio * F.col("host_pages")
    if long_ratio is not None:
        above = above | ((F.col("texts") >= least_pages) & (F.col("texts") > long_ratio * F.col("host_pages")))
    return joined.where(above).select("c.host", "line", "pages", "host_pages")


def without_boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
    long_ratio: float | None = LONG_RATIO, long_words: int = LONG_WORDS,
) -> DataFrame:
    """Rows of ``docs`` packed as ``row``, with new_text, n_lines and n_dropped."""
    found = boilerplate(docs, host, ratio, least_pages, long_ratio, long_words)
    by_host = cut(found.groupBy("host").agg(F.collect_list("line").alias("dropped")), "boilerplate")
    text = F.col("text").cast("string")
    keyed = packed(docs, F.col(host).alias("host"), text.alias("text")).alias("d")
    joined = keyed.join(by_host.alias("b"), F.col("d.host").eqNullSafe(F.col("b.host")), "left")
    lines = _lines(F.col("d.text"))
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col("b.dropped"), _bare(line)))
    kept = F.when(F.col("b.dropped").isNull(), lines).otherwise(kept)
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    return joined.select(
        "d.row", F.array_join(kept, "\n").alias("new_text"),
        F.when(F.col("d.text").isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
        F.when(F.col("d.text").isNull(), 0).otherwise(n_lines - F.size(kept)).cast("bigint").alias("n_dropped"),
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
    long_ratio: float | None = LONG_RATIO, long_words: int = LONG_WORDS,
) -> DataFrame:
    """The rows of ``docs`` with cleaned texts; n_chars, where there is one, follows."""
    cleaned = without_boilerplate(docs, host, ratio, least_pages, long_ratio, long_words)
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        length = F.char_length("new_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_dropped") > 0, length).otherwise(F.col("row").getField("n_chars"))
    return unpacked(cleaned, docs.columns, **new)
