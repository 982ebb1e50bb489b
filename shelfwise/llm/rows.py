"""Small helpers shared by the operators on documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def row_key(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """What tells two rows apart for a decision on (id, text): rows alike in both share every decision."""
    text = F.col(text_column).cast("string")
    return [F.col(id_column).alias("k_id"), F.xxhash64(text).alias("k_hash"), F.char_length(text).alias("k_len")]


def same_key(left: str = "l", right: str = "r") -> Column:
    """Null-safe equality on ``row_key`` of two aliased frames."""
    conditions = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("k_id", "k_hash", "k_len")]
    return conditions[0] & conditions[1] & conditions[2]


def packed(docs: DataFrame, *extra: Column) -> DataFrame:
    """The whole row as one column ``row``, so that helper columns cannot clash with the caller's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *extra)


def unpacked(frame: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The caller's columns again, in order; ``changed`` gives new values for some of them."""
    return frame.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])
