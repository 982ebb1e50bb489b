"""Matches of a pattern with their places, by SQL functions alone.

Splitting a text at a pattern gives the gaps between the matches that extracting gives, so a
match starts after the lengths of all gaps and matches before it. Lengths are code points.
Everything stays inside the document's row: no text is shuffled or sent to Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are summed at a time; keeps the work near linear in their number.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b)


def running(lengths: Column) -> Column:
    """For each number the sum of those before it, in blocks of BLOCK."""
    empty = F.array().cast("array<bigint>")

    def by_block(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

        def from_blocks(cut: Column) -> Column:
            return let(F.transform(cut, _sum), lambda sums: F.flatten(F.transform(cut, lambda block, b: _inside(block, _sum(F.slice(sums, F.lit(1), b))))))

        return let(blocks, from_blocks)

    def _inside(block: Column, before: Column) -> Column:
        return let(before, lambda base: F.transform(block, lambda _, i: base + _sum(F.slice(block, F.lit(1), i))))

    return F.when(F.size(lengths) > 0, let(lengths, by_block)).otherwise(empty)


SPAN = "array<struct<start:bigint,order:int,end:bigint,kind:string,value:string,left:string,right:string>>"


def matches(text: Column, pattern: str, kind: str, order: int, near: int = 40, needs: str | None = None) -> Column:
    """Leftmost non-overlapping matches: start, end (exclusive), kind, its order, value, and the text next to it.

    ``needs`` is a cheaper pattern that every text with a match has; others are not searched.
    """

    def placed(found: Column) -> Column:
        m, g = found["m"], found["g"]
        lengths = F.transform(m, lambda x, i: (F.char_length(x) + F.char_length(F.get(g, i))).cast("bigint"))

        def spans(before: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = F.get(before, i) + F.char_length(F.get(g, i))
                return F.struct(
                    start.cast("bigint").alias("start"), F.lit(order).alias("order"), (start + F.char_length(x)).cast("bigint").alias("end"), F.lit(kind).alias("kind"),
                    x.alias("value"), F.right(F.get(g, i), F.lit(near)).alias("left"), F.left(F.get(g, i + 1), F.lit(near)).alias("right"),
                )

            return F.transform(m, span)

        return let(running(lengths), spans)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    if needs is None:
        return let(found, placed)
    return F.when(text.rlike(needs), let(found, placed)).otherwise(F.array().cast(SPAN))


def masked(text: Column, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    """The text with each wanted match turned into as many NUL characters; places stay as they are."""

    def hidden(found: Column) -> Column:
        g = found["g"]
        blank = lambda x: F.when(wanted(x), F.repeat(F.lit("\0"), F.char_length(x))).otherwise(x)
        return F.concat(F.array_join(F.transform(found["m"], lambda x, i: F.concat(F.get(g, i), blank(x))), ""), F.element_at(g, -1))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), hidden)


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def in_order(spans: Column) -> Column:
    """By start, then by the order of kinds, then by end."""
    return F.sort_array(spans)


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark of its first kind."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.array().cast("array<string>").alias("parts"), zero.alias("at"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        fresh = F.struct(F.concat(done["parts"], F.array(gap, mark(s))).alias("parts"), s["end"].alias("at"))
        joined = F.struct(done["parts"].alias("parts"), F.greatest(done["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= done["at"], fresh).otherwise(joined)

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text)))

    return F.aggregate(spans, start, step, finish)
