"""Mixing sources to target weights along a low-discrepancy schedule.

Slot i of the schedule maps the golden ratio point frac(i * 0.618...) through the sources'
cumulative shares to a source. A share follows the target, plus LEAST_SLOTS slots, so that
small sources are spread too. Documents of a source are put in a hashed order and laid end
to end; passes over that stream, up to the target, are cut into as many equal blocks as
the source has slots, and the slot's rank among them is the block that it takes. Points of
this sequence spread evenly, so every stretch of the schedule holds each source in
proportion, and the blocks of a source add up to its target, rounded to words.

Ranks and running sums are taken in two steps (inside small ranges of slots or of the hash,
then over the ranges), so no task gets a whole source.

Cases: a null text has size 0; nulls are a source of their own, last; a document of size 0
is taken 0 times; repeated rows are laid side by side and share their words evenly; if all
sizes are 0 all targets are 0; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .rows import WORD, packed, text_or_empty, unpacked

WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Slots of the schedule for each source, on average, by target; and those that any source with a target has besides.
SLOTS_PER_SOURCE, LEAST_SLOTS = 4096, 64
#: Ranges of the hashed order in a source, of the unit interval, and slots ranked at a time.
RANGES_BITS, CELLS, SLOT_RANGE = 12, 4096, 1024
GOLDEN = 0.6180339887498949
#: Sources that may be broadcast; a row is a name and a few numbers.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def targets(
    by_source: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES, slots_per_source: int = SLOTS_PER_SOURCE
) -> DataFrame:
    """Adds s (rank of the source by code point, null last), weight, target, goal (in whole words), points, lo and hi to (source, source_size).

    Points are the slots that a source should have; lo and hi are its part of the unit interval by points.

    The level at which uncapped sources stand is the largest of the levels that follow when
    the sources are capped one after another, smallest capacity for its weight first.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * float(passes)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = by_source.withColumn("s", F.row_number().over(named))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", cap)
    zero = F.lit(0.0)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(filled), zero)
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), zero)
    levelled = ranked.withColumn("level", left / open_weight)
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight"))
    goal = F.least(F.round("target").cast("bigint"), F.col("source_size") * passes)
    aimed = levelled.withColumn("target", target).withColumn("goal", goal)
    per_slot = F.greatest(F.sum("target").over(everything) / (F.count("*").over(everything) * slots_per_source), F.lit(1.0))
    points = F.when(F.col("goal") > 0, F.col("target") / per_slot + LEAST_SLOTS).otherwise(zero)
    aimed = aimed.withColumn("points", points)
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    summed = aimed.withColumn("upto", F.sum("points").over(upto))
    whole = F.max("upto").over(everything)
    before = F.coalesce(F.lag("upto").over(Window.orderBy("s")), zero)
    share_of = lambda x: F.when(whole > 0, x / whole).otherwise(zero)
    summed = summed.withColumn("lo", share_of(before)).withColumn("hi", share_of(F.col("upto")))
    return summed.select("source", "source_size", "s", "weight", "target", "goal", "points", "lo", "hi")


def schedule(aimed: DataFrame, slots: int) -> DataFrame:
    """(slot, s, block): which block of which source each slot takes."""
    spark = aimed.sparkSession
    point = F.pmod(F.col("id") * F.lit(GOLDEN) + 0.5, F.lit(1.0))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    reach = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("bigint")))
    spans = aimed.where("hi > lo").select("s", "lo", "hi", F.explode(reach).alias("cell"))
    placed = points.join(spans, "cell").where("u >= lo and u < hi")
    placed = cut(placed.select("slot", "s", F.floor(F.col("slot") / SLOT_RANGE).alias("stretch")), "slots")
    earlier = Window.partitionBy("s").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("s", "stretch").agg(F.count("*").alias("n"))
    counts = counts.select("s", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint")).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("s", "stretch").orderBy("slot"))
    ranked = placed.withColumn("inside", inside).join(counts, ["s", "stretch"])
    return ranked.select("slot", "s", (F.col("earlier") + F.col("inside") - 1).alias("block"))


def laid_out(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the words before it in its source's stream, to (s, id, hash, size, copies)."""
    order = F.xxhash64("id", "hash")
    ranged = rows.withColumn("order", order).withColumn("range", F.shiftrightunsigned("order", 64 - RANGES_BITS))
    words = F.col("size") * F.col("copies")
    inside = Window.partitionBy("s", "range").orderBy("order", "id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    sums = ranged.groupBy("s", "range").agg(F.sum(words).alias("words"))
    sums = sums.select("s", "range", F.coalesce(F.sum("words").over(earlier), none).alias("earlier"))
    placed = ranged.withColumn("inside", F.coalesce(F.sum(words).over(inside), none)).join(sums, ["s", "range"])
    return placed.withColumn("start", F.col("earlier") + F.col("inside")).drop("earlier", "inside", "range", "order")


def pieces(laid: DataFrame, passes: int = PASSES) -> DataFrame:
    """(s, block, pass, id, hash, words): how many words of an entry lie in each block of each pass.

    Of ``goal`` words in ``slots`` blocks, block b has those from floor(b * goal / slots) on. Products are decimals, as they may be large.
    """
    words = F.col("size") * F.col("copies")
    each = laid.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).where(words > 0)
    each = each.withColumn("at", F.col("pass") * F.col("source_size") + F.col("start")).where("at < goal")
    each = each.withColumn("upto", F.least(F.col("at") + words, F.col("goal")))
    wide = lambda x: f"cast({x} as decimal(19,0))"
    block_of = lambda word: F.expr(f"({wide(f'{word} + 1')} * {wide('slots')} - 1) div {wide('goal')}")
    start_of = lambda block: F.expr(f"({wide(block)} * {wide('goal')}) div {wide('slots')}")
    cutup = each.withColumn("block", F.explode(F.sequence(block_of("at"), block_of("(upto - 1)"))))
    inside = F.least(F.col("upto"), start_of("(block + 1)")) - F.greatest(F.col("at"), start_of("block"))
    cutup = cutup.select("s", "block", "pass", "id", "hash", "size", "copies", inside.cast("bigint").alias("words"))
    return cutup.where("words > 0")  # where a source has more slots than words some blocks are empty


class Mix:
    """A planned mix of the documents: targets by source, the schedule, and the words taken of each row."""

    def __init__(
        self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
        slots_per_source: int = SLOTS_PER_SOURCE, id_column: str = "doc_id",
    ):
        text = text_or_empty()
        rows = docs.select(F.col("source"), F.col(id_column).alias("id"), F.xxhash64(F.col("text")).alias("hash"), size_of(text).alias("size"))
        self.rows = cut(rows.groupBy("source", "id", "hash", "size").agg(F.count("*").alias("copies")), "sizes")
        by_source = self.rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
        self.targets = cut(targets(by_source, weights, share, passes, slots_per_source), "targets")
        sources, points = self.targets.agg(F.count("*"), F.coalesce(F.sum("points"), F.lit(0.0))).first()
        self.schedule = cut(schedule(self.targets, math.ceil(points)), "schedule")
        self.passes = passes
        slots = self.schedule.groupBy("s").agg(F.count("*").alias("slots"))
        slotted = cut(self.targets.join(slots, "s", "left").select("source", "s", "source_size", "target", "goal", "slots"), "slotted")
        #: Words of the largest block of any source.
        self.block_words = slotted.agg(F.coalesce(F.max(F.ceil(F.col("goal") / F.col("slots"))), F.lit(1))).first()[0]
        self.sources = F.broadcast(slotted) if sources <= BROADCAST_SOURCES else slotted

    def pieces(self) -> DataFrame:
        """(slot, s, block, pass, id, hash, words): the mix in training order, by slot."""
        return self._pieces().join(self.schedule, ["s", "block"])

    def _pieces(self) -> DataFrame:
        named = self.rows.join(self.sources, self.rows.source.eqNullSafe(self.sources.source)).drop(self.sources.source)
        return pieces(laid_out(named), self.passes)

    def taken(self) -> DataFrame:
        """(source, id, hash, size, copies, source_size, target, words): words the mix takes of all rows alike."""
        summed = self.pieces().groupBy("s", "id", "hash").agg(F.sum("words").alias("words"))
        named = self.rows.alias("d").join(self.sources.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        same = (F.col("n.s") == F.col("w.s")) & F.col("n.id").eqNullSafe(F.col("w.id")) & (F.col("n.hash").eqNullSafe(F.col("w.hash")))
        full = named.select("d.*", "t.s", "t.source_size", "t.target").alias("n").join(summed.alias("w"), same, "left")
        return full.select("n.*", F.coalesce("w.words", F.lit(0).cast("bigint")).alias("words")).drop("s")


def _share(words: Column, copies: Column, number: Column) -> Column:
    """Words of one of several rows alike; number counts from 1."""
    return F.floor(words / copies) + F.when(number <= words % copies, 1).otherwise(0)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken."""
    found = Mix(docs, **settings).taken().withColumn("number", F.explode(F.expr("sequence(1, copies)")))
    taken = _share(F.col("words"), F.col("copies"), F.col("number")).cast("bigint")
    return found.select("id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows that the mix takes words of, with ``taken`` (in place of a column of that name)."""
    found = cut(Mix(docs, **settings).taken().where("words > 0").select("source", "id", "hash", "copies", "words"), "taken")
    keyed = packed(docs, F.col("source").alias("source"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text")).alias("hash"))
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & F.col("l.hash").eqNullSafe(F.col("r.hash")) & F.col("l.source").eqNullSafe(F.col("r.source"))
    joined = keyed.alias("l").join(found.alias("r"), same).select("l.*", "r.copies", "r.words")
    alike = Window.partitionBy("id", "hash", "source").orderBy(F.lit(0))
    once = joined.where("copies = 1").withColumn("number", F.lit(1))
    numbered = once.unionByName(joined.where("copies > 1").withColumn("number", F.row_number().over(alike)))
    taken = _share(F.col("words"), F.col("copies"), F.col("number")).cast("bigint")
    columns = [c for c in docs.columns if c != "taken"]
    return unpacked(numbered.withColumn("row_taken", taken), [*columns, "taken"], taken=F.col("row_taken")).where("taken > 0")
