"""Benchmark passages in documents, found by a hash set of normalised word n-grams.

Benchmark items are cut into windows of ten words (an item of fewer words is one window).
Every document window is looked up in that set; the join compares the whole window text,
so a hash collision is never a hit. The documents are read once and no text is shuffled to
find hits. The set of windows is broadcast only after its size was measured; a larger one
is joined by a shuffle.

Cases: a null text has no words; an item without words has no window; repeated items with
one id count once; null item ids are left out of the lists of items; repeated documents
rows get equal results, one each; an empty benchmark hits nothing; an empty table of
documents gives an empty table; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .rows import lower_ascii, packed, row_key, same_key, text_or_empty, unpacked

WINDOW = 10
#: What is no word in a lowered text: all ASCII but letters and digits.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text whose A-Z were not lowered.
RAW_WORD, NO_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a text that are handled as one row; bounds the windows held at a time.
SEGMENT = 1024
#: Windows of a benchmark that may be broadcast: at 80 bytes each and some overhead, about 200 MB.
BROADCAST_WINDOWS = 1_000_000


def normalised(text: Column) -> Column:
    """The words of a text, lower case in A-Z, with one space between them."""
    return F.trim(F.regexp_replace(lower_ascii(text), NO_WORD, " "))


def word_count(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(F.char_length(norm) - F.char_length(F.translate(norm, " ", "")) + 1).cast("bigint")


def windows_of(norm: Column, length: int) -> Column:
    """Every window of so many words of a normalised text, in order."""
    rest = f"(?:[^ ]++ ){{{length - 1}}}" if length > 1 else ""
    return F.regexp_extract_all(norm, F.lit(f"(?<![^ ])(?=({rest}[^ ]++))"), F.lit(1))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_column: str = "item_id") -> DataFrame:
    """(gram, size, items): each distinct window of the benchmark, its words, and the items that have it."""
    norm = benchmark.select(F.col(id_column).cast("string").alias("item"), normalised(text_or_empty()).alias("norm"))
    counted = norm.where("norm <> ''").withColumn("n", word_count(F.col("norm")))
    grams = F.when(F.col("n") < window, F.array("norm")).otherwise(windows_of(F.col("norm"), window))
    size = F.least(F.col("n"), F.lit(window)).cast("int").alias("size")
    rows = counted.select("item", size, F.explode(grams).alias("gram"))
    return rows.groupBy("gram", "size").agg(F.collect_set("item").alias("items"))


def _segments(norm: Column, window: int) -> Column:
    """Runs of SEGMENT words, each followed by the words that its last windows reach into."""
    run = f"(?:[^ ]++ ?+){{1,{SEGMENT}}}+"
    reach = f"(?=((?:[^ ]++ ?+){{0,{window - 1}}}+))"
    runs = F.regexp_extract_all(norm, F.lit(run), F.lit(0))
    tails = F.regexp_extract_all(norm, F.lit(run + reach), F.lit(1))
    return F.zip_with(runs, tails, lambda a, b: F.rtrim(F.concat(a, b)))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: k_id, k_hash, k_len, n_words, starts (word, size of each hit window), items (that have them).

    Rows alike in id and text are one row here, with their number in ``copies``.
    """
    grams = cut(benchmark_windows(benchmark, window), "grams")
    sizes = [r.size for r in grams.select("size").distinct().collect()] or [window]  # at most ``window`` numbers
    if grams.count() <= BROADCAST_WINDOWS:
        grams = F.broadcast(grams)
    norm = docs.select(*row_key(id_column), normalised(text_or_empty()).alias("norm"))
    parts = norm.select(
        "k_id", "k_hash", "k_len", word_count(F.col("norm")).alias("n_words"),
        F.posexplode_outer(_segments(F.col("norm"), window)).alias("segment", "part"),
    )
    by_size = F.lit(None).cast("array<string>")
    for s in sizes:
        by_size = F.when(F.col("size") == s, windows_of(F.col("part"), s)).otherwise(by_size)
    keys = ["k_id", "k_hash", "k_len"]
    each = parts.withColumn("size", F.explode(F.lit(sizes))) if len(sizes) > 1 else parts.withColumn("size", F.lit(sizes[0]))
    # the outer explode keeps one row of a document without words; such rows carry the count and no hit
    looked = each.select(*keys, "n_words", "segment", "size", F.posexplode_outer(by_size).alias("at", "gram"))
    first = (F.coalesce("segment", F.lit(0)) == 0) & (F.coalesce("at", F.lit(0)) == 0) & (F.col("size") == sizes[0])
    found = looked.withColumn("head", first).join(grams, ["gram", "size"], "left")
    found = found.where((F.col("head") | F.col("items").isNotNull()) & (F.coalesce("at", F.lit(0)) < SEGMENT))
    start = F.when(F.col("items").isNotNull(), F.struct((F.col("segment").cast("bigint") * SEGMENT + F.col("at")).alias("word"), "size"))
    return found.groupBy(*keys).agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("head").cast("int")).alias("copies"),
        F.sort_array(F.collect_set(start)).alias("starts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: k_id, n_words, n_hit (words in hit windows), items, starts."""
    found = hits(docs, benchmark, window, id_column)
    covered = F.transform("starts", lambda s: F.sequence(s["word"], s["word"] + s["size"] - 1))
    n_hit = F.size(F.array_distinct(F.flatten(covered))).cast("bigint")
    each = found.withColumn("n_hit", n_hit).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.drop("copy", "copies")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit window, unchanged."""
    bad = cut(hits(docs, benchmark, window).where(F.size("starts") > 0).select("k_id", "k_hash", "k_len"), "contaminated")
    kept = packed(docs, *row_key()).alias("l").join(bad.alias("r"), same_key(), "left_anti")
    return unpacked(kept, docs.columns)


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with every word of a hit window taken out of the text, and the separators after it."""
    found = hits(docs, benchmark, window).where(F.size("starts") > 0)
    found = cut(found.select("k_id", "k_hash", "k_len", "starts"), "passages")
    joined = packed(docs, *row_key()).alias("l").join(found.alias("r"), same_key(), "left").select("row", "starts")
    text = F.col("row").getField("text")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["word"], s["word"] + s["size"] - 1))))
    # pieces: what stands before the first word, then each word with the separators after it
    pieces = F.regexp_extract_all(text, F.lit(f"^{NO_RAW_WORD}|{RAW_WORD}{NO_RAW_WORD[:-1]}*"), F.lit(0))
    lead = F.when(text.rlike(f"^{NO_RAW_WORD}"), 1).otherwise(0)
    marked = F.transform(
        pieces, lambda p, i: F.when(F.array_contains(covered, (i - lead).cast("bigint")), "").otherwise(p)
    )
    return unpacked(joined, docs.columns, text=F.when(F.col("starts").isNull(), text).otherwise(F.array_join(marked, "")))
