"""Phrases of several words that stand together more often than their parts would.

Counts of all phrases come from truncated suffixes: the at most five words from a word on,
within a piece of text. Words come first and are counted; then pairs of frequent words; a
suffix goes on as long as its pairs are frequent, as no candidate holds a rare one, and those
of three words or more are grouped by prefixes that a memory budget allows: the first pair,
and while the pairs are heavy the next word as well, up to the first pair that is not, so
that no prefix has more occurrences than the cutoff. Whole prefixes are dealt to tasks. A
task sorts its suffixes, which puts the subtree below each prefix in one run, and a phrase's
count is the total of the leaves below it. Equal suffixes are added up before they are dealt,
so a passage that many texts share costs a task one row for each task before it.

What leaves the tasks for the driver is bounded: three bitmaps of fixed size that say which
words and which pairs may be frequent, and which pairs may be heavy. One let in by chance
costs time only; counts stay exact. The work is linear in the words of the texts.

Cases: a null or empty text has no words; a null lang counts as ``und``; repeated rows count
each; words may hold any character but the separators; a text of any length is one list of
words at a time; ties rank by count, then by phrase in byte order; an empty table gives an
empty table; other columns are not read. Scores are exact up to 10^38 in 1000 * a * n.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lineage import cut

#: Words of the longest phrase, and the least count of a candidate.
LONGEST, LEAST = 5, 100
#: A candidate goes when a longer one has at least this percentage of its count.
COVERED = 100
#: Words meant for a task, the most groups there are, and the parts of a budget above which a prefix is made longer.
BUDGET, GROUPS, PARTS = 1_000_000, 10_000, 64
#: Bits of a map of frequent words or pairs, a multiple of 32,768.
BITS = 1 << 25
#: Words read at a time; different words, pairs and suffixes that a task holds before it passes them on; rows passed on at a time.
BLOCK, HELD_WORDS, HELD_PAIRS, HELD_SUFFIXES, SLICE = 250_000, 300_000, 2_000_000, 200_000, 100_000
#: Different words that a task numbers before it starts anew, and the bits that a number takes.
NUMBERED, WIDTH = 500_000, 21
#: Makes one place of two words' hashes.
MIX = 1_000_003

#: A piece ends at each of these; a tab parts words like a space.
ENDS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\n"
PLAIN = bytes.maketrans(ENDS + b"\t", BREAK * len(ENDS) + b" ")
#: Characters that sort before the tab between the words of a suffix are written as a mark and a digit meanwhile.
LOW, MARK = bytes(range(9)), b"\x0b"


def _marked(text: bytes) -> bytes:
    if len(text.translate(None, LOW)) < len(text):
        for c in LOW:
            text = text.replace(bytes([c]), MARK + str(c).encode())
    return text


def _plain(phrase: bytes) -> bytes:
    if MARK in phrase:
        for c in LOW:
            phrase = phrase.replace(MARK + str(c).encode(), bytes([c]))
    return phrase


def _words(text: str) -> list[bytes]:
    """The words of a text in UTF-8, with a line feed wherever a piece ends; some are empty."""
    return _marked(text.encode().lower().translate(PLAIN)).replace(BREAK, b" \n ").split(b" ")  # bytes have only A-Z in capitals


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    lang_or = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    return docs.select(lang_or.alias("lang"), F.col(text).cast("string").alias("text")).where("text <> ''")


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of several texts of one lang, each ended by a break."""
    held: dict[str, list[bytes]] = defaultdict(list)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py()
            held[lang] += _words(text.as_py())
            held[lang].append(BREAK)
            if len(held[lang]) >= block:
                yield lang, held.pop(lang)
    yield from held.items()


def _batch(lang: str, phrases: pa.Array, n: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    return pa.record_batch({"lang": pa.repeat(pa.scalar(lang), len(phrases)), **more, "phrase": phrases, "n": pa.array(n, pa.int64())})


def frequent_words(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, n) of the words found ``least`` times, and one row of each lang with a null phrase and all its words."""

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def passed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(BREAK, None)
                counts.pop(b"", None)
                names = pa.array([*map(_plain, counts), None], pa.binary()).cast(pa.string())
                yield _batch(lang, names, np.array([*counts.values(), sum(counts.values())], np.int64))
            held.clear()

        for lang, words in _blocks(batches, BLOCK):
            held[lang].update(words)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from passed()
        yield from passed()

    counted = _texts(docs, lang, text).mapInArrow(added_up, "lang string, phrase string, n bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())


def _bitmap(phrases: DataFrame) -> bytes:
    """One bit for each place that a word, or a pair of words, hashes to."""
    words = F.transform(F.split("phrase", " "), lambda w: F.crc32(F.concat(F.col("lang"), F.lit("\t"), w).cast("binary")))
    at = F.aggregate(words, F.lit(0).cast("bigint"), lambda place, h: (place * MIX + h) % BITS) + 1
    width = 32768 // 8
    marked = phrases.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    found = np.zeros(BITS // 8, np.uint8)
    for row in marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        found[(row.bucket - 1) * width : row.bucket * width] = np.frombuffer(row.bits, np.uint8)
    return found.tobytes()


def _has(bitmap: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Whether the places of words, or of pairs, are marked."""
    at = np.zeros(len(hashes[0]), np.int64)
    for h in hashes:
        at = (at * MIX + h) % (8 * len(bitmap))
    return (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    lead = f"{lang}\t".encode()
    return np.fromiter((crc32(lead + _plain(w)) for w in words), np.int64, len(words))


class _Numbered:
    """The words of one lang that a task has met, by number, with their hashes and whether they may be frequent."""

    def __init__(self, lang: str, frequent: bytes):
        self.lang, self.frequent = lang, np.frombuffer(frequent, np.uint8)
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.empty, self.end = self.number[b""], self.number[BREAK]
        self.hash, self.ok = np.zeros(2, np.int64), np.zeros(2, bool)

    def read(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; empty ones are left out."""
        known = len(self.number)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = list(islice(self.number, known, None))
        fresh = _hashes(self.lang, new)
        self.hash = np.concatenate([self.hash, fresh])
        self.ok = np.concatenate([self.ok, _has(self.frequent, fresh)])
        return ids[ids != self.empty]

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """Where two words stand that both may be frequent."""
        good = self.ok[ids]
        return np.flatnonzero(good[:-1] & good[1:])

    def spelt(self) -> pa.Array:
        return pa.array(list(self.number), pa.binary()).cast(pa.string())


def frequent_pairs(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of two words in a row found ``least`` times."""
    known = texts.sparkSession.sparkContext.broadcast(_bitmap(words))

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, _Numbered] = {}
        held: dict[str, list[np.ndarray]] = defaultdict(list)

        def passed(lang: str) -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            names = by_lang[lang].spelt()
            for at in range(0, len(keys), SLICE):
                some = keys[at : at + SLICE]
                sides = [names.take(pa.array(k)) for k in (some >> WIDTH, some & ((1 << WIDTH) - 1))]
                yield _batch(lang, pc.binary_join_element_wise(*sides, " "), n[at : at + SLICE])

        for lang, found in _blocks(batches, BLOCK):
            numbered = by_lang.get(lang) or by_lang.setdefault(lang, _Numbered(lang, known.value))
            ids = numbered.read(found)
            at = numbered.pairs(ids)
            held[lang].append((ids[at] << WIDTH) | ids[at + 1])
            full = len(numbered.number) > NUMBERED
            if full or sum(map(len, held[lang])) > HELD_PAIRS:
                yield from passed(lang)
            if full:
                del by_lang[lang]
        for lang in list(held):
            yield from passed(lang)

    counted = texts.mapInArrow(added_up, "lang string, phrase string, n bigint")
    plain = F.col("phrase")
    for c in LOW:
        plain = F.replace(plain, F.lit(f"{MARK.decode()}{c}"), F.lit(chr(c)))
    counted = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return counted.withColumn("phrase", F.when(F.contains("phrase", F.lit(MARK.decode())), plain).otherwise(F.col("phrase")))


def suffixes(texts: DataFrame, known, longest: int = LONGEST) -> DataFrame:
    """(lang, part, phrase, n): truncated suffixes of three words or more, ``part`` the same for the same prefix.

    ``known`` holds the bitmaps of frequent words, frequent pairs and heavy pairs, for all tasks.
    """

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, pair_map, heavy_map = known.value
        pair_map, heavy_map = np.frombuffer(pair_map, np.uint8), np.frombuffer(heavy_map, np.uint8)
        by_lang: dict[str, _Numbered] = {}
        held: dict[str, list[np.ndarray]] = defaultdict(list)

        def read(numbered: _Numbered, words: list[bytes]) -> np.ndarray:
            """Rows of word numbers from each place where two frequent pairs follow, -1 past the end, and the words of the prefix."""
            ids = numbered.read(words)
            at = numbered.pairs(ids)
            hashes = numbered.hash[ids[at]], numbered.hash[ids[at + 1]]
            go, load = np.zeros(len(ids) + longest, bool), np.zeros(len(ids) + longest, bool)
            go[at], load[at] = _has(pair_map, *hashes), _has(heavy_map, *hashes)
            start = np.flatnonzero(go[:-1] & go[1:])
            rows = np.full((len(start), longest + 1), -1, np.int32)
            rows[:, 0], rows[:, 1] = ids[start], ids[start + 1]
            on, prefix, open_ = np.ones(len(start), bool), np.full(len(start), 2), load[start]
            for d in range(2, longest):
                on = on & go[start + d - 1]
                rows[on, d] = ids[start[on] + d]
                prefix += on & open_
                open_ = open_ & load[start + d - 1] & on
            rows[:, longest] = prefix
            return rows

        def passed(lang: str) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held.pop(lang))
            rows = rows[np.lexsort(rows.T[::-1])]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate([first, [len(rows)]]))
            names = by_lang[lang].spelt()
            for begin in range(0, len(first), SLICE):
                some = rows[first[begin : begin + SLICE]]
                sides = [names.take(pa.array(some[:, d], mask=some[:, d] < 0)) for d in range(longest)]
                whole = pc.binary_join_element_wise(*sides, "\t", null_handling="skip")
                kept = [pc.if_else(pa.array(some[:, longest] > d), side, pa.scalar(None, pa.string())) for d, side in enumerate(sides)]
                yield _batch(lang, whole, n[begin : begin + SLICE], prefix=pc.binary_join_element_wise(*kept, "\t", null_handling="skip"))

        for lang, words in _blocks(batches, BLOCK):
            numbered = by_lang.get(lang) or by_lang.setdefault(lang, _Numbered(lang, frequent))
            held[lang].append(read(numbered, words))
            full = len(numbered.number) > NUMBERED
            if full or sum(map(len, held[lang])) > HELD_SUFFIXES:
                yield from passed(lang)
            if full:
                del by_lang[lang]
        for lang in list(held):
            yield from passed(lang)

    found = texts.mapInArrow(added_up, "lang string, prefix string, phrase string, n bigint")
    return found.select("lang", F.xxhash64("lang", "prefix").alias("part"), "phrase", "n")


def _leaf_totals(known, longest: int, least: int):
    """Adds up the leaves below each phrase, over suffixes in order.

    A phrase whose suffixes may go on in the rows before or after, or whose pairs are all
    heavy and whose suffixes may be with other tasks, is passed on whatever its count.
    """

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_map = np.frombuffer(known.value[2], np.uint8)

        def below(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for lang in pc.unique(rows["lang"]).to_pylist():
                some = rows.filter(pc.equal(rows["lang"], lang)).combine_chunks()
                words = pc.split_pattern(some["phrase"], "\t").combine_chunks()
                lengths = pc.list_value_length(words)
                for d in range(3, longest + 1):
                    long = pc.greater_equal(lengths, d)
                    if not pc.any(long).as_py():
                        break
                    first = pc.binary_join(pc.list_slice(words.filter(long), 0, d), "\t")
                    sums = pa.table({"phrase": first, "n": some["n"].filter(long)}).group_by("phrase").aggregate([("n", "sum")])
                    edges = ["\t".join(words[i].as_py()[:d]) for i in (0, len(words) - 1)]
                    coded = pc.split_pattern(sums["phrase"], "\t").combine_chunks().flatten().dictionary_encode()
                    hashes = _hashes(lang, [w.encode() for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()].reshape(-1, d)
                    split = np.logical_and.reduce([_has(heavy_map, hashes[:, i], hashes[:, i + 1]) for i in range(d - 1)])
                    keep = pc.or_(pc.greater_equal(sums["n_sum"], least), pc.is_in(sums["phrase"], value_set=pa.array(edges)))
                    sums = sums.filter(pc.or_(keep, pa.array(split)))
                    phrases = [_plain(p.encode()).replace(b"\t", b" ") for p in sums["phrase"].to_pylist()]
                    yield _batch(lang, pa.array(phrases, pa.binary()).cast(pa.string()), sums["n_sum"].to_numpy())

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SLICE:
                yield from below(pa.Table.from_batches(held))
                held = []
        if held:
            yield from below(pa.Table.from_batches(held))

    return totals


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of one to ``longest`` words found ``least`` times, and (lang, n) of all words."""
    texts = _texts(docs, lang, text)
    counted = cut(frequent_words(docs, least, lang, text), "frequent-words")
    words, totals = counted.where("phrase IS NOT NULL"), counted.where("phrase IS NULL").select("lang", "n")
    pairs = cut(frequent_pairs(texts, words, least), "frequent-pairs")
    total = totals.agg(F.sum("n")).first()[0] or 0
    budget = max(BUDGET, total // GROUPS)
    heavy = pairs.where(F.col("n") > max(1, budget // PARTS))
    known = texts.sparkSession.sparkContext.broadcast((_bitmap(words), _bitmap(pairs), _bitmap(heavy)))
    groups = suffixes(texts, known, longest).repartition(total // budget + 1, "part").sortWithinPartitions("lang", "phrase")
    nodes = groups.select("lang", "phrase", "n").mapInArrow(_leaf_totals(known, longest, least), "lang string, phrase string, n bigint")
    longer = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words.unionByName(pairs).unionByName(longer), totals


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer one covers; the cut with the lowest score counts."""
    found, totals = phrases(docs, longest, least, lang, text)
    found = cut(found, "phrases")
    several = found.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    part = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    size = F.size("words")
    # a phrase between a candidate and a longer one has a count between theirs, so one word more is enough to look at
    longer = several.where(size > 2).select("lang", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("phrase"), F.col("n").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    open_ = several.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("n")))
    cuts = open_.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    first = found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang")
    exact = "1000BD * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    scored = scored.withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", *[f"best.{c}" for c in ("a", "l", "r", "n", "score")])


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first phrases of each lang with their rank from 1; each task passes on no more than ``most`` of a lang."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)
