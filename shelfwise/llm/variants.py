"""Spelling variants: words that differ by one inserted, deleted or replaced character.

A word's frequency vector counts its characters in each of a few groups of letters. One edit
adds at most one to one count (a surplus) and takes at most one from another (a deficit), so
near words are found in a trie whose levels are the counts, one group after the other: the
search goes down depth first and may spend one surplus and one deficit on the way. Words at
the leaves it reaches are verified by comparing characters.

The trie is cut into subtrees at the first level at which none has more than ``SUBTREE``
words. Every word is sent to its own subtree, and as a query to those that its budget can
reach and that exist. Of two near words one has the larger vector, reading the counts in
order, so it is enough that each looks for larger ones: a query spends its surplus first
and goes to 1 + levels * (levels + 1) / 2 subtrees at most. A subtree's task searches
for all its queries at once and returns one row for each word that has found another, the
number of its near words and the best of them, never pairs. A node of few words is not
divided further. The work of a leaf grows with its words times the queries that reach it;
leaves hold words made of the same letters, near-anagrams, which are few in any language.

Cases: a null text has no words, a null id counts as an empty one; repeated rows count each;
words are compared by code points, ties go to the smallest in code-point order; words longer
than ``WIDTH`` are verified the same way, by themselves; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .rows import LOWER, UPPER

#: What a word is made of, its least length and its least number of occurrences.
RUNS, SHORTEST, LEAST = r"[A-Za-zÀ-ÿ]{%d,}+", 7, 2
#: A word is a form of a near one that occurs so many times as often.
RATIO = 10
#: Levels of the trie, commonest letters first; any other character counts in the last level.
LEVELS = ("e", "n", "t", "i", "a", "o", "r", "s", "h", "l", "u", "c", "dg", "mfb", "pvwk")
#: Bits of a count in the number of a subtree, its largest count (one more and one less still fit), and the levels that fit.
FIELD, MOST, DEEPEST = 5, 29, 12
#: Most words of a subtree that a task is given, of a node that is searched word by word, and characters compared at a time.
SUBTREE, NODE, WIDTH = 4_096, 24, 32
#: Comparisons held at a time, as many characters each as a word is long.
BLOCK = 1 << 18


def typed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST, every: int = 31) -> DataFrame:
    """(word): each run of letters in lower case, with one letter left out where the hash of id and run says so."""
    text = F.col(text_column).cast("string")
    runs = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUNS % shortest), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    dropped = F.concat(F.expr("run").substr(F.lit(1), at), F.expr("run").substr(at + 2, F.char_length("run")))
    return runs.select(F.when(h % every == 0, dropped).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= shortest)


def vocabulary(words: DataFrame, least: int = LEAST) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _coded(words: DataFrame) -> DataFrame:
    """``words`` with the counts of the first levels as fields of one number, each one more than the count."""
    fields = [
        F.shiftleft((F.least(F.char_length("word") - F.char_length(F.translate("word", letters, "")), F.lit(MOST)) + 1).cast("bigint"), FIELD * i)
        for i, letters in enumerate(LEVELS[:DEEPEST])
    ]
    return words.select("word", "n", sum(fields[1:], fields[0]).alias("code"))


def _node(depth: int) -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << (FIELD * depth)) - 1))


def _depth(coded: DataFrame, subtree: int) -> int:
    """The first level at which no node has more words than a task is given."""
    for depth in range(DEEPEST):
        if (coded.groupBy(_node(depth).alias("node")).count().agg(F.max("count")).first()[0] or 0) <= subtree:
            return depth
    return DEEPEST


def _steps(depth: int) -> list[int]:
    """What one surplus, and a deficit after it, can add to a node's number."""
    unit = [1 << (FIELD * i) for i in range(depth)]
    return [0, *unit, *[unit[i] - unit[j] for i in range(depth) for j in range(i + 1, depth)]]


def _dealt(words: DataFrame, subtree: int) -> DataFrame:
    """(node, home, word, n): every word at home in its subtree, and as a query in all it may reach."""
    coded = cut(_coded(words), "coded")
    depth = _depth(coded, subtree)
    home = coded.select(_node(depth).alias("node"), "word", "n")
    steps = F.explode(F.array(*[F.lit(s).cast("bigint") for s in _steps(depth)]))
    queries = home.select("node", "word", "n", steps.alias("step")).select((F.col("node") + F.col("step")).alias("node"), "word", "n")
    queries = queries.join(home.select("node").distinct(), "node", "left_semi")
    return home.withColumn("home", F.lit(True)).unionByName(queries.withColumn("home", F.lit(False)))


def _vectors(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    level = {ord(c): i for i, group in enumerate(LEVELS) for c in group}
    table = np.array([level.get(c, len(LEVELS)) for c in range(256)], np.uint8)
    out = np.zeros((len(letters), len(LEVELS) + 1), np.int32)
    groups = table[np.minimum(letters, 255)]
    real = np.arange(letters.shape[1])[None, :] < lengths[:, None]
    for i in range(out.shape[1]):
        out[:, i] = ((groups == i) & real).sum(axis=1)
    return out


def _codes(text: str) -> np.ndarray:
    """Code points, in one byte each where they fit."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes


class _Words:
    """Words of a subtree as rows of characters, from the left and from the right."""

    def __init__(self, words: list[str], widest: int):
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int32, len(words))
        width = min(int(self.lengths.max(initial=1)), widest)
        flat = _codes("".join(words))
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        place = np.arange(width)[None, :]
        real = place < self.lengths[:, None]
        last = max(len(flat) - 1, 0)
        self.left = np.where(real, flat[np.minimum(starts[:, None] + place, last)], 0)
        self.right = np.where(real, flat[np.clip(starts[:, None] + self.lengths[:, None] - 1 - place, 0, last)], 0)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words of each pair differ by exactly one edit."""
        la, lb = self.lengths[a], self.lengths[b]
        alike = (self.left[a] != self.left[b]).sum(axis=1)
        width = self.left.shape[1]
        # equal lengths: one place differs; else what is equal at both ends makes up the shorter word
        from_left, from_right = ((np.argmax(np.column_stack([x[a] != x[b], np.ones(len(a), bool)]), axis=1)) for x in (self.left, self.right))
        shorter = np.minimum(la, lb)
        found = np.where(la == lb, alike == 1, (abs(la - lb) == 1) & (np.minimum(from_left, shorter) + np.minimum(from_right, shorter) >= shorter))
        for i in np.flatnonzero(np.maximum(la, lb) > width):
            found[i] = _one_edit(self.words[a[i]], self.words[b[i]])
        return found


def _one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _searched(table: pa.Table, node: int, widest: int) -> pa.Table:
    """For each word that another of the subtree is near: with how many so far, and the commonest of them."""
    home = table["home"].to_numpy(zero_copy_only=False)
    n = table["n"].to_numpy()
    words = table["word"].to_pylist()
    held = _Words(words, widest)
    vectors = _vectors(held.left, held.lengths)
    for i in np.flatnonzero(held.lengths > held.left.shape[1]):
        vectors[i] = _vectors(_codes(words[i])[None, :], held.lengths[i : i + 1])[0]
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    a, b = [], []

    def leaf(members: np.ndarray, queries: np.ndarray) -> None:
        rows = max(1, BLOCK // len(members))
        for at in range(0, len(queries), rows):
            some = queries[at : at + rows]
            q, m = np.repeat(some, len(members)), np.tile(members, len(some))
            close = np.abs(held.lengths[q] - held.lengths[m]) <= 1
            q, m = q[close], m[close]
            hit = held.near(q, m)
            q, m = q[hit], m[hit]
            # a query looks for larger vectors; among equal ones the words decide
            more = vectors[m] - vectors[q]
            first = more[np.arange(len(q)), np.argmax(more != 0, axis=1)]
            keep = (first > 0) | ((first == 0) & (place[q] < place[m]))
            a.append(q[keep])
            b.append(m[keep])

    def down(level: int, members: np.ndarray, queries: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """Depth first: ``members`` are the words below a node, ``queries`` those that reach it with what they have left."""
        if level == vectors.shape[1] or len(members) <= node:
            leaf(members, queries)
            return
        at, asked = vectors[members, level], vectors[queries, level]
        for count in np.unique(at):
            more, less = asked + 1 == count, asked - 1 == count
            go = (asked == count) | (more & surplus) | (less & deficit & ~surplus)
            if go.any():
                down(level + 1, members[at == count], queries[go], (surplus & ~more)[go], (deficit & ~less)[go])

    queries = np.flatnonzero(~home)
    if home.any() and len(queries):
        down(0, np.flatnonzero(home), queries, np.ones(len(queries), bool), np.ones(len(queries), bool))
    q = np.concatenate([np.zeros(0, np.int64), *a, *b])
    m = np.concatenate([np.zeros(0, np.int64), *b, *a])
    order = np.lexsort((place[m], -n[m], q))
    q, m = q[order], m[order]
    first, counts = np.unique(q, return_index=True, return_counts=True)[1:]
    return pa.table({
        "word": pa.array([words[i] for i in q[first]], pa.string()), "n_near": pa.array(counts, pa.int64()),
        "best": pa.array([words[i] for i in m[first]], pa.string()), "best_n": pa.array(n[m[first]], pa.int64()),
    })


def near_words(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, n_near, best, best_n) of every word of (word, n) that has near ones."""

    def search(table: pa.Table) -> pa.Table:
        return _searched(table, NODE, WIDTH)

    found = _dealt(words, subtree).groupBy("node").applyInArrow(search, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.word", (-F.col("best.order")).alias("best_n")).toDF("word", "n_near", "best", "best_n")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each form's own form is followed, twice as far every time.

    A form occurs several times as often as its word, so no chain is longer than the number
    of digits of the largest count.
    """
    roots = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = cut(roots.join(step, roots["root"] == step["via"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def grouped(words: DataFrame, ratio: int = RATIO, subtree: int = SUBTREE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n)."""
    words = cut(words, "vocabulary")
    found = near_words(words, subtree)
    with_form = F.col("best_n") >= ratio * F.col("n")
    judged = cut(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(with_form, F.col("best")).alias("form"), F.when(with_form, F.col("best_n")).alias("form_n"),
    ), "forms")
    roots = rooted(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
