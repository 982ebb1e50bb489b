"""Exact token counts of every prefix of a text, for byte-level BPE vocabularies.

Merging makes a token sequence the encoding of its bytes exactly when every two neighbours
in it would stay apart if encoded alone. So the encoding of each prefix of a piece ends in
one token, and its count is one more than that of the shorter prefix before that token:
one pass over the piece fills a table with the count at every byte. A text is its pieces
(words with their leading space, digits, signs, white space) laid end to end, so the counts
at all its prefixes follow from the tables of its pieces; truncation to a budget looks into
one piece's table and encodes nothing again.

The file is read on the driver and broadcast: it is the vocabulary, a fixed size whatever
the data. Tables of pieces are kept in each worker up to a bound, as most words return.

Cases: a null text counts as empty, 0 tokens; strings of added tokens inside a text are one
token each, as the library has it; texts of any length are handled piece by piece; repeated
rows are counted alike; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import gc
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How byte-level BPE cuts a text into pieces (the pattern the vocabulary file's library applies).
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
SHORT_FORMS = ("'re", "'ve", "'ll")
#: Cuts of a text that its pieces respect: before a space that has no white space after it.
CHUNKS = rf"(?<=.)(?= [^{WHITE}])"
#: What a worker keeps, at 100 to 200 bytes each: totals of parts, tables of pieces, tested pairs. The oldest go all at once.
KEPT, KEPT_TABLES, KEPT_PAIRS = 800_000, 100_000, 600_000
#: Above every token's number; makes one number of two.
PAIR = 1 << 24


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: itself where it prints, else from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges of a byte-level BPE file, with tokens numbered in the order in which they are formed."""

    def __init__(self, content: str):
        parsed = json.loads(content)
        model = parsed["model"]
        by_char = printable_bytes()
        if model["type"] != "BPE" or (parsed["pre_tokenizer"] or {}).get("type") != "ByteLevel" or parsed["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer is needed")
        if parsed["pre_tokenizer"].get("add_prefix_space") or not parsed["pre_tokenizer"].get("use_regex", True):
            raise ValueError("the pre-tokenizer's settings are not supported")
        self.special = [t["content"] for t in parsed["added_tokens"]]
        self.number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (self.number[bytes(by_char[c] for c in x)] for x in (left, right))
            joined = bytes(by_char[c] for c in left + right)
            if joined in self.number:  # a later way to form a token changes nothing here
                raise ValueError("two merges form one token")
            self.number[joined] = self.merged[a, b] = len(self.halves)
            self.halves.append((a, b))
        #: Tokens by their bytes from last to first: nested dicts, the token under -1, itself -1 where none ends.
        self.backwards: dict = {-1: -1}
        for token, n in self.number.items():
            node = self.backwards
            for byte in reversed(token):
                node = node.setdefault(byte, {-1: -1})
            node[-1] = n
        self.tables: dict[bytes, bytes | tuple[int, ...]] = {}
        self.totals: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        self.piece = regex.compile(PIECES)
        self.chunk = regex.compile(CHUNKS, regex.DOTALL)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def apart(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes together keeps a boundary between them.

        The merges are undone from the last one formed, on whichever side that was; at each
        state the two tokens that touch must not merge before that undone one was formed.
        """
        key = left * PAIR + right
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b, formed = left, right, len(self.halves)
        while True:
            if self.merged.get((a, b), formed) < formed:
                answer = False
                break
            if a < 256 and b < 256:
                answer = True
                break
            # of two equal numbers the left one was formed first, so the right one is undone first
            if a > b:
                formed, a = a, self.halves[a][1]
            else:
                # the merge across must come before this one; on a tie of rank the left place wins
                formed, b = b + 1, self.halves[b][0]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def table(self, piece: bytes) -> bytes | tuple[int, ...]:
        """Number of tokens of each prefix of a piece, by bytes; entry 0 is 0."""
        found = self.tables.get(piece)
        if found is not None:
            return found
        root, known, apart = self.backwards, self.pairs, self.apart
        counts, last = [0], [-1]
        for end in range(1, len(piece) + 1):
            node, fits, at = root, [], end
            while at:
                at -= 1
                node = node.get(piece[at])
                if node is None:
                    break
                if node[-1] >= 0:
                    fits.append((at, node[-1]))
            for at, token in reversed(fits):
                before = last[at]
                if before < 0:
                    break
                answer = known.get(before * PAIR + token)
                if answer or (answer is None and apart(before, token)):
                    break
            counts.append(counts[at] + 1)
            last.append(token)
        if len(self.tables) >= KEPT_TABLES:
            self.tables.clear()
        # flat values: the collector has nothing to follow in them
        found = self.tables[piece] = bytes(counts) if counts[-1] < 256 and max(counts) < 256 else tuple(counts)
        return found

    def total(self, chunk: str) -> int:
        """Tokens of a text that holds no added token, or of a part between two cuts."""
        found = self.totals.get(chunk)
        if found is None:
            found = sum(self.table(p.encode())[-1] for p in self.piece.findall(chunk))
            if len(self.totals) >= KEPT:
                self.totals.clear()
            if len(chunk) < 64:
                self.totals[chunk] = found
        return found

    def parts(self, text: str) -> list[str]:
        """The text cut where every encoding of it has a boundary; added tokens are parts."""
        if self.marks is None or not any(mark in text for mark in self.special):
            return self._cut(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self._cut(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self._cut(text[at:])

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        words = text.split(" ")
        # a space before white space is no cut; texts without one need no pattern
        if all(w and not w[0].isspace() for w in words[1:]):
            return ([words[0]] if words[0] else []) + [" " + w for w in words[1:]]
        return self.chunk.split(text)

    def count(self, text: str) -> int:
        known, special, n = self.totals, self.special, 0
        for part in self.parts(text):
            found = known.get(part)
            n += found if found is not None else (1 if part in special else self.total(part))
        return n

    def prefix_counts(self, text: str) -> np.ndarray:
        """Number of tokens of text[:i] for every i from 0 to len(text)."""
        out = np.zeros(len(text) + 1, np.int64)
        at, before = 0, 0
        parts = self.parts(text)
        for i, part in enumerate(parts):
            if part in self.special:
                # a part of an added token's string is ordinary text that may run on from the part before
                lead = parts[i - 1] if i and parts[i - 1] not in self.special else ""
                base = before - (self.total(lead) if lead else 0)
                for j in range(1, len(part)):
                    out[at + j] = base + self.total(lead + part[:j])
                out[at + len(part)] = before + 1
            else:
                out[at + 1 : at + len(part) + 1] = before + self._within(part)
            at += len(part)
            before = int(out[at])
        return out

    def _within(self, part: str) -> np.ndarray:
        out, base, at = np.zeros(len(part), np.int64), 0, 0
        pieces = self.piece.findall(part)
        for i, piece in enumerate(pieces):
            raw = piece.encode()
            counts = self.table(raw)
            ends = np.cumsum([len(c.encode()) for c in piece])
            out[at : at + len(piece)] = base + np.array(list(counts))[ends]
            if piece in SHORT_FORMS:  # cut inside, a shortened form is a sign and a letter
                out[at + 1] = base + 2
            if i and piece[0].isspace() and pieces[i - 1].isspace():  # a prefix that ends in white space keeps it whole
                run = pieces[i - 1] + piece[0]
                out[at] = base - self.table(pieces[i - 1].encode())[-1] + self.table(run.encode())[-1]
            base += counts[-1]
            at += len(piece)
        return out

    def cut(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens."""
        at = before = 0
        best = 0
        parts = self.parts(text)
        for i, part in enumerate(parts):
            n = 1 if part in self.special else self.total(part)
            if before + n > budget:
                # prefixes that end in this part, or past it while counts may still fall back
                tail = self.prefix_counts("".join(parts[max(0, i - 1) : i + 2]))
                lead = parts[i - 1] if i else ""
                base = before - ((1 if lead in self.special else self.total(lead)) if lead else 0)
                good = np.flatnonzero(base + tail <= budget)
                return at - len(lead) + int(good[-1]) if len(good) else best
            at += len(part)
            before += n
            best = at
        return len(text)


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(content) -> Vocabulary:
    """One for each worker process and broadcast file; its tables live as long as the worker."""
    key = hash(content.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content.value)
        gc.freeze()  # the vocabulary stays; the collector need not walk it again and again
    return _loaded[key]


def _broadcast(spark: SparkSession, vocabulary_file: str):
    with open(vocabulary_file, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def counts(spark: SparkSession, text: Column, vocabulary_file: str, budget: int) -> Column:
    """A struct of n_tokens and cut (characters of the longest prefix within the budget)."""
    content = _broadcast(spark, vocabulary_file)

    @F.pandas_udf("n_tokens bigint, cut bigint")
    def counted(texts: pd.Series) -> pd.DataFrame:
        vocabulary = _vocabulary(content)
        n = [vocabulary.count(t) for t in texts]
        cuts = [vocabulary.cut(t, budget) if k > budget else len(t) for t, k in zip(texts, n)]
        return pd.DataFrame({"n_tokens": n, "cut": cuts}, dtype="int64")

    return counted(text)


def prefix_counts(spark: SparkSession, text: Column, vocabulary_file: str) -> Column:
    """The number of tokens of every prefix of the text, from none to all of its characters."""
    content = _broadcast(spark, vocabulary_file)

    @F.pandas_udf("array<bigint>")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([_vocabulary(content).prefix_counts(t) for t in texts], dtype=object)

    return stored(text)


def within_budget(prefixes: Column, budget: int) -> Column:
    """Length of the longest prefix within a budget of tokens, from a stored table."""
    return F.greatest(F.lit(0), F.size(prefixes) - F.array_position(F.reverse(F.transform(prefixes, lambda n: n <= budget)), True)).cast("bigint")


def truncated(docs: DataFrame, vocabulary_file: str, budget: int) -> DataFrame:
    """The rows of ``docs`` with texts cut to the longest prefix within the budget; a null stays null."""
    found = counts(docs.sparkSession, F.coalesce(F.col("text"), F.lit("")), vocabulary_file, budget)
    rows = docs.select(F.struct("*").alias("row"), found.alias("found"))
    text = F.col("row.text")
    return rows.select(*[
        (F.substring(text, F.lit(1), F.col("found.cut").cast("int")) if c == "text" else F.col("row").getField(c)).alias(c)
        for c in docs.columns
    ])
