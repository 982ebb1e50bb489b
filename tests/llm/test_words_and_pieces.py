"""Spelling variants, SentencePiece and phrases against brute force, the library, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import collocations, pieces, variants
from shelfwise.llm.queries import LLM_QUERIES, PIECE_FILE, TOP_PHRASES, vocabulary_path

SF = "/root/testdata/sf0.001"


def lowered(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


# --- spelling variants


def one_edit(a: str, b: str) -> bool:
    """By the table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1] == 1


def brute_groups(n: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    out = {}
    for w in n:
        near = [o for k in (-1, 0, 1) for o in by_length[len(w) + k] if one_edit(w, o)]
        best = min(near, key=lambda o: (-n[o], o), default=None)
        out[w] = (best if best and n[best] >= ratio * n[w] else None, len(near))
    return out


def root_of(word: str, groups: dict[str, tuple]) -> str:
    while groups[word][0]:
        word = groups[word][0]
    return word


@pytest.mark.parametrize("subtree,node,width", [(10_000, 24, 32), (20, 3, 5), (1, 1, 40)])
def test_groups_of_made_words(spark, monkeypatch, subtree, node, width):
    """Subtrees of few words, leaves of one, and words wider than what is compared at a time."""
    monkeypatch.setattr(variants, "NODE", node)
    monkeypatch.setattr(variants, "WIDTH", width)
    rnd = random.Random(5)
    words = {"".join(rnd.choice("entiz") for _ in range(rnd.randint(3, 7))) for _ in range(250)} | {"漢字かな", "漢字かなé", "é" * 70, "é" * 69}
    n = {w: rnd.choice([2, 3, 30, 31, 400, 5000]) for w in words}
    groups = brute_groups(n)
    got = variants.grouped(spark.createDataFrame(list(n.items()), "word string, n bigint"), subtree=subtree).collect()
    assert {r.word: (r.form, r.n_near) for r in got} == groups
    assert {r.word: r.root for r in got} == {w: root_of(w, groups) for w in n}
    assert all(r.form_n == (n[r.form] if r.form else None) and r.n == n[r.word] for r in got)


def test_variants_query(spark):
    """The whole query on texts, where one letter of some words is left out."""
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", r.text or "")):
            h = crc32(f"{r.doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    groups = brute_groups(n)
    got = LLM_QUERIES["op11_spelling_variants"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = {(w, g[0], root_of(w, groups), n[w], g[1], n.get(g[0])) for w, g in groups.items()}
    assert {tuple(r) for r in got.collect()} == want


def test_variants_of_odd_rows(odd, empty):
    runs = Counter(r.word for r in variants.typed(odd).collect())
    assert all(len(w) >= 7 for w in runs)
    rows = variants.grouped(variants.vocabulary(variants.typed(odd))).collect()
    assert {r.word: r.n for r in rows} == {w: n for w, n in runs.items() if n >= 2}
    assert variants.grouped(variants.vocabulary(variants.typed(empty))).collect() == []


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary_path(PIECE_FILE))


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_model(vocabulary_path(PIECE_FILE)))


def ids_of(encoder, text: str) -> list[int]:
    return np.frombuffer(encoder.encode(text), "<i4").tolist()


def test_random_texts(library, encoder, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 300)
    rnd = random.Random(9)
    signs = " " * 9 + "▁▁ abcdefghijklmnopqrstuvwxyzTHEIN.,-!?<>/0123456789éèüß\n\t\r\0 ​日本語中文ひらがな한국어абвгд🙂𠮷́"
    for i in range(6000):
        if i % 3 == 0:
            text = "".join(rnd.choice(encoder.model.pieces[259:]) for _ in range(rnd.randint(0, 8)))
        else:
            text = "".join(rnd.choice(signs if i % 3 == 1 else "  etaoinshr") for _ in range(rnd.randint(0, 40)))
        ids = library.encode(text)
        assert ids_of(encoder, text) == ids, text
        assert encoder.decode(ids) == library.decode(ids)


def test_random_ids(library, encoder):
    rnd = random.Random(10)
    for _ in range(6000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(4), encoder.id["▁"]]) for _ in range(rnd.randint(0, 9))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_long_texts(library, encoder):
    for text in ("a" * 50_000, " " * 50_000, "ab c" * 20_000, "漢🙂" * 20_000, "\n" * 9_000):
        ids = library.encode(text)
        assert ids_of(encoder, text) == ids
        assert encoder.decode(ids) == library.decode(ids)


def test_every_prefix_has_its_last_piece(library, encoder):
    """The table itself: the last id of each prefix is what the library ends in."""
    part = "▁internationalizations"
    last = encoder.last_pieces(part)
    assert last[1:] == [library.encode(part[1:end])[-1] if end > 1 else encoder.id["▁"] for end in range(1, len(part) + 1)]


def test_sentencepiece_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, text in texts.items():
        ids = library.encode(text)
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    got = LLM_QUERIES["op12_sentencepiece"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_pieces_of_odd_rows(spark, odd, empty, library):
    model = vocabulary_path(PIECE_FILE)
    with_ids = odd.select("*", pieces.encoded(spark, F.col("text"), model).alias("ids"))
    rows = with_ids.select("*", pieces.decoded(spark, F.col("ids"), model).alias("back")).collect()
    assert len(rows) == odd.count()
    assert all(r.ids == library.encode(r.text or "") and r.back == (r.text or "") for r in rows)
    assert empty.select(pieces.encoded(spark, F.col("text"), model)).collect() == []


def test_decoding_of_odd_lists(spark, library):
    lists = [None, [], [0], [1, 2], [3, 4, 262], [230, 1, 152], [259, 259]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "n int, ids array<int>")
    got = rows.select("n", pieces.decoded(spark, F.col("ids"), vocabulary_path(PIECE_FILE)).alias("text")).collect()
    assert {r.n: r.text for r in got} == {i: library.decode(x or []) for i, x in enumerate(lists)}


# --- phrases


def brute_phrases(rows, least: int, most: int, longest: int = 5) -> set[tuple]:
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {
            p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and 100 * a >= 100 * counts[p[i:j]]
        }
        found = []
        for p in candidates.keys() - inside:
            score, k = min((1000 * counts[p] * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -counts[p], " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least,budget", [(5, 1_000_000), (8, 50), (30, 400)])
def test_phrases(spark, monkeypatch, least, budget):
    """With budgets that make most prefixes heavy, and tasks that pass on what they hold all the time."""
    if budget < 1_000_000:
        monkeypatch.setattr(collocations, "BUDGET", budget)
        for name, value in {"HELD_WORDS": 300, "HELD_PAIRS": 500, "HELD_SUFFIXES": 200, "SLICE": 90, "BLOCK": 400, "NUMBERED": 700}.items():
            monkeypatch.setattr(collocations, name, value)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_phrases([(r.lang, r.text) for r in docs.collect()], least, 100)
    got = collocations.ranked(collocations.collocations(docs, least=least), 100).select(COLUMNS).collect()
    assert len(want) > 20 and {tuple(r) for r in got} == want


def test_phrases_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_phrases([(r.lang, r.text) for r in docs.collect()], 100, TOP_PHRASES)
    got = LLM_QUERIES["op13_collocations"](spark, "/root/testdata/sf0.01")
    assert got.columns == COLUMNS and {tuple(r) for r in got.collect()} == want


def test_phrases_of_odd_words(spark, monkeypatch, odd, empty):
    """Control characters inside words, tabs, repeated words that overlap, and a bitmap with a single page."""
    monkeypatch.setattr(collocations, "BITS", 32768)
    texts = ["a\x00 b\x01 a\x00 b\x01 a\x00", "x\ty  z x y\vz x y", "no no no no no", "é É é É", "a\x00\x00 b a\x00 b", "x. y. x y; z"] * 4
    docs = spark.createDataFrame([(i, t, [None, "und", "en"][i % 3]) for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    want = brute_phrases([(r.lang, r.text) for r in docs.collect()], 2, 50)
    for budget in (1, 1_000_000):
        monkeypatch.setattr(collocations, "BUDGET", budget)
        got = collocations.ranked(collocations.collocations(docs, least=2), 50).select(COLUMNS).collect()
        assert {tuple(r) for r in got} == want
    want = brute_phrases([(r.lang, r.text) for r in odd.collect()], 3, 20)
    assert {tuple(r) for r in collocations.ranked(collocations.collocations(odd, least=3), 20).select(COLUMNS).collect()} == want
    assert collocations.collocations(empty).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 10**15
    found = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "a b", big)], "lang string, phrase string, n bigint")
    totals = spark.createDataFrame([("en", 90 * big)], "lang string, n bigint")
    monkeypatch.setattr(collocations, "phrases", lambda *a: (found, totals))
    row = collocations.collocations(None).first()
    assert row.score == 1000 * big * 90 * big // (6 * big * big)
