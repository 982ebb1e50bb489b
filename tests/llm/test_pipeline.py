"""The pipeline against a brute-force version, on test documents with planted cases."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from planted_texts import prose
from pyspark.sql import functions as F
from test_operators import SPACES, brute_components, brute_fingerprint, brute_grams, brute_hits, brute_targets

import corpus_pipeline
from shelfwise.llm import lines, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    planted = [
        (9000, prose(1, 400)), (9001, prose(1, 400)), (9002, prose(1, 400) + " tail"), (9003, prose(2, 80) + "\n" + leak + "\n" + prose(3, 80)),
        (9004, prose(4, 80)), (9005, None), (9006, ""),
    ] + [(9100 + i, "the very same footer\n" + prose(50 + i, 70)) for i in range(30)]
    extra = spark.createDataFrame([(i, t, "en", "src_new", 1) for i, t in planted], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.unionByName(extra).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def brute(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.trained(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = {r.doc_id: (r.source, r.text) for r in docs.collect() if model.score(r.text or "") < 0.5}
    pages, seen = Counter(s for s, _ in rows.values()), Counter()
    for s, t in rows.values():
        seen.update({(s, x.strip(lines.BLANKS)) for x in (t or "").split("\n")})
    dropped = {k for k, n in seen.items() if k[1] and n >= lines.LEAST_PAGES and n > lines.RATIO * pages[k[0]]}
    strip = lambda s, t: t and "\n".join(x for x in t.split("\n") if (s, x.strip(lines.BLANKS)) not in dropped)
    rows = {i: (s, strip(s, t)) for i, (s, t) in rows.items()}
    named = brute_components({i: brute_fingerprint(t) for i, (_, t) in rows.items()})
    rows = {i: x for i, x in rows.items() if named[i] == i}
    grams = brute_grams([(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    return {i: x for i, x in rows.items() if not brute_hits(x[1], grams)[1]}


def test_pipeline(spark, folder):
    want = brute(spark, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    size = {i: len(re.findall(SPACES, t or "")) for i, (_, t) in want.items()}
    sizes, taken = Counter(), Counter()
    for i, (s, _) in want.items():
        sizes[s] += size[i]
    for r in got:
        assert want[r.doc_id] == (r.source, r.text)
        assert 0 < r.taken <= 2 * size[r.doc_id]
        taken[r.source] += r.taken
    assert len({r.doc_id for r in got}) == len(got)
    targets = brute_targets(dict(sizes))
    assert all(abs(taken[s] - t) <= 0.005 * t + 3 for s, t in targets.items())
    ids = {r.doc_id for r in got}
    assert 9000 in ids and not {9001, 9002, 9003} & ids
    assert all("footer" not in r.text for r in got if r.doc_id >= 9100)


def test_stage_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("more", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns + (["taken"] if name == "mixing" else [])
