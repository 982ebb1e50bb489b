"""Every operator and every stage on odd rows, on an empty table, and without labels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from shelfwise.llm import decontaminate, lines, mixing, pii, quality_rules, resampling, secrets, simhash, tokens, toxicity
from shelfwise.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "two words"), (2, None), (None, "w5"), (3, ""), (1, "two words")], "item_id bigint, text string")


def rewriting(bench, labels):
    """Operators that return the caller's columns."""
    return {
        "drop_toxic": lambda d: toxicity.drop_toxic(d, labels),
        "truncated": lambda d: tokens.truncated(d, vocabulary_path(), 5),
        "pii": lambda d: pii.redacted(d, pii.fit(pii.proposals(d))),
        "drop_contaminated": lambda d: decontaminate.drop_contaminated(d, bench),
        "remove_passages": lambda d: decontaminate.remove_passages(d, bench),
        "drop_near_copies": simhash.drop_near_copies,
        "drop_boilerplate": lines.drop_boilerplate,
        "secrets": lambda d: secrets.redacted(d, secrets.fit(secrets.findings(d))),
        "resampling": lambda d: resampling.sample_documents(d, labels),
        "quality": lambda d: quality_rules.drop_low_quality(d, labels),
    }


NAMES = [
    "drop_toxic", "truncated", "pii", "drop_contaminated", "remove_passages", "drop_near_copies", "drop_boilerplate", "secrets",
    "resampling", "quality",
]


@pytest.mark.parametrize("name", NAMES)
def test_columns_and_rows(odd, bench, labels, name):
    out = rewriting(bench, labels)[name](odd)
    assert out.schema.names == odd.schema.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    rows = out.collect()
    if name in {"truncated", "pii", "remove_passages", "drop_boilerplate", "secrets"}:
        assert len(rows) == odd.count()
        assert sum(r.text is None for r in rows) == 2
    else:
        left = [tuple(r) for r in odd.collect()]
        for r in rows:
            left.remove(tuple(r))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(empty, bench, labels, no_labels, name):
    assert rewriting(bench, labels)[name](empty).collect() == []
    assert rewriting(bench.limit(0), no_labels)[name](empty).collect() == []


@pytest.mark.parametrize("name", ["drop_toxic", "drop_contaminated", "resampling", "quality"])
def test_no_labels_and_no_benchmark(odd, bench, no_labels, name):
    rows = rewriting(bench.limit(0), no_labels)[name](odd).collect()
    if name == "quality":  # the base rules still hold
        assert {r.doc_id for r in rows} <= {5, 6, 7, 8}
    else:
        assert len(rows) == odd.count()


def test_toxicity_without_labels_that_tell(spark, odd):
    """Labels of other documents, or of one sort only, reject nothing."""
    for rows in ([(i, 0, i % 2) for i in range(1000, 1040)], [(i, 0, 1) for i in range(10)]):
        other = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
        assert toxicity.drop_toxic(odd, other).count() == odd.count()


def test_toxicity_sample_is_bounded_in_rows(spark):
    """A labelled row that is there very often counts once; labels of documents that are not there take no place."""
    rows = [(1, "so many", "en", "s", 1)] * 400 + [(i, f"text {i}", "en", "s", 1) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    known = spark.createDataFrame([(i, 0, i % 2) for i in range(5000)], "doc_id bigint, quality int, toxic int")
    assert toxicity.sample(docs, known).count() == 39
    assert toxicity.sample(docs, known, rows=10).count() == 10


def test_near_copies_keep_one_of_each(odd):
    kept = simhash.drop_near_copies(odd).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(7) == 1 and 8 not in ids
    assert 1 in ids and 2 not in ids and 3 not in ids  # texts without words are one group
    assert len(kept) == len(set(ids))


def test_mixing(odd, empty):
    taken = mixing.mixed(odd).collect()
    assert len(taken) == odd.count()
    assert all(0 <= r.taken <= 2 * r.size for r in taken)
    copies = sorted(r.taken for r in taken if r.id == 7)
    assert len(copies) == 3 and copies[-1] - copies[0] <= 1
    rows = mixing.mix_documents(odd)
    assert rows.columns == [*odd.columns, "taken"]
    assert sum(r.taken for r in rows.collect()) == sum(r.taken for r in taken)
    assert mixing.mixed(empty).collect() == [] and mixing.mix_documents(empty).collect() == []


@pytest.mark.parametrize("name,stage", STAGES)
def test_stages(spark, tmp_path, odd, empty, labels, bench, name, stage):
    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    out = stage(spark, odd, folder)
    assert out.columns[: len(odd.columns)] == odd.columns
    assert len(out.columns) == len(odd.columns) + (name == "mixing")
    assert out.agg(F.count("*")).first()[0] <= odd.count()
    assert stage(spark, empty, folder).collect() == []
