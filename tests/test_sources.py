"""Readers and writers."""

from __future__ import annotations

import csv
from datetime import date
from pathlib import Path

from shelfwise.plans import ledger, reports
from shelfwise.sources import sinks, tables


def test_tables_written_and_read_back(spark, seed, tmp_path):
    for name in ("users", "categories", "suppliers", "products", "product_batches"):
        getattr(seed, name).write.parquet(f"{tmp_path}/{name}")
    sinks.append_ledger(seed.transactions, f"{tmp_path}/transactions")
    assert sorted(p.name for p in (tmp_path / "transactions").glob("txn_day=*")) == [
        "txn_day=2026-08-01", "txn_day=2026-08-02", "txn_day=2026-08-03",
    ]
    stored = tables.read_parquet(spark, str(tmp_path), date(2026, 8, 8))
    assert ledger.ledger(stored).collect() == ledger.ledger(seed).collect()
    assert reports.dashboard_stats(stored).collect() == reports.dashboard_stats(seed).collect()
    month = ledger.ledger(stored, period="THIS_MONTH")
    assert month.count() == 3 and ledger.ledger(stored, period="TODAY").isEmpty()
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_day" in plan


def read_csv(path):
    rows = []
    for part in sorted(Path(path).glob("part-*.csv")):
        with open(part, newline="") as f:
            rows += list(csv.reader(f))
    return rows


def test_ledger_file(spark, seed, tmp_path):
    sinks.write_csv(ledger.export_columns(ledger.ledger(seed)).coalesce(1), f"{tmp_path}/out")
    rows = read_csv(tmp_path / "out")
    assert rows[0] == [
        "Timestamp", "Txn ID", "Type", "Product", "SKU", "Batch", "Quantity", "Unit Price", "Total Amount", "Partner", "Logged By",
    ]
    assert rows[1][1:3] == ["TXN-OUT-20260803-01", "INTERNAL_USE"] and len(rows) == 4


def test_report_file_keeps_quotes_and_zeros(spark, tmp_path):
    df = spark.createDataFrame([('5" disk, "new"', 0, None)], "title string, stock int, note string")
    sinks.write_csv(df.coalesce(1), f"{tmp_path}/out", quote_all=True)
    assert read_csv(tmp_path / "out") == [["title", "stock", "note"], ['5" disk, "new"', "0", ""]]
    assert sinks.quoted(df).collect()[0].line == '"5"" disk, ""new""","0",""'


def test_report_document(spark, seed, tmp_path):
    doc = sinks.document(summary=reports.sales_summary(seed), items=reports.sales_by_category(seed))
    row = doc.collect()[0]
    assert row.summary[0].total_bills == 1 and row["items"][0].category_name == "Pharmaceuticals"
    sinks.write_json(doc, f"{tmp_path}/doc")
    assert spark.read.json(f"{tmp_path}/doc").count() == 1


def test_missing_and_hot_keys_in_a_lookup(spark):
    from shelfwise.operators.lookup import left_lookup

    fact = spark.createDataFrame([(i, None if i % 3 else 7, "a" if i % 2 else None) for i in range(60)], "n int, k bigint, s string")
    dim = spark.createDataFrame([(7, "seven"), (8, "eight")], "id bigint, name string")
    got = left_lookup(fact, dim, "k", "id", spread_by="n").collect()
    assert len(got) == 60 and sum(r.name == "seven" for r in got) == 20 and sum(r.name is None for r in got) == 40
    words = spark.createDataFrame([("a", 1)], "w string, v int")
    assert sum(r.v == 1 for r in left_lookup(fact, words, "s", "w", spread_by="n").collect()) == 30
