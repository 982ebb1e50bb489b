"""Receipts and bills against requests served one by one, however they are cut into runs."""

from __future__ import annotations

import datetime
import random

import pytest

from shelfwise.operators.components import components
from shelfwise.plans import bills, products, receipts
from shelfwise.sources import schemas

NOW = datetime.datetime(2026, 8, 8, 10)
PRODUCT = "id bigint, sku string, barcode string, title string, category_id int, unit_of_measure string, min_reorder_level int, domain_preset string"
BATCH = (
    "id bigint, batch_number string, product_id bigint, expiry_date date, serial_number string, available_qty bigint,"
    " purchase_price decimal(10,2), selling_price decimal(10,2), batch_discount_percent decimal(5,2), offer_description string"
)


def stored_products():
    return [(i, f"S{i}", f"B{i}" if i % 3 else None, f"Title {i % 25}", 1, "Pcs", 10, "GENERAL") for i in range(1, 41)]


def contested(rng: random.Random, count: int) -> list[dict]:
    """Receipts that fight over few SKUs, titles and barcodes, in any case, and some that name a product of the run."""
    rows = []
    for seq in range(1, count + 1):
        row = {"seq": seq, "received_at": NOW, "quantity": str(rng.randrange(1, 9)), "batch_number": f"L{rng.randrange(4)}", "purchase_price": str(rng.randrange(1, 50))}
        kind = rng.random()
        if kind < 0.1:
            row["product_id"] = rng.choice([rng.randrange(1, 60), receipts.NEW_ID_BASE + rng.randrange(1, seq + 1)])
        else:
            row["sku"] = rng.choice([None, f"s{rng.randrange(1, 80)}", f"N{rng.randrange(600)}", f"n{rng.randrange(600)}"])
            row["product_title"] = rng.choice([None, f"title {rng.randrange(40)}", f"New {rng.randrange(500)}", f"NEW {rng.randrange(500)}"])
            row["barcode"] = rng.choice([None, None, f"b{rng.randrange(1, 45)}", f"X{rng.randrange(200)}"])
        rows.append(row)
    return rows


def served_one_by_one(rows: list[dict]) -> tuple[dict, dict, set]:
    """(stock by product and batch, created products, refused) as a shop with one clerk has them."""
    skus = {p[1].lower(): p[0] for p in stored_products()}
    titles: dict[str, int] = {}
    for p in stored_products():
        titles.setdefault(p[3].lower(), p[0])
    bars, ids = {p[2].lower() for p in stored_products() if p[2]}, {p[0] for p in stored_products()}
    stock, created, refused = {}, {}, set()
    for r in rows:
        target = r.get("product_id")
        if target is not None:
            if target not in ids:
                refused.add(r["seq"])
                continue
        else:
            sku = r["sku"] or f"SKU-20260808-{r['seq']}"
            title = r["product_title"] or "New Received Item"
            target = skus.get(sku.lower(), titles.get(title.lower()))
            if target is None:
                bar = r["barcode"]
                if bar and bar.lower() in bars:
                    refused.add(r["seq"])
                    continue
                target = receipts.NEW_ID_BASE + r["seq"]
                created[target] = (sku, title, bar)
                ids.add(target)
                skus[sku.lower()] = titles[title.lower()] = target
                if bar:
                    bars.add(bar.lower())
        key = (target, r["batch_number"])
        stock[key] = stock.get(key, 0) + int(r["quantity"])
    return stock, created, refused


@pytest.mark.parametrize("runs,count", [(1, 10_000), (3, 2_000), (10, 400)])
def test_contested_receipts(spark, runs, count):
    rows = contested(random.Random(runs), count)
    stock, created, refused = served_one_by_one(rows)
    products, batches = spark.createDataFrame(stored_products(), PRODUCT), spark.createDataFrame([], BATCH)
    got_created, got_refused = {}, set()
    for i in range(runs):
        some = spark.createDataFrame(rows[i * count // runs : (i + 1) * count // runs], schemas.RECEIPT_REQUEST)
        done = receipts.receive(some, products, batches)
        new = done.new_products.collect()
        got_created |= {p.id: (p.sku, p.title, p.barcode) for p in new}
        got_refused |= {r.seq for r in done.rejects.collect()}
        products = spark.createDataFrame(products.collect() + [tuple(p[c] for c in products.columns) for p in new], PRODUCT)
        batches = spark.createDataFrame(done.batches.collect(), BATCH)
    assert got_created == created and got_refused == refused
    assert {(b.product_id, b.batch_number): b.available_qty for b in batches.collect()} == stock
    assert created and refused and len({k[0] for k in stock if k[0] >= receipts.NEW_ID_BASE}) < count / 2


def updates(rng: random.Random, count: int) -> list[dict]:
    return [
        {"seq": seq, "id": rng.randrange(1, 62), "title": rng.choice(["T", "U", "V", ""]), "sku": rng.choice([None, f"s{rng.randrange(1, 70)}", f"S{rng.randrange(1, 60)}", f"N{rng.randrange(9)}"]),
         "barcode": rng.choice([None, f"B{rng.randrange(1, 60)}", f"b{rng.randrange(1, 90)}"])}
        for seq in range(count)
    ]


def updated_one_by_one(rows: list[dict], stored: dict[int, tuple]) -> tuple[dict, set]:
    now, refused = {i: (s.lower(), b and b.lower()) for i, (s, b, _) in stored.items()}, set()
    titles = {i: t for i, (_, _, t) in stored.items()}
    for r in rows:
        want = (r["sku"] and r["sku"].lower(), r["barcode"] and r["barcode"].lower())
        others = [v for i, v in now.items() if i != r["id"]]
        clash = any(v[0] == want[0] or (want[1] and v[1] == want[1]) for v in others)
        if r["id"] not in now or not r["title"] or not want[0] or clash:
            refused.add(r["seq"])
        else:
            now[r["id"]], titles[r["id"]] = want, r["title"]
    return {i: (*now[i], titles[i]) for i in now}, refused


@pytest.mark.parametrize("runs,count", [(1, 900), (3, 300)])
def test_updates_take_values_that_others_freed(spark, runs, count):
    fields = "seq bigint, id bigint, title string, sku string, barcode string"
    rest = ["category_id", "unit_of_measure", "min_reorder_level", "domain_preset", "brand", "storage_location"]
    rows = updates(random.Random(runs), count)
    stored = {i: (f"S{i}", f"B{i}" if i % 4 else None, "old") for i in range(1, 61)}
    want, refused = updated_one_by_one(rows, stored)
    columns = "id bigint, sku string, barcode string, title string, category_id bigint, unit_of_measure string, min_reorder_level int, domain_preset string, brand string, storage_location string"
    held = spark.createDataFrame([(i, *v, 1, "Pcs", 1, "GENERAL", None, None) for i, v in stored.items()], columns)
    got_refused = set()
    for i in range(runs):
        some = [tuple(r[k] for k in ("seq", "id", "title", "sku", "barcode")) for r in rows[i * count // runs : (i + 1) * count // runs]]
        asked = spark.createDataFrame(some, fields)
        asked = asked.select("*", *[products.F.lit(None).cast(held.schema[c].dataType).alias(c) for c in rest])
        after, why = products.update(asked, held)
        got_refused |= {r.seq for r in why.collect()}
        held = spark.createDataFrame(after.select(*held.columns).collect(), held.schema)
    assert got_refused == refused
    assert {r.id: (r.sku.lower(), r.barcode and r.barcode.lower(), r.title) for r in held.collect()} == want


def served_bills(demand: dict[int, dict[int, int]], left: dict[int, int]) -> dict[int, bool]:
    out = {}
    for seq in sorted(demand):
        out[seq] = all(left[b] >= q for b, q in demand[seq].items())
        if out[seq]:
            for b, q in demand[seq].items():
                left[b] -= q
    return out


def test_many_chains_end_in_a_few_rounds(spark, monkeypatch):
    """200,000 lines of bills that hang on one another, in 500 components that do not touch."""
    rounds = []
    real = bills.cut
    monkeypatch.setattr(bills, "cut", lambda df, label="step": rounds.append(label) or real(df, label))
    rng = random.Random(8)
    demand, stock = {}, {}
    for seq in range(100_000):
        group = rng.randrange(500) * 10
        a, b = rng.sample(range(10), 2)
        demand[seq] = {group + a: rng.randrange(1, 30), group + b: rng.randrange(1, 30)}
        stock.setdefault(group + a, rng.randrange(200, 900))
        stock.setdefault(group + b, rng.randrange(200, 900))
    want = served_bills(demand, dict(stock))
    df = spark.createDataFrame([(s, b, q) for s, ls in demand.items() for b, q in ls.items()], "seq bigint, batch_id bigint, qty bigint")
    opening = spark.createDataFrame(list(stock.items()), "batch_id bigint, available_qty bigint")
    got = {r.seq: r.accepted for r in bills.guard_outcome(bills.settle(df, opening)).collect()}
    assert got == want and rounds.count("bills") <= 3


@pytest.mark.parametrize("slice_rows", [1, 40])
def test_a_component_larger_than_a_slice(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(bills, "SLICE_ROWS", slice_rows)
    rng = random.Random(slice_rows)
    size = 12 if slice_rows == 1 else 300
    demand = {s: {b: rng.randrange(1, 9) for b in rng.sample(range(6), rng.randrange(1, 4))} for s in range(size)}
    stock = {b: size // 2 for b in range(6)}
    want = served_bills(demand, dict(stock))
    df = spark.createDataFrame([(s, b, q) for s, ls in demand.items() for b, q in ls.items()], "seq bigint, batch_id bigint, qty bigint")
    opening = spark.createDataFrame(list(stock.items()), "batch_id bigint, available_qty bigint")
    assert {r.seq: r.accepted for r in bills.guard_outcome(bills.settle(df, opening)).collect()} == want


def test_components_of_chains_stars_and_loners(spark):
    rng = random.Random(3)
    links = [(i, i) for i in range(400)] + [(i, i + 1) for i in range(399)]  # a path in order
    links += [(1000 + i, rng.choice([5000, 5001 + i])) for i in range(300)] + [(2000 + i, 9000 + i) for i in range(20)]
    rows = spark.createDataFrame(links + links[:50], "thing bigint, key bigint")
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for thing, key in links:
        a, b = top(("t", thing)), top(("k", key))
        parent[max(a, b)] = min(a, b)
    least = {}
    for key in {k for _, k in links}:
        least.setdefault(top(("k", key)), []).append(key)
    want = {k: min(ks) for ks in least.values() for k in ks}
    assert {r.key: r.root for r in components(rows, "thing", "key").collect()} == want
    assert components(rows.limit(0), "thing", "key").collect() == []


def test_components_drop_what_nothing_links_any_more(spark, monkeypatch):
    from shelfwise.operators import components as module

    written = []

    def counted(df, label="step"):
        out = cut(df, label)
        written.append((label, out.count()))
        return out

    cut = module.cut
    monkeypatch.setattr(module, "cut", counted)
    alone = [(f"a{i}", f"x{i}") for i in range(50)]
    chain = [(f"c{i}", f"k{(i + d) * 37 % 101:03}") for i in range(60) for d in (0, 1)]
    rows = spark.createDataFrame(alone + chain, "thing string, key string")
    got = {r.key: r.root for r in components(rows, "thing", "key").collect()}
    assert {k: r for k, r in got.items() if k.startswith("x")} == {k: k for _, k in alone}
    assert {r for k, r in got.items() if k.startswith("k")} == {"k000"}
    links = [n for label, n in written if label == "links"]
    assert links[0] == 170 and links[1] <= 120 and links[-1] < links[0] / 2


def test_the_clerk_gets_numbers_of_contested_values_and_returns_refusals_alone():
    import pyarrow as pa

    from shelfwise.plans.products import SKU_USED, _clerk

    names = ["root", "seq", "id", "n_sku", "n_bar", "_sku_owner", "_bar_owner", "n_old_sku", "n_old_bar"]
    rows = [
        (1, 1, 7, 5, None, 8, None, 4, None),  # wants what 8 holds
        (1, 2, 8, None, None, None, None, 5, None),  # lets go of it
        (1, 3, 7, 5, None, 8, None, 4, None),  # can have it now
        (2, 4, 9, 6, None, 9, None, 6, None),
    ]
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
    got = [r for b in _clerk()(iter([batch])) for r in b.to_pylist()]
    assert got == [{"seq": 1, "_why": SKU_USED}]
