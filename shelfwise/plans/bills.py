"""Outgoing bills: lines, prices, and the all-or-nothing stock guard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import MONEY, EXACT, PRICE, big, first_text, money, number_or, parse_decimal, parse_int, round2, text_or
from ..operators.components import components
from ..operators.lineage import cut
from ..operators.lookup import left_lookup
from ..operators.running import CHUNK, in_chunks, running_before

LINE_FIELDS = ["product_id", "batch_id", "quantity", "unit_price", "discount_amount", "tax_amount"]

# Lines of a component that are served one by one in a round.
SLICE_ROWS = 1 << 16

# Texts of refusals.
NO_ITEM = "At least one valid item is required for Stock Out dispatch."
BAD_LINE = "Valid Product ID, Batch ID, and Quantity required for all items."
BAD_AMOUNT = "Price, discount and tax must be numbers."
AMOUNT_TOO_LARGE = "Amount is out of range."


def normalise(requests: DataFrame) -> DataFrame:
    """Bill requests with their defaults and always with an ``items`` array."""
    single = F.array(F.struct(*[F.col(f) for f in LINE_FIELDS]))
    day = F.date_format("received_at", "yyyyMMdd")
    kind = text_or("txn_type", "SALE")
    generated = F.concat(F.lit("BILL-"), day, F.lit("-"), F.col("seq").cast("string"))
    return requests.select(
        "seq",
        "received_at",
        text_or("invoice_ref", generated).alias("bill_number"),
        kind.alias("txn_type"),
        F.nullif("customer_name", F.lit("")).alias("customer_name"),
        F.nullif("dept_name", F.lit("")).alias("dept_name"),
        number_or("user_id", 1).cast("bigint").alias("user_id"),
        text_or("remarks", F.concat(F.lit("Stock Out ("), kind, F.lit(")"))).alias("remarks"),
        F.when(F.size("items") > 0, F.col("items")).otherwise(single).alias("items"),
    )


def bill_lines(requests: DataFrame) -> DataFrame:
    """One row per bill line, numbered from 1.

    Every bill has a line, so the outer form gives the same rows; from the plain one Spark
    infers a filter that works the items out several times more.
    """
    headers = normalise(requests)
    return headers.select(
        *[c for c in headers.columns if c != "items"], F.posexplode_outer("items").alias("pos", "item")
    ).select(
        *[c for c in headers.columns if c != "items"],
        (F.col("pos") + 1).alias("line_no"),
        *[F.col(f"item.{f}").alias(f) for f in LINE_FIELDS],
    )


def _total() -> Column:
    return F.round(F.col("qty") * F.col("_price") - F.col("_disc") + F.col("_tax"), 2)


def priced_lines(lines: DataFrame, batches: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with parsed numbers, price, total, and what is wrong with them, if anything.

    A line may name a batch of another product; that is accepted and flagged.
    """
    stock = batches.select(
        F.col("id").alias("_batch"), F.col("product_id").alias("_batch_product"), "selling_price"
    )
    known = products.select(F.col("id").alias("_product"), F.lit(True).alias("_known"))
    spread = lines.withColumn("_line", F.concat_ws("-", "seq", "line_no"))
    found = left_lookup(spread.withColumn("_b", F.col("batch_id")), stock, "_b", "_batch", spread_by="_line")
    found = left_lookup(found.withColumn("_p", F.col("product_id")), known, "_p", "_product", spread_by="_line")

    quantity = parse_int("quantity")
    given = F.nullif("unit_price", F.lit(""))
    price = F.when(F.col("unit_price").isNull(), F.col("selling_price").cast(EXACT)).otherwise(parse_decimal(given))

    def amount(c: str) -> Column:
        text = F.nullif(c, F.lit(""))
        return F.when(text.isNull(), F.lit(0).cast(EXACT)).otherwise(parse_decimal(text))

    numbers = found.select(
        "*", quantity.alias("qty"), price.alias("_price"), amount("discount_amount").alias("_disc"),
        amount("tax_amount").alias("_tax"),
    )
    missing = (
        F.coalesce(F.col("product_id"), F.lit(0)) == 0) | (F.coalesce(F.col("batch_id"), F.lit(0)) == 0
    ) | (F.coalesce(F.col("qty"), F.lit(0)) <= 0)
    problem = (
        F.when((F.col("line_no") == 1) & (F.coalesce(F.col("product_id"), F.lit(0)) == 0), NO_ITEM)
        .when(missing, BAD_LINE)
        .when(
            F.col("_batch_product").isNull(),
            F.concat(F.lit("Batch ID "), F.col("batch_id").cast("string"), F.lit(" not found in database.")),
        )
        .when(F.col("_known").isNull(), F.concat(F.lit("Product ID "), F.col("product_id").cast("string"), F.lit(" not found.")))
        .when(F.col("_price").isNull() | F.col("_disc").isNull() | F.col("_tax").isNull(), BAD_AMOUNT)
        .when(
            F.col("_price").try_cast(PRICE).isNull() | F.col("_disc").try_cast(PRICE).isNull()
            | F.col("_tax").try_cast(PRICE).isNull() | _total().try_cast(PRICE).isNull(),
            AMOUNT_TOO_LARGE,
        )
    )
    total = _total().try_cast(MONEY)
    keep = [c for c in lines.columns if c not in ("quantity", "unit_price", "discount_amount", "tax_amount")]
    return numbers.select(
        *keep,
        "qty",
        F.col("_price").try_cast(PRICE).alias("unit_price"),
        F.col("_disc").try_cast(PRICE).alias("discount_amount"),
        F.col("_tax").try_cast(PRICE).alias("tax_amount"),
        total.alias("total_amount"),
        (F.col("_batch_product") != F.col("product_id")).alias("batch_product_mismatch"),
        problem.alias("problem"),
    )


def cart_additions(lines: DataFrame, batches: DataFrame) -> DataFrame:
    """Sound lines with what the cart makes of each: ``accepted``, ``in_cart`` (units of its row by then) and ``reason``.

    Lines are added in order. One on a product and batch that the cart has already adds to
    that row; an addition beyond the batch's stock is refused and leaves the row as it is.
    The lines of one bill are one request document, so they are gathered per row.
    """
    stock = batches.select(F.col("id").alias("_batch"), big("available_qty").alias("_available"), F.col("batch_number").alias("_number"))
    line = F.struct("line_no", big("qty").alias("qty"), "unit_price", "discount_amount")
    rows = lines.groupBy("seq", "product_id", "batch_id").agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    rows = rows.join(stock, F.col("batch_id") == F.col("_batch"), "left")
    zero = F.lit(0).cast("bigint")

    def add(held: Column, line: Column) -> Column:
        fits = F.coalesce(held["units"] + line["qty"] <= F.col("_available"), F.lit(False))
        units = F.when(fits, held["units"] + line["qty"]).otherwise(held["units"])
        return F.struct(units.alias("units"), F.concat(held["done"], F.array(F.struct(fits.alias("accepted"), units.alias("in_cart")))).alias("done"))

    start = F.struct(zero.alias("units"), F.array().cast("array<struct<accepted:boolean,in_cart:bigint>>").alias("done"))
    done = F.aggregate("_lines", start, add)["done"]
    each = rows.withColumn("_done", done).select("seq", "product_id", "batch_id", "_available", "_number", F.explode(F.arrays_zip("_lines", "_done")).alias("_l"))
    lost, short, beyond = (
        F.concat(F.lit("Batch ID "), F.col("batch_id").cast("string"), F.lit(" not found in database.")),
        F.format_string("Requested %d units, but selected batch only has %d units available.", "qty", "_available"),
        F.format_string("Cannot exceed %d units for Batch #%s.", "_available", "_number"),
    )
    return each.select("seq", "product_id", "batch_id", "_l._lines.*", "_l._done.*", "_available", "_number").withColumn(
        "reason", F.when(~F.col("accepted"), F.when(F.col("_available").isNull(), lost).when(F.col("qty") > F.col("_available"), short).otherwise(beyond))
    ).drop("_available", "_number")


def merged_lines(lines: DataFrame, batches: DataFrame) -> DataFrame:
    """Cart rows: accepted lines of one bill on the same product and batch become one.

    The row keeps the first line's place, price and discount. Its subtotal goes by the latest
    line's price and discount, and that discount grows with the quantity: it is per line, not
    per unit.
    """
    cart = cart_additions(lines, batches).filter("accepted").groupBy("seq", "product_id", "batch_id").agg(
        F.min("line_no").alias("line_no"),
        big(F.sum("qty")).alias("quantity"),
        big(F.count(F.lit(1))).alias("merged"),
        F.min_by(F.struct("unit_price", "discount_amount"), "line_no").alias("first"),
        F.max_by(F.struct("qty", "unit_price", "discount_amount"), "line_no").alias("last"),
    )
    qty, last = F.col("quantity"), F.col("last.qty")
    exact = (qty * F.col("last.unit_price")).cast(EXACT) - (
        F.col("last.discount_amount").cast(EXACT) * qty.cast("decimal(10,0)") / last.cast("decimal(10,0)")
    )
    return cart.select(
        "seq", "product_id", "batch_id", "line_no", "quantity", "merged",
        money("first.unit_price").alias("unit_price"),
        money("first.discount_amount").alias("discount_amount"),
        round2(F.greatest(F.lit(0).cast(EXACT), exact.cast(EXACT))).alias("subtotal"),
    )


def cart_rejects(lines: DataFrame, batches: DataFrame) -> DataFrame:
    """(seq, line_no, batch_id, qty, reason) of the lines that a cart refuses."""
    return cart_additions(lines, batches).filter(~F.col("accepted")).select("seq", "line_no", "batch_id", "qty", "reason")


def bill_totals(cart: DataFrame) -> DataFrame:
    return cart.groupBy("seq").agg(
        big(F.count(F.lit(1))).alias("line_count"), money(F.sum("subtotal")).alias("bill_total")
    )


def _server():
    """Serves bills one by one, component after component, as a closure that needs nothing of this package."""

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[int, int] = {}
        at, wants, seqs, passed = None, [], [], []

        def close() -> None:
            ok = all(left - used.get(batch, 0) >= qty for batch, qty, left in wants)
            for batch, qty, _ in wants if ok else ():
                used[batch] = used.get(batch, 0) + qty
            seqs.append(at[1])
            passed.append(ok)

        for lines in batches:
            for root, seq, batch, qty, left in zip(*[lines.column(i).to_pylist() for i in range(5)]):
                if at != (root, seq):
                    if at is not None:
                        close()
                        if at[0] != root:
                            used.clear()
                    at, wants = (root, seq), []
                wants.append((batch, qty, left))
            yield pa.record_batch({"seq": pa.array(seqs, pa.int64()), "_served": pa.array(passed, pa.bool_())})
            seqs, passed = [], []
        if at is not None:
            close()
            yield pa.record_batch({"seq": pa.array(seqs, pa.int64()), "_served": pa.array(passed, pa.bool_())})

    return serve


def _served(lines: DataFrame) -> DataFrame:
    """(seq, _served) of the earliest bills of every component of open lines, as many as ``SLICE_ROWS`` lines hold.

    Bills that share a batch, directly or through others, are one component; components do
    not touch one another, so each is served in order by itself. Spark packs them into tasks.
    """
    placed = cut(lines.join(components(lines, "seq", "batch_id"), "batch_id"), "components")
    large = placed.groupBy("root").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > SLICE_ROWS)
    large = cut(large.select("root", F.lit(True).alias("_large")), "large")
    if not large.isEmpty():
        bills = placed.join(large, "root").groupBy("root", "seq").agg(F.count("*").alias("_rows"))
        ahead = running_before(in_chunks(bills, "root", "seq"), "root", "seq", {"_before": F.col("_rows")})
        late = ahead.filter(F.col("_before") >= SLICE_ROWS).select("seq")
        placed = placed.join(late, "seq", "left_anti")
    dealt = placed.select("root", "seq", "batch_id", "qty", "_left").repartition("root").sortWithinPartitions("root", "seq")
    return dealt.mapInArrow(_server(), "seq bigint, _served boolean")


def settle(demand: DataFrame, opening: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """All-or-nothing decision on every bill, as if bills were served one by one.

    ``demand`` holds (seq, batch_id, qty) with one row per bill and batch, ``opening``
    (batch_id, available_qty), ``receipts`` (seq, batch_id, qty) stock that arrives
    in the same order; sequence numbers are unique across bills and receipts.
    Returns demand with ``accepted`` and the balance the bill found.

    Each round bounds the balance each open line can find: at least what is left if all
    earlier open lines pass, at most what is left if none does. A bill whose lines all
    fit the lower bound is accepted, one with a line above the upper bound is refused.
    From the second round on, the bills still open fall into components that share no
    batch, and each component's earliest bills are served one by one, all components side
    by side. Only open rows go into the next round.
    """
    start = opening.select("batch_id", F.col("available_qty").cast("bigint").alias("_opening"))
    zero = F.lit(0).cast("bigint")
    rows = demand.select("seq", "batch_id", big("qty").alias("qty"), zero.alias("_in"))
    if receipts is not None:
        rows = rows.unionByName(receipts.select("seq", "batch_id", zero.alias("qty"), big("qty").alias("_in")))
    placed = in_chunks(rows.join(start, "batch_id", "left").fillna(0, ["_opening"]), "batch_id", "seq")
    if receipts is not None:
        placed = running_before(placed, "batch_id", "seq", {"_arrived": F.col("_in")})
        placed = placed.filter(F.col("_in") == 0).withColumn("_opening", F.col("_opening") + F.col("_arrived"))
    columns = ["seq", "batch_id", "qty", "_opening", CHUNK]
    state = placed.select(*columns, F.col("_opening").alias("_left"), F.lit(False).alias("_taken"))
    decided: list[DataFrame] = []
    left_open = True
    while left_open:
        seen = running_before(
            state,
            "batch_id",
            "seq",
            {
                "_gone": F.when(F.col("_taken"), F.col("qty")).otherwise(0),
                "_ahead": F.when(F.col("_taken"), 0).otherwise(F.col("qty")),
            },
        )
        lines = cut(seen.filter(~F.col("_taken")).withColumn("_left", F.col("_left") - F.col("_gone")), "open")
        fits = F.col("_ahead") + F.col("qty") <= F.col("_left")
        fails = F.col("qty") > F.col("_left")
        bills = lines.groupBy("seq").agg(F.bool_and(fits).alias("_ok"), F.bool_or(fails).alias("_bad"))
        verdict = F.when(F.col("_ok"), True).when(F.col("_bad"), False)
        judged = lines.join(bills, "seq")
        if decided:
            judged = judged.join(_served(lines), "seq", "left")
            verdict = F.coalesce("_served", verdict)
        step = cut(judged.select(*columns, "_left", verdict.alias("accepted")), "bills")
        decided.append(step.filter(F.col("accepted").isNotNull()).drop("_left"))
        if len(decided) == 16:
            decided = [cut(reduce(DataFrame.unionByName, decided), "bills")]
        left_open = not step.filter(F.col("accepted").isNull()).isEmpty()
        state = step.filter(F.coalesce("accepted", F.lit(True))).select(
            *columns, "_left", F.coalesce("accepted", F.lit(False)).alias("_taken")
        )
    settled = reduce(DataFrame.unionByName, decided)
    found = running_before(settled, "batch_id", "seq", {"_used": F.when(F.col("accepted"), F.col("qty")).otherwise(0)})
    return found.select(
        "seq", "batch_id", "qty", "accepted", (F.col("_opening") - F.col("_used")).alias("available")
    )


def bill_demand(priced: DataFrame) -> DataFrame:
    """Demand per bill and batch of the bills whose lines are all sound."""
    return (
        priced.groupBy("seq", "batch_id")
        .agg(big(F.sum("qty")).alias("qty"))
        .join(sound_bills(priced), "seq", "left_semi")
    )


def sound_bills(priced: DataFrame) -> DataFrame:
    return priced.groupBy("seq").agg(F.count("problem").alias("_n")).filter(F.col("_n") == 0).select("seq")


def guard_outcome(settled: DataFrame) -> DataFrame:
    """(seq, accepted, lines) per bill of a settled demand."""
    return settled.groupBy("seq").agg(
        F.bool_and("accepted").alias("accepted"), big(F.count(F.lit(1))).alias("line_count")
    )


def bill_rejects(priced: DataFrame, settled: DataFrame) -> DataFrame:
    """(seq, reason) of every refused bill: unsound lines first, then missing stock.

    Of several reasons the earliest line's counts. Two lines of one bill on one batch
    are reported with their summed quantity.
    """
    unsound = (
        priced.filter(F.col("problem").isNotNull())
        .groupBy("seq")
        .agg(F.min_by("problem", "line_no").alias("reason"))
    )
    places = priced.groupBy("seq", "batch_id").agg(F.min("line_no").alias("line_no"))
    short = settled.filter(~F.col("accepted") & (F.col("qty") > F.col("available")))
    text = F.format_string(
        "Insufficient stock in selected batch! Requested: %d, Available: %d", "qty", "available"
    )
    refused = (
        short.join(places, ["seq", "batch_id"])
        .groupBy("seq")
        .agg(F.min_by(text, "line_no").alias("reason"))
    )
    return unsound.unionByName(refused)


def bill_ledger(priced: DataFrame, settled: DataFrame) -> DataFrame:
    """Ledger rows of the accepted bills, one per line, quantities negative."""
    accepted = guard_outcome(settled).filter("accepted").select("seq")
    day = F.date_format("received_at", "yyyyMMdd")
    return priced.join(accepted, "seq", "left_semi").select(
        F.concat_ws("-", F.lit("TXN-OUT"), day, "seq", "line_no").alias("txn_number"),
        "txn_type", "product_id", "batch_id",
        (-F.col("qty")).cast("int").alias("quantity"),
        "unit_price", "discount_amount", "tax_amount",
        F.col("total_amount").try_cast(PRICE).alias("total_amount"),
        F.lit(None).cast("bigint").alias("supplier_id"),
        "customer_name", "dept_name",
        F.col("bill_number").alias("invoice_ref"),
        F.lit("PAID").alias("payment_status"),
        "remarks", "user_id",
        F.col("received_at").alias("txn_date"),
    )


@dataclass(frozen=True)
class CheckedOut:
    """Outcome of a run of bills."""

    lines: DataFrame
    settled: DataFrame

    @property
    def ledger(self) -> DataFrame:
        return bill_ledger(self.lines, self.settled)

    @property
    def rejects(self) -> DataFrame:
        return bill_rejects(self.lines, self.settled)


def check_out(requests: DataFrame, products: DataFrame, batches: DataFrame) -> CheckedOut:
    """Serve bill requests in ``seq`` order against the stored batches."""
    lines = cut(priced_lines(bill_lines(requests), batches, products), "bills")
    opening = batches.select(F.col("id").alias("batch_id"), "available_qty")
    return CheckedOut(lines, settle(bill_demand(lines), opening))


def batches_after(batches: DataFrame, settled: DataFrame) -> DataFrame:
    """Batches with the accepted demand taken off."""
    used = settled.filter("accepted").groupBy(F.col("batch_id").alias("id")).agg(F.sum("qty").alias("_used"))
    left = F.col("available_qty") - F.coalesce("_used", F.lit(0))
    return batches.join(used, "id", "left").withColumn("available_qty", left.cast(batches.schema["available_qty"].dataType)).drop("_used")
