"""Column expressions, value by value."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import dates, values


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "x string").select(expression.alias("y")).collect()[0].y


@pytest.mark.parametrize(
    ("text", "number"),
    [("12", 12), ("12abc", 12), ("3.7", 3), (" 8", 8), ("-1", -1), ("+4", 4), ("x", None), ("", None), (None, None),
     ("99999999999", None)],
)
def test_parse_int(spark, text, number):
    assert one(spark, text, values.parse_int("x")) == number


@pytest.mark.parametrize(
    ("text", "number"),
    [("12.345", "12.345"), (".5", "0.5"), ("7.", "7"), ("1e2", "100"), ("-3.25kg", "-3.25"), ("abc", "0"), (None, "0")],
)
def test_parse_decimal(spark, text, number):
    assert one(spark, text, values.parse_decimal("x", 0)) == D(number)


@pytest.mark.parametrize(("number", "rounded"), [("1.005", "1.01"), ("-1.005", "-1.01"), ("2.344999", "2.34"), ("0", "0")])
def test_round2_ties_go_away_from_zero(spark, number, rounded):
    assert one(spark, number, values.round2(F.col("x").cast("decimal(18,6)"))) == D(rounded)


def test_defaults(spark):
    assert one(spark, "", values.text_or("x", "d")) == "d"
    assert one(spark, "0", values.number_or(F.col("x").cast("int"), 10)) == 10
    assert one(spark, None, values.first_text("x", F.lit(""), default="N/A")) == "N/A"


def test_search_wildcards_and_nulls(spark):
    assert one(spark, "Blue_bolt 5%", values.like_any("e_b", "x")) is True
    assert one(spark, "BlueXbolt", values.like_any("e_b", "x")) is True
    assert one(spark, "BlueXbolt", values.contains_any("e_b", "x")) is False
    assert one(spark, None, values.like_any("a", "x")) is False


@pytest.mark.parametrize(
    ("period", "bounds"),
    [
        ("TODAY", (date(2024, 12, 31), date(2025, 1, 1))),
        ("THIS_WEEK", (date(2024, 12, 24), None)),
        ("THIS_MONTH", (date(2024, 12, 1), date(2025, 1, 1))),
        ("THIS_YEAR", (date(2024, 1, 1), date(2025, 1, 1))),
        ("ALL", (None, None)),
        (None, (None, None)),
    ],
)
def test_period_bounds(period, bounds):
    assert dates.period_bounds(period, date(2024, 12, 31)) == bounds


def test_period_filter_reaches_the_scan(spark):
    from shelfwise.plans import ledger
    from shelfwise.sources import scaled

    tables = scaled.load(spark, "/root/testdata/sf0.001")
    plan = ledger.ledger(tables, period="THIS_MONTH")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
