"""Quantities are worked out once a row, whatever reads them, and right on odd texts."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan import queries as own
from sylvan.functions import quantity, scalars
from sylvan.functions.readings import Val, number

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_comparison_parses_a_text_once(spark):
    assert plan(own.queries()["q1_quantity_order"](spark, SF)).count("regexp_extract(") == 2  # its number and its unit


def test_units_are_dealt_to_small_maps():
    slots = json.loads(quantity._slots())
    assert max(len(s) for s in slots) <= 8 and sum(len(s) for s in slots) == len(set(quantity._known()))


def test_every_unit_is_found(spark):
    units = sorted(set(quantity._known()))
    df = spark.createDataFrame([(f"2 {u}", f"2.5{u}/h") for u in units], "one string, two string")
    for (u, row) in zip(units, df.select(quantity.parse(F.col("one")).alias("one"), quantity.parse(F.col("two")).alias("two")).collect(), strict=True):
        base, factor = quantity.unit(u)
        assert tuple(row.one) == (2 * factor, base, 2.0, u)
        assert tuple(row.two) == (2.5 * (factor / 3600), base + "/s", 2.5, u + "/h")


@pytest.mark.parametrize("text", [None, "", "5", "km", "5 xx", "5km/", "5/km", "5 km/xx", "5 xx/h", "5 km/h/s", "5.m", ".5m", "1e3m", "5 m²", "٣ m"])
def test_other_texts_are_none(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(quantity.parse(F.col("t")).alias("q")).first().q is None


def test_comparisons_of_quantities(spark):
    df = spark.createDataFrame([("5km", "4999 m"), ("5 km", "5000m"), ("1 kg", "1 m"), (None, "1m"), ("-1 m", "xx")], "a string, b string")
    a, b = (Val(quantity.parse(F.col(c)), quantity.TYPE) for c in ("a", "b"))
    rows = df.select(quantity.less(">", a, b).alias("more"), quantity.equal(a, b).alias("same"), quantity.less("<", a, quantity.parse_literal("20cm")).alias("short")).collect()
    assert [tuple(r) for r in rows] == [(True, False, False), (False, True, False), (False, False, False), (False, False, False), (False, False, True)]


def test_a_conversion_parses_a_text_once(spark):
    assert plan(own.queries()["q2_quantities"](spark, SF)).count("regexp_extract(") == 2


def test_functions_of_quantities(spark):
    df = spark.createDataFrame([("5 in",), ("1.5ft",), ("2 kg",), (None,)], "t string")
    q = Val(quantity.parse(F.col("t")), quantity.TYPE)
    cm = Val(quantity.convert(q.col, "cm"), quantity.TYPE)
    text = scalars.substitute(cm, "[^0-9.]", "", "g")
    assert [tuple(r) for r in df.select(scalars.show(cm), number(text), scalars.substitute(cm, "[a-z]", "-", "").col, quantity.show(quantity.arithmetic("+", q, quantity.parse_literal("1m")).col)).collect()] == [("12.7cm", 12.7, "12.7-m", "44.37007874015748in"), ("45.720000000000006cm", 45.720000000000006, "45.720000000000006-m", "4.780839895013123ft"), (None, None, "", None), (None, None, "", None)]


@pytest.mark.parametrize("text", [None, "", " 5 ", "5\n", "5\u0085", "5 x", "-1.5e3", ".5", "5.", "+", "1e", "5d", "NaN", "Infinity", "0x1", "1 2"])
def test_a_costly_text_has_the_same_number(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    a, b = (number(Val(F.col("t"), T.StringType(), costly=c)) for c in (False, True))
    row = df.select(a.alias("a"), b.alias("b")).first()
    assert row.a == row.b
