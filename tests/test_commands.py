from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.functions import numbers
from tabulon.operators import pricing
from tabulon.plans.commands import Plan, Rule, interpret, parse_all, parse_groups, plan_from_json, read_values


@pytest.mark.parametrize(
    ("text", "kind", "value", "step", "mode"),
    [
        ("10% increase", "ok", 10, 0, "nearest"), ("discount 5%", "ok", -5, 0, "nearest"), ("-5%", "ok", -5, 0, "nearest"), ("15%", "direction", 15, None, None),
        ("10% increase round up 1000", "ok", 10, 1000, "up"), ("10% up and 5% down", "remote", None, None, None), ("row 3 10% increase", "remote", None, None, None),
        ("همه قیمت ها ۱۰ درصد افزایش", "ok", 10, 0, "nearest"), ("۵٪ تخفیف، رند به ۱۰۰۰ پایین", "ok", -5, 1000, "down"), ("۱۰ درصد افزایش رند کن", "ok", 10, -1, "nearest"),
    ],
)
def test_for_all(text, kind, value, step, mode):
    out = parse_all(text)
    assert out.kind == kind
    if kind == "ok":
        assert (out.plan.rules[0].value, out.plan.step, out.plan.mode) == (value, step, mode)
    elif kind == "direction":
        assert out.percent == value


def test_groups():
    groups = ["پژو 405", "پژو 206", "پراید"]
    out = parse_groups("گروه پژو ۱۰ درصد افزایش، پراید ۵ درصد کاهش، بقیه ۳ درصد افزایش", groups)
    assert [(r.groups, r.value) for r in out.plan.rules] == [(None, 3), (frozenset(["پژو 405", "پژو 206"]), 10), (frozenset(["پراید"]), -5)]
    assert parse_groups("پژو405 ۱۰ درصد و پراید ۵ درصد افزایش", groups).plan.rules[0].groups == frozenset(["پژو 405"])
    assert parse_groups("۱۰ درصد افزایش برای پراید", groups).plan.rules[0].groups == frozenset(["پراید"])
    assert parse_groups("پراید", groups).kind == "remote"
    assert interpret("پراید ۱۰ درصد افزایش", groups).plan.rules[0].groups == frozenset(["پراید"])


def test_remote_plans():
    plan = plan_from_json('{"rules":[{"op":"percent","value":5,"scope":"all"},{"op":"set","value":7,"ids":["a","zz"]},{"op":"odd"}],"rounding":{"step":50,"mode":"sideways"}}', "", {"a"})
    assert [(r.op, r.ids) for r in plan.rules] == [("percent", None), ("set", frozenset(["a"]))]
    assert (plan.step, plan.mode) == (50, "nearest")
    assert plan.with_rounding(10, "up").step == 10 and plan_from_json("not json", "", set()).rules == ()


@pytest.mark.parametrize(
    ("text", "n", "want"),
    [("34.8", 2, {1: "34.8"}), ("6.2 53.7", 2, {0: "6.2", 1: "53.7"}), ("بالا ۱۰ پایین ۵", 2, {0: "10", 1: "5"}), ("row 2 10k", 3, {1: "10K"}), ("all 5", 3, {0: "5", 1: "5", 2: "5"}), ("2,500", 1, {0: "2500"}), ("hello", 2, None)],
)
def test_read_values(text, n, want):
    assert read_values(text, n)[0] == want


def test_read_values_refuses():
    assert read_values("1 2 3", 2)[1] and read_values("row 5 10", 2)[1]
    assert read_values("see 5 of these", 1, strict=True) == (None, None)


def test_rule_precedence(spark):
    rows = spark.createDataFrame([("a", "", Decimal(100), 0), ("b", "", Decimal(100), 0), ("c", "", Decimal(100), 0)], "id string, grp string, value decimal(18,2), decimals int")
    plan = Plan((Rule("percent", Decimal(5)), Rule("percent", Decimal(10), ids=frozenset("ab")), Rule("set", Decimal(7), ids=frozenset("b")), Rule("set", Decimal(1), ids=frozenset())))
    assert {r.id: float(r.new) for r in pricing.compute(rows, plan).collect()} == {"a": 110, "b": 7, "c": 105}


@pytest.mark.parametrize(("value", "op", "operand", "want"), [(300, "add", -500, 0), (300, "set", 300, None), (12500, "percent", 0, None)])
def test_clamp_and_unchanged(spark, value, op, operand, want):
    rows = spark.createDataFrame([("a", "", Decimal(value), 0)], "id string, grp string, value decimal(18,2), decimals int")
    got = pricing.compute(rows, Plan((Rule(op, Decimal(operand)),))).collect()
    assert [float(r.new) for r in got] == ([] if want is None else [want])


GOLDEN = {
    "۳/۶۹۶/۰۰۰": (3696000, "/", ""), "58,000,000": (58000000, ",", ""), "3 /432/000": (3432000, "/", ""), "1.250": (1250, ".", ""), "12 345": (12345, " ", ""), "4950,000": (4950000, ",", ""),
    "6.850,000": (6850000, ",", ""), "12.5": (12.5, "", "."), "۷۶/۵": (76.5, "", "/"), "1405/06": (1405.06, "", "/"), "1,234.50": (1234.5, ",", "."), "12a34": (1234, "", ""),
    "1405/06/23": None, "05.06.21": None, "1,23456": None, "1 2": None, "100 3,696,000": None, "": None,
}


def test_parse_number_golden(spark):
    df = spark.createDataFrame([(t,) for t in GOLDEN], "t string").select("t", numbers.parse_number(F.col("t")).alias("p"))
    for r in df.collect():
        assert (None if r.p is None else (float(r.p.value), r.p.group_sep, r.p.decimal_sep)) == GOLDEN[r.t], r.t


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1000, 10**9), st.sampled_from([",", "٬", "/"]), st.sampled_from(["latin", "persian", "arabic"])), min_size=1, max_size=30))
def test_format_round_trip(spark, rows):
    df = spark.createDataFrame([(Decimal(v), s, k) for v, s, k in rows], "v decimal(18,2), sep string, script string")
    text = numbers.format_number(F.col("v"), F.col("script"), F.col("sep"), F.lit(""), F.lit(0))
    for r in df.select("v", "sep", "script", numbers.parse_number(text).alias("p")).collect():
        assert (float(r.p.value), r.p.group_sep, r.p.script) == (float(r.v), r.sep, r.script)
