import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions.labels import audit_labels, classify_labels
from evalspark.functions.numbers import double_text, numbers_match, parse_cell, parse_number
from evalspark.functions.programs import evaluate_programs

CATCH = [
    ["north", "trawlers", "boats"],
    ["spring", "$ 71.25", "$ 63.5"],
    ["landed", "$ 8,050", "$ -45 ( 45 )"],
    ["share", "37.5%", "none"],
    ["remarks", "see below", "-"],
    ["south", "trawlers", "boats"],
    ["Spring ", "$ 19.75", "$ 22.4"],
    [],
]
SCHEMA = "program string, table array<array<string>>"


def run(spark, programs, table=CATCH):
    df = spark.createDataFrame([(p, table) for p in programs], SCHEMA)
    rows = evaluate_programs(df, "program", "table").collect()
    return {r["program"]: r for r in rows}


def test_values(spark):
    cases = {
        "subtract(7.25, 5.75), divide(#0, 5.75)": (7.25 - 5.75) / 5.75,
        "divide(4.2, 3%)": 4.2 / (3 / 100),
        "multiply(const_1000, const_3)": 3000.0,
        "multiply(const_m1, 6)": -6.0,
        "subtract(-811, 94)": -905.0,
        "divide(const_1, const_4), exp(81, #0)": 3.0,
        "table_sum(landed, none)": 8005.0,
        "table_max(spring, none)": 22.4,
        "table_min(spring, none)": 19.75,
        "table_average(landed, none)": 4002.5,
        "table_max(share, none)": 0.375,
        "add(8, 9), EOF": 17.0,
        "  add($ 6,5 ), ": 11.0,
        "add(2_500, 4e2)": 2900.0,
        "table_max(landed, none), divide(#0, const_100)": 80.5,
    }
    got = run(spark, list(cases))
    for program, value in cases.items():
        assert got[program]["program_err"] is None, (program, got[program])
        assert got[program]["value_num"] == pytest.approx(value, rel=1e-15), program
        assert got[program]["value_text"] == str(got[program]["value_num"])


def test_plain_digits_are_read_like_any_number(spark):
    """The short cut for plain digits gives what the same number in another spelling gives."""
    numbers = ["0", "-0", "007", "12.50", "-3.125", "9007199254740993", "1" * 400, "0.1"]
    got = run(spark, [f"add({n}, {spelled})" for n in numbers for spelled in ("0", "$ 0", "0_0", ".0")] + [f"add({n}, 0)" for n in ("$ 007", "12.5_0", "+0.1")])
    for n in numbers:
        same = {(got[f"add({n}, {s})"]["value_text"], got[f"add({n}, {s})"]["program_err"]) for s in ("0", "$ 0", "0_0", ".0")}
        assert len(same) == 1, (n, same)
    assert [got[f"add({n}, 0)"]["value_num"] for n in ("$ 007", "12.5_0", "+0.1")] == [got[f"add({n}, 0)"]["value_num"] for n in ("007", "12.50", "0.1")]


def test_trace_and_warning(spark):
    got = run(spark, ["subtract(9, 4), greater(#0, 3)", "table_min(spring, none)"])
    row = got["subtract(9, 4), greater(#0, 3)"]
    assert row["step_values"] == ["5.0", "yes"]
    assert run(spark, ["add(4, 3), divide(#0, 0), add(#1, 6)"]).popitem()[1]["step_values"] == ["7.0"]
    assert row["value_text"] == "yes" and row["value_num"] is None
    assert got["table_min(spring, none)"]["warnings"] == ["ambiguous_row:spring:2_matches"]


def test_error_names(spark):
    cases = {
        " ": "no_steps",
        "subtract(8)": "arity",
        "multiply(4, 5, 6)": "arity",
        "modulo(9, 4)": "unknown_op",
        "divide(9, 4) and so on": "junk",
        "divide(6, 0)": "division_by_zero",
        "multiply(#2, 3)": "forward_reference",
        "subtract(#0, 7)": "forward_reference",
        "add(3, 4), add(#-1, 5)": "bad_reference",
        "add(3, 4), add(#y, 5)": "bad_reference",
        "greater(8, 6), multiply(#0, 2)": "boolean_reference",
        "add(const_many, 4)": "bad_constant",
        "add(seven, 4)": "not_a_number",
        "add(7f, 4)": "not_a_number",
        "table_max(autumn, none)": "row_not_found",
        "table_sum(remarks, none)": "no_numeric_cells",
        "exp(0, -3)": "non_finite",
        "exp(12, 390)": "non_finite",
        "exp(-5, 0.4)": "non_finite",
        # the first failing step decides, argument one before argument two
        "add(3, 4), divide(#0, 0), add(p, q)": "division_by_zero",
        "add(#5, p)": "forward_reference",
        "modulo(3, 4), add(6)": "unknown_op",
    }
    got = run(spark, list(cases))
    assert {p: got[p]["program_err"] for p in cases} == cases
    assert all(r["value_text"] is None for r in got.values())
    assert run(spark, ["table_max(landed, none)"], None)["table_max(landed, none)"]["program_err"] == "no_table"
    assert run(spark, ["table_max(landed, none)"], [])["table_max(landed, none)"]["program_err"] == "no_table"


def test_cells_and_literals(spark):
    df = spark.createDataFrame(
        [("$ -4096 ( 4096 )",), ("37.5%",), ("none",), ("$ 8,765.5 %",), (" 6 ",), ("4%",), ("",), ("3e2",)], "c string")
    rows = df.select("c", parse_cell(F.col("c")).alias("cell"), parse_number(F.col("c")).alias("num")).collect()
    got = {r["c"]: (r["cell"], r["num"]) for r in rows}
    assert got["$ -4096 ( 4096 )"] == (-4096.0, None)
    assert got["37.5%"] == (0.375, 0.375)
    assert got["none"] == (None, None)
    assert got["$ 8,765.5 %"] == (87.655, 87.655)
    assert got[" 6 "] == (6.0, 6.0)
    assert got["4%"] == (0.04, 0.04)
    assert got[""] == (None, None)
    assert got["3e2"] == (3.0, 300.0)


def test_percent_scale_is_opt_in(spark):
    one = spark.range(1)
    num = lambda x: F.lit(x).cast("double")
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    row = one.select(
        numbers_match(num(0.12), no_text, num(12), no_text).alias("a"),
        numbers_match(num(0.12), no_text, num(12), no_text, allow_percent_scale=True).alias("b"),
        numbers_match(none, F.lit(" Yes"), none, F.lit("yes")).alias("c"),
        numbers_match(num(101), no_text, num(100), no_text).alias("d"),
        numbers_match(num(100), no_text, num(98.9), no_text).alias("e"),
        numbers_match(num(float("nan")), no_text, num(1), no_text).alias("f"),
    ).first()
    assert row.asDict() == {"a": False, "b": True, "c": True, "d": True, "e": False, "f": False}


def test_label_classes(spark):
    cases = [("26.3%", "0.26302", "consistent"), ("9%", "0.09198", "rounding"), ("640", "6.4", "conflict"),
             ("no", "no", "boolean"), ("unknown", "2.0", "non_numeric"), ("31%", "31", "consistent"),
             ("", "4", "non_numeric"), ("$ 5,000", "5e3", "consistent")]
    df = spark.createDataFrame(cases, "answer string, exe_ans string, want string")
    for r in classify_labels(df, "answer", "exe_ans").collect():
        assert r["label_status"] == r["want"], r


def test_audit_agreement(spark):
    rows = [("subtract(7.25, 5.75), divide(#0, 5.75)", "0.26087", "26.1%"),
            ("greater(8, 6)", "yes", "yes"), ("add(2, 2)", "7", "4"), ("add(6)", "6", "6")]
    df = spark.createDataFrame([(p, None, e, a) for p, e, a in rows],
                               "program string, table array<array<string>>, exe_ans string, answer string")
    got = [(r["executor_matches_gold"], r["label_status"], r["gold_exe_ans"])
           for r in audit_labels(df, "program", "table", "exe_ans", "answer").collect()]
    assert got == [(True, "consistent", "0.26087"), (True, "boolean", "yes"),
                   (False, "conflict", "7.0"), (False, "consistent", "6.0")]


def test_double_text_is_one_rendering(spark):
    values = [0.0, -0.0, 1.0, 1e-4, 9.9e-5, 1e-5, 123456789.125, 7.7001e8, 1e15, 1e16, 1.5e16, -2.5e-7, 0.1 + 0.2,
              1 / 3, 1e22, 1e-300, 9007199254740993.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(json.dumps(i), v) for i, v in enumerate(values)], "i string, x double")
    got = {r["i"]: r["t"] for r in df.select("i", double_text(F.col("x")).alias("t")).collect()}
    assert [got[str(i)] for i in range(len(values))] == [str(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9), min_size=200, max_size=200))
def test_double_text_round_trips(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", double_text(F.col("x")).alias("t")).collect():
        assert float(r["t"]) == r["x"]


def test_missing_repeated_and_empty_rows_and_bound_values_keep_their_type(spark):
    """A missing, repeated or empty row is its own step's error or warning; what is bound once is read with a kept type."""
    grid = [["", "a", "b"], ["Mix", "9", "9"], [" mix ", "$ 4", "-2 ( x )"], ["none here", "n/a", ""], [], ["one", "50%", "1"]]
    programs = {
        "table_max(mix, none), table_min( MIX , none), table_sum(one, none), table_average(mix, none), add(#0, #2)": ("5.5", None, ["ambiguous_row:mix:2_matches", "ambiguous_row:MIX:2_matches", "ambiguous_row:mix:2_matches"]),
        "table_sum(one, none), table_sum(lost, none)": (None, "row_not_found", []),
        "table_sum(none here, none), add(1, 2)": (None, "no_numeric_cells", []),
        "add(1, 2), divide(#0, 2)": ("1.5", None, []),
    }
    df = spark.createDataFrame([(p, grid) for p in programs] + [("table_sum(one, none)", None)], "program string, grid array<array<string>>")
    done = evaluate_programs(df, "program", "grid")
    got = {r["program"]: (r["value_text"], r["program_err"], r["warnings"]) for r in done.filter("grid is not null").collect()}
    assert got == programs
    assert done.filter("grid is null").first()["program_err"] == "no_table"
    plan = done.select("value_num")._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(transform(array(" in plan
