"""Arithmetic programs as native expressions.

A program is ``op(arg, arg), op(arg, arg), ...``; an argument is a number, ``n%``, ``const_N``,
``const_mN``, ``#k`` (result of step k), a table row label, or ``none``. A whole questions table is
evaluated in a few projections and no shuffle: parse the steps, resolve everything that does not
depend on earlier values, then fold the numbers over the steps. Failures become an error name, never an
exception, so one bad program cannot stop a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.numbers import PLAIN_NUMBER, double_text, parse_cell, parse_number, to_double
from evalspark.functions.text import let, strip

# Operation names and the step pattern.
BINARY_OPS = ("add", "subtract", "multiply", "divide", "exp", "greater")
TABLE_OPS = ("table_max", "table_min", "table_sum", "table_average")
STEP_PATTERN = r"(?U)(\w+)\(([^()]*)\)"

_NUMBERS = "array<double>"


def _argument(arg: Column, steps: Column, i: Column) -> Column:
    """Number or step reference of an argument of step ``i``, or why it is neither.

    References can be judged here: the steps before ``i`` are known, and only ``greater`` is not a number.
    """
    body = F.regexp_replace(arg, "^const_", "")
    const = F.when(body.startswith("m"), -to_double(F.substring(body, 2, 1_000_000))).otherwise(to_double(body))
    is_ref, is_const = arg.startswith("#"), arg.startswith("const_")

    def judged(a: Column) -> Column:
        err = (
            F.when(~is_ref, F.when(a["num"].isNull(), F.when(is_const, "bad_constant").otherwise("not_a_number")))
            .when(a["ref"].isNull(), "bad_reference")
            .when(a["ref"] >= i, "forward_reference")
            .when(F.get(steps, a["ref"])["op"] == "greater", "boolean_reference")
        )
        return F.struct(a["num"].alias("num"), a["ref"].alias("ref"), err.alias("err"))

    # Most arguments are plain digits, which need none of this.
    plain = F.struct(arg.cast("double").alias("num"), F.lit(None).cast("int").alias("ref"), F.lit(None).cast("string").alias("err"))
    return F.when(arg.rlike(PLAIN_NUMBER), plain).otherwise(let(F.struct(
        F.when(is_const, const).when(~is_ref, parse_number(arg)).alias("num"),
        F.when(is_ref, F.regexp_extract(arg, r"^#\s*\+?(\d+)\s*$", 1).try_cast("int")).alias("ref"),
    ), judged))


def _row_values(label: Column, table: Column) -> Column:
    """Numeric cells of the last row carrying ``label``, with how many rows carry it."""
    def summary(rows: Column) -> Column:
        cells = F.try_element_at(rows, F.lit(-1))
        numbers = F.filter(
            F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(0))), parse_cell),
            lambda v: v.isNotNull(),
        )
        return F.struct(F.size(rows).alias("hits"), numbers.alias("vals"))

    def hits(key: Column) -> Column:
        return F.filter(table, lambda r: F.coalesce(F.lower(strip(F.get(r, F.lit(0)))) == key, F.lit(False)))

    return let(let(F.lower(strip(label)), hits), summary)


def _table_outcome(step: Column, table: Column) -> Column:
    """Value, error and warning of a table operation."""
    label = F.get(step["parts"], F.lit(0))

    def outcome(found: Column) -> Column:
        vals = found["vals"]
        total = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v)
        value = (
            F.when(step["op"] == "table_max", F.array_max(vals))
            .when(step["op"] == "table_min", F.array_min(vals))
            .when(step["op"] == "table_sum", total)
            .otherwise(F.try_divide(total, F.size(vals)))
        )
        err = (
            F.when(F.size(table) < 1, "no_table")
            .when(found["hits"] < 1, "row_not_found")
            .when(F.size(vals) < 1, "no_numeric_cells")
        )
        warning = F.when(
            found["hits"] > 1,
            F.concat(F.lit("ambiguous_row:"), label, F.lit(":"), found["hits"].cast("string"), F.lit("_matches")),
        )
        return F.struct(value.alias("num"), err.alias("err"), warning.alias("warning"))

    return let(_row_values(label, table), outcome)


def _resolved(step: Column, i: Column, steps: Column, table: Column) -> Column:
    """A step with everything filled in that does not depend on earlier values."""
    def parts(r: Column) -> Column:
        return F.struct(
            step["op"].alias("op"),
            r["a"]["num"].alias("x"), r["a"]["ref"].alias("x_ref"), r["b"]["num"].alias("y"), r["b"]["ref"].alias("y_ref"),
            r["tab"]["num"].alias("tab"),
            F.coalesce(r["tab"]["err"], r["a"]["err"], r["b"]["err"]).alias("err"),
            r["tab"]["warning"].alias("warning"),
        )

    is_table = step["op"].isin(*TABLE_OPS)
    argument = lambda n: F.when(~is_table, _argument(F.get(step["parts"], F.lit(n)), steps, i))
    return let(F.struct(argument(0).alias("a"), argument(1).alias("b"),
                        F.when(is_table, _table_outcome(step, table)).alias("tab")), parts)


def _value(step: Column, done: Column) -> Column:
    """Number of a step from the numbers before it; yes and no are 1 and 0, division by zero is null."""
    x = F.coalesce(step["x"], F.get(done, step["x_ref"]))
    y = F.coalesce(step["y"], F.get(done, step["y_ref"]))
    op = step["op"]
    return (
        F.when(op == "add", x + y)
        .when(op == "subtract", x - y)
        .when(op == "multiply", x * y)
        .when(op == "divide", F.try_divide(x, y))
        .when(op == "exp", F.pow(x, y))
        .when(op == "greater", ((x > y) & ~F.isnan(x)).cast("double"))
        .otherwise(step["tab"])
    )


def parse_programs(df: DataFrame, program: str) -> DataFrame:
    """Add ``steps`` (array of op and argument texts) and ``parse_err`` (null when well formed)."""
    text = strip(F.coalesce(F.col(program), F.lit("")))
    text = F.regexp_replace(strip(F.regexp_replace(text, r"EOF\z", "")), r",+\z", "")
    split_arguments = lambda a: F.transform(F.split(a, ",", -1), strip)
    return (
        df.withColumn("_text", text)
        .withColumns({
            "_ops": F.regexp_extract_all("_text", F.lit(STEP_PATTERN), F.lit(1)),
            "_args": F.regexp_extract_all("_text", F.lit(STEP_PATTERN), F.lit(2)),
            "_rest": strip(F.replace(F.regexp_replace("_text", STEP_PATTERN, ""), F.lit(","), F.lit(""))),
        })
        .withColumn("steps", F.zip_with(
            "_ops", "_args", lambda o, a: F.struct(o.alias("op"), split_arguments(a).alias("parts"))))
        .withColumn("parse_err", F.when(F.size("_ops") == 0, "no_steps").when(F.col("_rest") != "", "junk").otherwise(
            F.get(F.filter(
                F.transform("steps", lambda s: F.when(~s["op"].isin(*BINARY_OPS, *TABLE_OPS), "unknown_op")
                            .when(F.size(s["parts"]) != 2, "arity")),
                lambda e: e.isNotNull()), F.lit(0))))
        .drop("_text", "_ops", "_args", "_rest")
    )


def evaluate_programs(df: DataFrame, program: str, table: str | None = None) -> DataFrame:
    """Add ``steps``, ``step_values``, ``value_num``, ``value_text``, ``warnings`` and ``program_err``.

    ``step_values`` are the results up to the first failing step, as text. ``value_text`` is the canonical
    number text or yes/no; on an error it is null, like ``value_num``, and there are no warnings.
    """
    no_table = F.array().cast("array<array<string>>")
    grid = F.coalesce(F.col(table), no_table) if table else no_table

    # Every step gets a number (null or not finite where it failed); the first failure then decides.
    failure = F.zip_with("_resolved", "_done", lambda s, v: F.coalesce(
        s["err"],
        F.when((s["op"] == "divide") & v.isNull(), "division_by_zero")
        .when(F.isnan(v) | (F.abs(v) == float("inf")), "non_finite")))
    def as_text(op: Column, v: Column) -> Column:
        return F.when(op == "greater", F.when(v == 1, "yes").otherwise("no")).otherwise(double_text(v))

    text = F.zip_with("_resolved", "_done", lambda s, v: as_text(s["op"], v))
    good = F.col("program_err").isNull()
    return (
        parse_programs(df, program)
        .withColumn("_grid", grid)
        .withColumn("_resolved", F.when(F.col("parse_err").isNull(), F.transform(
            "steps", lambda s, i: _resolved(s, i, F.col("steps"), F.col("_grid")))))
        .withColumn("_done", F.aggregate("_resolved", F.array().cast(_NUMBERS),
                                         lambda done, s: F.concat(done, F.array(_value(s, done)))))
        .withColumn("_fail", failure)
        .withColumn("program_err", F.coalesce("parse_err", F.get(F.filter("_fail", lambda e: e.isNotNull()), F.lit(0))))
        .withColumns({
            "_op": F.when(good, F.try_element_at("_resolved.op", F.lit(-1))),
            "_last": F.when(good, F.try_element_at("_done", F.lit(-1))),
        })
        .withColumns({
            "step_values": F.coalesce(
                F.when(good, text),
                F.slice(text, F.lit(1), F.array_position(F.transform("_fail", lambda e: e.isNotNull()), True).cast("int") - 1),
                F.array().cast("array<string>")),
            "value_num": F.when(F.col("_op") != "greater", F.col("_last")),
            "value_text": as_text(F.col("_op"), F.col("_last")),
            "warnings": F.when(good, F.filter(F.col("_resolved.warning"), lambda w: w.isNotNull()))
            .otherwise(F.array().cast("array<string>")),
        })
        .drop("_grid", "_resolved", "_done", "_fail", "_op", "_last", "parse_err")
    )
