"""Number expressions: literals, table cells, canonical text, tolerant comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import let, strip

# Digits may be grouped with single underscores. The gate keeps out forms only the JVM accepts
# ("5d", "0x1p3"), which a plain cast would turn into numbers.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT = (
    rf"\A(?:[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|[+-]?(?i:inf|infinity)|(?i:nan))\z"
)
_CELL_NUMBER = r"-?\d+(?:\.\d+)?"
PLAIN_NUMBER = r"\A-?[0-9]+(?:\.[0-9]+)?\z"


def to_double(text: Column) -> Column:
    """Double from number text, null for anything else."""
    # Text that is no number must not reach the cast, which is slow at failing.
    return let(F.regexp_extract(strip(text), _FLOAT, 0), lambda number: F.when(
        number != "", F.replace(number, F.lit("_"), F.lit("")).try_cast("double")))


def _without_marks(text: Column) -> Column:
    return strip(F.replace(F.replace(text, F.lit(","), F.lit("")), F.lit("$"), F.lit("")))


def parse_number(token: Column) -> Column:
    """Literal as double: ``,`` and ``$`` dropped, ``5%`` is 0.05; null when not a number."""
    # Plain digits, the most common writing, need only the cast.
    return F.when(token.rlike(PLAIN_NUMBER), token.cast("double")).otherwise(let(_without_marks(token), lambda t: F.when(
        t.endswith("%"), to_double(F.regexp_replace(t, r"%+\z", "")) / 100).otherwise(to_double(t))))


def parse_cell(cell: Column) -> Column:
    """First number in a table cell, scaled when written as a percentage; null when there is none."""
    def scaled(parts: Column) -> Column:
        t, found = parts["t"], parts["found"]
        value = F.when(found != "", found).cast("double")
        return F.when(t.endswith("%") | F.contains(t, F.concat(found, F.lit("%"))), value / 100).otherwise(value)

    return let(_without_marks(cell), lambda t: let(
        F.struct(t.alias("t"), F.regexp_extract(t, _CELL_NUMBER, 0).alias("found")), scaled))


def double_text(x: Column) -> Column:
    """Shortest decimal text of a double: positional from 1e-4 up to 1e16, else ``1e-05`` style.

    Gives one rendering per value, whatever way the input wrote it.
    """
    jvm = x.cast("string")
    positional = F.regexp_replace(jvm.try_cast("decimal(38,22)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(jvm, "E", 1), r"\.0$", "")
    exponent = F.substring_index(jvm, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa, F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"),
    )
    size = F.abs(x)
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(x == 0, F.when(jvm.startswith("-"), "-0.0").otherwise("0.0"))
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(scientific)
    )


def close_to(pred: Column, gold: Column, rel: float, abs_: float) -> Column:
    """Within a tolerance relative to ``gold`` (not symmetric) or an absolute one."""
    gap = F.abs(pred - gold)
    return ~F.isnan(gap) & (gap <= F.greatest(F.lit(rel) * F.abs(gold), F.lit(abs_)))


def numbers_match(pred_num: Column, pred_text: Column, gold_num: Column, gold_text: Column,
                  rel: float = 0.01, abs_: float = 0.005, allow_percent_scale: bool = False) -> Column:
    """Tolerant comparison of two values, each a number or (when its number is null) a text.

    ``allow_percent_scale`` also accepts a factor of 100 either way; it is off by default because a
    scale error is a real error when scoring.
    """
    numeric = close_to(pred_num, gold_num, rel, abs_)
    if allow_percent_scale:
        numeric = (numeric | close_to(pred_num, gold_num * 100, rel, abs_)
                   | close_to(pred_num, gold_num / 100, rel, abs_))
    same_text = F.lower(strip(pred_text)) == F.lower(strip(gold_text))
    both = pred_num.isNotNull() & gold_num.isNotNull()
    return F.coalesce(F.when(both, numeric).otherwise(same_text), F.lit(False))
