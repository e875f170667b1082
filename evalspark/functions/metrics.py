"""Rank metrics as expressions over the sorted 1-based ranks of a question's gold units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut-offs, the metrics that are reported, compared and selected on.
KS = (1, 3, 5, 10)
METRICS = ("rr",) + tuple(f"{m}_at_{k}" for k in KS for m in ("recall", "all_gold", "ndcg"))
HEADLINE = ("recall_at_3", "recall_at_5", "recall_at_10", "all_gold_at_3", "all_gold_at_5", "all_gold_at_10",
            "rr", "ndcg_at_5", "ndcg_at_10")
SELECTION = "all_gold_at_5"
COMPARED = (SELECTION, "ndcg_at_10", "recall_at_3")

_GAIN = [1 / math.log2(rank + 1) for rank in range(1, max(KS) + 1)]
_IDEAL = [math.fsum(_GAIN[:g]) for g in range(1, max(KS) + 1)]
_EULER = 0.57721566490153286061


def _at(values: list[float], i: Column) -> Column:
    """Element of a short constant list, 1-based."""
    return F.get(F.array(*map(F.lit, values)), i.cast("int") - 1)


def recall_at(ranks: Column, k: int) -> Column:
    return F.size(F.filter(ranks, lambda r: r <= k)) / F.size(ranks)


def all_gold_at(ranks: Column, k: int) -> Column:
    return (F.array_max(ranks) <= k).cast("double")


def reciprocal_rank(ranks: Column) -> Column:
    return F.lit(1.0) / F.array_min(ranks)


def ndcg_at(ranks: Column, k: int) -> Column:
    """Binary gain 1/log2(rank+1), over the best that many gold units could reach."""
    gained = F.aggregate(F.filter(ranks, lambda r: r <= k), F.lit(0.0), lambda acc, r: acc + _at(_GAIN, r))
    return gained / _at(_IDEAL, F.least(F.size(ranks), F.lit(k)))


def rank_metrics(ranks: Column) -> dict[str, Column]:
    """All 13 metrics by name."""
    out = {"rr": reciprocal_rank(ranks)}
    for k in KS:
        out[f"recall_at_{k}"] = recall_at(ranks, k)
        out[f"all_gold_at_{k}"] = all_gold_at(ranks, k)
        out[f"ndcg_at_{k}"] = ndcg_at(ranks, k)
    return out


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n without a loop over n: summed up to 30, by its asymptotic series beyond."""
    small = F.aggregate(F.filter(F.sequence(F.lit(0), F.least(n, F.lit(30)).cast("int")), lambda i: i > 0),
                        F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / i)
    x = n.cast("double")
    square = x * x
    series = (F.log(x) + _EULER + F.lit(0.5) / x - F.lit(1.0) / (12 * square)
              + F.lit(1.0) / (120 * square * square) - F.lit(1.0) / (252 * square * square * square))
    return F.when(n <= 30, small).otherwise(series)


def random_metrics(n: Column, g: Column) -> dict[str, Column]:
    """Exact expectation of all 13 metrics when g gold units lie uniformly among n candidates.

    Constant work per row. For the reciprocal rank, the sum over r of C(n-r, g-1)/r equals
    C(n, g-1) (H(n) - H(g-1)), which over C(n, g) leaves g/(n-g+1) (H(n) - H(g-1)).
    """
    size, gold = n.cast("double"), g.cast("double")
    valid = F.when((g >= 1) & (g <= n), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("need 1 <= g <= n, got g="), g.cast("string"), F.lit(", n="), n.cast("string"))))
    out = {"rr": F.when(valid, gold / (size - gold + 1) * (harmonic(n) - harmonic(g - 1)))}
    for k in KS:
        seen = F.least(n, F.lit(k)).cast("int")
        out[f"recall_at_{k}"] = seen / size
        # All g in the first `seen`: a product of g factors, zero as soon as g exceeds them.
        draws = F.sequence(F.lit(0), F.least(g, F.lit(k)).cast("int") - 1)
        chance = F.aggregate(draws, F.lit(1.0), lambda p, i: p * (seen - i) / (size - i))
        out[f"all_gold_at_{k}"] = F.when(g > seen, 0.0).otherwise(chance)
        out[f"ndcg_at_{k}"] = gold * _at(_IDEAL, seen) / size / _at(_IDEAL, F.least(g, F.lit(k)))
    return out


def expected_random(n: Column, g: Column) -> Column:
    """The expectations as one struct, fields named like the metrics."""
    return F.struct(*[c.alias(name) for name, c in random_metrics(n, g).items()])
