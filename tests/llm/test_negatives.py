import math
import random

import pytest
from pyspark.sql import functions as F
from rows import clashing

from evalspark.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, every, positives=5, k=10, low=30, high=90):
    used = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, va, la) in enumerate(used):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, la == label) for b, (i, v, label) in enumerate(used) if b != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(anchor, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every, **options):
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % every == 0, **options).collect())


def made(n=150, dim=6):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0, rng.uniform(-1, 1)]) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 2) for i in range(20)]  # ties: copies of one vector
    rows += [rows[0], rows[10], (10, rows[11][1], 2)]  # repeated rows, and an id with two vectors
    rows += [(300, [0.0] * dim, 1), (310, [], 1), (320, [1.0], 0), (330, [1.0] * (dim + 3), 1)]
    rows += [(400, None, 1), (410, [1.0, None], 1), (420, [float("nan")] * dim, 1), (430, [float("inf")] * dim, 1), (440, [1.0] * dim, None), (None, [1.0] * dim, 1)]
    return [(i, v and [float(__import__("struct").unpack("f", __import__("struct").pack("f", x))[0]) if x is not None else None for x in v] if v is not None else None, label)
            for i, v, label in rows]


@pytest.mark.parametrize("block", [negatives.BLOCK, 16])
def test_rows_equal_brute_force(spark, block):
    assert mined(spark, made(), 10, block=block) == by_hand(made(), 10)


def test_other_limits(spark):
    assert mined(spark, made(80), 4, positives=2, negatives=3, low=10, high=100, block=30) == by_hand(made(80), 4, 2, 3, 10, 100)


def test_zero_and_negative_positives(spark):
    """A positive at zero opens the window of zero, also for smaller ids; one below zero opens an empty one."""
    rows = [(10, [1.0, 0.0], 0), (11, [0.0, 1.0], 0), (1, [0.0, 2.0], 1), (12, [0.0, 3.0], 1), (13, [-1.0, 0.0], 0), (14, [-0.5, 0.0], 1)]
    assert mined(spark, rows, 10) == by_hand(rows, 10) == [(10, 11, 1, 1, 0, 0), (10, 11, 2, 12, 0, 0)]


def test_large_whole_scores_are_exact_and_larger_ones_refused(spark):
    rows = [(0, [2.0**18, 1.0], 0), (1, [2.0**18, 3.0], 0), (2, [2.0**17, 1 / 256], 1), (3, [2.0**17, 2 / 256], 1)]
    assert mined(spark, rows, 2) == by_hand(rows, 2)
    with pytest.raises(Exception, match="2\\*\\*56"):
        mined(spark, [(0, [1e30], 0), (1, [1e30], 0)], 1)


def test_empty_tables(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(1, [1.0], 0), (3, [1.0], 1)], 2) == []
