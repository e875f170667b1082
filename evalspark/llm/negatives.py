"""Hard negatives of anchors by a secondary-sort shuffle of pair scores.

Vectors become whole numbers (``floor(scale * x)``), so scores are exact. Anchors and rows meet block by block: a pair of
blocks is one small matrix product. A first pass keeps the best same-label rows of each anchor and block, and the first of all
of them are its positives. The second pass knows the windows of negative scores that these positives open, and keeps per
anchor, block and window the first rows of other labels, which is all that can be among the first of the whole window.

Positives and kept negatives are then packed into keys (anchor, descending score, positives first, id), dealt by anchor and sorted
within their partitions (the DataFrame form of ``repartitionAndSortWithinPartitions``). An iterator streams over them: a positive
opens its window, a negative is emitted for each open window that holds its score and isn't full. It holds the windows of one anchor.

Rows without id or label, with a null vector, or with a null or non-finite component take no part. Every row is a row of its
own, also where ids repeat: a copy of an anchor is another row, and repeated anchors give their rows each. Ties go to the smaller id.
Vectors of different lengths are compared as if the shorter one ended in zeros; an empty vector scores 0 with all. A positive score
below zero opens an empty window; zero opens that of zero alone. Scores of 2**56 or more are refused by name. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalspark.llm.arrow import arrow_schema
from evalspark.scratch import materialize

BLOCK = 8_192  # rows, or anchors, of one block
BLOCK_NUMBERS = 1 << 22  # components of one block, for long vectors
CHUNK = 1 << 20  # scores held at once
LIMIT = float(1 << 56)  # a hundred times a score is still a 64-bit number
EXACT = float(1 << 53)  # whole numbers up to here are exact as doubles
PAIRS = "anchor bigint, anchor_id bigint, id bigint, score bigint"
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``row, id, label, v`` of the rows that take part; ``row`` tells rows with the same id apart."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                    F.col(vector_col).cast("array<double>").alias("x"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("x", whole))
        .select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Exact scores of some rows of ``a`` with all of ``b``, chunk after chunk, with the place of the first."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide].T
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(wide, 1)
    if bound >= LIMIT:
        raise ValueError(f"scores may reach {bound:.3g}; vectors whose scores may reach 2**56 are refused")
    if bound >= EXACT:
        a, b = a.astype(np.int64), b.astype(np.int64)
    step = max(1, CHUNK // max(1, b.shape[1]))
    for i in range(0, len(a), step):
        yield i, (a[i:i + step] @ b).astype(np.int64)


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, find, extra: list[str]) -> DataFrame:
    """``find`` over every pair of an anchor block and a row block."""
    schema = arrow_schema(PAIRS)

    def empty() -> pa.Table:
        return schema.empty_table()

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty()
        right = right.sort_by("id")  # so that a stable sort by score leaves ties in the order of ids
        found = list(find(left, right))
        if not found:
            return empty()
        at = np.concatenate([np.full(len(j), i) for i, j, _ in found])
        take = lambda t, name, k: t.column(name).take(pa.array(k))
        return pa.table({"anchor": take(left, "row", at), "anchor_id": take(left, "id", at),
                         "id": take(right, "id", np.concatenate([j for _, j, _ in found])),
                         "score": np.concatenate([s for _, _, s in found])}).cast(schema)

    dealt = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    anchor_dealt = F.pmod(F.xxhash64("row"), F.lit(anchor_blocks)).alias("anchors")
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)
    left = anchors.select("row", "id", "label", "v", *extra, anchor_dealt, every(blocks, "block"))
    right = rows.select("row", "id", "label", "v", dealt, every(anchor_blocks, "anchors"))
    keys = ["anchors", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, PAIRS)


def _parts(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def positives_of(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, k: int) -> DataFrame:
    """``anchor, anchor_id, id, score``: the first ``k`` other rows of each anchor's label."""

    def find(left: pa.Table, right: pa.Table):
        (mine, label), (row, labels) = _parts(left, "row", "label"), _parts(right, "row", "label")
        for first, scores in _scores(_matrix(left.column("v")), _matrix(right.column("v"))):
            for i, s in enumerate(scores, first):
                same = np.flatnonzero((labels == label[i]) & (row != mine[i]))
                best = same[np.argsort(-s[same], kind="stable")[:k]]
                if len(best):
                    yield i, best, s[best]

    best = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    return (_met(rows, anchors, blocks, anchor_blocks, find, [])
            .withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k).drop("at"))


def negatives_of(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, k: int, low: int, high: int) -> DataFrame:
    """``anchor, anchor_id, id, score``: per block the first ``k`` rows of other labels of each window of ``anchors`` (with ``opened``: positive scores)."""

    def find(left: pa.Table, right: pa.Table):
        (label,), (labels,) = _parts(left, "label"), _parts(right, "label")
        opened = left.column("opened").to_pylist()
        for first, scores in _scores(_matrix(left.column("v")), _matrix(right.column("v"))):
            for i, s in enumerate(scores, first):
                other = np.flatnonzero(labels != label[i])
                other = other[np.argsort(-s[other], kind="stable")]
                falling = -100 * s[other]
                keep = set()
                for p in set(opened[i]):
                    start = np.searchsorted(falling, -high * p, "left")
                    end = np.searchsorted(falling, -low * p, "right")
                    keep.update(range(start, min(end, start + k)))
                if keep:
                    some = other[sorted(keep)]
                    yield i, some, s[some]

    return _met(rows, anchors, blocks, anchor_blocks, find, ["opened"])


def stream_windows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Mined rows of pairs sorted by anchor, descending score, positives first, id."""
    at, windows = None, []
    for batch in batches:
        out = []
        for anchor, anchor_id, kind, other, score in zip(*(c.to_pylist() for c in batch.columns)):
            if anchor != at:
                at, windows = anchor, []
            if kind == 0:
                windows.append([other, score, 0])
                continue
            for w in windows:
                if w[2] < k and low * w[1] <= 100 * score <= high * w[1]:
                    w[2] += 1
                    out.append((anchor_id, w[0], w[2], other, w[1], score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``id``. For each anchor and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels whose score is between ``low`` and ``high`` hundredths of the positive's.
    """
    rows = materialize(usable(rows, id_col, label_col, vector_col, scale), "vectors")
    asked = F.coalesce(anchors, F.lit(False))
    n, n_anchors, wide = rows.agg(F.count("*"), F.count_if(asked), F.max(F.size("v"))).first()
    block = max(1, min(block, BLOCK_NUMBERS // max(1, wide or 1)))
    blocks, anchor_blocks = max(1, -(-n // block)), max(1, -(-n_anchors // block))
    asking = materialize(rows.filter(asked), "anchors")
    found = materialize(positives_of(rows, asking, blocks, anchor_blocks, positives), "positives")
    opened = found.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("opened"))  # at most ``positives`` of them
    asking = asking.join(opened, "row")
    kept = negatives_of(rows, asking, blocks, anchor_blocks, negatives, low, high)
    pairs = found.withColumn("kind", F.lit(0)).unionByName(kept.withColumn("kind", F.lit(1)))
    keys = pairs.select("anchor", "anchor_id", "kind", "id", "score", (-F.col("score")).alias("worse"))
    dealt = keys.repartition("anchor").sortWithinPartitions("anchor", "worse", "kind", "id").drop("worse")
    schema = arrow_schema(MINED)
    return dealt.mapInArrow(lambda batches: stream_windows(batches, schema, negatives, low, high), MINED)
