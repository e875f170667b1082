"""The prefix trie of conversations from sorted matrices of turn ids.

A turn's id is a 128-bit digest of its role and text; a conversation is the row of its turns' ids. Rows are dealt by ranges of
(path of ids, conversation), so that even equal conversations are split over shards. Within a shard ids become dense numbers, and the rows
a matrix, padded with 0 and sorted by ``lexsort``. Column ``d`` of the mask of changes from row to row, OR-accumulated over the columns,
tells where a node of depth ``d`` starts, and ``reduceat`` over these starts gives members, smallest member and ends of all nodes
of that depth. Matrices are made for ``WIDE`` columns at a time, of those rows only that are as long, so that one long conversation pads no other.

Nodes that hold neither the first nor the last row of a shard lie in it whole, with all below them. The others, two paths a
shard, are recombined: counts are added by node, and what they hold below them are differences of running sums
over the order of the rows. Ends of a recombined node are hashed by a stream over its sorted runs of ids.

Turns are ordered by turn, null first, then by digest. A null role or text is empty; rows without a conversation id take no part.
Repeated rows are turns of their own. An empty table has no nodes. Other columns are not read. A conversation is one row: its ids and
sizes (20 bytes a turn, no texts) have to fit a task. The hash of a node's ends is sequential by definition: its ids go through one task, in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalspark.llm.arrow import arrow_schema
from evalspark.scratch import materialize

SHARD = 16_384  # turns of a shard, about
WIDE = 64  # columns of a matrix
RUN = 512  # ids of one run of ends
ID = 16  # bytes of a turn id
NOTHING = hashlib.sha256(b"").hexdigest()
WHOLE, OPEN, ENDS = 0, 1, 2  # kinds of rows a shard gives
NODES = ("kind int, shard int, node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, size bigint, first bigint, last bigint, run bigint, ends array<bigint>, ends_sha256 string")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turns``: each conversation's turns in order, as structs of ``id`` (32 hex digits) and ``size`` (code points of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).isNotNull().alias("numbered"), F.col(turn_col).alias("turn"),
                    F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.char_length(text).alias("size"))
    kept = turns.select(F.col(conv_col).cast("bigint").alias("conv"), turn.alias("t")).filter("conv IS NOT NULL")
    return kept.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(found: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Conversations whose first ``shared`` turns (a number up to ``most``) are those of the conversation ``base``; both are expressions on ``conv``."""
    heads = found.filter(base == F.col("conv")).select(F.col("conv").alias("base"), F.slice("turns", 1, most).alias("head"))
    both = found.withColumn("base", base).join(heads, "base", "left")
    h, own = shared.cast("int"), F.col("turns")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice(own, 1, 0))
    return both.select("conv", F.concat(head, F.slice(own, h + 1, F.size(own))).alias("turns"))


# ---------- one shard ----------

def _dense(words: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the ids (two words each), in their order."""
    order = np.lexsort((words[:, 1], words[:, 0]))
    sorted_ = words[order]
    new = np.ones(len(words), np.int64)
    new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    out = np.empty(len(words), np.int64)
    out[order] = np.cumsum(new)
    return out


def _padded(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int, wide: int) -> np.ndarray:
    """Columns ``at`` to ``at + wide`` of ragged rows, 0 beyond their ends."""
    columns = np.arange(at, at + wide)
    inside = columns < lengths[:, None]
    out = np.zeros(inside.shape, np.int64)
    out[inside] = values[(starts[:, None] + columns)[inside]]
    return out


def _levels(conv: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    """The order of the rows, and per depth from 1 on the nodes: start, end (last row), n, low, ends, size, turn (place of the last turn's id)."""
    starts = np.cumsum(lengths) - lengths
    order = np.lexsort((conv,))
    group = np.zeros(len(conv), np.int64)  # of each sorted row: equal in all columns before
    levels, at = [], 0
    while at < lengths.max(initial=0):
        wide = int(min(WIDE, lengths.max() - at))
        # rows as long as this, and those that are equal to one so far; equal rows are neighbours
        alive = np.flatnonzero(np.isin(group, group[lengths[order] > at]))
        rows = order[alive]
        matrix = _padded(ids, starts[rows], lengths[rows], at, wide)
        by = np.lexsort((conv[rows], *matrix.T[::-1], group[alive]))
        rows, matrix, before = rows[by], matrix[by], group[alive][by]
        order[alive] = rows
        changed = np.ones(matrix.shape, bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        changed[1:, 0] |= before[1:] != before[:-1]
        changed = np.logical_or.accumulate(changed, axis=1)
        length = lengths[rows]
        for k in range(wide):
            bounds = np.flatnonzero(changed[:, k])
            n = np.diff(np.append(bounds, len(rows)))
            real = matrix[bounds, k] > 0  # not the pads of a shorter row
            low = np.minimum.reduceat(conv[rows], bounds)
            ends = np.add.reduceat((length == at + k + 1).astype(np.int64), bounds)
            bounds, n, low, ends = bounds[real], n[real], low[real], ends[real]
            turn = starts[rows[bounds]] + at + k
            levels.append({"start": alive[bounds], "end": alive[bounds + n - 1], "n": n, "low": low, "ends": ends, "size": sizes[turn], "turn": turn})
        # the rows equal in all columns up to here; numbers grow along the order
        fresh = np.zeros(len(order), np.int64)
        fresh[alive] = changed[:, -1]
        first = np.zeros(len(order), bool)
        first[1:] = group[1:] != group[:-1]
        group = np.cumsum((fresh > 0) | first)
        at += wide
    return order, levels


def shard_nodes(conv: np.ndarray, lengths: np.ndarray, path: bytes, sizes: np.ndarray, shard: int) -> Iterator[dict]:
    """Rows of ``NODES`` for the conversations of one shard."""
    raw = np.frombuffer(path, ">u8").astype(np.uint64).reshape(-1, 2)
    order, levels = _levels(conv, lengths, _dense(raw), sizes)
    sorted_conv, last = conv[order], len(conv) - 1
    root = {"start": np.array([0]), "end": np.array([last]), "n": np.array([len(conv)]), "low": np.array([conv.min()]),
            "ends": np.array([int((lengths == 0).sum())]), "size": np.array([0]), "turn": np.array([-1]), "up": np.array([-1])}
    levels = [root, *levels]
    keys: list[dict[int, bytes]] = [{0: hashlib.md5(b"").digest()}]
    for above, level in zip(levels, levels[1:]):
        level["up"] = np.searchsorted(above["start"], level["start"], "right") - 1
        edge = np.flatnonzero((level["start"] == 0) | (level["end"] == last))
        keys.append({int(i): hashlib.md5(keys[-1][int(level["up"][i])] + path[ID * level["turn"][i]:ID * (level["turn"][i] + 1)]).digest() for i in edge})
    for level in levels:
        level["open"] = (level["start"] == 0) | (level["end"] == last)
        for name in ("children", "leaves", "saved"):
            level[name] = np.zeros(len(level["start"]), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        level, whole = levels[depth], ~levels[depth]["open"]
        level["leaves"][whole & (level["children"] == 0)] += 1  # all children of a whole node are whole
        level["saved"][whole] += ((level["n"] - 1) * level["size"])[whole]
        if depth:
            above, up = levels[depth - 1], level["up"][whole]
            np.add.at(above["children"], up, 1)
            np.add.at(above["leaves"], up, level["leaves"][whole])
            np.add.at(above["saved"], up, level["saved"][whole])
    for depth, level in enumerate(levels):
        above = levels[depth - 1] if depth else None
        for i in range(len(level["start"])):
            up, start, open_ = int(level["up"][i]), int(level["start"][i]), bool(level["open"][i])
            ended = sorted_conv[start:start + int(level["ends"][i])]  # those that end here stand first, by id
            top = depth > 0 and not open_ and bool(above["open"][up])
            yield {"kind": OPEN if open_ else WHOLE, "shard": shard, "node": keys[depth][i] if open_ else None,
                   "parent": keys[depth - 1][up] if depth and (open_ or top) else None, "depth": depth, "conv_id": int(level["low"][i]),
                   "parent_conv_id": int(above["low"][up]) if depth and not open_ and not top else None, "n_convs": int(level["n"][i]),
                   "n_children": int(level["children"][i]), "n_leaves": int(level["leaves"][i]), "saved_tokens": int(level["saved"][i]),
                   "size": int(level["size"][i]), "first": start, "last": int(level["end"][i]), "run": None, "ends": None,
                   "ends_sha256": None if open_ else hashlib.sha256(",".join(map(str, ended.tolist())).encode()).hexdigest() if len(ended) else NOTHING}
            for run, a in enumerate(range(0, len(ended) if open_ else 0, RUN)):
                yield {"kind": ENDS, "shard": shard, "node": keys[depth][i], "run": run, "ends": ended[a:a + RUN].tolist()}


def _shards(rows: DataFrame) -> DataFrame:
    """``NODES`` of ``rows`` (conv, path, sizes), which are dealt by ranges."""
    schema = arrow_schema(NODES)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        table = pa.Table.from_batches(given)
        conv, path, sizes = (table.column(c).combine_chunks() for c in ("conv", "path", "sizes"))
        lengths = np.diff(sizes.offsets.to_numpy()).astype(np.int64)
        flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        some: list[dict] = []
        for node in shard_nodes(conv.to_numpy(), lengths, b"".join(path.to_pylist()), flat, TaskContext.get().partitionId()):
            some.append(node)
            if len(some) == 10_000:
                yield pa.RecordBatch.from_pylist(some, schema=schema)
                some = []
        yield pa.RecordBatch.from_pylist(some, schema=schema)

    return rows.mapInArrow(build, NODES)


# ---------- shards together ----------

def _hashed_ends(runs: DataFrame) -> DataFrame:
    """``node, ends_sha256``: runs sorted by node and place go through a hash each, of which only one is open."""
    out = "node binary, ends_sha256 string"
    schema = arrow_schema(out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            done = []
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = ",".join(map(str, ends)).encode()
                if node == at:
                    sha.update(b"," + text)
                    continue
                if at is not None:
                    done.append((at, sha.hexdigest()))
                at, sha = node, hashlib.sha256(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], schema[0].type), pa.array([sha.hexdigest()])], schema=schema)

    return runs.repartition("node").sortWithinPartitions("node", "shard", "run").select("node", "ends").mapInArrow(stream, out)


def _recombined(nodes: DataFrame) -> DataFrame:
    """The open nodes of all shards as whole ones: ``node`` and the columns of ``RESULT``."""
    merged = nodes.filter(F.col("kind") == OPEN).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.first("size").alias("size"), F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        F.min(F.struct("shard", "first")).alias("start"), F.max(F.struct("shard", "last")).alias("end"))
    merged = materialize(merged, "open-nodes")
    below = merged.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n")).select(F.col("parent").alias("node"), "n")
    own = merged.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("n", F.lit(0)))
    leaves = F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")
    own = materialize(own.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "start", "end", leaves.alias("leaves"), saved.alias("saved")), "open-sums")

    # Below a node is what starts between its first row and its last, and not above it: a difference of running sums.
    event = lambda start, at, row, leaves, saved: F.struct(
        F.lit(start).alias("starts"), F.col(at)["shard"].alias("shard"), F.col(at)[row].alias("row"), leaves.alias("leaves"), saved.alias("saved"))
    none = F.lit(0).cast("bigint")
    events = own.select("node", "depth", F.inline(F.array(event(True, "start", "first", F.col("leaves"), F.col("saved")), event(False, "end", "last", none, none))))
    so_far = W.partitionBy("shard").orderBy("row", F.desc("starts"), "depth").rowsBetween(W.unboundedPreceding, 0)
    totals = events.groupBy("shard").agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))  # one row a shard
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("shard", *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("leaves", "saved")])
    running = events.select("node", "starts", "shard", *[(F.sum(c).over(so_far) - F.when(F.col("starts"), F.col(c)).otherwise(0)).alias(c) for c in ("leaves", "saved")])
    sign = F.when(F.col("starts"), -1).otherwise(1)
    sums = running.join(before, "shard").groupBy("node").agg(*[
        F.sum(sign * (F.col(c) + F.col(f"before_{c}"))).alias(name) for c, name in (("leaves", "n_leaves"), ("saved", "saved_tokens"))])

    above = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hashes = _hashed_ends(nodes.filter(F.col("kind") == ENDS))
    return (own.join(above, "parent", "left").join(sums, "node").join(hashes, "node", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select("node", *RESULT))


def trie(found: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node of the conversations ``found`` (conv, turns): ``RESULT``.

    ``conv_id`` is the smallest member, ``n_leaves`` and ``saved_tokens`` cover the node and all below it, ``ends_sha256`` hashes the members that end here.
    """
    rows = materialize(found.select(
        "conv", F.unhex(F.array_join("turns.id", "")).alias("path"), F.col("turns.size").alias("sizes")), "turn-ids")
    total = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // shard)), "path", "conv")
    nodes = materialize(_shards(dealt), "shard-nodes")
    joined = materialize(_recombined(nodes), "recombined")
    whole = nodes.filter(F.col("kind") == WHOLE)
    # Only the topmost whole nodes have a parent elsewhere; it is looked up by shard, so no parent gathers its children.
    edge = (nodes.filter(F.col("kind") == OPEN).select("shard", F.col("node").alias("parent"))
            .join(joined.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), "parent"))
    tops = whole.filter("parent IS NOT NULL").drop("parent_conv_id").join(edge, ["shard", "parent"]).withColumnRenamed("above", "parent_conv_id")
    return joined.select(*RESULT).unionByName(tops.select(*RESULT)).unionByName(whole.filter("parent IS NULL").select(*RESULT))
