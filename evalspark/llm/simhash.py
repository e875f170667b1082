"""SimHash near-dedup with pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to many reference fingerprints, computed once. Two
fingerprints at distance d differ by at most d in each coordinate, so a pair whose rows differ by more than the
limit anywhere is discarded without looking at it, and the survivors are verified.

Pairs meet without a cross join: with at most 4 differing bits, at least 3 of 7 blocks of bits are equal. Each
fingerprint stands once for every 3 blocks, and the members of such a cell are swept in the order of their first
coordinate, up to the limit ahead. A pair is taken in the first cell that it shares, so it comes out once.

A cell with more than ``CELL`` members is not swept, since pairs would grow with the square. Its members are linked
exactly by another way: each gives all values within half of the limit of it, and two fingerprints are within the limit if and only if they
share such a value (for an odd limit, one within the smaller and the other within the larger half of it). That is linear in the members and drops no link.

Equal fingerprints are one node, however many documents have them. A text without words has fingerprint zero; null text
is empty. Rows with the same id are separate rows with equal results. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.arrow import arrow_schema, map_batches, packed, text_key, texts
from evalspark.llm.components import components
from evalspark.scratch import materialize

SHINGLE, SEED, LIMIT = 4, 42, 4
BLOCKS = 7  # of which BLOCKS - LIMIT are equal in a linked pair
CELL = 512
REFERENCES = 16
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """64 bits, signed."""
    found, h = text.encode().lower().split(), xxhash.xxh64_intdigest
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([h(joined, SEED)], "<u8")
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        cuts = zip((ends - sizes)[:1 - words].tolist(), ends[words - 1:].tolist())
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in cuts), "<u8", len(found) - words + 1)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``id, fp`` of every row, and with ``keyed`` the ``key`` of its text."""
    rows, more = texts(docs, id_col, text_col), ["id"]
    if keyed:
        rows, more = rows.withColumn("key", text_key("text")), ["id", "key"]

    def start():
        return lambda batch: {c: batch.column(c) for c in more} | {"fp": [fingerprint(t, words) for t in batch.column("text").to_pylist()]}
    return map_batches(rows, f"id {dict(docs.dtypes)[id_col]}, {'key bigint, ' if keyed else ''}fp bigint", start)


def block_masks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def cells(distinct: DataFrame, limit: int = LIMIT, blocks: int = BLOCKS, references: int = REFERENCES) -> DataFrame:
    """``combo, cell, fp, d0, d1``: each fingerprint in all its cells with its distances, eight to a number."""
    masks = block_masks(blocks)
    chosen = np.array([sum(c) for c in combinations(masks, blocks - limit)], np.uint64)
    pivots = np.random.default_rng(7).integers(0, 1 << 64, references, np.uint64, endpoint=False)

    def start():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            far = np.bitwise_count(fp[:, None] ^ pivots).astype(np.uint8)
            d = np.ascontiguousarray(far).view("<i8")
            n = len(chosen)
            return {"combo": np.tile(np.arange(n, dtype=np.int32), len(fp)), "cell": (fp[:, None] & chosen).view(np.int64).ravel(),
                    "fp": np.repeat(fp.view(np.int64), n), "d0": np.repeat(d[:, 0], n), "d1": np.repeat(d[:, 1], n)}
        return step

    return map_batches(distinct, "combo int, cell bigint, fp bigint, d0 bigint, d1 bigint", start)


def sweep(placed: DataFrame, limit: int = LIMIT, blocks: int = BLOCKS, most: int = CELL) -> DataFrame:
    """``a, b`` of linked fingerprints; ``b`` is null for a member ``a`` of a cell with more than ``most``."""
    masks = np.array(block_masks(blocks), np.uint64)
    chosen = list(combinations(range(blocks), blocks - limit))
    number = {sum(1 << i for i in c): k for k, c in enumerate(chosen)}
    # the first cell that a pair shares, by the set of its equal blocks
    first = np.array([number[sum(1 << i for i in [i for i in range(blocks) if s >> i & 1][:blocks - limit])]
                      if s.bit_count() >= blocks - limit else -1 for s in range(1 << blocks)])
    ddl = "a bigint, b bigint"
    schema = arrow_schema(ddl)

    def links(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """rows: whole cells of at most ``most`` members: combo, cell, fp, d0, d1."""
        fp = rows[:, 2].view(np.uint64)
        far = np.ascontiguousarray(rows[:, 3:5]).view(np.uint8).reshape(len(rows), -1).astype(np.int16)
        out, i, step = [], np.arange(len(rows)), 1
        while len(i := i[i + step < len(rows)]):
            j = i + step
            near = (rows[i, 0] == rows[j, 0]) & (rows[i, 1] == rows[j, 1]) & (far[j, 0] - far[i, 0] <= limit)
            i = i[near]
            j = i + step
            ok = (np.abs(far[i] - far[j]) <= limit).all(axis=1)
            a, b = i[ok], j[ok]
            differ = fp[a] ^ fp[b]
            ok = np.bitwise_count(differ) <= limit
            a, b, differ = a[ok], b[ok], differ[ok]
            equal = ((differ[:, None] & masks) == 0) @ (1 << np.arange(blocks))
            ok = first[equal] == rows[a, 0]
            out.append((rows[a[ok], 2], rows[b[ok], 2]))
            step += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b if b is not None else pa.nulls(len(a), pa.int64())], schema=schema)

        def whole(rows):
            for a, b in links(rows):
                if len(a):
                    yield emit(a, pa.array(b, pa.int64()))

        held, crowded = np.empty((0, 5), np.int64), None
        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            if crowded is not None:
                more = (rows[:, 0] == crowded[0]) & (rows[:, 1] == crowded[1])
                if more.any():
                    yield emit(rows[more, 2], None)
                    rows = rows[~more]
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            big = np.repeat(sizes > most, sizes)
            if big.any():
                yield emit(rows[big, 2], None)
            crowded = tuple(rows[-1, :2]) if sizes[-1] > most else None
            last = starts[-1]
            yield from whole(rows[:last][~big[:last]])
            held = rows[last:] if crowded is None else rows[:0]
        yield from whole(held)

    return placed.repartition("combo", "cell").sortWithinPartitions("combo", "cell", F.expr("d0 & 255")).mapInArrow(run, ddl)


def crowded_links(members: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``a, b``: links of distinct fingerprints (``fp``) through the values that two of them share."""
    def met_by(sizes) -> DataFrame:
        near = [sum(1 << i for i in c) for n in sizes for c in combinations(range(64), n)]
        near = [x - (1 << 64) if x >> 63 else x for x in near]
        flips = F.expr("array(" + ",".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in near) + ")")
        return members.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("value"))

    half = limit // 2
    met = met_by(range(half + 1))
    if limit % 2:
        # one of two gives the values a bit farther off too: only a member within the smaller half leads, so no link is longer than the limit
        leader = met.groupBy("value").agg(F.min("fp").alias("b"))
        met = met.unionByName(met_by([half + 1]))
    else:
        leader = met.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top").drop("top")
    return met.join(leader, "value").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_groups(docs: DataFrame, words: int = SHINGLE, limit: int = LIMIT, blocks: int = BLOCKS, id_col: str = "doc_id",
                text_col: str = "text", cell: int = CELL) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``."""
    rows, shared = _grouped(fingerprints(docs, words, id_col, text_col), limit, blocks, cell)
    component = F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("id"))
    return rows.join(shared, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def _grouped(found: DataFrame, limit: int, blocks: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """``found`` (id, fp) as a written table, and ``fp, root, component_id, shared`` of the fingerprints whose component has several rows."""
    rows = materialize(found, "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    found = materialize(sweep(cells(nodes.select("fp"), limit, blocks), limit, blocks, cell), "links")
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    edges = found.filter("b is not null").unionByName(crowded_links(crowded, limit))
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("size"))
    return rows, named.join(smallest.filter("size > 1"), "root").select("fp", "root", "component_id", F.lit(True).alias("shared"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, limit: int = LIMIT, blocks: int = BLOCKS,
             cell: int = CELL) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id, and of its texts one, stays.

    Rows without an id stay. Rows with an id in common are told apart by their texts; repeated rows stay or go together.
    """
    rows, shared = _grouped(fingerprints(docs, words, id_col, text_col, keyed=True), limit, blocks, cell)
    member = F.struct("id", "key")
    members = rows.filter("id IS NOT NULL").select("id", "key", "fp").join(shared.select("fp", "root"), "fp")
    first = members.groupBy("root").agg(F.min(member).alias("first"))
    gone = members.join(first, "root").filter(member != F.col("first")).select("id", "key").distinct()
    return packed(docs, id=F.col(id_col), key=text_key(text_col)).join(gone, ["id", "key"], "left_anti").select("row.*")
