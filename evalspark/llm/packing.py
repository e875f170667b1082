"""Packing by minimum bin slack.

``pieces`` turns each document into ids plus an end id and cuts it into pieces of the capacity and one
shorter rest. Full pieces are sequences of their own. The rests are dealt evenly over groups of bounded
size, and each group fills one window after another: the longest rest goes in first, a bitset over the
lengths that are left tells every total that they can reach, and the multiset of lengths whose total is
closest to the capacity is read back from the bitsets with its counts. A group ends when nothing is left;
only its last few windows have slack.

Null text is empty and gives one piece with the end id. Repeated rows and repeated ids are separate
documents. A document of any length is cut by the same rule. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.arrow import arrow_schema, map_batches, texts
from evalspark.llm.vocab import default_path, word_ids
from evalspark.scratch import materialize

CAPACITY = 2048
GROUP = 16_384  # rests that one group holds, about
ENCODED = 4 << 20  # bytes of texts encoded together, about
FULL = 1 << 62  # sequences of one full piece are numbered from here


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, slot``: ``slot`` numbers the pieces of the table."""
    path = path or default_path("word_bpe_49k.json")
    kind = dict(docs.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()

    def start():
        encoder = word_ids(path)
        context = TaskContext.get()
        slot = (context.partitionId() if context else 0) << 33

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            nonlocal slot
            out: dict[str, list] = defaultdict(list)
            keys, found = batch.column("id").to_pylist(), batch.column("text")
            sizes = pc.binary_length(found).to_numpy()
            # neighbouring texts of some ENCODED bytes at a time
            firsts = np.flatnonzero(np.diff(np.cumsum(sizes) // ENCODED, prepend=-1)).tolist()
            for first, last in zip(firsts, [*firsts[1:], len(keys)]):
                ids, counts = encoder.batch(found.slice(first, last - first))
                at = 0
                for key, n in zip(keys[first:last], counts.tolist()):
                    own = ids[at:at + n].tobytes() + end
                    at += n
                    for cut in range(0, len(own), 4 * capacity):
                        part = own[cut:cut + 4 * capacity]
                        for name, value in ((id_col, key), ("start", cut // 4), ("length", len(part) // 4),
                                            ("ids_crc32", zlib.crc32(part)), ("doc_tokens", n + 1), ("slot", slot)):
                            out[name].append(value)
                        slot += 1
            return {name: out[name] for name in names}
        return step

    ddl = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, slot bigint"
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "slot"]
    return map_batches(texts(docs, id_col, text_col), ddl, start)


def closest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, at most ``counts`` of each, whose total is the largest not above ``room``."""
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        layers.append((length, reach))
        left, power = min(counts[length], room // length), 1
        while left:
            some = min(power, left)
            reach |= (reach << (length * some)) & mask
            left, power = left - some, power * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        n = 0
        while not before >> (total - n * length) & 1:
            n += 1
        if n:
            chosen.append((length, n))
            total -= n * length
    return chosen


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of positions in ``lengths``. Equal lengths are taken in their order."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        waiting[lengths[i]].append(i)
    counts = {length: len(at) for length, at in waiting.items()}
    windows = []
    while counts:
        longest = max(counts)
        window, chosen = [], [(longest, 1)]
        for again in (True, False):
            for length, n in chosen:
                window += [waiting[length].pop() for _ in range(n)]
                counts[length] -= n
                if not counts[length]:
                    del counts[length]
            if again:
                chosen = closest(counts, capacity - longest)
        windows.append(window)
    return windows


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset`` instead of ``slot``."""
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    columns = [c for c in pieces.columns if c != "slot"]
    kinds = dict(pieces.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id bigint, offset bigint"

    schema = arrow_schema(ddl)

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        number = table.column("group")[0].as_py()
        lengths = table.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for k, window in enumerate(fill(lengths, capacity)):
            at = 0
            for i in window:
                sequence[i], offset[i] = (number << 32) + k, at
                at += lengths[i]
        out = table.select(columns).append_column("sequence_id", pa.array(sequence, pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64())).cast(schema)

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    full = pieces.filter(F.col("length") >= capacity).select(
        *columns, (F.col("slot") + F.lit(FULL)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return full.unionByName(dealt.groupBy("group").applyInArrow(place, ddl))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places. Slack is padding, unless a sequence's length is a power of two."""
    return pack(materialize(pieces(docs, path, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)
