"""Exact dedup against a minimal perfect hash of the digests seen before.

The distinct digests of the history are dealt over shards by their own bytes, and each shard gets a
minimal perfect hash: levels of bits in which a key that meets no other one is settled, and the number
of bits set before its bit is its slot. A slot holds the full digest, the winner's id and the number of
rows. Digests that arrive are grouped first, so a text with a third of all rows is one key, and looked up in
their shard: only an equal digest in the slot is a repeat. The others are groups of their own.

Texts are equal when they are after replacing each run of ASCII white space by one space; a null text is
empty. Of equal texts the smallest id stays. An id is the row's key: rows with the same id and text stay or
go together, and a row without an id stays only where no row of its text has one. An empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.arrow import arrow_schema, packed
from evalspark.scratch import materialize

SHARD = 16_384  # digests of one shard, about
WIDTH = 32  # bytes of a digest
SPREAD = 2  # bits of a level for each key that reaches it
INDEX = "shard bigint, levels array<binary>, digests binary, winners array<bigint>, sizes array<bigint>"
GROUPS = "digest binary, keep_id bigint, group_size bigint, member boolean"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest`` of every row."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A hash of each digest for a level, from one of its four words."""
    x = words[:, level % 4] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(keys: bytes) -> np.ndarray:
    return np.frombuffer(keys, ">u8").astype(np.uint64).reshape(-1, WIDTH // 8)


def build_levels(words: np.ndarray) -> list[np.ndarray]:
    """Bits of each level over distinct digests."""
    levels = []
    while len(words):
        at = (_mixed(words, len(levels)) % np.uint64(SPREAD * len(words))).astype(np.int64)
        n = np.bincount(at, minlength=SPREAD * len(words))
        levels.append(n == 1)
        words = words[n[at] > 1]
    return levels


def slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot of each digest. One that was not built in gets some slot, or -1."""
    out, open_, before = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        at = (_mixed(words[open_], k) % np.uint64(len(bits))).astype(np.int64)
        rank, hit = np.cumsum(bits), bits[at]
        out[open_[hit]] = before + rank[at[hit]] - 1
        open_, before = open_[~hit], before + int(rank[-1])
    return out


def _binary(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    groups = rows.groupBy("digest").agg(F.min("id").alias("winner"), F.count("*").alias("size"))
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard that holds any digest of ``history`` (``id, digest``)."""
    schema = arrow_schema(INDEX)

    def build(table: pa.Table) -> pa.Table:
        keys = _binary(table.column("digest"))
        words = _words(keys)
        levels = build_levels(words)
        order = np.argsort(slots(levels, words))
        table = table.take(pa.array(order))
        row = {"shard": table.column("shard")[0].as_py(), "digests": _binary(table.column("digest")),
               "levels": [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in levels],
               "winners": table.column("winner").to_pylist(), "sizes": table.column("size").to_pylist()}
        return pa.Table.from_pylist([row], schema=schema)

    return _grouped(history, shards).groupBy("shard").applyInArrow(build, INDEX)


def look_up(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """``digest, keep_id, group_size, member`` of every digest of the index and of ``arrivals`` (``id, digest``)."""
    schema = arrow_schema(GROUPS)

    def groups(new: pa.Table, held: pa.Table) -> pa.Table:
        keys = new.column("digest").to_pylist()
        winner, size = new.column("winner").to_pylist(), new.column("size").to_pylist()
        out: dict[str, list] = {"digest": [], "keep_id": [], "group_size": [], "member": []}
        found = np.full(len(keys), -1, np.int64)
        if held.num_rows:
            row = held.to_pylist()[0]
            digest = [row["digests"][i:i + WIDTH] for i in range(0, len(row["digests"]), WIDTH)]
            keep, total = row["winners"], row["sizes"]
            if keys:
                levels = [np.unpackbits(np.frombuffer(b[8:], np.uint8), count=int.from_bytes(b[:8], "little")).astype(bool)
                          for b in row["levels"]]
                found = slots(levels, _words(b"".join(keys)))
            for i, slot in enumerate(found):
                if slot < 0 or digest[slot] != keys[i]:
                    found[i] = -1
                    continue
                total[slot] += size[i]
                keep[slot] = min((x for x in (keep[slot], winner[i]) if x is not None), default=None)
            out = {"digest": digest, "keep_id": keep, "group_size": total, "member": [True] * len(digest)}
        for i, slot in enumerate(found):
            if slot < 0:
                for name, value in (("digest", keys[i]), ("keep_id", winner[i]), ("group_size", size[i]), ("member", False)):
                    out[name].append(value)
        return pa.table(out, schema=schema)

    return _grouped(arrivals, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(groups, GROUPS)


def exact_groups(docs: DataFrame, history: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                 shard: int = SHARD) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` per row of ``docs``.

    ``history`` (a condition on ``id``) tells the rows that are already indexed; by default those in the lower half of the
    range of ids. The result is the same for any history.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    n, low, high = rows.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if history is None:
        history = F.col("id") <= ((low + high) // 2 if low is not None else 0)
    old = F.coalesce(history, F.lit(False))
    shards = max(1, -(-n // shard))
    index = materialize(build_index(rows.filter(old), shards), "digest-index")
    groups = look_up(index, rows.filter(~old), shards)
    repeated = groups.filter("group_size > 1").select("digest", "keep_id", "group_size")
    size = F.coalesce("group_size", F.lit(1))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return (rows.join(repeated, "digest", "left")
            .select(F.col("id").alias(id_col), keep.alias("keep_id"), size.cast("bigint").alias("group_size"),
                    F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one for each id and text."""
    groups = exact_groups(docs, id_col=id_col, text_col=text_col)
    kept = groups.filter("kept").select(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    rows = packed(docs, id=F.col(id_col).cast("bigint"), sha=F.sha2(normalised(F.col(text_col)), 256))
    stays = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return stays.dropDuplicates(["id", "sha"]).select("row.*")
