"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text. A word start is a cut where the hash of the bytes before it is smaller
than at the word starts around, so cuts depend on the words nearby alone: an insertion moves no cut behind it, and a
passage that stands in two texts is cut alike in both, but for its first and last words. Chunks are compared by a
128-bit digest. The document with the smallest id that holds a chunk keeps it, and in later documents runs of
neighbouring repeated chunks of at least ``least`` words are repeats.

Texts without white space are cut at characters where the hash has a number of zero bits. A run in which no cut falls is cut after a fixed
number of words.

Null text is empty and has no chunk. Repeats inside one document, and rows that share an id, are not repeats of each other; rows of one id are
told apart by their texts, so each is cut by its own repeats. Rows without an id are neither cut nor sources. An empty table gives no rows; other columns are not read by ``repeats`` and pass through ``cut_repeats``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalspark.llm.arrow import map_batches, packed, text_key, texts
from evalspark.scratch import materialize

AROUND = 4  # word starts on either side of a cut that are no cuts
MOST = 64  # words of a chunk
LEAST = 16  # words of a run that counts as a repeat
SOLID = 256  # bytes without white space that are cut at characters
GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, np.uint32, endpoint=False)
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash up to and including each byte. A byte's share is shifted out after 32 more."""
    h, span = GEAR[data], 1
    while span < 32:
        ahead = h.copy()
        ahead[span:] += h[:-span] << np.uint32(span)
        h, span = ahead, span * 2
    return h


def cuts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where chunks begin, and the number of words of each chunk."""
    data = np.frombuffer(text, np.uint8)
    blank = SPACE[data]
    starts = ~blank
    starts[1:] &= blank[:-1]
    at = np.flatnonzero(starts)
    if not len(at):
        return at, at
    h = rolling(data)
    word = np.ones(len(at), np.int64)
    gaps = np.diff(np.append(at, len(data)))
    if gaps.max() > SOLID:
        inner = (data & 0xC0 != 0x80) & ~blank & (np.roll(h, 1) & np.uint32(31) == 0) & (np.repeat(gaps, gaps) > SOLID if at[0] == 0 else
                 np.concatenate([np.zeros(at[0], bool), np.repeat(gaps, gaps) > SOLID]))
        inner[at] = False
        more = np.flatnonzero(inner)
        at = np.concatenate([at, more])
        order = np.argsort(at, kind="stable")
        at, word = at[order], np.ones(len(at), np.int64)[order]
    value = np.full(len(at) + 2 * AROUND, 0xFFFFFFFF, np.uint32)
    own = np.where(at > 0, h[at - 1], np.uint32(0xFFFFFFFF))
    value[AROUND:-AROUND] = own
    n = len(at)
    low = np.ones(n, bool)
    for k in range(1, AROUND + 1):
        low &= own < value[AROUND - k:AROUND - k + n]
        low &= own <= value[AROUND + k:AROUND + k + n]
    low[0] = True
    first = np.flatnonzero(low)
    size = np.diff(np.append(first, n))
    if size.max() > MOST:
        first = np.concatenate([np.arange(f, f + s, MOST) for f, s in zip(first.tolist(), size.tolist())])
        size = np.diff(np.append(first, n))
    return at[first], size


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, start, length, words, d0, d1``: byte range, words and digest of every chunk; ``key`` is its text's."""
    def start():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = defaultdict(list)
            digests, digest = [], xxhash.xxh3_128_digest
            for key, own, text in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "text"))):
                data = text.encode()
                if not data:
                    continue
                at, words = cuts(data)
                ends = np.append(at[1:], len(data))
                out["id"].append(np.full(len(at), key, np.int64))
                out["key"].append(np.full(len(at), own, np.int64))
                out["start"].append(at)
                out["length"].append(ends - at)
                out["words"].append(words)
                digests += [digest(data[a:b].rstrip()) for a, b in zip(at.tolist(), ends.tolist())]
            found = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            none = np.empty(0, np.int64)
            return {k: np.concatenate(out[k] or [none]) for k in ("id", "key", "start", "length", "words")} | {
                "d0": np.ascontiguousarray(found[:, 0]), "d1": np.ascontiguousarray(found[:, 1])}
        return step

    rows = texts(docs, id_col, text_col).filter("id is not null").withColumn("key", text_key("text"))
    return map_batches(rows, "id bigint, key bigint, start bigint, length bigint, words bigint, d0 bigint, d1 bigint", start)


def _runs(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """``id, key, start, length, n_words, first_doc_id`` of every repeat."""
    found = materialize(chunks(docs, id_col, text_col), "chunks")
    held = (found.groupBy("d0", "d1").agg(F.min("id").alias("first"), F.max("id").alias("last"))
            .filter("first < last").drop("last"))
    again = found.join(held, ["d0", "d1"]).filter("id > first")
    by_place = W.partitionBy("id", "key").orderBy("start")
    begins = F.coalesce(F.lag(F.col("start") + F.col("length")).over(by_place) < F.col("start"), F.lit(True))
    runs = again.select("id", "key", "start", "length", "words", "first").distinct().withColumn("begins", begins.cast("int"))
    runs = runs.withColumn("run", F.sum("begins").over(by_place))
    return (runs.groupBy("id", "key", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length"),
                                                 F.sum("words").alias("n_words"), F.min("first").alias("first_doc_id"))
            .filter(F.col("n_words") >= least).drop("run"))


def repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, n_words, first_doc_id`` of every repeat: its bytes in the text, and a document that keeps them."""
    return _runs(docs, least, id_col, text_col).select(F.col("id").alias(id_col), "start", "length", "n_words", "first_doc_id")


def cut_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
                size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the repeats. ``size_col`` is counted again where it exists; a row of which only white space is left goes."""
    spans = (_runs(docs, least, id_col, text_col).groupBy("id", "key")
             .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans")))
    rows = packed(docs, id=F.col(id_col).cast("bigint"), key=text_key(text_col), bytes=F.encode(F.col(text_col), "UTF-8"))
    both = rows.join(spans, ["id", "key"], "left")
    left = F.expr("""aggregate(spans, struct(cast(0 as bigint) as at, cast('' as binary) as kept),
        (s, x) -> struct(x.start + x.length as at, concat(s.kept, substring(bytes, int(s.at + 1), int(x.start - s.at))) as kept),
        s -> concat(s.kept, substring(bytes, int(s.at + 1))))""")
    cut = both.withColumn("cut", F.when(F.col("spans").isNotNull(), F.decode(left, "UTF-8")))
    cut = cut.filter(r"cut is null or cut rlike '[^\x20\x09-\x0D]'")
    out = {c: F.col("row")[c].alias(c) for c in docs.columns}
    out[text_col] = F.coalesce("cut", F.col("row")[text_col]).alias(text_col)
    if size_col in docs.columns:
        kind = dict(docs.dtypes)[size_col]
        out[size_col] = F.when(F.col("cut").isNotNull(), F.length("cut").cast(kind)).otherwise(F.col("row")[size_col]).alias(size_col)
    return cut.select(*out.values())
