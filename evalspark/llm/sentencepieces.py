"""SentencePiece models on the ``tokenizers`` library.

The model file is a protocol buffer; its pieces, scores, kinds and normaliser settings are read field by field and
rebuilt as a ``tokenizers`` pipeline: the compiled character map, the extra-space rules, the word marker, and either a
unigram model with its scores or a BPE model whose merges follow from the scores, both with byte fallback.

A text is cut before each marker that follows another character, if no piece of the vocabulary crosses such a place, and
each different part is encoded once while a worker remembers it, in batches over ``threads`` threads. Ids and decoded texts are those of
the rebuilt tokenizer. Every part is also encoded by the ``sentencepiece`` library, only to compare, and decoded again; ``parity`` and
``round_trip`` tell whether all parts of the text agreed. A part's ids begin with its marker, so the decoded text of a whole is that of its parts
with spaces between, and equals the text if all parts come back.

Null text is empty and has no ids. Rows are independent: repeated rows give repeated rows, an empty table gives no rows, other
columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.arrow import map_batches, texts
from evalspark.llm.vocab import CACHE, LONGEST, default_path

MARK = "▁"
UNIGRAM, BPE = 1, 2  # kinds of model
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # kinds of piece


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            value = data[at:at + size]
            at += size
        yield key >> 3, value


@dataclass
class Spec:
    """What the model file says; defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    marker_last: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNK), 0)


def parse(data: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            trainer = dict(fields(value))
            spec.kind, spec.byte_fallback, spec.marker_last = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
        elif number == 3:
            rules = dict(fields(value))
            spec.charsmap = rules.get(2, b"")
            spec.dummy_prefix, spec.squeeze, spec.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
    return spec


def bpe_merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to put a piece together from two others; better scores first."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    ways = []
    for piece, i in ids.items():
        cut = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        ways += [(-pieces[i][1], ids[a], ids[b], a, b) for a, b in cut]
    return [w[3:] for w in sorted(ways)]


def build(spec: Spec):
    """A ``tokenizers.Tokenizer`` with the behaviour of the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers
    if spec.marker_last or not spec.escape:
        raise ValueError("models with the marker behind words, or without one, are not supported")
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unk, spec.byte_fallback)
    elif spec.kind == BPE:
        unk = spec.pieces[spec.unk][0]
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, bpe_merges(spec.pieces), unk_token=unk, fuse_unk=True,
                           byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"no unigram or BPE model: kind {spec.kind}")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tail = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


class Codec:
    """Encodes and decodes texts; remembers parts."""

    def __init__(self, path: str, threads: int):
        # read by the library when a worker first encodes a batch
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true" if threads > 1 else "false"
        import sentencepiece
        with open(path, "rb") as f:
            data = f.read()
        self.threads, self.spec = threads, parse(data)
        self.tokenizer = build(self.spec)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        crossed = any(MARK in p.lstrip(MARK) for p, _, kind in self.spec.pieces if kind in (NORMAL, USER))
        self.by_part = self.spec.dummy_prefix and not self.spec.charsmap and not self.spec.squeeze and not crossed
        self.known: dict[str, tuple[bytes, int]] = {}
        self.old: dict[str, tuple[bytes, int]] = {}  # known before; those that come again are known again

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of packed ids."""
        return self.tokenizer.decode_batch([list(struct.unpack(f"<{len(x) // 4}I", x)) for x in ids], skip_special_tokens=False)

    def parts(self, text: str) -> list[str]:
        """Parts without the space that the marker stands for; the first part has none."""
        if not self.by_part:
            return [text]
        parts = text.split(" ")
        # neighbouring spaces make one marker run with the word behind them
        return re.findall(r" *[^ ]+(?: +\Z)?| +\Z", " " + text) if "" in parts or MARK in text else parts

    def learn(self, new: list[str]) -> dict[str, tuple[bytes, int]]:
        bare = [p[1:] if self.by_part and p[:1] == " " else p for p in new]
        mine = [e.ids for e in self.tokenizer.encode_batch_fast(bare, add_special_tokens=False)]
        theirs = self.other.encode(bare, num_threads=self.threads)
        back = self.tokenizer.decode_batch(mine, skip_special_tokens=False)
        out = {}
        for part, text, a, b, again in zip(new, bare, mine, theirs, back):
            out[part] = struct.pack(f"<{len(a)}I", *a), (a == b) + 2 * (again == text)
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """Packed ids, and 1 for parity plus 2 for a round trip of all parts. An empty text has no parts."""
        cut = [self.parts(t) if t else [] for t in texts]
        new = {p for parts in cut for p in parts}.difference(self.known)
        again = {p: self.old[p] for p in new if p in self.old}
        got = again | self.learn(list(new.difference(again)))
        if len(self.known) + len(got) > CACHE // 2:
            here = {p: self.known[p] for parts in cut for p in parts if p in self.known}
            self.old, self.known = self.known, here
        if len(got) > CACHE // 2:
            known = {**self.known, **got}
        else:
            self.known.update(got)  # long parts leave again below
            known = self.known
        out = []
        for parts in cut:
            found = [known[p] for p in parts]
            out.append((b"".join([x[0] for x in found]), 3 if all(x[1] == 3 for x in found) else
                        int(all(x[1] & 1 for x in found)) + 2 * int(all(x[1] & 2 for x in found))))
        for p in got:
            if len(p) > LONGEST:
                self.known.pop(p, None)
        return out


@lru_cache(maxsize=1)
def codec(path: str, threads: int) -> Codec:
    return Codec(path, threads)


def encode(docs: DataFrame, path: str | None = None, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, parity, round_trip`` per row of ``docs``; ``ids`` are little-endian unsigned 32-bit numbers."""
    path = path or default_path("piece_bpe_32k.model")

    def start():
        coder = codec(path, threads)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            found = batch.column("text").to_pylist()
            out = [x for i in range(0, len(found), 256) for x in coder.encode(found[i:i + 256])]
            return {id_col: batch.column("id"), "ids": [x[0] for x in out], "parity": [bool(x[1] & 1) for x in out],
                    "round_trip": [bool(x[1] & 2) for x in out]}
        return step

    kind = dict(docs.dtypes)[id_col]
    return map_batches(texts(docs, id_col, text_col), f"`{id_col}` {kind}, ids binary, parity boolean, round_trip boolean", start)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``; null ids give an empty text."""
    path = path or default_path("piece_bpe_32k.model")

    def start():
        coder = codec(path, 1)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            return {id_col: batch.column("id"), "text": coder.decode([x or b"" for x in batch.column("ids").to_pylist()])}
        return step

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_batches(rows, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string", start)


def verify(docs: DataFrame, path: str | None = None, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, parity, round_trip, decoded_equal`` per row: both ways for the whole text, without keeping the ids."""
    path = path or default_path("piece_bpe_32k.model")

    def start():
        coder = codec(path, threads)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            found = batch.column("text").to_pylist()
            out = [x for i in range(0, len(found), 256) for x in coder.encode(found[i:i + 256])]
            return {id_col: batch.column("id"), "n_tokens": [len(x[0]) // 4 for x in out], "ids_crc32": [zlib.crc32(x[0]) for x in out],
                    "parity": [bool(x[1] & 1) for x in out], "round_trip": [bool(x[1] & 2) for x in out],
                    "decoded_equal": [bool(x[1] & 2) for x in out]}
        return step

    kind = dict(docs.dtypes)[id_col]
    ddl = f"`{id_col}` {kind}, n_tokens bigint, ids_crc32 bigint, parity boolean, round_trip boolean, decoded_equal boolean"
    return map_batches(texts(docs, id_col, text_col), ddl, start)
