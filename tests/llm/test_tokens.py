import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rows import clashing, documents, rows
from tokenizers import Tokenizer

from evalspark.llm import packing, token_counts
from evalspark.llm.vocab import WholeTokens, WordIds, default_path, whole_tokens, word_ids

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
ODD = ["", " ", "a", "  two  spaces \n x ", "\n\nA\n b", "it's IT'S don't 's ' s'll", "<|endoftext|> x<|endoftext|>y <|startoftext|>",
       "é É ÉCOLE e\u0301 E\u0301 İ Σας ΣΑΣ ß ſ ŉ ²³ ½ ١٢ 中文 字 a\x1cb\x1f x᠎y \x85z \xa0q 　w 😀 a😀b", "tab\tx\r\n y ", "12345 6.7 a1b2",
       "x" * 300 + " y", "\x00 \x01a \x7f", " lead", "trail ", "a  b   c", "_ __a_ _b", "Ω ªº µ", "a \n\n b\n \nc", "x" * 5000]


def library(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tokenizers_():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def check(tokenizers_, text):
    want = tokenizers_[WORD].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_ids(WORD).ids(text), "<u4").tolist() == want, text
    assert whole_tokens(BYTE).count(text) == len(tokenizers_[BYTE].encode(text, add_special_tokens=False).ids), text


def test_odd_texts_get_the_library_ids(tokenizers_):
    for text in [*ODD, "\n".join(ODD)]:
        check(tokenizers_, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 's\n\t.,1ÀéŒß\u0301Σ中<|>_-\xa0\u2028\x1c")), max_size=40))
def test_any_text_gets_the_library_ids(tokenizers_, text):
    check(tokenizers_, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 's\n\t.,1ÀéŒß\u0301Σ中<|>_-\xa0\u2028\x1c\x85\x0b")), max_size=30), max_size=6))
def test_batches_get_the_library_ids(tokenizers_, texts):
    ids, counts = word_ids(WORD).batch(pa.array(["x", *texts, ""], pa.string()).slice(1))
    want = [tokenizers_[WORD].encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))


def test_odd_texts_in_one_batch(tokenizers_):
    ids, counts = word_ids(WORD).batch(pa.array(ODD * 2))
    want = [tokenizers_[WORD].encode(t, add_special_tokens=False).ids for t in ODD * 2]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))


def test_caches_that_overflow_change_nothing(tokenizers_, monkeypatch):
    monkeypatch.setattr("evalspark.llm.vocab.CACHE", 3)
    words, counts = WordIds(WORD), WholeTokens(BYTE)
    for text in ["one two three four five one two", "six seven, one two One", "a b c d e f a b", *ODD]:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == tokenizers_[WORD].encode(text, add_special_tokens=False).ids
        assert counts.count(text) == len(tokenizers_[BYTE].encode(text, add_special_tokens=False).ids)
    assert len(words.words) <= 2 and len(counts.counts) <= 2


def test_whole_tokens_are_proven():
    counter = whole_tokens(BYTE)
    assert " the" in counter.proven and len(counter.proven) > 40_000
    for s in list(counter.proven)[::5000]:
        assert len(library(BYTE, s)) == 1


def test_token_counts(spark):
    docs = documents(spark, [*ODD, None, ODD[5]], ids=[*range(len(ODD)), None, 5])
    got = rows(token_counts.token_counts(clashing(docs), limit=10))
    want = [(i, len(t.encode()), n := len(library(BYTE, t)), n > 10) for i, t in [*enumerate(ODD), (None, ""), (5, ODD[5])]]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def best_total(counts, room):
    every = product(*[range(n + 1) for n in counts.values()])
    return max(t for c in every if (t := sum(k * n for k, n in zip(counts, c))) <= room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 60))
def test_closest_multiset_is_the_best(counts, room):
    chosen = dict(packing.closest(counts, room))
    assert all(n <= counts[k] for k, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == best_total(counts, room)


def test_fill_places_everything_with_little_slack():
    lengths = np.random.default_rng(3).integers(1, 2048, 3000).tolist()
    windows = packing.fill(lengths, 2048)
    assert sorted(i for w in windows for i in w) == list(range(3000))
    totals = [sum(lengths[i] for i in w) for w in windows]
    assert max(totals) <= 2048 and sum(2048 - t for t in totals) < 0.01 * 2048 * len(windows)
    assert packing.fill([], 9) == []


def test_packing(spark):
    texts = ["", None, "one two three", "word " * 40, "x" * 700, "a b c d e f g h " * 9, "one two three"] * 5
    docs = documents(spark, texts, ids=[i % 30 for i in range(len(texts))])
    got = packing.pack_documents(clashing(docs), capacity=32).collect()
    pieces = defaultdict(list)
    for i, t in zip(range(len(texts)), texts):
        ids = [*library(WORD, t or ""), 1]
        for at in range(0, len(ids), 32):
            part = np.array(ids[at:at + 32], "<u4")
            pieces[i % 30, at, len(part), zlib.crc32(part.tobytes()), len(ids)].append(1)
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(
        k for k, n in pieces.items() for _ in n)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert packing.pack_documents(docs.filter(F.col("text") == "")).count() == 5


def test_groups_are_independent_of_each_other(spark):
    docs = documents(spark, ["word " * n for n in range(1, 60)])
    table = spark.createDataFrame(packing.pieces(docs, capacity=64).collect(), packing.pieces(docs, capacity=64).schema)
    many = packing.pack(table, capacity=64, group=7)
    assert many.count() == table.count() and many.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 64").isEmpty()
