import struct

import numpy as np
import pytest
import sentencepiece
from rows import clashing, documents

from evalspark.llm import sentencepieces as sp
from evalspark.llm.vocab import default_path

PATH = default_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "  two  spaces \n x ", "\n\nA\n b", "<s> </s> <unk>", "☃ 中文 😀a", "tab\tx\r\n y ", "▁under ▁▁ x▁y", " lead", "trail ", "trail  ",
       "a  b   c", "\x00 \x01", "é É", "x" * 3000, "x \n", "<0x0A>", "end\n "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_whole_texts_get_the_library_ids(library):
    codec = sp.Codec(PATH, 1)
    for text in [*ODD, "\n".join(ODD), " ".join(ODD)]:
        want = library.encode(text)
        packed, _ = codec.encode([text])[0]
        assert np.frombuffer(packed, "<u4").tolist() == want, text
        assert codec.decode([packed]) == [library.decode(want)], text
        assert (codec.decode([packed]) == [text]) == bool(codec.encode([text])[0][1] & 2), text  # parts come back if the whole does


def test_ids_are_those_of_the_rebuilt_tokenizer(monkeypatch):
    """The other library only judges: where it says something else, ids stay and parity is false."""
    codec = sp.Codec(PATH, 1)
    right = codec.encode(["one two"])[0]
    monkeypatch.setattr(codec, "other", type("Wrong", (), {"encode": staticmethod(lambda texts, num_threads: [[7]] * len(texts))})())
    codec.known.clear()
    assert right[1] == 3 and codec.encode(["one two"])[0] == (right[0], 2)


def test_caches_that_overflow_change_nothing(monkeypatch, library):
    monkeypatch.setattr(sp, "CACHE", 6)
    codec = sp.Codec(PATH, 1)
    for texts in (["one two three", "two four"], ["one five six seven eight nine ten"], [*ODD], ["one two", "x" * 99 + " one"]) * 2:
        got = [np.frombuffer(x, "<u4").tolist() for x, _ in codec.encode(texts)]
        assert got == [library.encode(t) for t in texts]


def test_encode_and_decode(spark, library):
    docs = documents(spark, [*ODD, None, ODD[3]], ids=[*range(len(ODD)), None, 3])
    coded = sp.encode(clashing(docs))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in coded.collect()}
    assert got == {i: library.encode(t) for i, t in [*enumerate(ODD), (None, "")]}
    back = {r["doc_id"]: r["text"] for r in sp.decode(coded).collect()}
    assert back == {i: library.decode(library.encode(t)) for i, t in [*enumerate(ODD), (None, "")]}
    checked = sp.verify(docs).collect()
    assert len(checked) == len(ODD) + 2 and all(r["n_tokens"] == len(got[r["doc_id"]]) for r in checked)
    plain = [r for r in checked if r["doc_id"] is None or "▁" not in ODD[r["doc_id"]]]
    assert all(r["parity"] and r["decoded_equal"] for r in plain)
    assert sp.encode(docs.limit(0)).count() == 0 and sp.verify(docs.limit(0)).count() == 0 and sp.decode(coded.limit(0)).count() == 0


def message(*fields):
    """A protocol buffer message by hand."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        else:
            out += varint(number << 3) + varint(value)
    return out


def test_unigram_model_built_by_hand():
    """Scores, byte fallback and extra-space rules of a unigram model."""
    words = {"▁": -2.0, "▁the": -2.5, "▁cat": -3.5, "▁ca": -4.0, "t": -3.0, "c": -6.0, "a": -5.0, "h": -6.0, "e": -5.5, "s": -4.5, "▁s": -4.0, "at": -3.2, "▁sat": -5.0}
    pieces = [("<unk>", 0.0, sp.UNK), ("<s>", 0.0, sp.CONTROL), ("</s>", 0.0, sp.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, sp.BYTE) for b in range(256)] + [(w, s, sp.NORMAL) for w, s in words.items()]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, sp.UNIGRAM), (35, 1), (40, 0), (41, 1), (42, 2)))) + message((3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    spec = sp.parse(data)
    assert (spec.kind, spec.byte_fallback, spec.squeeze, spec.unk, len(spec.pieces)) == (sp.UNIGRAM, True, True, 0, len(pieces))
    mine, theirs = sp.build(spec), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ["the cat sat", "the  cat ", " the catsat", "cat the é!", "hats", ""]:
        assert mine.encode(text, add_special_tokens=False).ids == theirs.encode(text), text
        assert mine.decode(mine.encode(text, add_special_tokens=False).ids) == theirs.decode(theirs.encode(text))


def test_unsupported_models_are_refused():
    for spec in (sp.Spec(marker_last=True), sp.Spec(kind=3), sp.Spec(escape=False)):
        with pytest.raises(ValueError):
            sp.build(spec)
