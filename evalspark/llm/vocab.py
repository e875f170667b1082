"""Ids and token counts of whole texts through small caches over the ``tokenizers`` library.

A text is cut where the tokenizer's own splitting rule is certain to cut, and different pieces are
encoded once while a worker remembers them. Pieces with characters outside a plain range are encoded by the library as
they stand, so every text gets exactly the library's ids.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE = 500_000  # words kept by a worker, in two halves
LONGEST = 64  # characters of a piece that is worth keeping
#: Printable ASCII and the Latin letters whose lower case and byte form are simple.
PLAIN = re.compile("[!-~À-įı-ňŊ-ž]+")
#: White space for Python but not for the library, or the other way round.
ODD = re.compile("[\x1c-\x1f᠎]")


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: a byte that prints stands for
    itself, the others follow from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent(dict):
    """Values of the keys seen last. A full half becomes the old one; old keys that come again return to the young half."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.half, self.old = make, CACHE // 2, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class _Pieces:
    """``ids`` of one pre-token by the model alone."""

    #: Marks that are a pre-token of their own behind a word, and begin nothing else.
    MARKS = frozenset(".,;:!?)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = byte_alphabet()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def tokens(self, piece: str) -> list:
        return self.model.tokenize(piece if piece.isascii() and " " not in piece and "\n" not in piece else piece.encode().decode("latin-1").translate(self.table))


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(_Pieces):
    """Ids under a vocabulary that drops white space and lower-cases, so words are independent of each other."""

    RULE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        super().__init__(path)
        self.words = Recent(self._word)

    def _word(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or PLAIN.fullmatch(word)):  # one pre-token
            low = word.lower()
            return _packed([t.id for t in self.tokens(low)]) if low == word else self.words[low]
        # "<|" begins the special strings, which the library finds before it splits
        if not PLAIN.fullmatch(word) or "<|" in word:
            return _packed(self.whole(word))
        pieces = (word[:-1], word[-1]) if word[-1] in self.MARKS and word[:-1].isalpha() else self.RULE.findall(word.lower())
        if len(pieces) > 1:
            return b"".join([self.words[p] for p in pieces])
        return _packed([t.id for t in self.tokens(pieces[0])])

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if ODD.search(text):
            return _packed(self.whole(text))
        return b"".join(map(self.words.__getitem__, text.split()))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and how many each text has.

        Texts are split and their different words found by Arrow; only those are looked up. White space outside of ASCII stays in
        its word, which the library then splits.
        """
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        found = [self.words[w] if w else b"" for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        words = coded.indices.to_numpy()
        n = sizes[words]
        ends = np.cumsum(n)
        out = table[np.repeat(starts[words] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return out, np.diff(edges)


class WholeTokens(_Pieces):
    """Token counts under a byte-level vocabulary that keeps white space.

    ``proven`` holds the vocabulary strings that the library itself encodes alone as one token. A pre-token
    among them counts one; the others are merged by the model.
    """

    RULE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    GLUED = re.compile(r" \s| \Z")
    CUT = re.compile(r" (?=\S)")

    def __init__(self, path: str):
        super().__init__(path)
        back = {ord(c): b for b, c in self.table.items()}
        strings = []
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                strings.append(bytes(back[ord(c)] for c in token).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # no pre-token of a text is a part of a character
        tokenizer = self.tokenizer
        self.proven = {s for s, e in zip(strings, tokenizer.encode_batch_fast(strings, add_special_tokens=False))
                       if len(e.ids) == 1 and self.RULE.findall(s) == [s]}
        self.counts = Recent(lambda word: self._count(" " + word))

    def _one(self, piece: str) -> int:
        return 1 if piece in self.proven else len(self.tokens(piece))

    def _count(self, part: str) -> int:
        """Tokens of a part that begins at a cut; ``part`` has its leading space."""
        word = part[1:]
        if part[:1] == " " and (word.isascii() or PLAIN.fullmatch(word)):
            if word.isalpha():
                return self._one(part)
            if word[-1:] in self.MARKS and word[:-1].isalpha():
                return self.counts[word[:-1]] + self._one(word[-1])
        if not PLAIN.fullmatch(part.replace(" ", "").replace("\n", "") or "!") or "<|" in part:
            return len(self.whole(part))
        return sum(map(self._one, self.RULE.findall(part)))

    def count(self, text: str) -> int:
        """A space that something other than white space follows always begins a pre-token."""
        if ODD.search(text) or not text:
            return len(self.whole(text))
        parts = self.CUT.split(text) if self.GLUED.search(text) else text.split(" ")
        first = self._count(parts[0]) if parts[0] else 0
        del parts[0]
        return first + sum(map(self.counts.__getitem__, parts))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process, kept from task to task."""
    return WordIds(path)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> WholeTokens:
    return WholeTokens(path)
