import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from rows import clashing, documents, rows

from evalspark.llm import exact, simhash, substrings
from evalspark.llm.components import components

TEXTS = ["a b", "a  b", "a\t\r\nb", " a b", "a b ", "A b", None, "", "  ", " ", "a\u00a0b", "x" * 300_000, "x" * 300_000, "é", "e\u0301"]


def exact_by_hand(pairs):
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    out = []
    for i, t in pairs:
        same = [j for j, u in pairs if norm(u) == norm(t)]
        keep = min((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark):
    pairs = [*enumerate(TEXTS, 5), (None, "a b"), (None, "alone"), (7, "a b"), (7, "a b"), (2, "é")]
    docs = documents(spark, [t for _, t in pairs], ids=[i for i, _ in pairs])
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for history in (None, F.lit(True), F.lit(False), F.col("id") % 2 == 0):
        got = exact.exact_groups(clashing(docs), history, shard=3)
        assert rows(got, *columns) == exact_by_hand(pairs)
    assert exact.exact_groups(docs.limit(0)).count() == 0
    kept = exact.keep_first(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert rows(kept, "doc_id", "text") == sorted({(i, t) for i, t in pairs if any(r[0] == i and r[3] and r[4] == exact_by_hand([(i, t)])[0][4]
                                                                                  for r in exact_by_hand(pairs))}, key=str)


def test_perfect_hash_is_minimal_and_foreign_keys_are_caught(spark):
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    words = exact._words(b"".join(keys))
    levels = exact.build_levels(words)
    assert sorted(exact.slots(levels, words)) == list(range(5000))
    foreign = exact._words(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(5000)))
    found = exact.slots(levels, foreign)
    assert found.max() < 5000 and (found >= 0).any()  # some slot: only the bytes tell
    make = lambda pairs: spark.createDataFrame(pairs, "id bigint, digest binary")
    index = exact.build_index(make([(i, bytearray(k)) for i, k in enumerate(keys[:50])]), 4)
    got = {bytes(r["digest"]): r for r in exact.look_up(index, make([(99, bytearray(keys[3])), (98, bytearray(keys[60])), (97, bytearray(keys[60]))]), 4).collect()}
    assert len(got) == 51 and (got[keys[3]]["keep_id"], got[keys[3]]["group_size"], got[keys[3]]["member"]) == (3, 2, True)
    assert (got[keys[60]]["keep_id"], got[keys[60]]["group_size"], got[keys[60]]["member"]) == (97, 2, False)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = sorted((x, root(x)) for x in parent if any(a != b and x in (a, b) for a, b in edges))
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert sorted(tuple(r) for r in components(df).collect()) == want
    assert components(df.limit(0)).count() == 0


def fingerprint_by_hand(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints, limit=4):
    """Component of every position."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= limit:
                ri, rj = root(i), root(j)
                parent[max(ri, rj)] = min(ri, rj)
    return [root(i) for i in range(len(prints))]


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one two\tthree", "a b c d", "É É é a B", "w " * 999, *(" ".join(rng.choices("abcdefgh", k=k)) for k in (5, 9, 300, 4000))]
    got = {r["doc_id"]: r for r in simhash.near_groups(clashing(documents(spark, texts))).collect()}
    prints = [fingerprint_by_hand(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == groups_by_hand(prints)
    same = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64)
    assert xxhash.xxh64(b"a b c d", seed=42).intdigest() == same
    assert simhash.near_groups(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("cell", [2, 5, 512])
def test_links_lose_no_pair(spark, cell):
    """Clouds of fingerprints around centres, chains with steps of 4 bits and far ones; small cells take the exact way for crowded ones."""
    rng = random.Random(cell)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [flip(prints[i], rng.randrange(8)) for i in range(4) for _ in range(25)]
    chain = prints[9]
    for _ in range(6):
        prints.append(chain := flip(chain, 4))
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint").repartition(3)
    found = simhash.sweep(simhash.cells(df), most=cell).collect()
    direct = {frozenset((r["a"], r["b"])) for r in found if r["b"] is not None}
    crowded = {r["a"] for r in found if r["b"] is None}
    linked = {frozenset((signed(a), signed(b))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4}
    assert direct <= linked and len(direct) == sum(1 for r in found if r["b"] is not None)
    assert all(pair <= crowded for pair in linked - direct)
    assert bool(crowded) == (cell < 20)
    if crowded:
        members = spark.createDataFrame([(x,) for x in crowded], "fp bigint")
        stars = [(r["a"], r["b"]) for r in simhash.crowded_links(members).collect()]
        assert {frozenset(s) for s in stars} <= linked
        order = sorted(crowded)
        want = groups_by_hand([x % (1 << 64) for x in order])
        roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()}
        assert [roots.get(x, x) for x in order] == [order[i] for i in want]


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_crowded_links_of_odd_limits(spark, limit):
    """Chains with steps of exactly the limit, and steps of one bit more that must not link."""
    rng = random.Random(limit)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = [rng.getrandbits(64) for _ in range(6)]
    for p in prints[:3]:
        for _ in range(5):
            prints.append(p := flip(p, limit))
    prints += [flip(p, limit + 1) for p in prints[3:6]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    members = sorted(map(signed, set(prints)))
    stars = [(r["a"], r["b"]) for r in simhash.crowded_links(spark.createDataFrame([(x,) for x in members], "fp bigint"), limit).collect()]
    assert stars and all((a % (1 << 64) ^ b % (1 << 64)).bit_count() <= limit for a, b in stars)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()}
    want = groups_by_hand([x % (1 << 64) for x in members], limit)
    assert [roots.get(x, x) for x in members] == [members[i] for i in want]


def test_keep_one(spark):
    base = [f"w{i}" for i in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    docs = documents(spark, [" ".join(near), " ".join(base), "other words stand here now", None, ""], ids=[8, 3, 5, 6, 7])
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(n))


def test_cuts_depend_on_the_words_nearby():
    rng = random.Random(2)
    text = prose(rng, 3000)
    moved = prose(rng, 37) + " " + text

    def pieces(t):
        at = substrings.cuts(t.encode())[0].tolist()
        return [t.encode()[a:b] for a, b in zip(at, [*at[1:], None])]

    one, two = pieces(text), pieces(moved)
    assert b"".join(one) == text.encode() and len(set(one) & set(two)) > 0.98 * len(one)
    at, words = substrings.cuts(text.encode())
    assert words.sum() == 3000 and words.max() <= substrings.MOST and 6 < words.mean() < 12
    solid = "".join(rng.choices("abc", k=20_000))
    assert len(substrings.cuts(solid.encode())[0]) > 20
    for odd in ("", "   ", "a", " a", "é" * 5000, "ly " * 5000, "字" * 3000):
        at, words = substrings.cuts(odd.encode())
        for a in at.tolist():
            odd.encode()[a:].decode()  # cuts never fall into a character


def test_rolling_hash():
    data = np.frombuffer(random.Random(1).randbytes(200), np.uint8)
    h = 0
    for got, byte in zip(substrings.rolling(data), data):
        h = ((h << 1) + int(substrings.GEAR[byte])) & 0xFFFFFFFF
        assert got == h


def test_repeats(spark):
    rng = random.Random(7)
    passages = [prose(rng, rng.randrange(51, 80)) for _ in range(40)]
    texts = [prose(rng, 200) for _ in range(30)]  # clean
    texts += [f"{prose(rng, 60)}\n{p}\n{prose(rng, 60)}" for p in passages for _ in range(3)]
    texts += [None, "", "  ", prose(rng, 8), prose(rng, 20_000)]
    docs = documents(spark, texts)
    spans = substrings.repeats(clashing(docs)).collect()
    found = {r["doc_id"] for r in spans}
    later = {30 + 3 * i + k for i in range(40) for k in (1, 2)}
    assert found == later
    for r in spans:
        passage = passages[(r["doc_id"] - 30) // 3]
        part = texts[r["doc_id"]].encode()[r["start"]:r["start"] + r["length"]].decode()
        assert part.strip() in passage and len(part.split()) == r["n_words"] >= substrings.LEAST
        assert r["first_doc_id"] == 30 + (r["doc_id"] - 30) // 3 * 3
    cut = substrings.cut_repeats(clashing(docs))
    assert cut.columns == clashing(docs).columns
    left = {r["doc_id"]: r for r in cut.collect()}
    assert set(left) == set(range(len(texts)))
    for i, t in enumerate(texts):
        if i not in later:
            assert left[i]["text"] == t
        else:
            assert passages[(i - 30) // 3] not in left[i]["text"] and left[i]["n_chars"] == len(left[i]["text"])
            assert len(left[i]["text"].split()) < len(t.split()) - 15
    assert substrings.repeats(docs.limit(0)).count() == 0 and substrings.cut_repeats(docs.limit(0)).count() == 0


def test_whole_copies_and_rows_with_the_same_id(spark):
    rng = random.Random(8)
    text = "é " + prose(rng, 120)
    docs = documents(spark, [text, text, text, text], ids=[4, 4, 9, None])
    assert {r["doc_id"] for r in substrings.repeats(docs).collect()} == {9}
    assert rows(substrings.cut_repeats(docs), "doc_id") == [(4,), (4,), (None,)]  # of 9 nothing is left


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    """Of two rows with an id, the one that is a copy goes; the unrelated one stays whole."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    one, two, passage = text(300), text(300), text(80)
    near = one.replace(" ", "  ", 1) + " "  # other white space, the same words
    docs = clashing(documents(spark, [one, near, two, near, two], ids=[3, 5, 5, 3, 5]))
    assert sorted((r["doc_id"], r["text"] == two) for r in simhash.keep_one(docs).collect()) == [(3, False), (5, True), (5, True)]
    exactly = clashing(documents(spark, [one, one, two, two, None, ""], ids=[3, 5, 5, 5, 7, 7]))
    assert sorted((r["doc_id"], r["text"] or "") for r in exact.keep_first(exactly).collect()) == sorted([(3, one), (5, two), (7, "")])
    holding, plain = f"{text(50)}\n{passage}", text(200)
    cut = substrings.cut_repeats(clashing(documents(spark, [passage + " " + text(40), holding, plain], ids=[1, 9, 9])))
    left = {r["text"] for r in cut.collect() if r["doc_id"] == 9}
    assert plain in left and holding not in left and len(left) == 2
    assert set(cut.columns) == set(clashing(docs).columns)
