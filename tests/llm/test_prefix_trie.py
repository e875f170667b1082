import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from rows import clashing

from evalspark.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def own_turns(rows):
    by_conv = {}
    for c, t, role, text in rows:
        if c is not None:
            by_conv.setdefault(c, []).append((t, role or "", text or ""))
    digest = lambda t: hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()
    return {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))] for c, ts in by_conv.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def by_hand(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[:len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in below)]
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m),
                    sum(len(x) == len(node) + 1 for x in below), len(leaves),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, rebuild=False, shard=prefix_trie.SHARD):
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found = prefix_trie.paths(df)
    if rebuild:
        conv = F.col("conv")
        found = prefix_trie.rebuilt(found, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5)
    return sorted((tuple(r) for r in prefix_trie.trie(found, shard).collect()), key=str)


def random_rows(seed, n=130):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 330), n):
        for t in range(rng.choice([1, 2, 3, 8])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["é", "", "ab", None, "𝄞x"])))
    rows += [(c, t, "user", "same") for c in range(400, 460) for t in range(3)]  # a large group of copies
    rows += [(c, t, "user", f"long {t}") for c in (500, 501, 502) for t in range(200 if c != 502 else 64)]
    return rows + rows[:9] + [(None, 1, "user", "x"), (600, None, None, None)]


@pytest.mark.parametrize("shard", [prefix_trie.SHARD, 300, 20])
def test_nodes_equal_brute_force(spark, shard):
    rows = random_rows(1)
    assert trie(spark, rows, shard=shard) == by_hand(own_turns(rows))


@pytest.mark.parametrize("seed", [2, 3])
def test_rebuilt_conversations(spark, seed):
    rows = random_rows(seed)
    assert trie(spark, rows, rebuild=True, shard=40) == by_hand(rebuilt(own_turns(rows)))


def test_long_copies_over_many_shards(spark, monkeypatch):
    """Paths beyond one matrix that many shards share, and ends hashed in several runs."""
    monkeypatch.setattr(prefix_trie, "WIDE", 4)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rng = random.Random(5)
    rows = [(c, t, "u", str(t) if t < 11 else rng.choice("ab")) for c in range(60) for t in range(rng.choice([4, 8, 11, 14, 14]))]
    assert trie(spark, rows, shard=30) == by_hand(own_turns(rows))


def test_shards_lose_nothing_without_spark():
    """One conversation without turns, and one turn repeated."""
    import numpy as np
    same = bytes(16)
    rows = list(prefix_trie.shard_nodes(np.array([7, 3]), np.array([0, 2]), same * 2, np.array([1, 1]), 0))
    nodes = [(r["depth"], r["n_convs"]) for r in rows if r["kind"] != prefix_trie.ENDS]
    assert sorted(nodes) == [(0, 2), (1, 1), (2, 1)]


def test_empty_tables(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "x")], rebuild=True) == []


def test_turnless_conversation(spark):
    """All own turns replaced, and no base: the conversation is a member of the root only."""
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert trie(spark, [(c, 0, "user", "x")], rebuild=True) == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
