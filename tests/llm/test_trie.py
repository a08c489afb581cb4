"""The conversation trie against nodes as plain tuples."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from marketlake.llm import trie
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    nodes = collections.defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = own.get(base, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append((c, d == len(whole)))
    children, leaves, saved = collections.Counter(k[:-1] for k in nodes if k), collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    first = {k: min(c for c, _ in m) for k, m in nodes.items()}
    return sorted((first[k], len(k), first[k[:-1]] if k else -1, len(m), children[k], leaves[k], saved[k], sha([c for c, e in m if e])) for k, m in nodes.items())


def rows_of(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def talks(rng, n, most, kinds):
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "b c", " d\n e f ", "x" * 300])) if kinds > 2 else (rng.choice(["u", "v"][:kinds]), "w w")
    out = []
    for c in range(-25, n):
        out += [(c, rng.choice([k, k, k, None, 0]), *turn()) for k in range(rng.randint(1, most))]
    return out


@pytest.mark.parametrize("seed,n,most,kinds", [(1, 150, 6, 3), (2, 300, 4, 2), (3, 60, 25, 1), (4, 40, 60, 2)])
def test_nodes(spark, monkeypatch, seed, n, most, kinds):
    monkeypatch.setattr(trie, "CHUNK", 7)
    monkeypatch.setattr(trie, "HOT", 3)
    rng = random.Random(seed)
    rows = talks(rng, n, most, kinds)
    rows += [(None, 1, "user", "lost"), (7000, None, None, None), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, ha string").repartition(3)
    got = trie.prefix_trie(df)
    assert got.columns == COLUMNS
    assert rows_of(got) == brute(rows)


def test_hot_groups(spark, monkeypatch):
    """A third of the conversations are one and the same, another third shares a first turn, one is very long."""
    monkeypatch.setattr(trie, "CHUNK", 50)
    monkeypatch.setattr(trie, "HOT", 20)
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c, k, "user", f"same {k}") for c in range(0, 900, 3) for k in range(3)]
    rows += [(c, k, "user", "same 0" if not k else f"own {c} {k}") for c in range(1, 900, 3) for k in range(4)]
    rows += [(5001, k, "user", "on and on") for k in range(1500)] + [(5002, k, "user", "on and on") for k in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(trie.prefix_trie(df)) == brute(rows)


def test_paths_cross_owners(spark):
    """Heavy children with larger and larger smallest members: pointers are doubled along them."""
    rows = []
    chain = [f"t{k}" for k in range(12)]
    for k in range(12):
        for c in range(k + 1):  # many share a deep prefix, the smallest ids leave early
            rows += [(100_000 * (k + 1) + 1000 * c, d, "r", t) for d, t in enumerate([*chain[:k], f"end {k} {c}"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(trie.prefix_trie(df)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).count() == 0
    assert trie.prefix_trie(df.where("false")).columns == COLUMNS
