"""The prefix trie against plain Python."""

import hashlib
import random
import zlib

import pytest

from storyspark.llm import prefix_trie as trie
from storyspark.llm import queries

TURNS = "conv_id long, turn long, role string, text string, n_convs long, seq string, depth int"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    for turns in own.values():
        turns.sort()
    own = {c: [(t[2], t[4]) for t in turns] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    first = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    return {c: own.get(first(c), [])[:h[c]] + own[c][h[c]:] for c in own}


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}
    out = []
    for p, own in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(p))))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children[p]), sum(not children[q] for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **sizes):
    got = trie.nodes(trie.rebuild(df), **sizes)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 3), n):
        for k in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é😀", None, "", "x" * 40])))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 25, "fan_in": 2}])
def test_trie_equals_brute_force(spark, sizes):
    rows = made(5, 120)
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(90) for t in range(7)]  # a hundred of copies
    rows += [(2000 + k, t, "user", "first" if t < 8 else f"{k}") for k in range(80) for t in range(9)]  # one node with many children
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], TURNS).repartition(5)
    assert found(df, **sizes) == brute(rows)


def test_forests_join_across_boundaries_in_plain_python():
    rng = random.Random(8)
    name = lambda k: bytes([k]) * trie.NAME
    seqs = sorted({b"".join(name(rng.randrange(3)) for _ in range(rng.randrange(7))) for _ in range(300)})
    rows = lambda own: [(s, [1] * (len(s) // trie.NAME), {len(s) // trie.NAME: [1, i, 0, 0, 0, "e"]}) for i, s in own]
    every = list(enumerate(seqs))
    whole, left = trie.contract(rows(every), True, False)
    assert not left
    for size in (1, 2, 7):
        closed, paths = [], []
        for k in range(0, len(every), size):
            c, p = trie.contract(rows(every[k:k + size]), False, False)
            closed, paths = closed + c, paths + p
        c, p = trie.contract(paths, True, True)
        assert not p
        key = lambda n: (n[1], n[0], *n[5:])
        assert sorted(map(key, closed + c)) == sorted(map(key, whole))
        names = {n[4]: n[0] for n in c}
        assert sorted((n[1], n[0], names[n[3]] if n[3] else n[2]) for n in closed + c if n[1]) == sorted((n[1], n[0], n[2]) for n in whole if n[1])


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 3, "user", "b"), (7, 3, "assistant", "a"), (100, 0, "user", "only"),
            (101, 0, "user", "own"), (-5, 0, "user", "neg"), (300, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], TURNS)
    assert found(df) == brute(rows)
    assert found(spark.createDataFrame([], TURNS)) == []


def test_query_reads_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_prefix_trie"](spark, folder)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
