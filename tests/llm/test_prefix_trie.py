import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from coffer.llm import prefix_trie as P

SCHEMA = "conv_id long, turn int, role string, text string, depth string, pos int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    kids = defaultdict(int)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    leaves, gain = defaultdict(int), defaultdict(int)
    for n, m in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            gain[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == n)))
        up = min(nodes[n[:-1]]) if n else None
        out.append((min(m), len(n), up, len(m), kids[n], leaves[n], gain[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    d = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(5)
    out = P.prefix_trie(d)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("small", [True, False])
def test_equal_to_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(P, "SEGMENT", 3)
    r = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 230), -205, -200, -7, 9_000_000_000]:
        n = r.choice([1, 2, 3, 5, 8, 9])
        rows += [(c, t, r.choice(["user", None, "assistant"]), r.choice(["a", "bb", "é𝒳", "", None])) for t in range(n)]
    for c in range(400, 480):  # a large group of the same conversation
        rows += [(c, t, "user", "same") for t in range(7)]
    rows += [(3, None, "user", "x"), (3, None, "user", "x"), (5, 1, "b", "y"), (5, 1, "a", "y"), (None, 1, "user", "lost")]
    rows += [(17, t, "user", f"long {t % 3}") for t in range(60)] + [(18, t, "user", f"long {t % 3}") for t in range(61)]
    assert got(spark, rows) == brute(rows)


def test_turnless_single_and_empty(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone")]  # no base, and its only turn is replaced
    assert got(spark, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert got(spark, [(None, 1, "user", "x")]) == []


def test_pieces_of_end_lists(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 7)
    rows = [(c, t, "user", "same") for c in range(1, 60) for t in range(8)]
    assert got(spark, rows) == brute(rows)
