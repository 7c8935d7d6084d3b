import math
import random

import pytest

from coffer.llm import top_k as T


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q is None or q % 50:
            continue
        best = sorted(
            (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=False)))), c is None, c or 0) for c, y in ok if c is None or c != q
        )[:k]
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(best)]
    return sorted(out, key=str)


def got(spark, rows, k=5, kind="array<float>"):
    d = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], f"vec_id long, embedding {kind}, rank string, score double")
    return sorted((tuple(r) for r in T.top_k_of_every_50th(d.repartition(3), k).collect()), key=str)


@pytest.mark.parametrize("small", [True, False])
def test_equal_to_brute_force(spark, monkeypatch, small):
    if small:  # several groups, stripes and tiles
        for name, n in (("BLOCK", 16), ("_BLOCK_BYTES", 4000), ("GROUP", 8), ("STRIPE", 64), ("_TILE", 3)):
            monkeypatch.setattr(T, name, n)
    r = random.Random(5)
    unit = lambda: [round(x / 4) * 4 / 256 for x in (r.gauss(0, 40) for _ in range(48))]
    rows = [(k, unit()) for k in range(700)]
    rows += [(1000 + k, rows[50][1]) for k in range(20)]  # ties
    rows += [(2000, []), (2050, None), (2100, [1.0, None]), (2150, [float("nan")]), (2200, [float("inf")]), (2250, [0.5] * 7)]
    rows += [(100, rows[100][1]), (None, rows[3][1]), (None, rows[50][1])]
    assert got(spark, rows) == brute(rows)


def test_bounds_drop_candidates():
    """Late blocks of far candidates are left out, and the result is that of all sums."""
    import numpy as np

    rng = np.random.default_rng(1)
    m = np.floor(rng.standard_normal((600, 64)) * 256 / np.arange(1, 65))  # most mass in the first blocks
    names = ("ids", "n", "dim", "peak", "parts", "masses")
    row = lambda at, x: dict(zip(names, T._block(list(range(at, at + len(x))), x), strict=True)) | {"block": at}
    cell = T._Cell([row(10_000, m[:40])], 5, True)
    seen = []
    pairs = T._Cell._pairs
    T._Cell._pairs = lambda self, tile, c, at, *rest: (seen.append(len(at)), pairs(self, tile, c, at, *rest))
    try:
        for at in range(0, 600, 100):
            cell.meet(row(at, m[at : at + 100]))
    finally:
        T._Cell._pairs = pairs
    want = np.argsort(-(m[:40] @ m.T), axis=1, kind="stable")[:, :5]
    assert (cell.found == want).all()
    assert seen and sum(seen) < 0.1 * 40 * 600


def test_large_numbers_few_rows_and_empty(spark):
    rows = [(0, [1e12, -3.0]), (50, [2e11, 0.001]), (3, [1e300, 1.0]), (4, [-0.5, 0.25])]
    assert got(spark, rows, kind="array<double>") == brute(rows)
    assert got(spark, [(0, [1.0])]) == []
    assert got(spark, [(7, [1.0])]) == []
    assert got(spark, [(50, [1.0]), (1, [0.5])], k=3) == [(50, 1, 1, 32768)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.top_k_of_every_50th(empty).collect() == []
