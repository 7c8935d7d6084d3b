import re
import zlib
from collections import Counter

from coffer.llm import quality as Q
from coffer.llm import sharding as S

TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c a b c", "the cat is in the house\n" * 30, "x\n\nx\n y\nx", "#* $% &| <> the",
    " ".join(f"word{k} the" for k in range(60)), "the é\x0b\x00 ü𝒳 and\x85b " * 30, "a " * 5000, "#" * 100 + " the of " * 40,
]


def measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    rep = len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep


def test_quality_rules(spark):
    rows = [(k, t, True, 5) for k, t in enumerate(TEXTS)] + [(None, TEXTS[8], None, None), (3, "one", False, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, n_words long")
    got = sorted((tuple(r) for r in Q.quality_rules(d).collect()), key=str)
    want = []
    for doc_id, t, *_ in rows:
        m = measures(t)
        want.append((doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert [g[:7] for g in got] == sorted(want, key=str)
    assert all(not g[7] for g in got if g[6])
    assert {g[0] for g in got if g[7]} == {8, 9 if measures(TEXTS[9])[4] * 2 <= measures(TEXTS[9])[0] else 8, None}
    kept = Q.keep_good(d)
    assert kept.columns == d.columns and kept.count() == sum(g[7] for g in got)
    assert Q.quality_rules(d.limit(0)).collect() == []


def test_shards(spark):
    rows = [(k * 7 % 101, "t" * (k % 50), "clash") for k in range(101)] + [(None, None, "x"), (4, "ü", "x"), (4, "ü", "x")]
    rows += [(1000, "same", "hot")] * 300
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = sorted((tuple(r) for r in S.shard_by_bytes(d, 7).collect()), key=lambda r: (r[4], r[5]))
    assert len(got) == len(rows)
    size = {s: sum(g[1] for g in got if g[4] == s) for s in range(7)}
    assert max(size.values()) - min(size.values()) <= 2 * max(g[1] for g in got)
    for s in range(7):
        assert [g[5] for g in got if g[4] == s] == list(range(sum(g[4] == s for g in got)))
    order = [g[0] for g in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert {(g[0], g[1], g[2]) for g in got} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert S.shard_by_bytes(d.limit(0)).collect() == []
