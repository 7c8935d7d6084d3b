import hashlib
import random

import pyarrow as pa
import pytest

from coffer.llm import suffix_dedup as S


def brute(texts, depth=200):
    seen, twice = set(), set()
    for t in texts:
        for p in range(len(t) - depth + 1):
            w = t[p : p + depth]
            (twice if w in seen else seen).add(w)
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for p in range(len(t) - depth + 1):
            if t[p : p + depth] in twice:
                cover[p : p + depth] = b"\1" * depth
        left = bytes(c for c, x in zip(t, cover) if not x)
        spans = sum(x and not (i and cover[i - 1]) for i, x in enumerate(cover))
        out.append((len(t), sum(cover), spans, hashlib.sha256(left).hexdigest()))
    return out


def make(seed, letters):
    r = random.Random(seed)

    def text(n):
        return "".join(r.choice(letters) for _ in range(n))

    passage = [text(r.choice([199, 200, 201, 260, 500])) for _ in range(6)]
    out = [None, "", "short", text(200), text(2000)]
    for _ in range(25):
        out.append(text(r.randint(0, 300)) + r.choice(passage) + text(r.randint(0, 300)))
    for _ in range(6):  # near copies
        t = list(out[4])
        for _ in range(3):
            t[r.randrange(len(t))] = "#"
        out.append("".join(t))
    inside = text(230)
    out.append(inside + text(50) + inside + inside)  # repeats within one document
    out.append("a" * 450 + text(30))  # a run overlaps itself
    out.append("ab" * 150)
    out.append(out[10])
    return out


@pytest.mark.parametrize("seed,letters", [(1, "abcdefghij "), (2, "ab"), (3, "äöü€ x")])
def test_against_brute_force(spark, seed, letters):
    texts = make(seed, letters)
    rows = [(k if k else None, t, "clash", 3) for k, t in enumerate(texts)] + [(7, texts[8], "same id", 3), (7, texts[8], "same id", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string, tag int").repartition(4)
    got = [tuple(r) for r in S.suffix_dedup(d).collect()]
    want = [(r[0], *w) for r, w in zip(rows, brute([(r[1] or "").encode() for r in rows]), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_many_texts_under_a_null_and_a_repeated_id(spark):
    r = random.Random(8)
    passage = ["".join(r.choice("abcdefgh ") for _ in range(230)) for _ in range(40)]
    rows = []
    for k in range(1500):
        own = "".join(r.choice("abcdefgh ") for _ in range(r.randint(5, 60)))
        rows.append((r.choice([None, 7, -(2**63)]), own + r.choice(passage) + own[::-1] if k % 2 else own * 5))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(x) for x in S.suffix_dedup(d).collect()]
    want = [(x[0], *w) for x, w in zip(rows, brute([x[1].encode() for x in rows]), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts_go_through_in_parts(spark, monkeypatch):
    texts = [t.encode() for t in make(4, "abcd") if t]
    whole = sorted((k, *rest) for g in S.anchors(texts) for k, *rest in zip(*(x.tolist() for x in g)))
    monkeypatch.setattr(S, "_CHUNK", 700)
    parts = sorted((k, *rest) for g in S.anchors(texts) for k, *rest in zip(*(x.tolist() for x in g)))
    assert whole == parts


@pytest.mark.parametrize("period", ["a", "ab", "abcdefghijklmnop" * 3, "0123456789" * 17])
def test_periodic_texts_are_few_rows(spark, period):
    long = (period * (3_000_000 // len(period) + 1))[:3_000_000]
    d = spark.createDataFrame([(1, long), (2, "x" + long[:700] + "y"), (3, period * 2)], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in S.suffix_dedup(d).collect())
    assert got == [(1, 3_000_000, 3_000_000), (2, 702, 700), (3, 2 * len(period), 2 * len(period) if len(period) >= 100 else 0)]
    batch = pa.RecordBatch.from_pydict({"doc": [1], "tag": [1], "text": [long.encode()]})
    # in each part of the text: a run, and the anchors at its two ends
    assert sum(b.num_rows for b in S._places([batch])) <= 30


def test_text_that_stays_and_empty_table(spark):
    d = spark.createDataFrame([(1, "x" + "0123456789" * 25), (2, "0123456789" * 25 + "y")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept_text"]) for r in S.suffix_dedup(d, with_text=True).collect()}
    assert got == {1: b"x", 2: b"y"}
    assert S.suffix_dedup(d.limit(0)).collect() == []
