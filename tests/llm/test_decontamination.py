import hashlib
import random
import re

import pytest

from coffer.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, t in items:
            iw = words(t)
            n = min(13, len(iw))
            for i in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[i : i + n]:
                        hit.update(range(p, p + n))
                        names.add("" if name is None else str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def case(seed, letters="ab"):
    r = random.Random(seed)

    def text(n):
        return "".join(r.choice(letters) + r.choice([" ", ", ", "\n", " Ä "]) for _ in range(n))

    items = [(k, text(r.choice([0, 1, 3, 12, 13, 14, 30]))) for k in range(6)] + [(None, text(15)), (2, text(20)), (9, None)]
    docs = [(k, text(r.randint(0, 60))) for k in range(25)]
    for k in range(8):
        docs.append((100 + k, text(r.randint(0, 9)) + (r.choice(items)[1] or "") + text(r.randint(0, 200))))
    docs += [(None, docs[-1][1]), docs[-1], (7, None), (8, ""), (9, items[5][1] + "x " * 3000)]
    return docs, items


@pytest.mark.parametrize("seed,letters,block", [(1, "ab", 10**6), (2, "abcdefgh", 10**6), (3, "abc", 20), (4, "abcdefgh", 30)])
def test_against_brute_force(spark, seed, letters, block):
    docs, items = case(seed, letters)
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, n_words string, item_id long")
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in D.contamination(d, b, max_block_words=block).collect()]
    want = brute(docs, items)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = [tuple(r) for r in D.remove_contaminated(d, b, max_block_words=block).collect()]
    assert sorted(kept, key=key) == sorted(
        ((i, t, "clash", 1) for (i, t), w in zip(docs, want) if not w[-1]), key=key
    )


def test_blocks_get_the_stretches_of_their_anchors_only(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([2, 8, 40, 90])))) for k in range(60)]
    clean = [(k, " ".join(r.choices([f"c{j}" for j in range(400)], k=300))) for k in range(40)]
    dirty = [(100 + k, f"{clean[k][1]} {items[k][1]} {clean[k][1]}") for k in range(30)] + [(100, f"x {items[3][1]}")] * 50
    d = spark.createDataFrame(clean + dirty, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    written = {}
    dealt = D._dealt

    def spy(df, n, name):
        out = dealt(df, n, name)
        written[name] = (n, out.count())
        return out

    monkeypatch.setattr(D, "_dealt", spy)
    got = [tuple(x) for x in D.contamination(d, b, max_block_words=300).collect()]
    assert sorted(got) == sorted(brute(clean + dirty, items))
    blocks, rows = written["document-stretches"]
    # stretches of hit places and of hash collisions, not of all the texts' words
    assert blocks > 10 and rows < 80 * 40


def test_clashing_columns_stay_with_large_benchmarks(spark):
    docs, items = case(7, "abc")
    columns = "doc_id long, text string, hash string, spans int, names string, row long, block int, anchor string"
    rows = [(i, t, "h", 1, None, 2, 3, "a") for i, t in docs]
    b = spark.createDataFrame(items, "item_id long, text string")
    left = D.remove_contaminated(spark.createDataFrame(rows, columns), b, max_block_words=20)
    want = [x for x, w in zip(rows, brute(docs, items)) if not w[-1]]
    assert left.columns == ["doc_id", "text", "hash", "spans", "names", "row", "block", "anchor"]
    assert sorted(map(tuple, left.collect()), key=key) == sorted(want, key=key)


def test_anchors_are_those_of_equal_windows():
    r = random.Random(6)
    words = [bytes([97 + r.randrange(3)]) for _ in range(3000)]
    hashed = D._hashed(words)
    for length in (1, 2, 3, 5, 13):
        seen = {}
        for p, a in enumerate(D.anchors(hashed, length).tolist()):
            assert seen.setdefault(tuple(words[p : p + length]), a) == a
        covered = [(s, e - length) for _, s, e in D.stretches(hashed, length)]
        assert covered[0][0] == 0 and covered[-1][1] == len(words) - length
        assert all(y[0] == x[1] + 1 for x, y in zip(covered, covered[1:]))
    assert len(D.anchors(hashed[:4], 5)) == 0


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.contamination(d, b).collect()] == [(1, 3, 0, 0)]
    assert D.contamination(d.limit(0), b).collect() == []
    assert D.remove_contaminated(d, b).count() == 1


def test_long_spans_are_cut(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rest = " ".join(f"z{k}" for k in range(500))
    d = spark.createDataFrame([(1, f"{rest}, {item}. End"), (2, f"{item} end")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r) for r in D.remove_contaminated(d, b, longer_than=15).collect()] == [(1, f"{rest}, . End")]
