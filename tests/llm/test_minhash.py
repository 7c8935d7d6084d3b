import random

import numpy as np
import pytest

from coffer.llm import minhash as M
from coffer.llm import shingles as S


def brute(rows):
    """(doc_id, text) -> {doc_id: (set size, component)} for unique doc_ids."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def make(seed):
    r = random.Random(seed)

    def word():
        return "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))

    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([1, 3, 5, 8, 30, 120, 400]))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 2)] = [word() for _ in range(r.randint(0, 2))]
            out.append(r.choice([" ", "\n", " \t "]).join(x.upper() if r.random() < 0.1 else x for x in w))
    passage = " ".join(word() for _ in range(60))
    out += [passage + " " + " ".join(word() for _ in range(r.randint(10, 60))) for _ in range(25)]
    # a chain: each near the next, the ends far apart
    chain = [word() for _ in range(200)]
    for _ in range(8):
        out.append(" ".join(chain))
        k = r.randrange(0, 180)
        chain[k : k + 15] = [word() for _ in range(15)]
    out += [None, "", " \n", out[3], out[3], "\x85 ü ü", "word"]
    r.shuffle(out)
    return [(7 * k + 3, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = make(seed)
    d = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, key string, id int").repartition(4)
    got = {r["doc_id"]: r for r in M.near_duplicates(d).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e F"), (3, None), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in M.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=str)
    assert M.near_duplicates(d.limit(0)).collect() == []


def test_word_hashes_do_not_depend_on_grouping(monkeypatch):
    r = random.Random(5)
    texts = [("".join(r.choice("ab \n") for _ in range(r.randint(0, 400)))).encode() for _ in range(50)]
    whole = [h.tolist() for h in S.word_hashes(texts)]
    assert [len(h) for h in whole] == [len(t.split()) for t in texts]
    seen = {}
    for t, h in zip(texts, whole):
        for w, x in zip(t.split(), h):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(S, "_CHUNK", 150)
    assert [h.tolist() for h in S.word_hashes(texts)] == whole


def test_a_word_of_any_size_is_one_hash(monkeypatch):
    r = random.Random(6)
    for n in (S._CHUNK - 2, S._CHUNK - 1, S._CHUNK, 3 * S._CHUNK):
        w = r.randbytes(n // 2).hex().encode() + b"z" * (n % 2)
        (alone,), (around), (other,) = S.word_hashes([w, b"a " + w.upper() + b"\nb", w[:-1] + b"y"])
        assert around.tolist() == [*next(S.word_hashes([b"a"])), alone, *next(S.word_hashes([b"b"]))]
        assert alone != other and len(S.shingle_set(np.array([alone]))) == 1
    texts = [b"".join(r.choice([b"a", b"b", b"B" * 7, b"x" * 300, b" ", b"\n"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    whole = [h.tolist() for h in S.word_hashes(texts)]
    assert [len(h) for h in whole] == [len(t.split()) for t in texts]
    monkeypatch.setattr(S, "_CHUNK", 50)
    assert [h.tolist() for h in S.word_hashes(texts)] == whole


def test_estimate_follows_the_similarity(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 1000).astype("u8")
    for share in (0.5, 0.75, 0.95):
        other = np.concatenate((base[: int(1000 * share)], r.integers(0, 2**63, 1000 - int(1000 * share)).astype("u8")))
        j = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        equal = (M.minima(base) == M.minima(other)).mean()
        assert abs(equal - j) < 0.15


def test_repeated_rows_make_no_more_pairs(spark, monkeypatch):
    """2,000 copies of each of two linked rows are two sets and one pair."""
    made = {}
    saved = M.saved

    def counted(df, name):
        out = saved(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(M, "saved", counted)
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join([*words, "more"])
    d = spark.createDataFrame([(1, a), (2, b)] * 2000 + [(3, "else where"), (9, a)], "doc_id long, text string").repartition(8)
    got = M.near_duplicates(d).groupBy("doc_id", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 2000), (2, 1, 2000), (3, 3, 1), (9, 1, 1)]
    assert max(made[x] for x in ("minhash-sets", "minhash-pairs", "minhash-links")) <= 2


def test_texts_that_share_a_doc_id_are_one_document(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 5) for _ in range(40))
    x, y, z = text(), text(), text()
    rows = [(5, x), (5, y), (5, text()), (8, x + " end"), (2, y + " end"), (9, z), (7, z)] + [(20, text()) for _ in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(q["doc_id"], q["component_id"]) for q in M.near_duplicates(d).collect()}
    assert got == {(5, 2), (8, 2), (2, 2), (9, 7), (7, 7), (20, 20)}


def test_parity_sketches_bound_the_unshared_shingles(spark):
    r = np.random.default_rng(4)
    rows = []
    for n, other in ((300, 40), (300, 300), (5000, 100), (1, 0), (9000, 9000)):
        x = np.unique(r.integers(0, 2**63, n).astype("u8"))
        y = np.unique(np.concatenate((x[other // 2 :], r.integers(0, 2**63, other // 2).astype("u8"))))
        common = len(np.intersect1d(x, y))
        link = 100 * common >= M.LEAST * (len(x) + len(y) - common)
        odd = int(np.bitwise_count((M.parities(x) ^ M.parities(y)).view("u8")).sum())
        assert odd <= len(x) + len(y) - 2 * common
        rows.append((M.parities(x).tolist(), M.parities(y).tolist(), len(x), len(y), link))
    d = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>, nx long, ny long, link boolean")
    got = [(q.link, q.may) for q in d.select("link", M._may_link("x", "y", "nx", "ny").alias("may")).collect()]
    assert all(may for link, may in got if link) and (False, False) in got


def test_families_just_below_the_limit_make_no_pairs(spark, monkeypatch):
    """Of 60 texts with mutual similarities of some 0.7, no pair is a link, and few become rows."""
    made = {}
    saved = M.saved

    def counted(df, name):
        out = saved(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(M, "saved", counted)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in range(7):  # no two texts differ from the base at one place
            w[(k * 57 + (i % 19) * 3 + i // 19) % 400] = f"x{i}y{k}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {q["doc_id"]: (q["n_shingles"], q["component_id"]) for q in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert made["minhash-pairs"][-1] <= 60
