import random
import re
from collections import Counter, defaultdict

import pytest

from coffer.llm import phrases as P


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 80 * cand[lang, w[i : i + k]]:
                    dropped.add((lang, w[i : i + k]))
    by = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in dropped:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            by[lang].append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted((lang, r + 1, p.decode(), *x) for lang, v in by.items() for r, (_, _, p, *x) in enumerate(sorted(v)[:top]))


def got(spark, rows, least, top):
    d = spark.createDataFrame([(k, lang, t, "x", 1) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int")
    out = P.collocations(d.repartition(3), least, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def corpus():
    r = random.Random(2)
    words = ["a", "B", "the", "é", "cat's", "x-y", "\x0e", "of", "日本", "zz"]
    passage = " ".join(f"p{k}" for k in range(300))  # a long path with one way through
    out = []
    for _ in range(400):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", " ; "]) for _ in range(r.randrange(40)))
        out.append((r.choice(["en", "en", None, "und", "fr"]), t))
    out += [("en", passage + " " + r.choice(words)) for _ in range(12)] + [("en", "p10 p11 p12 p13 end") for _ in range(5)]
    out += [("fr", "a a a a a a a a"), ("fr", None), (None, ""), ("xx", " .,;"), ("en", "the of " * 3000)]
    return out


@pytest.mark.parametrize(("least", "top", "chunk"), [(6, 25, 1 << 22), (3, 10_000, 500)])
def test_equal_to_brute_force(spark, monkeypatch, least, top, chunk):
    monkeypatch.setattr(P, "_CHUNK", chunk)
    rows = corpus()
    assert got(spark, rows, least, top) == brute(rows, least, top)


def test_paths_are_merged(spark):
    edges = [("en", f"{a} {a + 1} {a + 2} {a + 3}", 9) for a in range(10, 60)] + [("en", "x 20 21 22", 4)]
    nodes = [("en", f"{a} {a + 1} {a + 2}", 9) for a in range(10, 64)] + [("en", "x 20 21", 4)]
    nodes = [(x, p, 13 if p == "20 21 22" else n) for x, p, n in nodes]
    of = lambda x: spark.createDataFrame(x, "lang string, phrase string, f long")
    paths = P.unary_paths(of(edges), of(nodes)).collect()
    windows = sorted((" ".join(p["words"][i : i + 4]), p["f"]) for p in paths for i in range(len(p["words"]) - 3))
    assert windows == sorted((p, n) for _, p, n in edges)
    assert len(paths) < 15


def test_nothing_to_find(spark):
    assert got(spark, [("en", "one two three"), (None, None)], 2, 5) == []
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert P.collocations(empty).collect() == []
