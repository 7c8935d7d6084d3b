"""The pipeline's stages against plain Python on a small corpus."""

import random

import corpus_pipeline as C
import pytest
from test_decontamination import brute as contaminated
from test_minhash import brute as near
from test_quality_sharding import measures
from test_spans import base_pii

from coffer.llm import quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    lexicon = ["the", "of", "and", "to", "in"] + ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(800)]

    def text(n):
        return " ".join(r.choice(lexicon) if r.random() < 0.7 else r.choice(lexicon[:5]) for _ in range(n))

    items = [(k, text(r.choice([8, 20, 40]))) for k in range(5)]
    docs = []
    for k in range(60):
        kind, t = k % 6, text(r.randint(60, 200))
        if kind == 1:
            t = t + " mail x.y@z.example now, call +1 234 567 8901"
        elif kind == 2:
            t = t + " " + items[k % 5][1]
        elif kind == 3 and docs:
            w = docs[-3][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif kind == 4:
            t = "# | # " * 40 + t if k % 4 else text(20)
        docs.append((3 * k + 1, t, "en", f"src{k % 3}", len(t)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, text(80), "en", "s", 9), docs[7], docs[7]]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def good(t):
    m = dict(zip(quality.MEASURES, measures(t), strict=True))
    w = (t or "").split()
    lines = [x for x in (t or "").split("\n") if x.strip()]
    stops = {*quality.STOP_WORDS, *(x.capitalize() for x in quality.STOP_WORDS)}
    m |= {"one": 1, "n_lines": len(lines), "n_stop_words": sum(x in stops for x in w)}
    return all(
        (r.least is None or m[r.numerator] >= r.least * m[r.denominator]) and (r.most is None or m[r.numerator] <= r.most * m[r.denominator])
        for r in quality.RULES
    )


def test_run_against_plain_python(spark, folder):
    path, docs, items = folder
    kept = [d for d in docs if good(d[1])]
    assert 0 < len(kept) < len(docs)
    with_id = list({d[0]: d for d in kept if d[0] is not None}.values())
    groups = near([(d[0], d[1]) for d in with_id])
    unique = [d for d in with_id if groups[d[0]][1] == d[0]] + [d for d in kept if d[0] is None]
    assert len(unique) < len(kept)
    verdict = contaminated([(d[0], d[1]) for d in unique], items)
    clean = [d for d, v in zip(unique, verdict, strict=True) if not v[-1]]
    assert 0 < len(clean) < len(unique)
    want = {}
    for doc_id, t, lang, source, _ in clean:
        for k, s, e in sorted(base_pii(t), key=lambda x: -x[1]):
            t = f"{t[:s]}<{k.upper()}>{t[e:]}"
        want[doc_id] = (t, lang, source, len(t))
    got = C.run(spark, path).collect()
    assert {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"]) for r in got} == want
    assert len(got) == len(want) and all(r["lossless"] and r["n_pieces"] == len(r["piece_ids"]) > 0 for r in got)
    assert any("<EMAIL>" in r["text"] for r in got)


def test_near_duplicates_are_rows_not_ids(spark, folder):
    path, _, _ = folder
    r = random.Random(3)

    def text():
        return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))

    own, copy, near_one = [text() for _ in range(8)], text(), text()
    rows = [(5, own[0]), (5, own[1]), (5, own[2]), (None, own[3]), (None, own[4])]  # clean, under shared ids
    rows += [(5, copy), (2, copy), (2, copy), (None, copy)]  # one copy stays: id 2
    rows += [(7, near_one + " end"), (5, near_one), (9, own[5]), (9, near_one)]  # id 5
    rows += [(None, own[6]), (None, own[6]), (None, own[6])]  # copies without an id
    rows += [(8, None), (8, ""), (None, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in C.near_duplicate_stage(spark, d, path).collect()]
    want = [*rows[:5], (2, copy), (5, near_one), (9, own[5]), (None, own[6]), *rows[-3:]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    path, _, _ = folder
    docs = C.documents(spark, path).selectExpr("*", "1 AS kept", "'x' AS n_words", "2 AS component_id")
    for name, stage in C.STAGES:
        out = stage(spark, docs, path)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        if name != "pieces":
            assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).collect() == []
