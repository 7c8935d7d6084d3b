"""What a Python worker holds and sends does not grow with the input: op13 was stopped by executor memory at 6 GB."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from coffer.llm import phrases as P


class _Task:
    get = classmethod(lambda cls: cls)
    partitionId = staticmethod(lambda: 0)


@pytest.fixture
def chunks(monkeypatch):
    """Two chunks of some 200,000 words each."""
    monkeypatch.setattr(P, "TaskContext", _Task)
    monkeypatch.setattr(P, "_CHUNK", 1 << 20)
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(20_000)]
    texts = [" ".join(words[int(r.paretovariate(0.7)) % 20_000] for _ in range(2000)) + ". End" for _ in range(200)]
    table = pa.table({"lang": ["x\ny", "en"] * 100, "text": [t.encode() for t in texts]})
    out = list(P._chunks(iter(table.to_batches())))
    assert len(out) == 2
    return out


def test_asking_takes_little_memory(chunks):
    words = max(b.column("n_words")[0].as_py() for b in chunks)
    tracemalloc.start()
    try:
        for b in P._ask(7)(iter(chunks)):
            assert b.num_rows <= 7
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50 * words  # bytes; 72 a word before


def test_answers_are_bits_and_batches_are_short(chunks, monkeypatch):
    monkeypatch.setattr(P, "_ROWS", 1000)
    groups, least = 5, 9
    asked = pa.Table.from_batches(P._ask(groups)(iter(chunks)))
    answered = [P._answer(least)(asked.filter(pc.equal(asked.column("group"), g))) for g in range(groups)]
    answers = pa.concat_tables(answered).to_pylist()
    n_pairs = sum(len(x) for x in asked.column("hashes").to_pylist()) // 4
    assert sum(len(x["often"]) for x in answers) <= n_pairs // 8 + asked.num_rows
    found, direct, ends = Counter(), Counter(), 0
    pairs = Counter()
    for b in chunks:
        c = P._Chunk(b.to_pylist()[0], groups)
        for i in c.at.tolist():
            pairs[c.words[c.code[i]], c.words[c.code[i + 1]], c.langs[c.lang_of[c.code[i]]]] += 1
    for b in chunks:
        row = b.to_pylist()[0]
        c = P._Chunk(row, groups)
        here = [(x["group"], x["often"]) for x in answers if x["chunk"] == row["chunk"]]
        for out in P._chunk_grams(row | {"often": [{"group": g, "often": o} for g, o in here]}, groups):
            assert out.num_rows <= 1000
            for key, n in zip(out.column("key").to_pylist(), out.column("n").to_pylist(), strict=True):
                lang, _, phrase = key.decode().rpartition("\n")
                ends += n
                if phrase.count(" ") == 3:
                    found[lang, phrase] += n
        linked, code = set(c.at.tolist()), c.code.tolist()
        of = lambda i: (c.words[code[i]], c.words[code[i + 1]], c.langs[c.lang_of[code[i]]])  # noqa: E731, B023
        for i in range(len(code) - 3):
            if all(j in linked and pairs[of(j)] >= least for j in (i, i + 1, i + 2)):
                direct[c.langs[c.lang_of[code[i]]], b" ".join(c.words[x] for x in code[i : i + 4]).decode()] += 1
    assert direct and found == direct
    assert ends == sum(b.column("n_words")[0].as_py() for b in chunks)  # each word starts one row's phrase


def test_languages_with_line_feeds_keep_their_names(spark):
    rows = [("a\nb", "one two three"), ("a", "b one two three"), ("", "one two three"), ("a\n", "one two")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r)[:4] for r in P.collocations(docs, 3, 9).select("lang", "phrase", "a", "n").collect())
    assert got == [
        ("", "one two three", 3, 9), ("a", "b one two three", 3, 12), ("a\n", "one two", 3, 6), ("a\nb", "one two three", 3, 9)
    ]
