import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from coffer.llm import pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "\n", "a", "Hello world, hello  world.", "  lead and trail  ", "tab\there\r\n\n", "▁ literal ▁▁", "Größe façade ñandú",
    "中文字符 𝒳😀 \x00\x7f", "<s> </s> <unk> <0x41>", "x" * 3000, "no_spaces_" * 400, "the " * 2000,
]


@pytest.fixture(scope="module")
def vocabulary():
    return P.load(MODEL)


def segmentations(v, text):
    """All (ids, log weight) of a short text, by brute force over its bytes."""
    words = {s: i for i, s in enumerate(v.surface) if s and len(s) <= P.MAX_PIECE and np.isfinite(v.logs[i]) and i not in set(v.byte_ids.tolist())}

    def walk(at):
        if at == len(text):
            yield (), 0.0
            return
        edges = [(text[at : at + n], words[text[at : at + n]]) for n in range(1, P.MAX_PIECE + 1) if at + n <= len(text) and text[at : at + n] in words]
        start = at
        while start and text[start] & 0xC0 == 0x80:
            start -= 1
        end = start + 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        if text[start:end] not in words:
            edges.append((text[at : at + 1], int(v.byte_ids[text[at]])))
        for s, i in edges:
            for ids, w in walk(at + len(s)):
                yield (i, *ids), w + v.logs[i]

    return list(walk(0))


@pytest.mark.parametrize("text", ["there", " the", "a b", "ñu\n", "  x", "中a"])
def test_samples_follow_the_lattice(vocabulary, text):
    data = text.encode()
    every = segmentations(vocabulary, data)
    total = sum(math.exp(w) for _, w in every)
    share = {ids: math.exp(w) / total for ids, w in every}
    n = 20_000
    got = collections.Counter(tuple(x.tolist()) for x in P.Sampler(vocabulary, 5).encode([data] * n, np.arange(n).astype("u8")))
    assert set(got) <= set(share)
    for ids, p in share.items():
        assert abs(got[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_pieces_of_any_length_are_in_the_lattice(vocabulary):
    byte_ids = set(vocabulary.byte_ids.tolist())
    words = {s: i for i, s in enumerate(vocabulary.surface) if s and np.isfinite(vocabulary.logs[i]) and i not in byte_ids}
    long = [s for s in words if len(s) > 16]
    assert len(long) == 20 and max(map(len, long)) == 25
    for k, s in enumerate(long):
        edges = vocabulary.edges(np.frombuffer(s, "u1"), np.full(len(s), len(s)))
        every = {(a, n): words[s[a : a + n]] for a in range(len(s)) for n in range(1, len(s) - a + 1) if s[a : a + n] in words}
        assert {(a, w + 1): int(edges[a, w]) for a, w in zip(*np.nonzero(edges >= 0)) if s[a : a + w + 1] in words} == every
        if k % 5:
            continue
        # forward sums over all pieces: the share of the segmentation of one piece
        sums = [1.0] + [0.0] * len(s)
        for e in range(1, len(s) + 1):
            sums[e] = sum(sums[a] * math.exp(vocabulary.logs[i]) for (a, n), i in every.items() if a + n == e)
        n, share = 20_000, math.exp(vocabulary.logs[words[s]]) / sums[-1]
        got = sum(x.tolist() == [words[s]] for x in P.Sampler(vocabulary, 5).encode([s] * n, np.arange(n).astype("u8")))
        assert abs(got / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_round_trip_and_reproducibility(spark, vocabulary):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "null id", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_pieces string")
    one = P.encode(d.repartition(3), MODEL)
    two = {(r["doc_id"], r["text"]): r["piece_ids"] for r in P.encode(d.repartition(1), MODEL).collect()}
    out = P.decode(one, MODEL).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "piece_ids", "n_pieces", "ids_crc32", "decoded"}
    for r in out:
        assert r["decoded"] == (r["text"] or "")
        assert r["piece_ids"] == two[r["doc_id"], r["text"]] and r["n_pieces"] == len(r["piece_ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["piece_ids"], "<u4").tobytes())
        assert not {0, 1, 2} & set(r["piece_ids"])
    other = P.encode(d, MODEL, seed=18).agg(F.sum("ids_crc32")).first()[0]
    assert other != one.agg(F.sum("ids_crc32")).first()[0]
    assert P.round_trip(d, MODEL).filter("not lossless").count() == 0
    assert P.round_trip(d.limit(0), MODEL).collect() == []


def test_groups_do_not_change_samples(vocabulary, monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("ab é\n") for _ in range(r.randint(0, 60))).encode() for _ in range(80)]
    keys = np.arange(80).astype("u8")
    whole = [x.tolist() for x in P.Sampler(vocabulary, 1).encode(texts, keys)]
    monkeypatch.setattr(P, "_GROUP", 100)
    assert [x.tolist() for x in P.Sampler(vocabulary, 1).encode(texts, keys)] == whole


@pytest.mark.parametrize("window", [40, 1 << 16])
def test_long_units_are_drawn_as_short_ones(vocabulary, monkeypatch, window):
    """The windowed filter gives the segmentations of the array form, but for ties within rounding."""
    r = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzéñ中😀0123456789"
    texts = ["".join(r.choice(alphabet) for _ in range(600)).encode() for _ in range(5)] + [("ab" * 300).encode(), b"short one " + b"y" * 200]
    texts.append(b"two " + texts[0] + b" and " + texts[0] + b" end")
    keys = np.arange(len(texts)).astype("u8")
    want = [x.tolist() for x in P.Sampler(vocabulary, 9).encode(texts, keys)]
    monkeypatch.setattr(P, "_LONG", 100)
    monkeypatch.setattr(P, "_WINDOW", window)
    got = [x.tolist() for x in P.Sampler(vocabulary, 9).encode(texts, keys)]
    assert all(P.decode_ids(vocabulary, np.array(x)) == t for x, t in zip(got, texts))
    same = sum(a == b for a, b in zip(got, want))
    assert same >= len(texts) - 1


def test_a_long_unit_takes_time_and_memory_by_its_length(vocabulary):
    import time

    data = random.Random(4).randbytes(750_000)
    text = __import__("base64").b64encode(data)  # a megabyte without a blank
    began = time.process_time()
    (ids,) = P.Sampler(vocabulary, 1).encode([text], np.array([7], "u8"))
    assert P.decode_ids(vocabulary, ids) == text and time.process_time() - began < 30
