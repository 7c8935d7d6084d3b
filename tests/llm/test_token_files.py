import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from coffer.llm import token_files as T
from coffer.llm.common import shared_path

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Plain text, with 12 numbers and it's words.", None, "", "Größe — naïve 中文 \x1c\x85 x", " lead", "trail  ", "a\n\n b",
    "<|endoftext|> as text", "wörd " * 3000, "x" * 70000, "𝒳 emoji 😀", "  \t ",
]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_encoder_equals_whole_text_encoding(whole, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 4000)
    monkeypatch.setattr(T, "SLOTS", 1 << 6)
    monkeypatch.setattr(T, "KEPT_IDS", 300)
    enc = T.Encoder(FILE)
    assert enc.splits
    texts = [t or "" for t in TEXTS] * 2 + ["a_b __c d'll x² ½ ªº µ×÷ \xa0 y\r\n z"]
    got = [b""] * len(texts)
    for k, ids, _ in enc.encode(texts):
        got[k] += ids
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == whole(t)


def test_round_trip(spark, whole):
    rows = [(100 - k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "null id", "x"), (5, "twice", "x"), (5, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    folder = shared_path(spark, "tok-test")
    manifest = T.write_tokens(docs, folder, FILE, frame_ids=1000)
    got = sorted((tuple(r) for r in T.read_tokens(manifest).collect()), key=lambda r: r[1])
    start = 0
    for (doc_id, text, _), g in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), got, strict=True):
        ids = np.array([*whole(text), 2], "<u4")
        assert g == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_output(docs, FILE).collect() == []


def test_output_has_the_ids_of_the_library_call(spark, monkeypatch):
    t = Tokenizer.from_file(FILE)
    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext| >", "word " * 200 + "<|endoftext|> é" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    start = 0
    for k, g in enumerate(sorted(tuple(r) for r in T.token_output(docs, FILE).collect())):
        ids = np.array([*t.encode(texts[k] or "", add_special_tokens=False).ids, 2], "<u4")
        assert g == (k, start, len(ids), zlib.crc32(ids.tobytes())), texts[k]
        start += len(ids)
    monkeypatch.setattr(T, "SEGMENT", 100)  # no token is cut where a text is
    got = [b""] * len(texts)
    for k, ids, _ in T.Encoder(FILE, text_only=False).encode([x or "" for x in texts]):
        got[k] += ids
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


class _Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_reader_decompresses_only_what_is_asked_and_checks_it():
    out = io.BytesIO()
    w = T.Writer(out, frame_ids=10)
    docs = [np.arange(k, k + n, dtype="<u4") for k, n in enumerate([3, 40, 0, 7])]
    for k, d in enumerate(docs):
        w.add(d.tobytes())
        w.end_document(k)
    w.close()
    data = out.getvalue()
    r = T.Reader(_Sized(data))
    asked = []
    frame = r.frame
    r.frame = lambda k: asked.append(k) or frame(k)
    assert b"".join(r.ids(3)) == docs[3].tobytes() and asked == [4]
    assert [b"".join(r.ids(i)) for i in range(4)] == [d.tobytes() for d in docs]
    import zstandard

    # any Zstandard reader sees the ids and skips the tables
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(d.tobytes() for d in docs)
    broken = bytearray(data)
    broken[10] ^= 1
    with pytest.raises(Exception):  # noqa: B017 - either the frame or its checksum
        list(T.Reader(_Sized(bytes(broken))).ids(0))


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_random_texts(whole, seed):
    r = random.Random(seed)
    letters = ["a", "s", "t", "re", "ve", "m", "ll", "d", "é", "Z", "'", "'", " ", " ", "  ", "\n", "\t", "1", "23", "!", "_", "-", "µ", "×"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    enc = T.Encoder(FILE)
    for _ in range(2):  # the second time from the cache
        for k, ids, last in enc.encode(texts):
            assert last and np.frombuffer(ids, "<u4").tolist() == whole(texts[k]), texts[k]
