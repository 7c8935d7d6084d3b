"""Benchmark decontamination with a generalised suffix automaton.

The words of the benchmark items go into one suffix automaton per block of
items; document words stream through it while the longest matching length is
tracked. A match of ``WINDOW`` words ends a window; an item of fewer words is
one window as a whole.

A benchmark of up to ``max_block_words`` words is one block: a single pass over
the documents without a shuffle. A larger one is dealt into blocks, so that a
Python worker holds one block whatever the benchmark's size, and the documents
are not read once a block:

* The *anchor* of a window is the smallest hash of its grams of 3 words, so
  equal windows have equal anchors, and a window's block follows from its
  anchor. Successive windows of one anchor are a *stretch*.
* Items are dealt to blocks as stretches. One pass over the documents writes
  the stretches whose anchor may be one of the benchmark's (a bitmap of fixed
  size tells), dealt likewise.
* Each block's automaton reads the stretches of its block only; the hits join
  the documents by text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import kept_in_worker, saved, shared_path, tidied, utf8
from coffer.llm.shingles import mix

#: Words: after lower-casing A-Z, runs of digits, letters a-z and non-ASCII bytes.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
MAX_BLOCK_WORDS = 100_000
#: Words of a gram, and bits of the map of the benchmark's anchors (1 MB).
GRAM = 3
BITS = 1 << 23
#: A document is contaminated from this share of its words on: n_hit * 20 >= n_words.
COVERAGE = 20


def words_of(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        owners: list[set[str]] = [set()]
        shorts: list[tuple[int, str, list[int]]] = []
        self.least = window
        for name, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c, owners)
                owners[last].add(name)
            if 0 < len(ids) < window:
                shorts.append((len(ids), name, ids))
                self.least = min(self.least, len(ids))
        # a state's items: those of the states below it in the tree of links
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.length[up] >= self.least:
                owners[up] |= owners[v]
        self.owners = owners
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for n, name, ids in shorts:
            v = 0
            for c in ids:
                v = self.next[v][c]
            self.whole.setdefault(v, []).append((n, name))

    def _state(self, length: int, link: int, nxt: dict, owners: list) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        owners.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int, owners: list) -> int:
        """The state of the longest string that reaches q from p by c."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), owners)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, owners: list) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c, owners)
        cur = self._state(self.length[last] + 1, 0, {}, owners)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, self.next[p][c], c, owners)
        return cur

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [start, end) inside windows, and the items they are of."""
        n = len(words)
        if n < self.least or not self.vocab:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), "int64", n)
        known = np.concatenate(([0], (ids >= 0).astype("int8"), [0]))
        edges = np.flatnonzero(np.diff(known))
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= self.least:  # no window lies in a shorter run of known words
                self._stream(ids[lo:hi].tolist(), lo, spans, names)
        return spans, names

    def _stream(self, ids: list[int], at: int, spans: list, names: set) -> None:
        length, link, nxt, window = self.length, self.link, self.next, self.window
        v = matched = 0
        for i, c in enumerate(ids, at):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            v = nxt[v].get(c, 0)
            matched = matched + 1 if v else 0
            start = i + 1
            if matched >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                names |= self.owners[u]
                start = i + 1 - window
            if self.whole:
                u = v
                while u > 0:
                    for m, name in self.whole.get(u, ()):
                        if matched >= m:
                            names.add(name)
                            start = min(start, i + 1 - m)
                    u = link[u]
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))


def _automaton(key: str, items: list[tuple[str, bytes]], window: int) -> SuffixAutomaton:
    """The block's automaton, built once per Python worker."""
    return kept_in_worker(key, lambda: SuffixAutomaton([(name, text.split(b" ")) for name, text in items], window))


def _items(batches):
    """Items with words as (item_id, words joined by spaces, n_words)."""
    for b in batches:
        rows = [(i, words_of(t)) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
        rows = [(i, b" ".join(w), len(w)) for i, w in rows if w]
        yield _batch(rows, (pa.string(), pa.binary(), pa.int64()), ["item_id", "words", "n_words"])


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), "u8", len(words))


def anchors(hashed: np.ndarray, length: int) -> np.ndarray:
    """The anchor of each window of ``length`` words, from the words' hashes."""
    gram = min(GRAM, length)
    n = len(hashed) - length + 1
    if n < 1:
        return np.empty(0, "u8")
    grams = np.zeros(len(hashed) - gram + 1, "u8")
    for j in range(gram):
        grams = mix(grams + hashed[j : j + len(grams)] + np.uint64(j + 1))
    least = grams[:n].copy()
    for j in range(1, length - gram + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return least


def stretches(hashed: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, start, end) in words of each run of successive windows of one anchor."""
    least = anchors(hashed, length)
    if not len(least):
        return
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], len(least)) - 1
    yield from zip(least[first].view("i8").tolist(), first.tolist(), (last + length).tolist(), strict=True)


def _item_stretches(window: int):
    def run(batches):
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("words").to_pylist(), strict=True):
                words = text.split(b" ")
                rows = [
                    (a, item, b" ".join(words[s:e]), e - s) for a, s, e in stretches(_hashed(words), min(window, len(words)))
                ]
                yield _batch(rows, (pa.int64(), pa.string(), pa.binary(), pa.int64()), ["anchor", "item_id", "words", "n_words"])

    return run


def _text_stretches(lengths: list[int], bits: np.ndarray):
    """Stretches of texts, for each length of the benchmark's windows, whose anchor's bit is set."""

    def run(batches):
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = ["hash", "start", "anchor", "words"]
        for b in batches:
            rows = []
            for h, text in zip(b.column("hash").to_pylist(), _bytes(b), strict=True):
                words = words_of(text)
                hashed = _hashed(words)
                for length in lengths:
                    for a, s, e in stretches(hashed, length):
                        if int(bits[(a & (BITS - 1)) >> 6]) >> (a & 63) & 1:
                            rows.append((h, s, a, b" ".join(words[s:e])))
                    if len(rows) > 10_000:
                        yield _batch(rows, types, names)
                        rows = []
            yield _batch(rows, types, names)

    return run


def _bitmap(dealt: DataFrame) -> np.ndarray:
    """BITS bits, those of the benchmark's anchors set; the driver gets BITS / 64 rows at most."""
    bit = F.col("anchor").bitwiseAND(F.lit(BITS - 1))
    one = F.expr("shiftleft(1L, CAST(anchor & 63 AS INT))")
    rows = dealt.groupBy(F.shiftright(bit, 6).alias("place")).agg(F.bit_or(one).alias("bits")).collect()
    out = np.zeros(BITS // 64, "i8")
    for r in rows:
        out[r["place"]] = r["bits"]
    return out.view("u8")


def _dealt(df: DataFrame, n: int, name: str) -> DataFrame:
    """``df`` with the block of each row's anchor, written in a folder per block."""
    path = shared_path(df.sparkSession, name)
    out = df.withColumn("block", F.pmod("anchor", F.lit(n)))
    out.hint("rebalance", F.col("block")).write.partitionBy("block").parquet(path)  # AQE splits what is large
    return df.sparkSession.read.schema(out.schema).parquet(path)


def _routed(texts: DataFrame, items: DataFrame, window: int, max_block_words: int) -> DataFrame:
    """hash, spans (flat, in words) and names of each text (``hash``, ``text``) that has a window of the benchmark."""
    lengths = [r["n"] for r in items.select(F.least("n_words", F.lit(window)).alias("n")).distinct().collect()]  # window at most
    dealt = saved(
        items.mapInArrow(_item_stretches(window), "anchor long, item_id string, words binary, n_words long").distinct(),
        "benchmark-stretches",
    )
    n = max(1, -(-dealt.agg(F.sum("n_words")).first()[0] // max_block_words))
    dealt = dealt.withColumn("block", F.pmod("anchor", F.lit(n)))
    bits = _bitmap(dealt)
    candidates = _dealt(
        texts.mapInArrow(_text_stretches(sorted(lengths), bits), "hash string, start long, anchor long, words binary"),
        n, "document-stretches",
    )
    found = None
    for r in dealt.groupBy("block").agg(F.sum("n_words").alias("words")).orderBy("block").collect():
        parts = -(-r["words"] // max_block_words)  # a block beyond the average goes in parts
        for part in range(parts):
            mine = dealt.filter((F.col("block") == r["block"]) & (F.pmod(F.xxhash64("words"), F.lit(parts)) == part))
            block = sorted((x["item_id"], bytes(x["words"])) for x in mine.select("item_id", "words").collect())
            hits = candidates.filter(F.col("block") == r["block"]).select("hash", "start", "words")
            hits = hits.mapInArrow(_block_hits(uuid.uuid4().hex, block, window), "hash string, start long, spans array<long>, names array<string>")
            one = saved(hits.dropDuplicates(["hash", "start"]), "block-hits")
            found = one if found is None else found.unionByName(one)
    # a row per stretch of a text at most
    return found.groupBy("hash").agg(
        F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")
    )


def _block_hits(key: str, block: list, window: int):
    @tidied
    def run(batches):
        sam = _automaton(key, block, window)
        for b in batches:
            rows = []
            for h, start, text in zip(*(b.column(c).to_pylist() for c in ("hash", "start", "words")), strict=True):
                spans, names = sam.hits(text.split(b" "))
                if spans:
                    rows.append((h, start, [start + x for s in spans for x in s], sorted(names)))
            types = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield _batch(rows, types, ["hash", "start", "spans", "names"])

    return run


def _verdict(n_words: int, spans: list, names: set) -> tuple:
    n_hit = sum(e - s for s, e in spans)
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return n_words, n_hit, len(names), digest, n_hit > 0 and COVERAGE * n_hit >= n_words


OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


def _merged(lists) -> list[tuple[int, int]]:
    """The union of flat [start, end, start, end, ...] lists as disjoint spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x[i], x[i + 1]) for x in lists or () for i in range(0, len(x), 2)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _matched(docs: DataFrame, benchmark: DataFrame, window: int, max_block_words: int, finish, schema) -> DataFrame:
    """``finish(batch, texts, hits)`` over all documents; hits are (spans, items) by row.

    One block: a single pass. More: texts are known by their SHA-256 and their
    hits joined to the documents; AQE splits hot texts.
    """
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), utf8().alias("text"))
    items = named.mapInArrow(_items, "item_id string, words binary, n_words long")
    if (items.agg(F.sum("n_words")).first()[0] or 0) <= max_block_words:
        key = uuid.uuid4().hex
        block = sorted((r["item_id"], bytes(r["words"])) for r in items.select("item_id", "words").collect())  # max_block_words at most

        @tidied
        def run(batches):
            sam = _automaton(key, block, window)
            for b in batches:
                words = [words_of(t) for t in _bytes(b)]
                yield finish(b, words, [sam.hits(w) for w in words])

        return docs.mapInArrow(run, schema)

    text_hash = F.sha2(utf8(), 256)
    by_text = _routed(docs.select(text_hash.alias("hash"), "text"), items, window, max_block_words)
    # the documents' columns go as one struct, so that no name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_hash.alias("hash"))

    def run(batches):
        for b in batches:
            hits = [(_merged(s), set(n or ())) for s, n in zip(b.column("spans").to_pylist(), b.column("names").to_pylist(), strict=True)]
            row = b.column("row")
            whole = pa.RecordBatch.from_arrays(row.flatten(), [f.name for f in row.type])
            yield finish(whole, [words_of(t) for t in _bytes(whole)], hits)

    return rows.join(by_text, "hash", "left").select("row", "spans", "names").mapInArrow(run, schema)


def _bytes(b: pa.RecordBatch) -> list[bytes]:
    return [t if isinstance(t, bytes) else (t or "").encode() for t in b.column("text").to_pylist()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per input row.

    Repeated rows give repeated results. A null or empty text has no words and
    is not contaminated. Benchmark items without words have no window; a null
    item_id counts as the empty string, and rows that share an item_id are one
    item in the count. With an empty benchmark nothing is hit. Other columns
    of either table are ignored.
    """

    def finish(b, words, hits):
        out = [_verdict(len(w), *h) for w, h in zip(words, hits, strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * len(_TYPES)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))],
            ["doc_id", *(x.split()[0] for x in OUT.split(", "))],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _matched(docs.select("doc_id", "text"), benchmark, window, max_block_words, finish, f"doc_id {kind}, {OUT}")


def cut_spans(text: str, spans: list[tuple[int, int]], longer_than: int) -> str:
    """The text without the word spans that have more than ``longer_than`` words."""
    data = text.encode()
    at = [m.span() for m in WORDS.finditer(data.lower())]
    out, done = [], 0
    for s, e in spans:
        if e - s > longer_than:
            out.append(data[done : at[s][0]])
            done = at[e - 1][1]
    return b"".join([*out, data[done:]]).decode()


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    longer_than: int | None = None,
    max_block_words: int = MAX_BLOCK_WORDS,
) -> DataFrame:
    """``docs``, columns unchanged, without what exceeds the limits.

    Documents at or above the coverage limit (a 20th of their words) go as a
    whole; all others stay. With ``longer_than``, hit spans of more words than
    that are also cut out of the texts that stay. Nulls and empty tables are
    as in ``contamination``.
    """

    def finish(b, words, hits):
        keep = [not _verdict(len(w), *h)[-1] for w, h in zip(words, hits, strict=True)]
        if longer_than is not None:
            texts = b.column("text").to_pylist()
            texts = [cut_spans(t, h[0], longer_than) if h[0] else t for t, h in zip(texts, hits, strict=True)]
            k = b.schema.get_field_index("text")
            b = b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))
        return b.filter(pa.array(keep, pa.bool_()))

    return _matched(docs, benchmark, window, max_block_words, finish, docs.schema)


def oracle_sql(window: int = WINDOW) -> str:
    """``contamination`` of ``documents`` by ``benchmark`` as DuckDB SQL."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
    i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {words} AS ws FROM benchmark),
    iw AS (
      SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS g
      FROM (SELECT item_id, ws, least({window}, len(ws)) AS n,
              unnest(generate_series(1, len(ws) - least({window}, len(ws)) + 1)) AS p
            FROM i WHERE len(ws) > 0)),
    dw AS (
      SELECT rid, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g
      FROM (SELECT rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p
            FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
    h AS (SELECT rid, p, n, item_id FROM dw JOIN iw USING (n, g)),
    c AS (SELECT rid, count(DISTINCT p + k) AS n_hit
          FROM (SELECT DISTINCT rid, p, n FROM h), (SELECT unnest(generate_series(0, {window - 1})) AS k)
          WHERE k < n GROUP BY rid),
    s AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND {COVERAGE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)"""
