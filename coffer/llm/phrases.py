"""Phrase collocations from a weighted de Bruijn graph of words.

1. Texts become chunks of word codes with piece starts, written once.
2. Sieve: a phrase found LEAST times has only pairs of neighbours found LEAST
   times. Each chunk asks the owners of its pairs' hashes which of them reach
   that over all chunks, and cuts its pieces where they do not. A pair is
   asked for by 32 bits within its owner, and the answer is one bit. Hash
   collisions can only leave a cut out, so every count below stays exact.
3. Edges: a 4-gram is an edge from the node of its first three words to that
   of its last three. Edges are counted in each chunk, then over all, as text.
4. Shorter counts come from the flow: a phrase occurs as often as the longer
   ones it starts, and once more for each piece (or cut) that it ends.
5. Unary paths: where an edge takes the whole flow of its head node, and the
   edge before it the whole flow of the same node, both are one path. Paths
   are contracted by pointer doubling; some nodes, chosen by hash, stay path
   ends, so that a path's row is short however long a copied passage is.
6. A path gives what its edges contain once, for the test of containment; the
   rest are joins on (lang, phrase).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import saved, shuffle_partitions, sliced, tidied, utf8
from coffer.llm.shingles import mix
from coffer.operators.segments import numbered

#: Words of an edge; least occurrences of a candidate; phrases per language; share that a longer phrase must have.
LONGEST, LEAST, TOP, SHARE, SCALE = 4, 30, 2000, 80, 2_000_000
#: Text bytes of a chunk (one text at least), pairs that one group of the sieve counts.
_CHUNK, _PAIRS = 1 << 22, 1 << 21
#: Rows of a batch that a worker hands back.
_ROWS = 1 << 14
#: One node in so many ends a path.
_ANCHOR = 16
_BREAKS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_KIND = np.zeros(256, "u1")  # 0 part of a word, 1 between words, 2 between pieces
_KIND[list(_GAPS)], _KIND[list(_BREAKS)] = 1, 2
_CHUNK_TYPE = "chunk long, n_words long, langs array<string>, lang_of binary, words binary, codes binary"


def _coded(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a text, and for each word its number and whether it starts a piece."""
    data = _LOWER[np.frombuffer(text, "u1")]
    kind = _KIND[data]
    solid = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view("i1")))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype("i8")
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]
    ).dictionary_encode()
    piece = np.cumsum(kind == 2)[starts]
    first = np.ones(len(starts), bool)
    first[1:] = piece[1:] != piece[:-1]
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype("i8"), first


def _chunks(batches):
    """Rows (lang, text) to chunks: languages, distinct words with their language, codes 2 * word + starts a piece."""
    part, made = TaskContext.get().partitionId(), 0
    texts: dict[str, list[bytes]] = {}
    size = 0

    def flush():
        nonlocal made
        words, lang_of, codes = [], [], []
        for at, lang in enumerate(texts):
            distinct, numbers, first = _coded(b"\n".join(texts[lang]))
            codes.append((numbers + len(words)) * 2 + first)
            words += distinct.to_pylist()
            lang_of += [at] * len(distinct)
        codes = np.concatenate(codes).astype("<i4")
        row = [
            (part << 32) + made, len(codes), list(texts), np.array(lang_of, "<i4").tobytes(), b"\n".join(words), codes.tobytes()
        ]
        types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())
        made += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(row, types, strict=True)], ["chunk", "n_words", "langs", "lang_of", "words", "codes"]
        )

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            text = text.as_py()
            texts.setdefault(lang, []).append(text)
            size += len(text) + 1
            if size >= _CHUNK:
                yield flush()
                texts, size = {}, 0
    if texts:
        yield flush()


def _rows(batches):
    """Chunks as dicts, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


class _Chunk:
    """A chunk's words and its distinct pairs of neighbours, dealt to the groups of the sieve.

    ``groups`` has the numbers of the groups that this chunk asks; the i-th of
    them is asked for the pairs ``order[ends[i]:ends[i + 1]]``. Within a group
    a pair goes by 32 bits of its hash.
    """

    def __init__(self, row: dict, groups: int):
        raw = np.frombuffer(row["codes"], "<i4")
        self.code, first = raw >> 1, (raw & 1).astype(bool)
        self.words = row["words"].split(b"\n") if len(raw) else []
        self.langs, self.lang_of = row["langs"], np.frombuffer(row["lang_of"], "<i4")
        self.v = max(1, len(self.words))
        self.at = np.flatnonzero(~first[1:]).astype("i4")  # words with a neighbour in their piece
        pairs, self.n = np.unique(self._pair(), return_counts=True)
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[at]) for w, at in zip(self.words, self.lang_of, strict=True)), "u8", len(self.words))
        hashes = mix(mix(hashes[pairs // self.v]) + hashes[pairs % self.v])
        self.hash = hashes.astype("<u4")
        to = ((hashes >> np.uint64(32)) % np.uint64(groups)).astype("i4")
        self.order = np.argsort(to, kind="stable").astype("i4")
        self.groups, starts = np.unique(to[self.order], return_index=True)
        self.ends = [*starts.tolist(), len(pairs)]

    def _pair(self) -> np.ndarray:
        out = self.code[self.at].astype("i8")
        out *= self.v
        out += self.code[self.at + 1]
        return out

    def linked(self, hit: np.ndarray) -> np.ndarray:
        """Of each word whether the next one is its neighbour in a pair that ``hit`` marks."""
        place = np.argsort(self._pair(), kind="stable").astype("i4")  # a pair's places are neighbours here
        out = np.zeros(len(self.code) + LONGEST - 1, bool)
        out[self.at[place]] = np.repeat(hit, self.n)
        return out


def _ask(groups: int):
    """mapInArrow function: of each chunk and group of hashes, one row of hashes and counts."""

    def asked(row: dict) -> pa.RecordBatch:
        c = _Chunk(row, groups)
        n = len(c.groups)
        hashes, counts = c.hash[c.order].tobytes(), c.n[c.order].astype("<i4").tobytes()
        ends = pa.py_buffer(4 * np.array(c.ends, "<i4"))  # four bytes a pair, both
        return pa.RecordBatch.from_arrays(
            [
                pa.array(c.groups.astype("i8")),
                pa.array(np.full(n, row["chunk"], "i8")),
                *(pa.BinaryArray.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(x)]) for x in (hashes, counts)),
            ],
            ["group", "chunk", "hashes", "counts"],
        )

    @tidied
    def run(batches):
        for row in _rows(batches):
            yield from sliced([asked(row)], _ROWS)

    return run


def _answer(least: int):
    """applyInArrow function over a group: to each chunk, one bit for each of its hashes: whether it is found often enough."""

    def run(table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        distinct, of = np.unique(joined("hashes", "<u4"), return_inverse=True)
        total = np.zeros(len(distinct), "i8")
        np.add.at(total, of, joined("counts", "<i4"))
        often = (total >= least)[of]
        ends = np.cumsum(pc.binary_length(table.column("hashes")).to_numpy() // 4)
        parts = np.split(often, ends[:-1])
        bits = [np.packbits(x).tobytes() if x.any() else None for x in parts]
        out = pa.table({"chunk": table.column("chunk"), "group": table.column("group"), "often": pa.array(bits, pa.binary())})
        return out.filter(pc.is_valid(out.column("often")))

    return run


def _chunk_grams(row: dict, groups: int):
    """A chunk with the answers to it as batches of counted edges (k = 4) and ends of cut pieces (k = 1 to 3).

    The key is language, line feed, phrase: a phrase has no line feed, and one short column is hashed, sent and kept faster than three.
    """
    c = _Chunk(row, groups)
    hit = np.zeros(len(c.hash), bool)
    answers = {x["group"]: x["often"] for x in row["often"] or []}
    for i, g in enumerate(c.groups.tolist()):
        if g in answers:
            here = c.order[c.ends[i] : c.ends[i + 1]]
            hit[here] = np.unpackbits(np.frombuffer(answers[g], "u1"), count=len(here)).view(bool)
    linked = c.linked(hit)
    code, words, langs, lang_of, v = c.code, pa.array(c.words, pa.binary()), pa.array([x.encode() for x in c.langs], pa.binary()), c.lang_of, c.v
    del c, hit, answers, row
    #: Phrases that start at each word, by number, as long as the words are linked.
    name, start = code.astype("i8"), np.arange(len(code), dtype="i4")
    for k in range(1, LONGEST + 1):
        goes_on = linked[start + (k - 1)]
        ends = slice(None) if k == LONGEST else ~goes_on
        _, one, counts = np.unique(name[ends], return_index=True, return_counts=True)
        places = start[ends][one]
        for i in range(0, len(places), _ROWS):
            here = places[i : i + _ROWS]
            cols = [words.take(pa.array(code[here + j])) for j in range(k)]
            phrase = cols[0] if k == 1 else pc.binary_join_element_wise(*cols, b" ")
            key = pc.binary_join_element_wise(langs.take(pa.array(lang_of[code[here]])), phrase, b"\n")
            yield pa.RecordBatch.from_arrays([key, pa.array(counts[i : i + _ROWS].astype("i8"))], ["key", "n"])
        if k < LONGEST:
            start, name = start[goes_on], name[goes_on]
            if len(start):
                _, name = np.unique(name, return_inverse=True)
                name = name * np.int64(v) + code[start + k]


def _grams(groups: int):
    """mapInArrow function: ``_chunk_grams`` of each chunk."""

    @tidied
    def run(batches):
        for row in _rows(batches):
            yield from _chunk_grams(row, groups)

    return run


def _first(k: int) -> Column:
    return F.substring_index("phrase", " ", k)


def _rest() -> Column:
    return F.expr("substr(phrase, instr(phrase, ' ') + 1)")


def gram_counts(docs: DataFrame, least: int = LEAST) -> dict[int, DataFrame]:
    """By length 1 to 4: lang, phrase, f. Phrases found ``least`` times are all there, with exact counts; of single words, all are."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8().alias("text"))
    chunks = saved(texts.mapInArrow(tidied(_chunks), _CHUNK_TYPE), "phrase-chunks")
    n_words = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    groups = max(shuffle_partitions(spark), -(-n_words // _PAIRS))
    asked = chunks.mapInArrow(_ask(groups), "group long, chunk long, hashes binary, counts binary")
    often = asked.groupBy("group").applyInArrow(_answer(least), "chunk long, group long, often binary")
    often = often.groupBy("chunk").agg(F.collect_list(F.struct("group", "often")).alias("often"))  # a bit for each pair asked for, at most
    grams = (
        chunks.join(often, "chunk", "left")
        .mapInArrow(_grams(groups), "key binary, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("f"))
        .select("key", "f", F.substring_index(F.col("key").cast("string"), "\n", -1).alias("phrase"))
        .select(
            F.expr("cast(substr(key, 1, octet_length(key) - octet_length(phrase) - 1) AS string)").alias("lang"),
            F.expr("octet_length(phrase) - octet_length(replace(phrase, ' ', '')) + 1").alias("k"),
            "phrase",
            "f",
        )
    )
    grams = saved(grams, "phrase-grams")
    counts = {LONGEST: grams.where(F.col("k") == LONGEST).select("lang", "phrase", "f")}
    for k in range(LONGEST - 1, 0, -1):
        flow = counts[k + 1].select("lang", _first(k).alias("phrase"), "f")
        ends = grams.where(F.col("k") == k).select("lang", "phrase", "f")
        counts[k] = saved(flow.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), f"phrase-{k}")
    return counts


def unary_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """lang, words (array), f: the edges (lang, phrase, f) merged along nodes (lang, phrase, f) with one way through."""
    node = lambda to, at: nodes.select("lang", F.col("phrase").alias(at), F.col("f").alias(to))
    e = edges.select("lang", "phrase", "f", _first(LONGEST - 1).alias("head"), _rest().alias("tail"))
    e = e.join(node("f_head", "head"), ["lang", "head"]).join(node("f_tail", "tail"), ["lang", "tail"])
    e = saved(e, "phrase-edges")
    into = e.where("f = f_tail").select("lang", F.col("tail").alias("head"), F.col("phrase").alias("up"))
    open_head = (F.col("f") == F.col("f_head")) & (F.pmod(F.xxhash64("lang", "head"), F.lit(_ANCHOR)) != 0)
    step = e.where(open_head).join(into, ["lang", "head"]).select("lang", "phrase", "up", F.lit(1).alias("d"))
    step = e.select("lang", "phrase", "f").join(step, ["lang", "phrase"], "left")
    ptr = step.select("lang", "phrase", "f", F.coalesce("up", "phrase").alias("up"), F.coalesce("d", F.lit(0)).alias("d"))
    ptr = saved(ptr, "phrase-path")
    while True:  # rounds: log2 of the longest stretch between path ends
        target = ptr.where("d > 0").select("lang", F.col("phrase").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        nxt = ptr.join(target, ["lang", "up"], "left").select(
            "lang", "phrase", "f", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"),
            F.col("d2").isNotNull().alias("moved"),
        )
        nxt = saved(nxt, "phrase-path")
        moved = nxt.agg(F.max("moved")).first()[0]
        ptr = nxt.drop("moved")
        if not moved:
            break
    line = F.sort_array(F.collect_list(F.struct("d", F.substring_index("phrase", " ", -1).alias("w"))))
    return (
        ptr.groupBy("lang", "up")
        .agg(line.alias("line"), F.max("f").alias("f"))
        .select(
            "lang",
            F.concat(F.split("up", " "), F.transform(F.slice("line", 2, F.size("line")), lambda x: x["w"])).alias("words"),
            "f",
        )
    )


def _windows(words: str, k: int) -> Column:
    """Distinct runs of k words of an array, as phrases."""
    return F.expr(f"array_distinct(transform(sequence(1, size({words}) - {k - 1}), i -> array_join(slice({words}, i, {k}), ' ')))")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to 4 words.

    Texts (null: none) are lower-cased (A-Z), cut into pieces at
    ``[.,;:!?\\x0A-\\x0D]`` and into words at blanks and tabs; a null lang
    counts as ``und``. a: occurrences (``least`` or more); l and r: those of
    the two parts at the cut with the lowest score 2,000,000 * a / (l + r),
    rounded down (ties: the earlier cut); n: the language's words. Left out
    are phrases inside a longer candidate that has 80 % of their occurrences.
    Ties go to the higher a, then to the first phrase in UTF-8 order. Repeated
    rows count each time; doc_id and other columns are ignored; an empty table
    gives an empty result.
    """
    f = gram_counts(docs, least)
    n = f[1].groupBy("lang").agg(F.sum("f").alias("n"))
    often = {k: f[k].where(F.col("f") >= least) for k in f}
    paths = unary_paths(often[4], often[3])
    inside = (
        paths.select("lang", "f", F.explode(F.concat(_windows("words", 2), _windows("words", 3))).alias("phrase"))
        .unionByName(
            often[3].select("lang", "f", F.split("phrase", " ").alias("words")).select("lang", "f", F.explode(_windows("words", 2)).alias("phrase"))
        )
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    big = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits
    candidates = None
    for k in (2, 3, 4):
        c = often[k].select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"))
        candidates = c if candidates is None else candidates.unionByName(c)
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (big("longer") * 100 < big("a") * SHARE)
    )
    parts = often[1].unionByName(often[2]).unionByName(often[3])
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "*",
        F.expr("substring_index(phrase, ' ', cut)").alias("left"),
        F.expr("substr(phrase, length(substring_index(phrase, ' ', cut)) + 2)").alias("right"),
    )
    of = lambda side, to: parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(to))
    scored = (
        cuts.join(of("left", "l"), ["lang", "left"])
        .join(of("right", "r"), ["lang", "right"])
        .withColumn("l_r", big("l") + big("r"))
        .withColumn("a2", big("a") * SCALE)
        .withColumn("score", F.expr("a2 div l_r"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.max("a").alias("a"))
        .select("lang", "phrase", "a", "best.l", "best.r", "best.score", (-F.col("best.score")).alias("worse"), (-F.col("a")).alias("rarer"))
    )
    ranked = numbered(scored, ["lang"], ["worse", "rarer", "phrase"], "rank").where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same result as DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t
      FROM documents),
    p AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    g AS (
      SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4)) AS o(k) WHERE len(ws) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= {least}),
    s AS (
      SELECT lang, a, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase
      FROM c, (VALUES (2), (3)) AS o(m) WHERE k > m),
    x AS (SELECT lang, phrase, max(a) AS longer FROM s GROUP BY ALL),
    q AS (
      SELECT c.* FROM c LEFT JOIN x USING (lang, phrase)
      WHERE longer IS NULL OR 100 * longer::HUGEINT < {SHARE} * a::HUGEINT),
    cut AS (
      SELECT q.lang, q.phrase, a, i, array_to_string(ws[1:i], ' ') AS fore, array_to_string(ws[i + 1:], ' ') AS aft
      FROM q, (VALUES (1), (2), (3)) AS o(i) WHERE i < k),
    sc AS (
      SELECT cut.*, l.f AS l, r.f AS r, CAST({SCALE}::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = fore JOIN f r ON r.lang = cut.lang AND r.phrase = aft),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM sc),
    z AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE o = 1)
    SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= {top}"""
