"""Suffix-array dedup: a depth-limited radix sort of suffixes, distributed.

A byte string of ``depth`` (200) bytes that starts at two places is two
suffixes that agree to that depth. The sort is by most significant digit and
never goes deeper; a group that is down to one suffix is dropped at once, so
each pass handles only what is still ambiguous:

1. First digit: a content-defined 32-byte gram inside the window, the one with
   the smallest hash (ties: the leftmost). Equal windows have the same gram at
   the same offset, and neighbouring windows share theirs, so one row (an
   *anchor*) stands for some 70 suffixes. Grams that occur once drop out.
   In periodic texts an anchor may stand for one suffix only; runs of equal
   neighbouring anchors are one row there.
2. Second digit: the whole region that the anchor's windows cover. Equal
   regions are equal windows throughout: all of them are repeated.
3. Third digit, only for grams with several different regions, and for one
   representative of each: blocks of 8 neighbouring windows, by the bytes that
   all 8 share. A block whose shared bytes occur once has no repeated window;
   where all blocks of a group agree to the outer ends, all windows are.
4. Last digit: the windows of the blocks that are left. Groups of two or more
   are exactly the repeated windows.

Regions and windows compare by 64-bit hashes within a gram's 64 bits. Each
pass is an aggregation that combines before its shuffle, joined back by plain
equi-joins that AQE splits: a group of any size costs a row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import saved, utf8
from coffer.llm.shingles import mix

DEPTH = 200
GRAM = 32
_CHUNK = 1 << 19
_POSITION = np.uint64((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15 | 3, 0xD1342543DE82EF95 | 3)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = [_powers(b, _CHUNK + 1) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 1 << 64), _CHUNK + 1) for b in _BASES]


class Hashes:
    """Hashes of any substrings of ``data`` (of at most _CHUNK bytes), by prefix sums."""

    def __init__(self, data: np.ndarray):
        shifted = data + np.uint64(1)
        self.sums = []
        for up in _UP:
            s = np.zeros(len(data) + 1, "u8")
            np.cumsum(shifted * up[: len(data)], out=s[1:])
            self.sums.append(s)

    def one(self, start, end, k: int = 0) -> np.ndarray:
        return (self.sums[k][end] - self.sums[k][start]) * _DOWN[k][start]

    def both(self, start, end) -> np.ndarray:
        return mix(self.one(start, end, 0) ^ mix(self.one(start, end, 1) + np.uint64(0x5851F42D4C957F2D)))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` successive keys (running minima of blocks)."""
    n = len(keys)
    full = -(-n // width) * width
    blocks = np.full(full, np.iinfo("u8").max, "u8")
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def _anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """position, first and last window start, gram and region hash of each anchor.

    ``bounds`` are the ends of the texts that ``data`` joins; no window
    crosses them.
    """
    empty = np.empty(0, "i8")
    if len(data) < DEPTH:
        return empty, empty, empty, empty.view("u8"), empty.view("u8")
    h = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = mix(h.one(at, at + GRAM))
    least = _smallest((grams & ~_POSITION) | at.astype("u8"), DEPTH - GRAM + 1)
    where = (least & _POSITION).astype("i8")  # of each window's gram
    starts = np.arange(len(where))
    ends = bounds[np.searchsorted(bounds, starts, "right")]
    inside = np.flatnonzero(starts + DEPTH <= ends)
    if not len(inside):
        return empty, empty, empty, empty.view("u8"), empty.view("u8")
    where = where[inside]
    # a gram's windows follow each other, within one text
    new = np.flatnonzero((np.diff(where) != 0) | (np.diff(inside) != 1)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new, [len(inside)])) - 1
    lo, hi, where = inside[first], inside[last], where[first]
    region = mix(h.both(lo, hi + DEPTH) + (where - lo).astype("u8") * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype("u8"))
    return where, lo, hi, grams[where], region


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, position, first, last, gram, region) arrays for groups of texts.

    Texts beyond _CHUNK bytes go through in overlapping parts; a part ends
    where an anchor's windows end, so that each anchor is one record.
    """
    group: list[bytes] = []
    numbers: list[int] = []
    size = 0

    def flush():
        if not group:
            return None
        data = np.frombuffer(b"".join(group), "u1")
        ends = np.cumsum([len(t) for t in group])
        at, lo, hi, gram, region = _anchors(data, ends)
        text = np.searchsorted(ends, lo, "right")
        base = np.concatenate(([0], ends))[text]
        return np.array(numbers)[text], at - base, lo - base, hi - base, gram, region

    for k, t in enumerate(texts):
        if len(t) < DEPTH:
            continue
        if len(t) > _CHUNK - 1:
            if group:
                yield flush()
                group, numbers, size = [], [], 0
            yield from _long(k, t)
            continue
        if size + len(t) > _CHUNK - 1:
            yield flush()
            group, numbers, size = [], [], 0
        group.append(t)
        numbers.append(k)
        size += len(t)
    if group:
        yield flush()


def _long(k: int, text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    start = 0
    while True:
        data = np.frombuffer(text, "u1", min(_CHUNK - 1, len(text) - start), start)
        at, lo, hi, gram, region = _anchors(data, np.array([len(data)]))
        done = start + len(data) >= len(text)
        if not done:  # the last anchor may have windows beyond this part
            at, lo, hi, gram, region = at[:-1], lo[:-1], hi[:-1], gram[:-1], region[:-1]
        yield np.full(len(at), k), at + start, lo + start, hi + start, gram, region
        if done:
            return
        start += int(hi[-1]) + 1


def _pack(at, lo, hi):
    """Gram position, its distance from the first window start, and that of the last from the first."""
    return (at << 16) | ((at - lo) << 8) | (hi - lo)


def _unpack(packed):
    at = packed >> 16
    lo = at - ((packed >> 8) & 255)
    return at, lo, lo + (packed & 255)


def _counts(batches):
    """(gram, region, n), combined within each batch."""
    for b in batches:
        for _, _, _, _, gram, region in anchors(b.column("text").to_pylist()):
            order = np.lexsort((region, gram))
            g, r = gram[order], region[order]
            first = np.flatnonzero(np.concatenate(([True], (np.diff(g) != 0) | (np.diff(r) != 0)))) if len(g) else []
            n = np.diff(np.concatenate((first, [len(g)]))) if len(g) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[first].view("i8")), pa.array(r[first].view("i8")), pa.array(n, pa.int64())] if len(g) else [pa.array([], pa.int64())] * 3,
                ["gram", "region", "n"],
            )


def _places(batches):
    """(gram, region, doc, tag, packed, more) of the anchors.

    In periodic texts equal anchors follow each other without a gap. Such a run
    is one row, that of its first anchor; ``more`` is the distance from that
    anchor's last window start to the last one of the run.
    """
    for b in batches:
        doc, tag = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
        for k, at, lo, hi, gram, region in anchors(b.column("text").to_pylist()):
            if not len(k):
                continue
            goes_on = (k[1:] == k[:-1]) & (gram[1:] == gram[:-1]) & (region[1:] == region[:-1]) & (lo[1:] == hi[:-1] + 1)
            first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
            last = np.append(first[1:], len(k)) - 1
            packed = _pack(at, lo, hi)[first]
            columns = [gram[first].view("i8"), region[first].view("i8"), doc[k[first]], tag[k[first]], packed, hi[last] - hi[first]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "region", "doc", "tag", "packed", "more"])


def _regions(batches):
    """The bytes of each representative's region."""
    for b in batches:
        rows = []
        for doc, tag, text, reps in zip(*(b.column(c).to_pylist() for c in ("doc", "tag", "text", "reps")), strict=True):
            for r in reps:
                _, lo, hi = _unpack(r["packed"])
                rows.append(
                    {"gram": r["gram"], "doc": doc, "tag": tag, "packed": r["packed"], "alone": r["alone"], "bytes": text[lo : hi + DEPTH]}
                )
        yield pa.RecordBatch.from_pylist(rows, _REGION)


_REGION = pa.schema(
    [("gram", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("packed", pa.int64()), ("alone", pa.bool_()), ("bytes", pa.binary())]
)
BLOCK = 8


def _spread(b: pa.RecordBatch):
    """Hashes over the joined regions of a batch, and by window: region number,
    place in the join, and start relative to the gram."""
    data = b.column("bytes").to_pylist()
    at, lo, hi = _unpack(b.column("packed").to_numpy(zero_copy_only=False))
    n = hi - lo + 1
    base = np.concatenate(([0], np.cumsum([len(x) for x in data])))[:-1]
    which = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return Hashes(np.frombuffer(b"".join(data), "u1")), which, base[which] + i, (lo - at)[which] + i


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, _CHUNK // (2 * DEPTH + 2 * 256))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def _blocks(batches):
    """(core, hull, rep, first, last) of each block of windows of a region: hashes of the
    bytes that all its windows share, and of all that the present ones cover."""
    for big in batches:
        for b in _slices(big):
            h, which, place, rel = _spread(b)
            block = (rel + 256) // BLOCK
            new = np.flatnonzero(np.concatenate(([True], (np.diff(which) != 0) | (np.diff(block) != 0))))
            last = np.concatenate((new[1:], [len(which)])) - 1
            w, q = which[new], block[new]
            gram = b.column("gram").to_numpy(zero_copy_only=False).view("u8")[w]
            core_at = place[new] + (q * BLOCK - 256 + BLOCK - 1 - rel[new])
            salt = mix(gram + q.astype("u8"))
            core = mix(h.both(core_at, core_at + DEPTH - BLOCK + 1) ^ salt)
            hull = mix(h.both(place[new], place[last] + DEPTH) + (rel[new] * 512 + rel[last]).astype("u8"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(core.view("i8")),
                    pa.array(hull.view("i8")),
                    b.column("rep").take(pa.array(w)),
                    pa.array(rel[new]),
                    pa.array(rel[last]),
                ],
                ["core", "hull", "rep", "first", "last"],
            )


def _windows(batches):
    """(window, doc, tag, lo) of the windows of open blocks; lo is null in regions that are flagged already."""
    for big in batches:
        for b in _slices(big):
            h, which, place, rel = _spread(b)
            first = [x or [] for x in b.column("firsts").to_pylist()]
            last = [x or [] for x in b.column("lasts").to_pylist()]
            keep = np.zeros(len(which), bool)
            begin = np.searchsorted(which, np.arange(b.num_rows))
            for k in range(b.num_rows):
                r0 = rel[begin[k]]
                for f, e in zip(first[k], last[k], strict=True):
                    keep[begin[k] + f - r0 : begin[k] + e - r0 + 1] = True
            which, place, rel = which[keep], place[keep], rel[keep]
            gram = b.column("gram").to_numpy(zero_copy_only=False).view("u8")[which]
            packed = b.column("packed").to_numpy(zero_copy_only=False)[which]
            alone = b.column("alone").to_numpy(zero_copy_only=False).astype(bool)[which]
            window = mix(h.both(place, place + DEPTH) ^ mix(gram + rel.astype("u8")))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(window.view("i8")),
                    b.column("doc").take(pa.array(which)),
                    b.column("tag").take(pa.array(which)),
                    pa.array(_unpack(packed)[0] + rel, mask=~alone),
                ],
                ["window", "doc", "tag", "lo"],
            )


def _remove(text: bytes, spans: list) -> tuple[int, int, str, bytes]:
    """Removed bytes, maximal runs, and the SHA-256 and bytes of what stays."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + DEPTH)
        else:
            runs.append([lo, hi + DEPTH])
    parts, done = [], 0
    for s, e in runs:
        parts.append(text[done:s])
        done = e
    left = b"".join([*parts, text[done:]])
    return len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc, tag (as in ``_texts``), spans of all documents with a repeated window: spans are (lo, hi),
    the first and last start of a run of repeated windows; they may overlap."""
    texts = _texts(docs)
    anchored = texts.filter(F.length("text") >= DEPTH)

    # digits 1 and 2
    counted = anchored.select("text").mapInArrow(_counts, "gram long, region long, n long")
    regions = counted.groupBy("gram", "region").agg(F.sum("n").alias("n"))
    grams = regions.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("regions")).filter("all > 1")
    known = saved(
        regions.join(grams, "gram").select("gram", "region", (F.col("n") > 1).alias("again"), (F.col("regions") > 1).alias("open")),
        "suffix-regions",
    )
    places = anchored.mapInArrow(_places, "gram long, region long, doc long, tag long, packed long, more long")
    hits = saved(
        places.join(known, ["gram", "region"]).select(
            F.when(F.col("open"), F.col("gram")).alias("gram"),
            F.when(F.col("open"), F.col("region")).alias("region"),
            "doc", "tag", "packed", "more", "again", "open",
        ),
        "suffix-hits",
    )

    # digits 3 and 4, on one representative of each region of a gram with several
    reps = hits.filter("open").groupBy("gram", "region").agg(
        F.min(F.struct("doc", "tag", "packed")).alias("at"), F.min(~F.col("again")).alias("alone")
    )
    by_doc = reps.select("at.doc", "at.tag", "gram", "at.packed", "alone").groupBy("doc", "tag").agg(
        F.collect_list(F.struct("gram", "packed", "alone")).alias("reps")
    )
    region_bytes = texts.join(by_doc, ["doc", "tag"]).select("doc", "tag", "text", "reps").mapInArrow(
        _regions, "gram long, doc long, tag long, packed long, alone boolean, bytes binary"
    )
    table = saved(region_bytes.withColumn("rep", F.monotonically_increasing_id()), "suffix-bytes")
    blocks = table.mapInArrow(_blocks, "core long, hull long, rep long, first long, last long")
    cores = blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("hull").alias("h0"), F.max("hull").alias("h1")).filter("n > 1")
    met = saved(blocks.join(cores, "core").select("rep", "first", "last", (F.col("h0") == F.col("h1")).alias("same")), "suffix-blocks")
    whole = met.filter("same").join(table.filter("alone").select("rep", "doc", "tag", "packed"), "rep")
    at = F.shiftright("packed", 16)
    whole = whole.select("doc", "tag", (at + F.col("first")).alias("lo"), (at + F.col("last")).alias("hi"))
    mixed = met.filter(~F.col("same")).groupBy("rep").agg(
        F.collect_list(F.struct("first", "last")).alias("parts")
    ).select("rep", F.col("parts.first").alias("firsts"), F.col("parts.last").alias("lasts"))
    windows = saved(
        table.join(mixed, "rep").mapInArrow(_windows, "window long, doc long, tag long, lo long"), "suffix-windows"
    )
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    single = windows.filter("lo is not null").join(twice, "window").select("doc", "tag", "lo", F.col("lo").alias("hi"))

    lo = F.shiftright("packed", 16) - F.shiftright("packed", 8).bitwiseAND(255)
    flagged = hits.filter("again").select("doc", "tag", lo.alias("lo"), (lo + F.col("packed").bitwiseAND(255) + F.col("more")).alias("hi"))
    # at most one span per run of equal anchors, block and window of a document; rows of equal id and text have the same ones
    return flagged.unionByName(whole).unionByName(single).groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, known by 128 bits of hashes (doc, tag) of both: rows may share a doc_id, null included."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return rows.select("*", F.xxhash64("text", "doc_id").alias("doc"), F.xxhash64(F.lit(DEPTH), "text", "doc_id").alias("tag"))


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) per input row.

    Texts are UTF-8 bytes; null and empty ones have nothing to remove. Each
    row is a document of its own, so repeated rows of 200 bytes or more are
    removed throughout. Strings are judged on the input. Other columns are
    ignored. ``kept_text`` has the bytes that stay (cuts may split a
    character, so it is binary).
    """
    spans = repeated_windows(docs)

    def run(batches):
        for b in batches:
            out = []
            for text, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                out.append((len(text), *_remove(text, [(x["lo"], x["hi"]) for x in s or ()])))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            n = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays[:n]], ["doc_id", *names[:n]])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text
    return _texts(docs).join(spans, ["doc", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
