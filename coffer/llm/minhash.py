"""Near-duplicate detection with b-bit MinHash.

1. Sketch: each document's set of 5-word shingles gives 144 minima. Their
   bands of 4 generate candidates; of each minimum the 2 lowest bits (after
   mixing) are kept and packed into bit planes. At a similarity of 0.75 a pair
   shares none of the 36 bands with probability (1 - 0.75**4)**36 = 1.2e-6.
2. Documents with equal sets are one class from here on.
3. Stars: of the smallest classes of its buckets, each class is paired with
   the smallest, so that a bucket of any size gives a linear number of pairs.
   In further rounds, each class of a bucket that is still apart is paired
   with the likeliest of a few members of other components, drawn anew.
4. Estimate: bit counts of the planes' differences give the share of equal
   bits, corrected for chance collisions; pairs below 0.49 (six standard
   deviations under 0.75) go.
5. Confirm: the full shingle sets of the remaining pairs are intersected.
6. Components of the confirmed links. Then classes that share a bucket but are
   in different components are compared with each other inside the join, by
   sizes, by the estimate of a signature of 2048 minima, which has a limit of
   0.68, and by a bound on the similarity from parity sketches, which no link
   fails; what passes is confirmed and added. For sets of up to a thousand
   shingles or so the bound is close: hardly any pairs but links become rows.

The large groups of near copies collapse in step 3; step 6 sees what is left
and drops nothing. Joins on hot buckets, centres and classes are plain
equi-joins of two shuffled sides, which AQE splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import saved, sliced, tidied, utf8
from coffer.llm.components import components
from coffer.llm.shingles import mix, shingle_set, word_hashes

SHINGLE_WORDS = 5
BANDS, ROWS = 36, 4
BITS = 2
LONGS = -(-BANDS * ROWS // 64)
#: Links have 100 * intersection >= LEAST * union.
LEAST = 75
MIN_ESTIMATE = 0.49
#: Rounds of drawn centres, and centres drawn for a class in each.
ROUNDS, CENTRES = 3, 5

#: Minima of the finer signature, and its limit (six standard deviations under 0.75).
FINE, MIN_FINE = 2048, 0.68
#: Cells of the parity sketch.
PARITY = 4096

_SEEDS = mix(np.arange(1, 2 * (BANDS * ROWS + FINE) + 1, dtype="u8"))
_MUL = (_SEEDS[0::2] >> np.uint64(32)).astype("u4") | np.uint32(1)
_ADD = (_SEEDS[1::2] >> np.uint64(32)).astype("u4")


def minima(shingles: np.ndarray, first: int = 0, n: int = BANDS * ROWS) -> np.ndarray:
    """The minimum of each of the ``n`` permutations from ``first`` on over a non-empty set."""
    h = (shingles >> np.uint64(32)).astype("u4")
    mul, add = _MUL[first : first + n], _ADD[first : first + n]
    out = np.full(n, 0xFFFFFFFF, "u4")
    for at in range(0, len(h), 256):
        np.minimum(out, (h[at : at + 256, None] * mul + add).min(axis=0), out=out)
    return out


def _packed(m: np.ndarray) -> np.ndarray:
    """The low bits of mixed minima (rows x minima) as bit planes in 64-bit words."""
    n, k = m.shape
    low = mix(m.astype("u8") + np.uint64(0x51ED27)).astype("u1")
    planes = np.zeros((n, BITS, 64 * -(-k // 64)), "u1")
    for p in range(BITS):
        planes[:, p, :k] = (low >> p) & 1
    return np.packbits(planes, axis=2, bitorder="little").reshape(n, -1).view("<i8")


@tidied
def _sketch(batches):
    places = mix(np.arange(1, BANDS * ROWS + 1, dtype="u8") << np.uint64(20)).reshape(BANDS, ROWS)
    for b in sliced(batches, 1000):
        keys, sizes, all_minima, some = [], [], [], []
        for words in word_hashes(b.column("text").to_pylist()):
            s = shingle_set(words, SHINGLE_WORDS)
            sizes.append(len(s))
            some.append(len(s) > 0)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            all_minima.append(minima(s) if len(s) else np.zeros(BANDS * ROWS, "u4"))
        n = b.num_rows
        m = np.array(all_minima, "u4").reshape(n, BANDS * ROWS).astype("u8")
        bands = mix(((mix(m).reshape(n, BANDS, ROWS) ^ places) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=2, dtype="u8"))
        packed = _packed(m)
        offsets = lambda k: pa.array(np.arange(0, (n + 1) * k, k, dtype="i4"))
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array([k if x else None for k, x in zip(keys, some, strict=True)], pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets(BANDS), pa.array(bands.view("i8").ravel())),
                pa.ListArray.from_arrays(offsets(BITS * LONGS), pa.array(packed.ravel())),
            ],
            ["doc_id", "key", "n_shingles", "bands", "planes"],
        )


@tidied
def _sets(batches):
    """(id, shingles) of the rows whose set has the key that is asked for; a task gives each id once."""
    seen: set[int] = set()
    for b in sliced(batches, 1000):
        sets, ids = [], []
        asked = zip(b.column("id").to_pylist(), b.column("key").to_pylist(), strict=True)
        for words, (i, key) in zip(word_hashes(b.column("text").to_pylist()), asked, strict=True):
            s = shingle_set(words, SHINGLE_WORDS).tobytes()
            if i not in seen and xxhash.xxh3_128_digest(s) == key:
                seen.add(i)
                ids.append(i)
                sets.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])


@tidied
def _keys(batches):
    """(key, text) of each distinct set that a task sees."""
    seen: set[bytes] = set()
    for b in sliced(batches, 1000):
        texts = b.column("text").to_pylist()
        keys = [xxhash.xxh3_128_digest(shingle_set(w, SHINGLE_WORDS).tobytes()) for w in word_hashes(texts)]
        new = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[k] for k in new], pa.binary()), pa.array([texts[k] for k in new], pa.binary())], ["key", "text"]
        )


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of PARITY cells whether an odd number of the set's shingles falls into it, in 64-bit words."""
    odd = np.bincount((shingles % np.uint64(PARITY)).astype("i8"), minlength=PARITY) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype="i4")), pa.array(rows.ravel()))


@tidied
def _fine(batches):
    for b in sliced(batches, 200):  # 16 KB of minima a row
        n = b.num_rows
        sets = [np.frombuffer(x, "u8") for x in b.column("shingles").to_pylist()]
        m = [minima(s, BANDS * ROWS, FINE) for s in sets]
        parity = np.array([parities(s) for s in sets], "<i8").reshape(n, PARITY // 64)
        columns = [b.column("id"), _lists(_packed(np.array(m, "u4").reshape(n, FINE))), _lists(parity)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "fine", "parity"])


@tidied
def _confirm(batches):
    for b in sliced(batches, 500):
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * common >= LEAST * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _corrected(wrong: Column, minima: int) -> Column:
    """Similarity from the number of unequal low bits, corrected for chance collisions."""
    chance = 2.0**-BITS
    return (1 - wrong / F.lit(float(minima)) - chance) / (1 - chance)


def _estimate(x: str, y: str) -> Column:
    """Estimate from the bit planes ``x`` and ``y`` of the sketches."""
    wrong = []
    for k in range(LONGS):
        planes = [F.get(x, F.lit(p * LONGS + k)).bitwiseXOR(F.get(y, F.lit(p * LONGS + k))) for p in range(BITS)]
        differ = planes[0]
        for p in planes[1:]:
            differ = differ.bitwiseOR(p)
        wrong.append(F.bit_count(differ))
    return _corrected(sum(wrong[1:], wrong[0]), BANDS * ROWS)


def _fine_estimate(x: str, y: str) -> Column:
    """Estimate from the finer signatures; too many words for an unrolled expression."""
    half = FINE // 64

    def plane(p: int) -> Column:
        return F.zip_with(F.slice(x, p * half + 1, half), F.slice(y, p * half + 1, half), lambda a, b: a.bitwiseXOR(b))

    wrong = F.zip_with(plane(0), plane(1), lambda a, b: F.bit_count(a.bitwiseOR(b)))
    return _corrected(F.aggregate(wrong, F.lit(0), lambda total, n: total + n), FINE)


def _may_link(x: str, y: str, nx: str, ny: str) -> Column:
    """False only for pairs that are no link, judged by their parity sketches.

    Shingles of both sets leave no trace in the sketches' difference, and each
    odd cell there needs a shingle of one set only: of the ``nx + ny`` shingles
    at least as many are unshared as there are odd cells.
    """
    odd = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)
    both = F.col(nx) + F.col(ny)
    return (both - odd) * 100 >= (both + odd) * LEAST


def _plausible(x: str, y: str, nx: str, ny: str) -> Column:
    small, large = F.least(nx, ny), F.greatest(nx, ny)
    return (small * 100 >= large * LEAST) & (_estimate(x, y) >= MIN_ESTIMATE)


def _labelled(buckets: DataFrame, found: DataFrame) -> DataFrame:
    return buckets.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "hash", F.coalesce("component", "id").alias("label")
    )


def _class_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and shingles of the classes ``wanted`` (id, key, first), each once, from the texts of their first doc_ids.

    A text meets the one class that starts at its doc_id. Where several do
    (different texts under one doc_id), texts are told apart by their keys.
    """
    several = wanted.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("first")
    asked = wanted.withColumnRenamed("first", "doc_id")
    mixed = several.head(1)
    if mixed:
        several = saved(several.withColumnRenamed("first", "doc_id"), "minhash-several")
        keyed = texts.join(several, "doc_id", "left_semi").select("text").mapInArrow(_keys, "key binary, text binary")
        keyed = keyed.join(asked.join(several, "doc_id", "left_semi").select("key", "id"), "key").select("id", "key", "text")
        asked = asked.join(several, "doc_id", "left_anti")
    rows = texts.join(asked.hint("merge"), "doc_id").select("id", "key", "text")
    if mixed:
        rows = rows.unionByName(keyed)
    sets = saved(rows.mapInArrow(_sets, "id long, shingles binary"), "minhash-sets")
    # copies of a row meet in one task, unless their partition was split: then a set is there more than once
    if sets.groupBy("id").count().filter("count > 1").head(1):
        sets = saved(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "minhash-sets")
    return sets


def _same_doc(members: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of different texts that share a doc_id: a star for each such id, if there is any."""
    rows = members.filter("doc_id is not null and key is not null").select("doc_id", "key", F.xxhash64("key").alias("hash"))
    ends = rows.groupBy("doc_id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter("lo <> hi")
    ends = saved(ends.select("doc_id"), "minhash-shared-ids")
    if not ends.head(1):
        return None
    texts = rows.join(ends, "doc_id", "left_semi").select("doc_id", "key").distinct()
    texts = saved(texts.join(classes.select("key", "id"), "key").select("doc_id", "id"), "minhash-texts")
    centres = texts.groupBy("doc_id").agg(F.min("id").alias("a"))
    return texts.join(centres, "doc_id").filter("id <> a").select("a", F.col("id").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per input row.

    Null and empty texts have an empty set and are linked with nothing.
    Repeated rows give repeated results; different texts under one doc_id
    count as one document when links are followed. Rows without a doc_id are
    not linked: their component_id is null and they are kept. Other columns
    are ignored.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cols.select("doc_id", utf8().alias("text")).mapInArrow(
        _sketch, "doc_id long, key binary, n_shingles long, bands array<bigint>, planes array<bigint>"
    )
    sketches = saved(sketched, "minhash-sketches")
    members = sketches.select("doc_id", "key", "n_shingles")
    linked = sketches.filter("doc_id is not null and key is not null")
    # one row per set, with a number of its own and its smallest doc_id
    firsts = linked.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    classes = linked.join(firsts, ["key", "doc_id"]).dropDuplicates(["key"]).withColumnRenamed("doc_id", "first")
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "minhash-classes")
    rows = classes.select("id", F.explode("bands").alias("hash"))
    shared = rows.groupBy("hash").agg(F.min("id").alias("a"), F.max("id").alias("_last")).filter("a <> _last")
    buckets = saved(rows.join(shared.select("hash", "a"), "hash"), "minhash-buckets")
    wanted = classes.select("key", "id", "first").join(buckets.select("id").distinct(), "id", "left_semi")
    sets = _class_sets(cols.select("doc_id", utf8().alias("text")), wanted)
    sketch = classes.select("id", "n_shingles", "planes")

    def side(s: str) -> DataFrame:
        return sketch.select(F.col("id").alias(s), F.col("n_shingles").alias("n" + s), F.col("planes").alias("p" + s))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs.select("a", "b").distinct(), "minhash-pairs")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
        )
        return saved(both.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long"), "minhash-links")

    def plausible(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(_plausible("pa", "pb", "na", "nb"))

    stars = buckets.filter("id <> a").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a"))
    links = confirmed(plausible(stars))
    same = _same_doc(members, classes)
    if same is not None:
        links = links.unionByName(same)
    found = components(links)

    # classes of buckets that are still apart: the likeliest of a few centres, drawn anew each round
    for k in range(ROUNDS):
        left = _labelled(buckets, found)
        draw = F.xxhash64("id", F.lit(k))
        ends = left.groupBy("hash").agg(
            F.min("label").alias("_lo"),
            F.max("label").alias("_hi"),
            *[f(c, draw).alias(c + e) for c in ("id", "label") for e, f in (("_1", F.min_by), ("_2", F.max_by))],
        )
        apart = left.join(ends.filter("_lo <> _hi"), "hash")
        centre = F.when(F.col("label") != F.col("label_1"), F.col("id_1")).when(F.col("label") != F.col("label_2"), F.col("id_2"))
        drawn = apart.select(F.col("id").alias("b"), centre.alias("a"), F.pmod("hash", F.lit(CENTRES)).alias("slot"))
        drawn = drawn.filter("a is not null").groupBy("b", "slot").agg(F.min("a").alias("a")).select("a", "b").distinct()
        best = plausible(drawn).groupBy("b").agg(F.max_by("a", _estimate("pa", "pb")).alias("a"))
        more = confirmed(best)
        if not more.head(1):
            break
        links = links.unionByName(more)
        found = components(links)

    # classes of one bucket that are apart even now
    left = _labelled(buckets, found)
    ends = left.groupBy("hash").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi")
    left = saved(left.join(ends.select("hash"), "hash"), "minhash-open")
    # a finer signature tells families of moderate similarity apart inside the join
    finer = sets.join(left.select("id").distinct(), "id", "left_semi")
    finer = saved(finer.mapInArrow(_fine, "id long, fine array<bigint>, parity array<bigint>"), "minhash-fine")
    open_rows = left.join(finer, "id").join(classes.select("id", "n_shingles", "planes", "bands"), "id")

    def half(k: str) -> DataFrame:
        columns = ("id", "label", "n_shingles", "planes", "fine", "parity", "bands")
        return open_rows.select("hash", *[F.col(c).alias(c + k) for c in columns])

    rest = half("_x").join(half("_y"), "hash").filter(
        (F.col("label_x") < F.col("label_y"))
        & _plausible("planes_x", "planes_y", "n_shingles_x", "n_shingles_y")
        & (_fine_estimate("fine_x", "fine_y") >= MIN_FINE)
        # a pair comes from the first of the buckets that it shares
        & (F.col("hash") == F.array_min(F.array_intersect("bands_x", "bands_y")))
        & _may_link("parity_x", "parity_y", "n_shingles_x", "n_shingles_y")
    )
    links = links.unionByName(confirmed(rest.select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))))
    found = components(links)

    by_key = classes.select("key", "id", "first").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "first", F.coalesce("component", "id").alias("component")
    )
    smallest = by_key.groupBy("component").agg(F.min("first").alias("smallest"))
    by_key = by_key.join(smallest, "component").select("key", F.col("smallest").alias("component"))
    with_doc, without = members.filter("doc_id is not null"), members.filter("doc_id is null")
    out = with_doc.join(by_key, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    return out.unionByName(without.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))).select(
        "*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
