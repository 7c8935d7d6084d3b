"""Exact top-k search by inner product: columnar branch-and-bound over blocks.

1. Both sides are packed into blocks of vectors in vertical layout: one array
   per block of 16 dimensions, and for each of them what mass (norm) a vector
   has left behind it.
2. A grid deals the work out: candidate blocks go to stripes, query blocks to
   groups of a bounded number of queries, and a cell is a stripe with a group.
   A cell's queries come first in its sorted partition, then its candidate
   blocks stream past them, so a task holds one group and one block.
3. In a cell, scores grow one block of dimensions at a time. By Cauchy-Schwarz
   the rest of a score is at most the product of the masses that are left;
   whoever cannot reach a query's k-th best score any more is dropped, and
   what survives is compacted: first columns, then single pairs.
4. A cell returns at most k rows a query; a window over the query ranks them.

Sums are exact: in doubles while they stay below 2**53, else in whole numbers
of any size (a choice by the largest component, never by the row count).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.llm.common import saved, shuffle_partitions

SCALE = 256
#: The largest long.
TOP = 2**63 - 1
#: Dimensions of a vertical block, vectors of a packed block.
DIMS, BLOCK = 16, 2048
#: Queries of a group, candidates of a stripe.
GROUP, STRIPE = 1 << 14, 1 << 20
#: Bytes of a block's and a group's components as doubles: wide vectors make smaller ones.
_BLOCK_BYTES, _GROUP_BYTES = 1 << 21, 1 << 25
#: Queries that meet a candidate block at once.
_TILE = 512
#: Below this share of live pairs they are followed one by one.
_SPARSE = 0.1
_PACKED = "ids array<long>, n long, dim int, peak double, parts array<binary>, masses binary"
_FOUND = "q_block long, q_at int, query_id long, vec_id long, score long"


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null, and all components are there and finite (also 256-fold)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(F.lit(float(SCALE)) * x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def _block(ids: list, matrix: np.ndarray):
    """One packed row of the vectors (rows of ``matrix``, whole numbers as doubles)."""
    n, dim = matrix.shape
    parts = [np.ascontiguousarray(matrix[:, at : at + DIMS].T) for at in range(0, dim, DIMS)]
    with np.errstate(over="ignore"):
        mass = np.array([np.square(p).sum(axis=0) for p in parts]).reshape(len(parts), n)
        left = np.sqrt(mass[::-1].cumsum(axis=0)[::-1][1:])
    peak = float(np.abs(matrix).max(initial=0.0))
    kind = "<i4" if peak < 2**31 else "<f8"
    return ids, n, dim, peak, [p.astype(kind).tobytes() for p in parts], left.astype("<f8").tobytes()


def _pack(batches):
    for b in batches:
        vectors = b.column("vector")
        ends = vectors.offsets.to_numpy()
        with np.errstate(over="ignore"):
            flat = np.floor(vectors.values.to_numpy(zero_copy_only=False).astype("f8") * SCALE)
        ids = b.column("vec_id").to_pylist()
        step = max(1, min(BLOCK, _BLOCK_BYTES // (8 * max(1, int(np.diff(ends).max(initial=0))))))
        for at in range(0, b.num_rows, step):
            e = ends[at : at + step + 1].astype("i8")
            sizes = np.diff(e)
            dim = int(sizes.max(initial=0))
            matrix = np.zeros((len(sizes), dim))
            matrix[np.arange(dim) < sizes[:, None]] = flat[e[0] : e[-1]]
            row = _block(ids[at : at + step], matrix)
            types = (pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.binary()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, types, strict=True)], ["ids", "n", "dim", "peak", "parts", "masses"]
            )


def pack(vectors: DataFrame, name: str) -> DataFrame:
    """``vectors`` (vec_id, embedding) as numbered blocks in vertical layout, written to the shared folder."""
    rows = vectors.where(usable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return saved(rows.mapInArrow(_pack, _PACKED), name).withColumn("block", F.monotonically_increasing_id())


class _Side:
    """Blocks of one side in memory: ids, whether an id is null, parts (dims x n) and masses by part."""

    def __init__(self, rows: list[dict], exact: bool):
        kind = "f8" if exact else object
        n = [r["n"] for r in rows]
        self.n = sum(n)
        self.ids = np.array([0 if i is None else i for r in rows for i in r["ids"]], "i8")
        self.nulls = np.array([i is None for r in rows for i in r["ids"]], bool)
        wide = max((len(r["parts"]) for r in rows), default=0)
        self.parts, self.masses = [], []
        for j in range(wide):
            part, mass = np.zeros((DIMS, self.n), kind), np.zeros(self.n)
            at = 0
            for r in rows:
                if j < len(r["parts"]):
                    raw = r["parts"][j]
                    height = min(DIMS, r["dim"] - j * DIMS)
                    x = np.frombuffer(raw, "<i4" if r["peak"] < 2**31 else "<f8").reshape(height, r["n"])
                    if exact:
                        part[:height, at : at + r["n"]] = x
                    else:
                        part[:height, at : at + r["n"]] = [[int(v) for v in line] for line in x.tolist()]
                if j + 1 < len(r["parts"]):
                    mass[at : at + r["n"]] = np.frombuffer(r["masses"], "<f8").reshape(-1, r["n"])[j]
                at += r["n"]
            self.parts.append(part)
            self.masses.append(mass)


class _Cell:
    """The queries of a group and, for each, the best k of the candidates so far."""

    def __init__(self, rows: list[dict], k: int, exact: bool):
        self.k, self.exact = k, exact
        self.side = _Side(rows, exact)
        self.block = np.concatenate([np.full(r["n"], r["block"], "i8") for r in rows])
        self.at = np.concatenate([np.arange(r["n"], dtype="i4") for r in rows])
        self.score = np.full((self.side.n, k), -np.inf, "f8" if exact else object)
        self.found = np.zeros((self.side.n, k), "i8")
        self.null = np.zeros((self.side.n, k), bool)

    def meet(self, row: dict) -> None:
        """Lets a candidate block pass by all queries."""
        c = _Side([row], self.exact)
        for lo in range(0, self.side.n, _TILE):
            self._tile(slice(lo, min(lo + _TILE, self.side.n)), c)

    def _tile(self, tile: slice, c: _Side) -> None:
        q = self.side
        wide = min(len(q.parts), len(c.parts))  # behind it one side is zero
        least = self.score[tile, -1]
        own = (q.ids[tile, None] == c.ids) & ~q.nulls[tile, None] & ~c.nulls
        cols = np.arange(c.n)
        sums = np.zeros((len(least), c.n), self.score.dtype)
        for j in range(wide):
            if j and self.exact:
                reach = np.outer(q.masses[j - 1][tile], c.masses[j - 1][cols])
                live = (sums + (reach * (1 + 1e-9) + 1) >= least[:, None]) & ~own
                if live.mean() < _SPARSE:
                    at, ci = np.nonzero(live)
                    self._pairs(tile, c, at, cols[ci], sums[at, ci], j, wide)
                    return
                keep = live.any(axis=0)
                if keep.mean() < 0.75:
                    cols, sums, own = cols[keep], sums[:, keep], own[:, keep]
            sums = sums + q.parts[j][:, tile].T @ c.parts[j][:, cols]
        if len(cols) == 0:
            return
        if not self.exact:
            sums = np.minimum(np.maximum(sums, -TOP - 1), TOP)
        sums[own] = -np.inf
        kth = np.sort(sums, axis=1)[:, -self.k] if len(cols) >= self.k else np.full(len(least), -np.inf)
        at, ci = np.nonzero((sums >= np.maximum(least, kth)[:, None]) & (sums > -np.inf))
        self._merge(tile, c, at, cols[ci], sums[at, ci])

    def _pairs(self, tile: slice, c: _Side, at, ci, sums, j: int, wide: int) -> None:
        q = self.side
        least = self.score[tile, -1]
        while len(at) and j < wide:
            sums = sums + np.einsum("ij,ij->j", q.parts[j][:, tile][:, at], c.parts[j][:, ci])
            keep = sums + (q.masses[j][tile][at] * c.masses[j][ci] * (1 + 1e-9) + 1) >= least[at]
            at, ci, sums = at[keep], ci[keep], sums[keep]
            j += 1
        keep = sums >= least[at]
        self._merge(tile, c, at[keep], ci[keep], sums[keep])

    def _merge(self, tile: slice, c: _Side, at, ci, sums) -> None:
        """Puts the pairs among the best; ties go to the smaller id, null ids last."""
        if not len(at):
            return
        old_at, old = np.nonzero(self.score[tile] > -np.inf)
        here = self.score[tile]
        at = np.concatenate((old_at, at))
        sums = np.concatenate((here[old_at, old], sums))
        ids = np.concatenate((self.found[tile][old_at, old], c.ids[ci]))
        nulls = np.concatenate((self.null[tile][old_at, old], c.nulls[ci]))
        if self.exact:
            order = np.lexsort((ids, nulls, -sums, at))
        else:
            order = np.array(sorted(range(len(at)), key=lambda i: (at[i], -sums[i], nulls[i], ids[i])))
        at, sums, ids, nulls = at[order], sums[order], ids[order], nulls[order]
        first = np.searchsorted(at, np.arange(here.shape[0]))
        rank = np.arange(len(at)) - first[at]
        keep = rank < self.k
        at, rank = at[keep] + tile.start, rank[keep]
        self.score[at, rank], self.found[at, rank], self.null[at, rank] = sums[keep], ids[keep], nulls[keep]

    def result(self) -> pa.RecordBatch:
        q, rank = np.nonzero(self.score > -np.inf)
        scores = [int(x) for x in self.score[q, rank]]
        side = self.side
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.block[q]),
                pa.array(self.at[q]),
                pa.array(side.ids[q], mask=side.nulls[q]),
                pa.array(self.found[q, rank], mask=self.null[q, rank]),
                pa.array(scores, pa.int64()),
            ],
            ["q_block", "q_at", "query_id", "vec_id", "score"],
        )


def _search(k: int, exact: bool):
    """mapInArrow function over blocks sorted by cell, queries first."""

    def run(batches):
        at, queries, cell = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if row["cell"] != at:
                    if cell is not None:
                        yield cell.result()
                    at, queries, cell = row["cell"], [], None
                if not row["candidate"]:
                    queries.append(row)
                elif queries:
                    if cell is None:
                        cell = _Cell(queries, k, exact)
                    cell.meet(row)
        if cell is not None:
            yield cell.result()

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the highest scores for each row of ``queries``.

    Both have vec_id and embedding (array of numbers); other columns are
    ignored. A component x counts as floor(256 * x), the score is the inner
    product of these whole numbers, of vectors of unequal length over the
    components that both have (an empty vector scores 0). Vectors that are
    null or hold null or non-finite components take no part. Rows with the
    query's own vec_id are never its candidates. Ties go to the smaller
    vec_id, null ids last; fewer than k candidates give fewer rows. Repeated
    candidate rows each take a rank; each repeated query row has ranks of its
    own. Scores beyond a long count as the nearest long. Empty tables give
    an empty result.
    """
    spark = vectors.sparkSession
    cand, asked = pack(vectors, "top-k-candidates"), pack(queries, "top-k-queries")
    size = lambda d: d.agg(  # noqa: E731  one row: rows, blocks, largest component, longest vector
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("peak"), F.lit(0.0)), F.coalesce(F.max("dim"), F.lit(0))
    ).first()
    (n_c, blocks, peak_c, dim), (n_q, _, peak_q, _) = size(cand), size(asked)
    exact = peak_c * peak_q * max(dim, 1) < 2**53
    groups = max(1, -(-n_q // GROUP), -(-8 * n_q * dim // _GROUP_BYTES))
    stripes = max(1, -(-n_c // STRIPE), min(blocks, shuffle_partitions(spark)))
    of = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = (
        asked.withColumn("candidate", F.lit(False)).withColumn("group", of(groups)).withColumn("stripe", every(stripes))
    ).unionByName(cand.withColumn("candidate", F.lit(True)).withColumn("stripe", of(stripes)).withColumn("group", every(groups)))
    dealt = (
        cells.withColumn("cell", F.col("stripe") * groups + F.col("group"))
        .drop("stripe", "group")
        .repartition(min(groups * stripes, 100_000), "cell")
        .sortWithinPartitions("cell", "candidate")
    )
    found = dealt.mapInArrow(_search(k, exact), _FOUND)
    best = Window.partitionBy("q_block", "q_at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def top_k_of_every_50th(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k best of all rows for each row whose vec_id is divisible by 50."""
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k)


def oracle_sql(k: int = 5) -> str:
    """The same result as DuckDB SQL."""
    return f"""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))::HUGEINT) AS y
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id,
        coalesce(list_sum(list_transform(range(1, least(len(q.y), len(c.y)) + 1), lambda i: q.y[i] * c.y[i])), 0) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= {k}"""
