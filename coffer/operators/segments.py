"""Numbers and running values within a key, without one task per key.

A window over a key is one task, however long the key's history is. Here a
key's rows are cut into bounded segments: each segment is summed by itself, a
small table with one row per (key, segment) carries what came before, and one
equi-join on (key, segment) adds it. A key with a third of all rows is then
spread over as many tasks as it has segments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.session import ensure_checkpoint_dir


def numbered(rows: DataFrame, key: Sequence[str], order: Sequence[str], to: str = "pos") -> DataFrame:
    """``rows`` with ``to``: the row's number (from 1) within ``key`` by ``order`` (nulls first).

    One range shuffle by key and order puts a key's rows in consecutive
    partitions, which are numbered by themselves; the partitions' counts carry
    over. Rows equal in key and order are numbered in any order, and a large
    group of them is spread as well. Keys are not null. Internal columns are
    named ``__seg_*``.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    key, order = list(key), list(order)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        rows.withColumn("__seg_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *key, *order, "__seg_tie")
        .withColumn("__seg_part", F.spark_partition_id())
        .checkpoint()  # partition ids are data from here on
    )
    local = F.row_number().over(Window.partitionBy("__seg_part", *key).orderBy(*order, "__seg_tie"))
    before = F.sum("__seg_n").over(Window.partitionBy(*key).orderBy("__seg_part").rowsBetween(Window.unboundedPreceding, -1))
    carries = (
        dealt.groupBy(*key, "__seg_part")
        .agg(F.count(F.lit(1)).alias("__seg_n"))
        .withColumn("__seg_before", before)
        .where("__seg_before > 0")  # at most one key of each partition began before it
        .select(*key, "__seg_part", "__seg_before")
    )
    return (
        dealt.withColumn("__seg_local", local)
        .join(carries, [*key, "__seg_part"], "left")
        .select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__seg_local") + F.coalesce("__seg_before", F.lit(0))).alias(to))
    )


def running(
    rows: DataFrame,
    key: Sequence[str],
    segment: str,
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
    firsts: Mapping[str, str] | None = None,
    before: Mapping[str, str] | None = None,
    highs: Mapping[str, str] | None = None,
) -> DataFrame:
    """``rows`` with running values within ``key`` by ``order``, a segment at a time.

    ``segment`` is a column that never falls along ``order`` within a key; no
    task gets more than a (key, segment) together. ``sums``, ``lasts``,
    ``firsts``, ``before`` and ``highs`` map new columns to input columns: the
    sum so far (NULL as long as all values are), the latest value that is not
    NULL up to the row, the next one from the row on, the latest one above the
    row, the greatest one up to the row. ``rows`` is read twice: hand in something
    written or checkpointed where it is dear.
    """
    key, order = list(key), list(order)
    sums, lasts, firsts, before = dict(sums or {}), dict(lasts or {}), dict(firsts or {}), dict(before or {})
    highs = dict(highs or {})
    cell = Window.partitionBy(*key, segment).orderBy(*order)
    upto, after = cell.rowsBetween(Window.unboundedPreceding, 0), cell.rowsBetween(0, Window.unboundedFollowing)
    above = cell.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    have = lambda c: F.when(F.col(c).isNotNull(), place)  # noqa: E731  max_by and min_by skip null places
    totals = rows.groupBy(*key, segment).agg(
        F.count(F.lit(1)).alias("__seg_n"),
        *[F.sum(c).alias(f"__seg_{to}") for to, c in sums.items()],
        *[F.max(c).alias(f"__seg_{to}") for to, c in highs.items()],
        *[F.max_by(c, have(c)).alias(f"__seg_{to}") for to, c in (lasts | before).items()],
        *[F.min_by(c, have(c)).alias(f"__seg_{to}") for to, c in firsts.items()],
    )
    by_segment = Window.partitionBy(*key).orderBy(segment)
    earlier, later = by_segment.rowsBetween(Window.unboundedPreceding, -1), by_segment.rowsBetween(1, Window.unboundedFollowing)
    carry = totals.select(
        *key,
        segment,
        *[F.sum(f"__seg_{to}").over(earlier).alias(f"__seg_{to}") for to in sums],
        *[F.max(f"__seg_{to}").over(earlier).alias(f"__seg_{to}") for to in highs],
        *[F.last(f"__seg_{to}", ignorenulls=True).over(earlier).alias(f"__seg_{to}") for to in lasts | before],
        *[F.first(f"__seg_{to}", ignorenulls=True).over(later).alias(f"__seg_{to}") for to in firsts],
    )
    local = rows.select(
        "*",
        *[F.sum(c).over(upto).alias(f"__loc_{to}") for to, c in sums.items()],
        *[F.max(c).over(upto).alias(f"__loc_{to}") for to, c in highs.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"__loc_{to}") for to, c in lasts.items()],
        *[F.first(c, ignorenulls=True).over(after).alias(f"__loc_{to}") for to, c in firsts.items()],
        *[F.last(c, ignorenulls=True).over(above).alias(f"__loc_{to}") for to, c in before.items()],
    )
    both = lambda to: F.coalesce(F.col(f"__loc_{to}") + F.col(f"__seg_{to}"), f"__loc_{to}", f"__seg_{to}")
    return local.join(carry, [*key, segment]).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[both(to).alias(to) for to in sums],
        *[F.greatest(f"__loc_{to}", f"__seg_{to}").alias(to) for to in highs],  # skips NULLs
        *[F.coalesce(f"__loc_{to}", f"__seg_{to}").alias(to) for to in [*lasts, *firsts, *before]],
    )
