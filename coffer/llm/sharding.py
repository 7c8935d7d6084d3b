"""Contiguous shards of near-equal bytes, cut from global prefix sums.

Documents are put in ascending doc_id order by one range shuffle of their
sizes (never their texts). Each range partition writes its own running sums;
the per-partition totals (one row per partition) give every partition its
global offset, and a document's place on the byte axis decides its shard.

Law ``bytes``: a document belongs to the shard that its middle byte falls in,
so every shard is within one document's size of ``total / n_shards``.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import saved, shuffle_partitions

ROW_OVERHEAD = 8


def _running(batches):
    """Adds the partition's id, the bytes and the rows before each row."""
    part, seen, row = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False)
        ends = seen + np.cumsum(size)
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("size"),
                b.column("text_crc32"),
                pa.array(np.full(n, part, "int64")),
                pa.array(ends - size),
                pa.array(row + np.arange(n, dtype="int64")),
            ],
            ["doc_id", "size", "text_crc32", "_part", "_before", "_row"],
        )
        if n:
            seen, row = int(ends[-1]), row + n


def shard_by_bytes(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per input row.

    ``size`` is the text's UTF-8 bytes plus 8; a null text counts as empty.
    Null doc_ids come first; rows with the same doc_id are ordered by their
    text's checksum, and identical rows in either order. An empty table gives
    an empty result; other columns are ignored. ``slot`` counts from 0 within
    a shard in that order. ``grown_shard`` is null (only a key law has one).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),  # splits repeated rows
    )
    order = ["doc_id", "text_crc32", "_tie"]
    ranged = sizes.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # written: the partition ids below are data from here on
    local = saved(
        ranged.mapInArrow(
            _running,
            "doc_id long, size long, text_crc32 long, _part long, _before long, _row long",
        ),
        "shard-sums",
    )
    totals = (
        local.groupBy("_part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).orderBy("_part").collect()
    )  # one row per range partition
    total = sum(r["size"] for r in totals)
    bytes_at = [0, *accumulate(r["size"] for r in totals)]
    rows_at = [0, *accumulate(r["rows"] for r in totals)]
    offsets = spark.createDataFrame(
        [(r["_part"], bytes_at[i], rows_at[i]) for i, r in enumerate(totals)],
        "_part long, _bytes_at long, _rows_at long",
    )
    middle2 = 2 * (F.col("_bytes_at") + F.col("_before")) + F.col("size")
    placed = local.join(F.broadcast(offsets), "_part").withColumn("_middle2", middle2).select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr(f"cast(least({n_shards - 1}, _middle2 * {n_shards} div {max(1, 2 * total)}) as int)").alias("shard"),
        (F.col("_rows_at") + F.col("_row")).alias("_rank"),
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
