"""Keyed upserts without a MERGE-capable table.

``upsert`` is the set form of ``MERGE … WHEN MATCHED UPDATE <cols> WHEN NOT
MATCHED INSERT``: one full outer join on the keys (one exchange per side,
no broadcast), after the source has been de-duplicated last-write-wins.
Keys are unique on both sides by then, so the join has no hot key whatever
the data's skew. Nothing is ever deleted; target columns that are not in
``update_cols`` (e.g. ``date_utc``, ``created_at``) keep their stored values.

``write_upsert`` applies an upsert to a parquet table partitioned by a
column (month, day): only the partitions the batch touches are read and
rewritten, through a staging copy in the session's checkpoint directory so
the job never overwrites the files it is reading.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.operators.ledger import last_write_wins
from coffer.session import remove_folder, scratch_folder
from coffer.sources.readers import stored

ACTION = "_action"
ACTIONS = ("inserted", "updated", "kept")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    seq: str | None = None,
    now: Column | str | None = None,
    created_col: str | None = "created_at",
) -> DataFrame:
    """Merge ``source`` into ``target`` on ``keys``; returns the new table.

    * source rows are reduced to one per key, the greatest ``seq`` winning
      (I6); without ``seq`` the source must already be unique on its keys;
    * matched keys take ``update_cols`` from the source, every other column
      from the target;
    * new keys are inserted with ``created_col`` set to ``now`` (I10);
    * unmatched target rows are kept as they are.

    The result has the target's columns plus ``_action`` in
    ('kept', 'updated', 'inserted').
    """
    keys = list(keys)
    cols = [c for c in target.columns if c != ACTION]
    src = source
    if seq is not None:
        src = last_write_wins(source, keys, seq).drop("n_rows")
    src_cols = [c for c in src.columns if c in cols or c in keys]
    t = target.select(*[F.col(c).alias(f"t__{c}") for c in cols], F.lit(True).alias("t__hit"))
    s = src.select(*[F.col(c).alias(f"s__{c}") for c in src_cols], F.lit(True).alias("s__hit"))
    cond = None
    for k in keys:
        c = F.col(f"t__{k}") == F.col(f"s__{k}")
        cond = c if cond is None else cond & c
    j = t.join(s, cond, "full_outer")
    t_hit = F.col("t__hit").isNotNull()
    s_hit = F.col("s__hit").isNotNull()
    now_col = None
    if now is not None:
        now_col = now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")
    out = []
    for c in cols:
        tc = F.col(f"t__{c}")
        sc = F.col(f"s__{c}") if c in src_cols else F.lit(None)
        if c in keys:
            v = F.when(t_hit, tc).otherwise(sc)
        elif c in update_cols:
            v = F.when(s_hit, sc).otherwise(tc)
        elif created_col is not None and c == created_col:
            v = F.when(t_hit, tc).otherwise(now_col if now_col is not None else sc)
        else:
            v = F.when(t_hit, tc).otherwise(sc)
        out.append(v.cast(target.schema[c].dataType).alias(c))
    action = (
        F.when(t_hit & s_hit, F.lit("updated"))
        .when(t_hit, F.lit("kept"))
        .otherwise(F.lit("inserted"))
    )
    return j.select(*out, action.alias(ACTION))


def fill_numeric_nulls(df: DataFrame, numeric_cols: Sequence[str]) -> DataFrame:
    """I5 detail: NULL numbers are stored as 0 by the sheet upsert."""
    return df.na.fill(0, subset=list(numeric_cols))


def write_upsert(
    source: DataFrame,
    target_path: str,
    keys: Sequence[str],
    update_cols: Sequence[str],
    partition_col: str,
    seq: str | None = None,
    now: Column | str | None = None,
) -> dict[str, int]:
    """Apply an upsert to a parquet table partitioned by ``partition_col``.

    Returns how many rows were ``inserted``, ``updated`` and ``kept`` (in the
    partitions that the batch touches), counted by the job that writes them.

    The source must carry ``partition_col`` (derived from a key, so a key
    never moves between partitions). The batch is written once to a staging
    folder under ``spark.checkpoint.dir`` and read from there, so its plan
    runs once. Only partitions present in it are read from the target (their
    values, one per directory the batch touches, prune the file listing). The
    merged partitions are staged too, which cuts the lineage to the target's
    files, then swapped in with dynamic partition overwrite; the staging
    folder is removed at the end. A note in the table names it meanwhile: a
    run that was cut off during the swap is finished by the next one.

    Only a missing target path means a first write. Any failure to read the
    target raises before anything in it is replaced.
    """
    spark = source.sparkSession
    finish_upsert(spark, target_path, partition_col)
    if seq is not None:  # last write wins inside the batch, on every path
        source = last_write_wins(source, list(keys), seq).drop("n_rows", seq)
    stage = scratch_folder(spark, "upsert")
    source.write.parquet(f"{stage}/batch")
    batch = spark.read.schema(source.schema).parquet(f"{stage}/batch")
    values = [r[0] for r in batch.select(partition_col).distinct().collect()]
    counts = dict.fromkeys(ACTIONS, 0)
    if values:
        target = stored(spark, target_path)
        if target is None:
            merged = batch
            if now is not None and "created_at" not in merged.columns:
                merged = merged.withColumn("created_at", F.lit(str(now)).cast("timestamp_ntz"))
            merged = merged.withColumn(ACTION, F.lit("inserted"))
        else:
            merged = upsert(target.filter(F.col(partition_col).isin(values)), batch, keys, update_cols, now=now)
        merged, seen = counted(merged)
        merged.write.partitionBy(partition_col).parquet(f"{stage}/merged")
        _note(spark, target_path, stage)
        _swap_in(spark, target_path, stage, partition_col, merged.schema)
        counts = seen.get
    remove_folder(spark, stage)
    return counts


PENDING = "_upsert_pending"  # Spark reads no folder of a table that starts with an underscore


def _note(spark: SparkSession, target_path: str, stage: str) -> None:
    """Leaves the staging folder's name in the table, for a run that is cut off while it swaps."""
    spark.createDataFrame([(stage,)], "stage string").coalesce(1).write.mode("overwrite").text(f"{target_path}/{PENDING}")


def _swap_in(spark: SparkSession, target_path: str, stage: str, partition_col: str, schema: T.StructType | None = None) -> None:
    """Replaces the staged partitions of the table and takes the note away.

    Per-write option (not the session conf): only the staged partitions are
    replaced, and concurrent jobs on the session are unaffected.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    merged = reader.parquet(f"{stage}/merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(target_path)
    remove_folder(spark, f"{target_path}/{PENDING}")


def finish_upsert(spark: SparkSession, target_path: str, partition_col: str) -> bool:
    """Finishes an upsert that was cut off while it swapped its partitions in; whether there was one.

    The note in the table names the folder where the merged partitions lie
    whole; putting them in again gives the table that the cut-off run meant.
    """
    try:
        notes = spark.read.text(f"{target_path}/{PENDING}").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    for note in notes:
        _swap_in(spark, target_path, note["value"], partition_col)
        remove_folder(spark, note["value"])
    return bool(notes)


def counted(merged: DataFrame) -> tuple[DataFrame, Observation]:
    """``merged`` without its action column, and the actions' counts that the job that runs it observes."""
    seen = Observation()
    counts = [F.count_if(F.col(ACTION) == a).alias(a) for a in ACTIONS]
    return merged.observe(seen, *counts).drop(ACTION), seen


def bucket_count(spark: SparkSession, rows: int, per_bucket: int = 1_000_000) -> int:
    """How many buckets a new table of ``rows`` rows gets.

    A bucket is one task of the writing and of the join, so their number
    follows the table: with a fixed one each task's sort grows with it. Not
    below the session's shuffle partitions: Spark exchanges the stored side of
    a join too where it has fewer buckets than the batch has partitions.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_bucket))


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """``df`` as catalog table ``table``, bucketed and sorted by its keys; ``path`` makes it external.

    One shuffle by the keys puts each bucket in one file. A table that has
    the same keys and bucket count is joined on them without being moved.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def bucketed_upsert(
    source: DataFrame,
    table: str,
    keys: Sequence[str],
    update_cols: Sequence[str],
    seq: str | None = None,
    now: Column | str | None = None,
) -> DataFrame:
    """``upsert`` into a table of ``write_bucketed``: only the batch is exchanged.

    The stored side of the join comes bucket by bucket from its files, however
    large it is; the batch is shuffled to the same number of buckets. Returns
    the new table with ``_action``; ``write_bucketed_upsert`` stores it.
    """
    return upsert(source.sparkSession.table(table), source, keys, update_cols, seq=seq, now=now)


def write_bucketed_upsert(
    source: DataFrame,
    table: str,
    keys: Sequence[str],
    update_cols: Sequence[str],
    buckets: int,
    seq: str | None = None,
    now: Column | str | None = None,
    path: str | None = None,
) -> dict[str, int]:
    """Applies a batch to a bucketed table (made by the first batch); returns the counts of ``write_upsert``.

    The new table is written whole beside the old one, takes its name last,
    and then the old one goes. A run that was cut off between the two is
    finished by the next one; running a batch again changes nothing.
    ``path`` is a folder for the versions of an external table.
    """
    spark = source.sparkSession
    exists = spark.catalog.tableExists
    fresh = f"{table}__next"
    if not exists(table) and exists(fresh):
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {fresh}")
    if exists(table):
        merged = bucketed_upsert(source, table, keys, update_cols, seq, now)
    else:
        merged = last_write_wins(source, list(keys), seq).drop("n_rows", seq) if seq is not None else source
        if now is not None and "created_at" not in merged.columns:
            merged = merged.withColumn("created_at", F.lit(str(now)).cast("timestamp_ntz"))
        merged = merged.withColumn(ACTION, F.lit("inserted"))
    merged, seen = counted(merged)
    write_bucketed(merged, fresh, keys, buckets, path and f"{path.rstrip('/')}/{uuid.uuid4().hex}")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    return seen.get
