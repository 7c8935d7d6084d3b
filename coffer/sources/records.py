"""CSV records of files that are read by many tasks each (A1).

A quoted field may hold line feeds, so a task that starts inside a file does
not know whether its first line is inside quotes. Here every line is a
function of that one bit (inside or not, before the line -> after it), and
only lines with quotes are other than the identity. The functions compose, so
one pass over the lines with quotes, segment by segment with a carry, gives
the bit everywhere; lines that a quoted field joins are then put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.operators.segments import running
from coffer.session import ensure_checkpoint_dir, scratch_folder

#: States inside a line: at the start of a field, in a bare one, in quotes, behind a closing quote.
_START, _BARE, _QUOTED, _CLOSED = range(4)
_TOKENS = '"|,|[^",]+'


def _ends_inside(line: Column, start: int) -> Column:
    """Whether a line ends inside quotes, read from state ``start``."""
    tokens = F.regexp_extract_all(line, F.lit(_TOKENS), F.lit(0))

    def step(state: Column, token: Column) -> Column:
        quote = (
            F.when(state == _START, _QUOTED)
            .when(state == _BARE, _BARE)  # a quote inside a bare field is a character
            .when(state == _QUOTED, _CLOSED)
            .otherwise(_QUOTED)  # a doubled quote
        )
        comma = F.when(state == _QUOTED, _QUOTED).otherwise(_START)
        other = F.when(state == _QUOTED, _QUOTED).otherwise(_BARE)
        return F.when(token == '"', quote).when(token == ",", comma).otherwise(other)

    return F.aggregate(tokens, F.lit(start), step) == _QUOTED


def staged_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """time, file, block, line, value of all lines, written to the shared folder.

    ``block`` is the byte where the line's split begins, ``line`` rises within
    it; both are data from here on, whatever happens to executors.
    """
    path = scratch_folder(spark, "csv-lines")
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    lines.write.parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def _joined_lines(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """line, record, block: the lines of records with line feeds, and the first line of each."""
    quoted = lines.filter(F.contains("value", F.lit('"'))).select(
        "file", "block", "line", _ends_inside(F.col("value"), _START).alias("f0"), _ends_inside(F.col("value"), _QUOTED).alias("f1")
    )
    # what is left turns the bit over, or sets it
    marks = quoted.filter("f0 or not f1").select(
        "file", "block", "line", F.expr("int(f0 and not f1)").alias("turn"), F.expr("if(f0 = f1, int(f0), null)").alias("set_to")
    )
    marks = marks.checkpoint()
    place = dict(key=["file"], segment="block", order=["line"])
    marks = running(marks, **place, sums={"turns": "turn"})
    marks = marks.withColumn("reset", F.when(F.col("set_to").isNotNull(), F.struct("set_to", "turns"))).checkpoint()
    marks = running(marks, **place, lasts={"since": "reset"})
    bit = (F.coalesce("since.set_to", F.lit(0)) + F.col("turns") - F.coalesce("since.turns", F.lit(0))) % 2
    marks = marks.select("file", "block", "line", bit.alias("after")).checkpoint()
    marks = running(marks, **place, before={"bit": "after"}).withColumn("bit", F.coalesce("bit", F.lit(0)))
    close = F.when((F.col("bit") == 1) & (F.col("after") == 0), F.struct("line", "block"))
    marks = running(marks.withColumn("close", close).checkpoint(), **place, firsts={"end": "close"})
    # a quote that nothing closes opens nothing: its line stays a record
    spans = marks.filter("bit = 0 and after = 1 and end is not null").select(
        "file", F.col("block").alias("from"), F.col("line").alias("record"), F.col("end.line").alias("last"), F.col("end.block").alias("to")
    )
    whole = spans.filter("from = to").select("record", "from", F.explode(F.sequence("record", "last")).alias("line"))
    parted = (
        spans.filter("from <> to")
        .join(ranges, "file")
        .filter("block between from and to")
        .select("record", "from", F.explode(F.sequence(F.greatest("record", "low"), F.least("last", "high"))).alias("line"))
    )
    return whole.unionByName(parted).withColumnRenamed("from", "block")


def csv_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """time, file, block, line, record: the CSV records behind the header of each file.

    ``block`` and ``line`` are those of a record's first line. Empty lines are
    no records. Within a record line feeds are kept; a carriage return at its
    end is not. A quote that no later one closes is taken as a character.
    """
    lines = staged_lines(spark, files)
    ranges = lines.groupBy("file", "block").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    heads = ranges.filter("block = 0").select(F.col("low").alias("line"))
    inner = _joined_lines(lines, ranges).checkpoint()
    single = lines.join(inner.select("line"), "line", "left_anti").join(heads, "line", "left_anti")
    together = F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"])
    several = (
        lines.drop("block")
        .join(inner, "line")
        .groupBy("time", "file", "block", "record")
        .agg(F.array_join(together, "\n").alias("value"))
        .withColumnRenamed("record", "line")
    )
    both = single.unionByName(several)
    value = F.regexp_replace("value", "\r$", "")
    return both.select("time", "file", "block", "line", value.alias("record")).filter("record <> ''")
