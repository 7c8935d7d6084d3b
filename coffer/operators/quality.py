"""Data-quality audits and repairs.

All audits are aggregates: counts per key or per symbol, with samples of a
fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.schemas import NULL_AUDIT_SAMPLE
from coffer.session import ensure_checkpoint_dir


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q2: key values that occur more than once, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def domain_rules(
    not_null: Sequence[str] = (),
    max_len: dict[str, int] | None = None,
    decimals: dict[str, T.DecimalType] | None = None,
) -> list[tuple[str, Column]]:
    """Q3 rule list: (reason, violation predicate) pairs.

    * NOT NULL columns;
    * string length caps (``NVARCHAR(n)``);
    * numbers that do not fit their stored ``DECIMAL(p,s)`` (overflow, NaN
      or infinity make ``try_cast`` NULL while the value is not).
    """
    rules: list[tuple[str, Column]] = []
    for c in not_null:
        rules.append((f"null:{c}", F.col(c).isNull()))
    for c, n in (max_len or {}).items():
        rules.append((f"length:{c}>{n}", F.length(F.col(c)) > n))
    for c, dt in (decimals or {}).items():
        v = F.col(c)
        # doubles well inside the type need no cast, which goes through their decimal texts
        inside = F.typeof(v).isin("double") & (F.abs(v.try_cast("double")) < 10.0 ** (dt.precision - dt.scale) / 2)
        rules.append((f"decimal:{c}", v.isNotNull() & ~inside & v.try_cast(dt).isNull()))
    return rules


def domain_split(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Q3: (valid rows, rejected rows with a ``reason`` column).

    The reason is the first violated rule in list order; the batch goes on
    with the valid rows, as the per-row inserts of the original skipped
    failing rows.
    """
    reason = F.lit(None).cast("string")
    for name, pred in reversed(rules):
        reason = F.when(F.coalesce(pred, F.lit(False)), F.lit(name)).otherwise(reason)
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def domain_audit(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Q3 summary: one row per rule with the number of rows violating it."""
    aggs = [F.count_if(F.coalesce(pred, F.lit(False))).alias(f"r{i}") for i, (_, pred) in enumerate(rules)]
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    rows = [
        F.struct(F.lit(name).alias("reason"), F.col(f"r{i}").alias("n_rejected"), F.col("n_rows"))
        for i, (name, _) in enumerate(rules)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def null_audit(
    df: DataFrame,
    value_col: str,
    group_col: str = "symbol",
    as_of: Column | None = None,
    sample: int = NULL_AUDIT_SAMPLE,
) -> DataFrame:
    """Q4 (+H4, D5): per group, how many dates (``<= as_of``) have a NULL
    value, and the first ``sample`` of those dates as ``YYYY-MM-DD, …``.

    The count is an aggregate; the dates are the first ``sample`` NULL rows of
    each group (a window whose rank limit Spark applies before its shuffle),
    so no list grows with the data. Groups without NULLs have an empty text.
    ``df`` is computed once, to its groups, dates and what is NULL.
    """
    ensure_checkpoint_dir(df.sparkSession)
    d = df if as_of is None else df.filter(F.col("date") <= as_of)
    d = d.select(group_col, "date", F.col(value_col).isNull().alias("__null")).checkpoint()
    counts = d.groupBy(group_col).agg(F.count_if("__null").alias("n_null"))
    by_date = Window.partitionBy(group_col).orderBy("date")
    first = d.filter("__null").select(group_col, "date").withColumn("__k", F.row_number().over(by_date)).filter(F.col("__k") <= sample)
    texts = first.groupBy(group_col).agg(F.array_sort(F.collect_list("date")).alias("__dates"))  # ``sample`` dates at most
    return counts.join(texts, group_col, "left").select(
        group_col,
        "n_null",
        F.coalesce(F.array_join(F.transform("__dates", lambda x: x.cast("string")), ", "), F.lit("")).alias("sample_dates"),
    )


def fill_nulls(df: DataFrame, numeric_cols: Sequence[str]) -> DataFrame:
    """Q5: NULL -> 0 on the declared numeric columns (not on inferred ones)."""
    return df.na.fill(0, subset=list(numeric_cols))


def count_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q5 follow-up: remaining NULLs per column, one row per column."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(cols)]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def evolve_schema(target: DataFrame, incoming: DataFrame, stray: Sequence[str] = ("index",)) -> DataFrame:
    """Q7: add the columns either side lacks (NULL-filled) and drop stray
    columns such as a leaked ``index`` unless the incoming data has it."""
    out = target.unionByName(incoming, allowMissingColumns=True)
    drop = [c for c in stray if c in out.columns and c not in incoming.columns]
    return out.drop(*drop)


_INTS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
_INT_DIGITS = {"byte": 3, "short": 5, "integer": 10, "long": 20}
_DOUBLE_DIGITS = {"byte", "short", "integer"}  # whole numbers that a double holds exactly


def _rank(dtype: T.DataType) -> str:
    """The chain a type stands on: void, int, decimal, double, date, text, or other."""
    if isinstance(dtype, T.NullType):
        return "void"
    if dtype in _INTS:
        return "int"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return "date"
    return "text" if isinstance(dtype, T.StringType) else "other"


def least_upper_type(a: T.DataType, b: T.DataType) -> tuple[T.DataType, bool]:
    """The narrowest type above both, and whether it keeps every value of both.

    void below all; whole numbers by width, below decimals, below double;
    dates below UTC timestamps; text above everything. Decimals that need more
    than 38 digits, and numbers that a double cannot hold exactly, become the
    next type up and are told as not kept (double) or kept (text).
    """
    if a == b:
        return a, True
    ra, rb = _rank(a), _rank(b)
    if "void" in (ra, rb):
        return (b, True) if ra == "void" else (a, True)
    ranks = {ra, rb}
    if ranks == {"int"}:
        return max(a, b, key=_INTS.index), True
    if ranks <= {"int", "decimal"}:
        wide = [t if isinstance(t, T.DecimalType) else T.DecimalType(_INT_DIGITS[t.typeName()], 0) for t in (a, b)]
        scale, whole = max(t.scale for t in wide), max(t.precision - t.scale for t in wide)
        return (T.DecimalType(scale + whole, scale), True) if scale + whole <= 38 else (T.StringType(), True)
    if ranks <= {"int", "decimal", "double"}:
        rest = [t for t in (a, b) if _rank(t) != "double"]
        return T.DoubleType(), all(t.typeName() in _DOUBLE_DIGITS for t in rest)
    if ranks == {"date"}:
        return T.TimestampNTZType(), True
    return T.StringType(), "other" not in ranks


def reconcile_schemas(stored: T.StructType, incoming: T.StructType) -> list[tuple[str, str | None, str | None, T.DataType, str]]:
    """Q7/Q1: (column, stored type, incoming type, common type, verdict) for each column of either side.

    Verdicts: ``same``, ``added`` (incoming only), ``absent`` (stored only),
    ``widened`` (values kept), ``lossy`` (a double cannot hold all values),
    ``text`` (only text holds both). Names are matched as they are.
    """
    old, new = ({f.name: f.dataType for f in s.fields} for s in (stored, incoming))
    out = []
    for name in [*old, *(n for n in new if n not in old)]:
        a, b = old.get(name), new.get(name)
        if a is None or b is None:
            common, verdict = (b, "added") if a is None else (a, "absent")
        else:
            common, kept = least_upper_type(a, b)
            verdict = "same" if a == b else "text" if isinstance(common, T.StringType) else "widened" if kept else "lossy"
        out.append((name, a and a.simpleString(), b and b.simpleString(), common, verdict))
    return out


def reconciled_union(stored: DataFrame, incoming: DataFrame, stray: Sequence[str] = ("index",)) -> tuple[DataFrame, DataFrame]:
    """Q7: both sides' rows under one schema, and a report of what was done to each column.

    Columns that one side lacks are NULL there; columns of different types
    meet at their least upper type (``reconcile_schemas``). Stray columns as
    in ``evolve_schema``. The report has column_name, stored_type,
    incoming_type, common_type and verdict; nothing is read for it.
    """
    plan = [p for p in reconcile_schemas(stored.schema, incoming.schema) if p[0] not in stray or p[0] in incoming.columns]

    def side(df: DataFrame, at: int) -> DataFrame:
        return df.select(*[(F.col(f"`{p[0]}`") if p[at] is not None else F.lit(None)).cast(p[3]).alias(p[0]) for p in plan])

    report = stored.sparkSession.createDataFrame(
        [(name, a, b, common.simpleString(), verdict) for name, a, b, common, verdict in plan],
        "column_name string, stored_type string, incoming_type string, common_type string, verdict string",
    )
    return side(stored, 1).unionByName(side(incoming, 2)), report
