"""Decimal texts of doubles in the form of Python's ``repr``.

A table that was filled by the original importer holds hashes over such texts
(``1e-05``, ``0.0005``, ``1e+16``, ``-0.0``). To find the same hashes again a
column needs the shortest decimal that reads back as the same double, and
Python's layout of it. The digits come from Jackson's double writer, which is
part of every Spark distribution and always gives the shortest and closest
decimal (``Double.toString`` of Java before 19 does not); the layout is column
arithmetic on its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal exponents that Python writes without an ``e``.
FIXED_FROM, FIXED_UPTO = -4, 15
#: Sizes of numbers that Java writes without an ``E``, from one up to below the other.
JAVA_FIXED_FROM, JAVA_FIXED_BELOW = 1e-3, 1e7


def shortest_text(x: Column) -> Column:
    """The shortest decimal of a double in Java's layout, such as ``-1.0E-5``; NULL stays NULL."""
    writer = F.reflect(F.lit("com.fasterxml.jackson.core.io.NumberOutput"), F.lit("toString"), x, F.lit(True))
    return F.when(x.isNotNull(), writer)


def _digits(s: Column) -> tuple[Column, Column]:
    """All digits of a Java text without sign, and the decimal point's place in them."""
    body = F.ltrim(s, F.lit("-"))
    number = F.substring_index(body, "E", 1)
    whole = F.substring_index(number, ".", 1)
    shift = F.when(F.contains(body, F.lit("E")), F.substring_index(body, "E", -1).try_cast("int")).otherwise(F.lit(0))
    return F.concat(whole, F.substring_index(number, ".", -1)), F.length(whole) + shift


def _layout(s: Column, digits: Column, point: Column) -> Column:
    """Python's layout of significant digits with the point after ``point`` of them."""
    n = F.length(digits)
    fixed = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(n <= point, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )
    exponent = F.abs(point - 1).cast("string")
    short = F.concat(
        F.substring(digits, 1, 1),
        F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")),
        F.when(point < 1, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(exponent) < 2, F.concat(F.lit("0"), exponent)).otherwise(exponent),
    )
    sign = F.when(F.startswith(s, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(s == "NaN", F.lit("nan"))
        .when(s == "Infinity", F.lit("inf"))
        .when(s == "-Infinity", F.lit("-inf"))
        .when(n == 0, F.concat(sign, F.lit("0.0")))
        .otherwise(F.concat(sign, F.when((point - 1).between(FIXED_FROM, FIXED_UPTO), fixed).otherwise(short)))
    )


def _relaid(s: Column) -> Column:
    """Python's form of a Java text; steps are lambdas, so that each is named once in the next."""

    def named(step, *values: Column) -> Column:
        fields = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
        return F.get(F.transform(F.array(fields), lambda x: step(*[x[f"v{i}"] for i in range(len(values))])), 0)

    def stripped(s: Column, digits: Column, point: Column) -> Column:
        lead = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
        return named(_layout, s, F.btrim(digits, F.lit("0")), point - lead)

    return named(lambda s: named(stripped, s, *_digits(s)), s)


def python_text(x: Column) -> Column:
    """Python's text of a double (pass an attribute): ``nan``, ``inf`` and ``-inf`` as
    there; a negative zero is ``-0.0``; NULL stays NULL.

    Java and Python lay out zeros and numbers from 0.001 up to ten million alike,
    so only the texts of others are taken apart.
    """
    size = F.abs(x)
    alike = (size < JAVA_FIXED_BELOW) & ((size >= JAVA_FIXED_FROM) | (x == 0))
    return F.when(alike, shortest_text(x)).otherwise(_relaid(shortest_text(x)))


def with_python_texts(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with the Python text of each double column under a new name."""
    return df.withColumns({to: python_text(F.col(c)) for c, to in names.items()})
