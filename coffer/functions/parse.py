"""Safe parsing of untyped ledger values.

All parsers are native expressions guarded by character-class checks and
regular expressions, so bad input becomes NULL (or a default) instead of an
ANSI cast error, and the accepted syntax is the one of the system being
replaced rather than Spark's more lenient casts (for example Spark reads
``1.0d`` as a double and rejects ``1_000``; the ledger semantics are the
reverse).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUE — the characters Python's ``str.strip()`` removes
# (``str.isspace``), in code-point order.
PY_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Decimal literal with optional underscores between digits and exponent.
_DIGITS = r"\d(?:_?\d)*"
_FLOAT_RE = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_NUM_CHARS = "0123456789+-.eE"


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace as ``str.strip`` does.

    A character-set trim (no regular expression), which compares every
    character; text that begins and ends with printable ASCII needs none.
    """
    last = F.substring(c, -1, 1)
    bare = (c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(bare, c).otherwise(F.btrim(c, F.lit(PY_WHITESPACE)))


def parse_float(c: Column) -> Column:
    """Float syntax of the ledger (B4): NULL when the text is not a number.

    Accepts surrounding whitespace, sign, underscores between digits,
    exponents, ``nan`` and ``inf``/``infinity`` in any case; rejects what
    Spark's cast alone would also take (``1.0d``, hex floats).

    Fast path: text that begins and ends as a decimal literal is cast
    directly; the character checks only run for what is left, the regular
    expression only for text with underscores.
    """
    return parse_float_text(strip_ws(c.cast(T.StringType())))


def decimal_value(s: Column) -> Column:
    """The double of text that begins and ends as a decimal literal; NULL for all
    other text, numbers among them. White space at the ends keeps text out.

    Of the syntax that the cast alone would take, white space, type letters,
    ``NaN`` and ``Infinity`` show at the ends of the text, hex floats by their
    first characters: text from ``0X`` up to ``1`` is left out, signed or not.
    """
    ends = (s >= "+") & (s < ":") & F.substring(s, -1, 1).isin(*"0123456789")
    for sign in ("", "-", "+"):
        ends = ends & ~((s >= f"{sign}0X") & (s < f"{sign}1"))
    return F.when(ends, s.try_cast(T.DoubleType()))


def checked_value(s: Column) -> Column:
    """The number in stripped text by character checks, for what ``decimal_value`` leaves."""
    only_num = (F.length(s) > 0) & (F.translate(s, _NUM_CHARS, "") == "")
    with_us = (F.length(s) > 0) & (F.translate(s, _NUM_CHARS + "_", "") == "")
    low = F.lower(s)
    return (
        F.when(only_num, s.try_cast(T.DoubleType()))
        .when(with_us & s.rlike(_FLOAT_RE), F.replace(s, F.lit("_"), F.lit("")).cast(T.DoubleType()))
        .when(low.isin("nan", "+nan", "-nan"), F.lit(float("nan")))
        .when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
        .when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
    )


def parse_float_text(s: Column) -> Column:
    """``parse_float`` of text that is already stripped (pass an attribute:
    the text is referenced by several branches and is not re-derived)."""
    return F.coalesce(decimal_value(s), checked_value(s))


def to_float(c: Column | None, default: float = 0.0) -> Column:
    """``to_float(x, default)``: parsed float, ``default`` when missing or bad."""
    if c is None:
        return F.lit(default).cast(T.DoubleType())
    return F.coalesce(parse_float(c), F.lit(default).cast(T.DoubleType()))


def scrub_number(c: Column, dtype: T.DataType, keep_null: bool = False) -> Column:
    """Numeric scrub of a mixed column (B13): strip, coerce, NULL/bad -> 0.

    ``dtype`` is the column's current type; numeric columns only get the
    NULL -> 0 step. With ``keep_null`` the unparseable values stay NULL.
    """
    if isinstance(dtype, T.StringType):
        v = parse_float(c)
    else:
        v = c.cast(T.DoubleType())
    return v if keep_null else F.coalesce(v, F.lit(0.0))


def try_date(c: Column) -> Column:
    """Sheet date (B19): any date/time-like value to DATE, invalid -> NULL."""
    return F.coalesce(
        c.try_cast(T.DateType()),
        F.to_date(c.try_cast(T.TimestampNTZType())),
    )


# --- B5 date ladder ---------------------------------------------------------
# Each fixed format of the ledger is a regular expression whose groups are
# rewritten into one canonical, space-separated form
#     "year month day hour minute second fraction sign off_hours off_minutes"
# (empty fields allowed). Digit widths are the ones the format accepts (one
# or two digits for every field but the year); the calendar check is done by
# ``try_make_timestamp_ntz``. Formats are mutually exclusive patterns, so a
# CASE picks the first that matches, as the ordered ladder does.
_Y = r"(\d{4})"
_N2 = r"(\d{1,2})"
_WS = r"(?U)\s+"
_FORMAT_RES = [
    # %Y-%m-%dT%H:%M:%S
    (rf"(?i)^{_Y}-{_N2}-{_N2}T{_N2}:{_N2}:{_N2}$", "$1 $2 $3 $4 $5 $6    "),
    # %Y-%m-%d %H:%M:%S
    (rf"^{_Y}-{_N2}-{_N2}{_WS}{_N2}:{_N2}:{_N2}$", "$1 $2 $3 $4 $5 $6    "),
    # %d/%m/%Y %H:%M
    (rf"^{_N2}/{_N2}/{_Y}{_WS}{_N2}:{_N2}$", "$3 $2 $1 $4 $5 0    "),
    # %d/%m/%Y %H:%M:%S
    (rf"^{_N2}/{_N2}/{_Y}{_WS}{_N2}:{_N2}:{_N2}$", "$3 $2 $1 $4 $5 $6    "),
]

# ISO-8601 fallback: extended or basic date (week dates have become calendar
# dates before), optional time with fraction, optional UTC offset (only after a time).
_ISO_RE = (
    r"^(\d{4})-?(\d{2})-?(\d{2})"
    r"(?:[Tt ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:([+-])(\d{2})(?::?(\d{2}))?)?)?$"
)
_ISO_OUT = "$1 $2 $3 $4 $5 $6 $7 $8 $9 $10"


# Week dates (extended or basic, day optional), before an optional time.
_WEEK_RE = r"^(\d{4})(-?)W(\d{2})(?:\2(\d))?(|[Tt ].*)$"


def week_to_calendar(s: Column) -> Column:
    """A text that starts with an ISO week date (``2025-W38-7``, ``2025W387``,
    ``2025-W38``) with the calendar date in its place; NULL if it is none.

    Week 1 is the one with 4 January; a missing day is Monday; week 53 only in
    years that have it.
    """
    parts = F.split(F.when(s.rlike(_WEEK_RE), F.regexp_replace(s, _WEEK_RE, "$1|$3|$4|$5")), "[|]", 4)

    def calendar(p: Column) -> Column:
        year, week = p[0].cast("int"), p[1].cast("int")
        day = F.when(p[2] == "", F.lit(1)).otherwise(p[2].cast("int"))
        fourth = F.try_make_timestamp_ntz(year, F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).cast("date")
        monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7)
        ok = (year >= 1) & (week >= 1) & (day >= 1) & (day <= 7) & (F.weekofyear(F.date_add(monday, 3)) == week)
        return F.when(ok, F.concat(F.date_add(monday, day - 1).cast("string"), p[3]))

    # as a lambda of the split fields, so that they are named once in the generated code
    return F.get(F.transform(F.array(parts), calendar), 0)


def ledger_datetime_fields(c: Column) -> Column:
    """The canonical field array of a ledger date text (NULL if no format
    matches). Every ``Z`` is removed first (upper case only).

    The text's shape picks the candidates (slash formats or dash formats),
    so a row runs at most three pattern matches, usually one.
    """
    return ledger_datetime_fields_text(ledger_date_text(c))


def ledger_date_text(c: Column) -> Column:
    """Stripped date text with every upper-case ``Z`` removed, week dates as calendar dates."""
    s = F.replace(strip_ws(c.cast(T.StringType())), F.lit("Z"), F.lit(""))
    return F.when(F.substring(s, 5, 2).isin("W0", "W1", "W2", "W3", "W4", "W5", "-W"), week_to_calendar(s)).otherwise(s)


# Texts of the usual shapes: calendar dates of full width, in the two orders.
_PLAIN_YMD_RE = r"^(?!0000)\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z*)?\z"
_PLAIN_DMY_RE = r"^\d{2}/\d{2}/(?!0000)\d{4} \d{2}:\d{2}(?::\d{2})?\z"


def plain_datetime_text(s: Column) -> Column:
    """A ledger date text of one of the usual shapes as ``yyyy-MM-dd HH:mm:ss[.f]``
    (or with a ``T``), which a cast to TIMESTAMP_NTZ reads as the date ladder would;
    NULL for all others. These shapes have no white space and no ``Z`` but after
    the time, so the text need not have passed through ``ledger_date_text``.

    These shapes fix every field's width, so the cast, which has no regular
    expressions and checks the calendar, has no room for its laxer syntax.
    """
    ymd = F.concat(F.substring(s, 7, 4), F.lit("-"), F.substring(s, 4, 2), F.lit("-"), F.substring(s, 1, 2))
    hms = F.when(F.length(s) == 16, F.concat(F.substring(s, 11, 6), F.lit(":00"))).otherwise(F.substring(s, 11, 9))
    dated = F.when(s.rlike(_PLAIN_YMD_RE), F.when(F.length(s) == 10, F.concat(s, F.lit(" 00:00:00"))).otherwise(F.rtrim(s, F.lit("Z"))))
    return F.when(F.contains(s, F.lit("/")), F.when(s.rlike(_PLAIN_DMY_RE), F.concat(ymd, hms))).otherwise(dated)


def ledger_datetime_fields_text(s: Column) -> Column:
    """``ledger_datetime_fields`` of text already passed through
    ``ledger_date_text`` (pass an attribute)."""
    slash = [(p, o) for p, o in _FORMAT_RES if "/" in p]
    # Dash-shaped text tries the ISO pattern first: whenever one of the two
    # dash formats also matches, both yield the same fields (no fraction, no
    # offset), so the order does not change results; it saves pattern runs
    # on the common ISO-shaped exports.
    dash = [(_ISO_RE, _ISO_OUT)] + [(p, o) for p, o in _FORMAT_RES if "/" not in p]

    def ladder(cands):
        out = None
        for pat, rep in cands:
            out = (F.when if out is None else out.when)(s.rlike(pat), F.regexp_replace(s, pat, rep))
        return out

    canon = F.when(F.contains(s, F.lit("/")), ladder(slash)).otherwise(ladder(dash))
    return F.split(canon, " ")


def datetime_from_fields(parts: Column) -> Column:
    """UTC NTZ instant from ``ledger_datetime_fields``; NULL if not a valid
    calendar time. A UTC offset is subtracted.

    The fields are digit strings or empty (the regexes guarantee it), so a
    plain cast guarded on emptiness is used: ``try_cast`` of an empty string
    is an order of magnitude slower.
    """

    def num(i):
        x = F.element_at(parts, i)
        return F.when(x == "", F.lit(0)).otherwise(x.cast(T.IntegerType()))

    y, mo, d, h, mi, sec = (num(i) for i in range(1, 7))
    frac_txt = F.element_at(parts, 7)
    micros = F.when(frac_txt == "", F.lit(0)).otherwise(
        F.rpad(F.substring(frac_txt, 1, 6), 6, "0").cast(T.IntegerType())
    )
    oh, om = num(9), num(10)
    ok = (y > 0) & (h < 24) & (mi < 60) & (sec < 60) & (oh < 24) & (om < 60)
    local = F.try_make_timestamp_ntz(y, mo, d, h, mi, sec.cast("decimal(8,6)"))
    sign = F.when(F.element_at(parts, 8) == "-", F.lit(-60000000)).otherwise(F.lit(60000000))
    shift = micros.cast("long") - sign.cast("long") * (oh * 60 + om).cast("long")
    return F.when(parts.isNotNull() & ok, F.timestamp_add("MICROSECOND", shift, local))


def parse_ledger_datetime(c: Column) -> Column:
    """``_parse_dt`` (B5) without the clock: UTC NTZ instant, NULL if unparseable.

    Every ``Z`` is removed first (upper case only), then the fixed formats are
    tried in order, then the ISO fallback, whose offset is honoured. Callers
    substitute their ``as_of`` for NULL (the original substituted "now").
    For wide projections compute ``ledger_datetime_fields`` in one select and
    ``datetime_from_fields`` in the next, so the split is evaluated once.
    """
    return datetime_from_fields(ledger_datetime_fields(c))
