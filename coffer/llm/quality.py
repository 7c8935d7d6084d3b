"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in column expression and every rule a row of
``RULES``; there is no user function and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import SPACES, WORD

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it was on as with be by at this "
    "der die das und ist von den mit zu nicht ein eine "
    "le la les de des et un une est que qui pour dans "
    "el los las y en del se por con para"
).split()


@dataclass(frozen=True)
class Rule:
    """``least <= numerator / denominator <= most`` (either bound may be absent)."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("words", "n_words", "one", least=50),
    Rule("repeated_words", "n_repeat_words", "n_words", most=0.5),
    Rule("word_length", "word_chars", "n_words", least=2, most=20),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.6),
)
#: The rules that the base verdict consists of.
BASE_RULES = ("words", "repeated_words")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _failed(rule: Rule, prefix: str) -> Column:
    """Ratios are compared as products, so no division by zero and no rounding."""
    num = F.col(prefix + rule.numerator) * 100
    den = F.lit(1) if rule.denominator == "one" else F.col(prefix + rule.denominator)
    bad = F.lit(False)
    if rule.least is not None:
        bad = bad | (num < den * round(100 * rule.least))
    if rule.most is not None:
        bad = bad | (num > den * round(100 * rule.most))
    return bad


def with_measures(docs: DataFrame, prefix: str, text: str = "text") -> DataFrame:
    """``docs`` with the measures as extra columns named ``prefix + measure``."""
    p = prefix

    def without(chars: str) -> Column:
        return F.length(F.translate(F.col(p + "text"), chars, ""))

    out = docs.withColumn(p + "text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns(
        {
            p + "words": F.regexp_extract_all(F.col(p + "text"), F.lit(WORD), F.lit(0)),
            p + "lines": F.filter(
                F.split(F.col(p + "text"), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0
            ),
            p + "n_chars": F.length(F.col(p + "text")),
            p + "word_chars": without(SPACES).cast("long"),
            p + "no_symbols": without(SYMBOLS),
        }
    )
    words = F.col(p + "words")
    # each 3-word window with its place, in the order of its words
    out = out.withColumn(
        p + "windows",
        F.sort_array(
            F.transform(
                F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
                lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
            )
        ),
    )
    windows = F.col(p + "windows")
    again = F.filter(
        windows,
        lambda x, i: F.get(windows, i - 1)["w"].eqNullSafe(x["w"]) | F.get(windows, i + 1)["w"].eqNullSafe(x["w"]),
    )
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    stops = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    return out.withColumns(
        {
            p + "n_words": F.size(words).cast("long"),
            p + "n_symbols": (F.col(p + "n_chars") - F.col(p + "no_symbols")).cast("long"),
            p + "n_lines": F.size(p + "lines").cast("long"),
            p + "n_dup_lines": (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("long"),
            p + "n_repeat_words": F.size(covered).cast("long"),
            p + "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stops))).cast("long"),
        }
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the five measures, base_failed, kept and the failed rules' names.

    One row per input row, repeated rows included. A null text has no words
    and no lines, so it fails like an empty one. Other columns are ignored.
    """
    p = "__q_"
    m = with_measures(docs.select("doc_id", "text"), p)
    base = F.lit(False)
    for r in RULES:
        if r.name in BASE_RULES:
            base = base | _failed(r, p)
    failed = F.filter(
        F.array(*[F.when(_failed(r, p), F.lit(r.name)) for r in RULES]), lambda x: x.isNotNull()
    )
    return m.select(
        "doc_id",
        *[F.col(p + c).alias(c) for c in MEASURES],
        base.alias("base_failed"),
        (F.size(failed) == 0).alias("kept"),
        F.concat_ws(",", failed).alias("failed_rules"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that pass every rule."""
    p = "__q_"
    bad = F.lit(False)
    for r in RULES:
        bad = bad | _failed(r, p)
    # a filter on a generated column stays above the projections; pushed below
    # them it would repeat their expressions at each use
    cols = [F.col(f"`{c}`") for c in docs.columns]
    judged = with_measures(docs, p).select(*cols, F.explode(F.array(~bad)).alias(p + "kept"))
    return judged.filter(F.col(p + "kept")).select(*cols)


def oracle_sql() -> str:
    """The same result as DuckDB SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))

    def failed(r: Rule) -> str:
        den = "1" if r.denominator == "one" else r.denominator
        parts = []
        if r.least is not None:
            parts.append(f"100 * {r.numerator} < {round(100 * r.least)} * {den}")
        if r.most is not None:
            parts.append(f"100 * {r.numerator} > {round(100 * r.most)} * {den}")
        return "(" + " OR ".join(parts) + ")"

    spaces = r"'[\x20\x09-\x0D]+'"
    base = " OR ".join(failed(r) for r in RULES if r.name in BASE_RULES)
    every = " OR ".join(failed(r) for r in RULES)
    names = ", ".join(f"CASE WHEN {failed(r)} THEN '{r.name}' END" for r in RULES)
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
      SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, {spaces}, '', 'g')) > 0) AS ls
      FROM d),
    g AS (
      SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
    r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
    c AS (
      SELECT rid, count(DISTINCT i + k) AS n_repeat_words
      FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid),
    m AS (
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, {spaces}, '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(list_filter(ws, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN c USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      ({base}) AS base_failed, NOT ({every}) AS kept, concat_ws(',', {names}) AS failed_rules
    FROM m"""
