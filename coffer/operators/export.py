"""Report and table exports.

Writers are distributed: every table is written by its own tasks as a
directory of part files (no ``coalesce(1)``, nothing through the driver).
Output names are made file-safe and unique at plan time (B18); there are as
many names as tables, a handful.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from coffer.functions.names import safe_base, unique_names

REPORT_COLUMNS = ["symbol", "qty", "investi", "price_eur", "valeur_actuelle", "pnl"]


def write_report_csv(report: DataFrame, path: str) -> str:
    """The holdings report as CSV with a header (no ``pnl_pct``)."""
    report.select(*REPORT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    return path


def select_tables(tables: Mapping[str, DataFrame], names: Iterable[str] | None) -> list[str]:
    """Exact-name selection in the source order; error when none match."""
    available = list(tables)
    if not names:
        return available
    wanted = set(names)
    chosen = [t for t in available if t in wanted]
    if not chosen:
        raise ValueError(f"none of the requested tables exist: requested={sorted(wanted)}, available={available}")
    return chosen


def export_tables(
    tables: Mapping[str, DataFrame],
    outdir: str,
    names: Iterable[str] | None = None,
    export_json: bool = False,
) -> list[str]:
    """I8: write each selected table as ``<safe name>.csv`` (header) and,
    optionally, ``<safe name>.json`` (one record per line, ISO dates).

    Returns the output paths in write order.
    """
    chosen = select_tables(tables, names)
    bases = unique_names([safe_base(n) for n in chosen])
    out = []
    for name, base in zip(chosen, bases):
        df = tables[name]
        p = f"{outdir.rstrip('/')}/{base}.csv"
        df.write.mode("overwrite").option("header", True).csv(p)
        out.append(p)
        if export_json:
            pj = f"{outdir.rstrip('/')}/{base}.json"
            (
                df.write.mode("overwrite")
                .option("dateFormat", "yyyy-MM-dd")
                .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS")
                .option("ignoreNullFields", False)
                .json(pj)
            )
            out.append(pj)
    return out
