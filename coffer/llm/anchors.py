"""Spans as text and digests, shared by the span-finding operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import tidied

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def span_report(docs: DataFrame, find: Callable, base: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256, spans, and n_<kind> of the rest.

    ``find()`` runs once per task and gives the function from text to spans.
    """
    extra = [k for k in kinds if k not in base]

    @tidied
    def run(batches):
        spans_of = find()
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in kinds}
            digests, texts = [], []
            for text in b.column("text").to_pylist():
                spans = spans_of(text or "")
                for k in kinds:
                    counts[k].append(sum(s[0] == k for s in spans))
                first = joined([s for s in spans if s[0] in base], base)
                digests.append(hashlib.sha256(first.encode()).hexdigest())
                texts.append(joined(spans, kinds))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    *(pa.array(counts[k], pa.int64()) for k in base),
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.string()),
                    *(pa.array(counts[k], pa.int64()) for k in extra),
                ],
                ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans", *(f"n_{k}" for k in extra)],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(
        [f"doc_id {kind}", *(f"n_{k} long" for k in base), "base_sha256 string, spans string", *(f"n_{k} long" for k in extra)]
    )
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def masked(docs: DataFrame, find: Callable) -> DataFrame:
    """``docs``, columns unchanged, with each span's text replaced by ``<KIND>``.

    Overlapping spans become one, named after the first.
    """

    @tidied
    def run(batches):
        spans_of = find()
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                spans = sorted((s, e, k) for k, s, e in spans_of(text)) if text else []
                if spans:
                    parts, done = [], 0
                    for s, e, k in spans:
                        if s >= done:
                            parts += [text[done:s], f"<{k.upper()}>"]
                        done = max(done, e)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            k = b.schema.get_field_index("text")
            yield b.set_column(k, b.schema.field(k), pa.array(out, b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
