"""The corpus pipeline: five stages from raw documents to sampled pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and rereads it as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm import decontamination, minhash, pieces, pii, quality
from coffer.llm.common import documents, saved, ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    ship_package(spark)
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: of those with the smallest doc_id (nulls last) one.

    Rows are judged by their texts, whatever they share a doc_id with; rows
    without words are in no group and all stay.
    """
    ship_package(spark)
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = minhash.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row")
    first = rows.select("__row", order.alias("__order")).join(
        groups.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")), "__row"
    )
    kept = first.groupBy("__group").agg(F.min("__order").alias("__order")).select("__order.__row")
    return rows.join(kept, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go; all others stay as they are."""
    ship_package(spark)
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows where there is such a column."""
    ship_package(spark)
    out = pii.mask_pii(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each text, and whether they decode to it."""
    import public_tokenizers  # only this stage needs a vocabulary

    ship_package(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(docs, model), model)
    return out.withColumn("lossless", F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")).drop("decoded")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]
#: Sampled segmentations are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
