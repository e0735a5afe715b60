"""A training corpus from raw documents: quality, toxicity, near duplicates, personal data, packing.

STAGES lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Null texts pass the stages as empty
texts do. Filters fit on the labels of ``sf_dir``; without labels that tell classes apart they keep everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import neardup, packing, pii, quality, toxicity
from lexigraph.llm.common import durable, read_table, release, unused
from lexigraph.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels").where(~quality.is_held_out()))
    score = unused("quality", *docs.columns)
    return quality.scored_texts(docs, model, score).where(F.col(score) >= quality.KEEP_FROM).select(docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity chain rejects."""
    chain = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    prefix = "p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return toxicity.scored(docs, chain, prefix).where(F.col(f"{prefix}toxic") < toxicity.TOXIC_FROM).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return neardup.representatives(docs)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars follows."""
    masked = pii.redacted(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens into sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("near duplicates", keep_one_of_each),
    ("personal data", mask_personal),
    ("packing", pack_tokens),
]

#: SQL can express neither the trained stages nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
