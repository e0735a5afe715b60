"""The registered queries of this subpackage: thin wrappers that derive the contract's columns from each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, neardup, packing, pii, quality, sharding, toxicity, warc
from .common import durable, read_table, removed_at_exit, shared_dir

#: The tokenizer file that the contracts name.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def hex_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = fingerprints.edited_with_next(read_table(spark, sf_dir, "documents"))
    following = signed.select(F.col("doc_id").alias("next_id"), F.col("samples").alias("next_samples"))
    like = lambda b: fingerprints.likeness(F.col("samples"), F.col(b))
    spelled = lambda c: fingerprints.spelled(F.col(c))
    return signed.join(following, "next_id").select("doc_id", "n_chars", "edited_sha256", spelled("samples").alias("fingerprint"), spelled("edited_samples").alias("edited_fingerprint"), like("edited_samples").alias("near_edited"), like("next_samples").alias("near_next"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = durable(quality.described(read_table(spark, sf_dir, "documents")), "stats")
    model = quality.fit(stats, read_table(spark, sf_dir, "labels").where(~quality.is_held_out()), described_before=True)
    scored = quality.score(stats, model)
    return scored.select("doc_id", quality.is_held_out().alias("held_out"), "score", (F.col("score") >= quality.KEEP_FROM).cast("int").alias("predicted"))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, hex_of(listed(of_kind(*pii.BASE))).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` against an archive of them, written as WARC volumes in another order and read back. On the way some
    records, by a hash of page_id, were flipped (1 %), lost (1 %) or written twice (1 %)."""
    ours = warc.records(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    fate = F.pmod(F.xxhash64("record_id"), F.lit(100))
    flipped = F.concat(F.expr("left(record, length(record) - 1)"), F.lit("#"))
    copied = ours.where(fate != 0).withColumn("record", F.when(fate == 1, flipped).otherwise(F.col("record")))
    copied = copied.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(fate == 2, 2).otherwise(1))))
    path = f"{shared_dir(spark)}/lexigraph-warc-{uuid.uuid4().hex}"
    warc.write(copied, path, F.xxhash64("digest"), "copy")
    removed_at_exit(spark, path)
    ours = durable(ours.drop("record"), "ours")
    found = warc.audit(ours, durable(warc.read(spark, path), "theirs"))
    finding = F.when(F.col("changed") > 0, "changed").when(F.col("missing") > 0, "missing").when(F.col("added") > 0, "added").otherwise("intact")
    return ours.withColumn("node", warc.leaf()).join(found.drop("record_id"), "node", "left").select(F.col("record_id").alias("page_id"), "length", "digest", finding.alias("finding"), "file", "offset")


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read_table(spark, sf_dir, "documents"))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    coded = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), hex_of(F.array_join("ids", " ")).alias("ids_sha256"), hex_of(F.col("decoded")).alias("decoded_sha256"))


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", *(f"p_{k}" for k in chain.names), (F.col("p_toxic") >= toxicity.TOXIC_FROM).cast("int").alias("toxic"))


def op10_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = (op1_near_duplicates, op2_weighted_fingerprints, op3_quality_classifier, op4_pii_anchors, op5_merkle_audit, op6_sampled_splitters, op7_bpe_roundtrip, op8_hilbert_packing, op9_toxicity_chain, op10_ivfpq_search)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {}
