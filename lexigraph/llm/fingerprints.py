"""Document fingerprints by consistent weighted sampling, by DataFrame functions alone.

A text's terms are its words (runs of letters and digits in lower case), weighted by their occurrences. For each of
SAMPLES positions every term draws gamma variates r and c (each the sum of two exponential ones) and a uniform beta from
its hash; with t = floor(ln w / r + beta) the term of least ln c - r (t - beta + 1) is the sample, named by term and t.
Two texts agree in a position with a chance of their generalised Jaccard similarity.

Null texts are empty texts; a text without words has the fingerprint "empty", which is like itself only. Rows that
repeat a doc_id count as one document, with the greatest of their texts. A single document is its own next document.
Rows without a doc_id have no place in the order and get no row. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty
from .splitters import range_of, splitters_of

SAMPLES = 32
ROWS_A_RANGE = 2_000_000
_NAME = (1 << 24) - 1


def sample(term: Column, ln_w: Column, position: int) -> Column:
    """A bigint whose least over the terms is the sample; its low 24 bits name it."""
    h = F.xxhash64(term, F.lit(position))
    g = F.xxhash64(h)
    uniform = lambda x, shift, wide: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << wide) - 1)).cast("double") + F.lit(0.5)) / F.lit(float(1 << wide))
    r = -F.ln(uniform(h, 0, 16) * uniform(h, 16, 16))
    c = -F.ln(uniform(h, 32, 16) * uniform(h, 48, 16))
    t = F.floor(ln_w / r + uniform(g, 0, 24))
    ln_a = F.ln(c) - r * (t - uniform(g, 0, 24) + F.lit(1.0))
    name = F.shiftrightunsigned(g, 24).bitwiseXOR(t * F.lit(2654435)).bitwiseAND(F.lit(_NAME))
    return F.shiftleft(((ln_a + F.lit(128.0)) * F.lit(float(1 << 27))).cast("bigint"), 24).bitwiseOR(name)


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and samples array<bigint> for every text that has a word; keys must be unique.

    Where ``texts`` is already partitioned by some of the keys, no row is shuffled.
    """
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")
    terms = texts.select(*keys, words).where("word <> ''").select(*keys, F.xxhash64("word").alias("term"))
    counted = terms.groupBy(*keys, "term").agg(F.count("*").alias("n")).select(*keys, "term", F.ln(F.col("n").cast("double")).alias("ln_w"))
    least = [F.min(sample(F.col("term"), F.col("ln_w"), k)).alias(f"s{k}") for k in range(samples)]
    return counted.groupBy(*keys).agg(*least).select(*keys, F.array(*(F.col(f"s{k}").bitwiseAND(F.lit(_NAME)) for k in range(samples))).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal positions; null arrays (no words) are like each other only."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def spelled(samples: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), ""), F.lit("empty"))


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id) in ascending order; the greatest doc_id is followed by the least."""
    ids = durable(docs.select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("key"), F.lit(0).cast("bigint").alias("tie")), "ids")
    there = ids.count()
    found = splitters_of(ids, F.lit(1), max(64, there // ROWS_A_RANGE)) if there else []
    ranged = ids.withColumn("range", range_of(F.col("key"), F.col("tie"), found))
    # One row a range
    firsts = ranged.groupBy("range").agg(F.min("doc_id").alias("first")).orderBy("range").collect()
    after = [(a["range"], b["first"]) for a, b in zip(firsts, firsts[1:] + firsts[:1])]
    bases = docs.sparkSession.createDataFrame(after, "range int, after bigint")
    order = Window.partitionBy("range").orderBy("doc_id")
    lead = ranged.withColumn("following", F.lead("doc_id").over(order))
    return lead.join(F.broadcast(bases), "range").select("doc_id", F.coalesce("following", "after").alias("next_id"))


def edited_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, next_id, samples, edited_samples for every doc_id."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).where("doc_id IS NOT NULL")
    links = durable(successors(docs), "links")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").desc())
    one = docs.withColumn("turn", F.row_number().over(order)).where("turn = 1").select("doc_id", "text")
    halves = one.select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("half"))
    wanted = links.join(halves, "doc_id").select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), "half")
    heads = one.join(wanted, "doc_id").select(F.col("for_id").alias("doc_id"), F.expr("left(text, half)").alias("head"))
    kept = F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))")
    both = one.join(heads, "doc_id").select("doc_id", "text", F.concat(kept, F.col("head")).alias("edited"))
    told = both.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    variants = both.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x")).select("doc_id", F.col("x.v").alias("variant"), F.col("x.t").alias("text"))
    signed = fingerprints(variants, ["doc_id", "variant"])
    by_doc = signed.groupBy("doc_id").agg(*(F.first(F.when(F.col("variant") == v, F.col("samples")), ignorenulls=True).alias(n) for v, n in ((0, "samples"), (1, "edited_samples"))))
    return durable(told.join(by_doc, "doc_id", "left").join(links, "doc_id"), "signed")
