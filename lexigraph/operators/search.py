"""Ranked retrieval: query vectors, cosine scores over matching terms, top k, publications of the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import terms

from .index import Index, damped, inverse_frequency, is_small, term_frequencies

#: Query terms up to this many are broadcast, if their bytes allow it; more are joined by shuffle.
BROADCAST_TERMS = 100_000
#: Terms of one query up to which they are put into the scan as a filter.
FILTER_TERMS = 1000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the table is small."""
    return F.broadcast(df) if is_small(df, rows) else df


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return term_frequencies(queries, query_id, F.col(text)).withColumnRenamed("tf", "query_tf")


def query_vectors(queries: DataFrame, idf: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term, weight) of unit length; terms that no document has are left out before the norm.

    There is at most a row for each term asked, so few terms asked make a table to broadcast.
    """
    asked = query_terms(queries, query_id, text)
    few = is_small(asked, BROADCAST_TERMS)
    vectors = weighted(F.broadcast(asked) if few else asked, idf, query_id)
    return F.broadcast(vectors) if few else vectors


def weighted(asked: DataFrame, idf: DataFrame, query_id: str) -> DataFrame:
    raw = idf.join(asked, "term").select(query_id, "term", (damped(F.col("query_tf")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(query_id)))
    return raw.select(query_id, "term", (F.col("raw") / norm).alias("query_weight"))


def scores(vectors: DataFrame, weights: DataFrame, key: str, query_id: str = "query_id") -> DataFrame:
    """(query_id, key, score, matched_terms) of documents that share a term; only their postings are read past the join."""
    hits = weights.join(vectors, "term")
    scored = hits.groupBy(query_id, key).agg(F.sum(F.col("query_weight") * F.col("weight")).alias("score"), F.array_sort(F.collect_set("term")).alias("matched_terms"))
    return scored.where("score > 0")


def ranked(scored: DataFrame, key: str, limit: int, query_id: str = "query_id", digits: int = 9) -> DataFrame:
    """The ``limit`` best of each query, ties to the lesser key; a negative limit leaves that many off the end."""
    order = Window.partitionBy(query_id).orderBy(F.round("score", digits).desc(), key)
    placed = scored.withColumn("rank", F.row_number().over(order))
    if limit >= 0:
        return placed.where(F.col("rank") <= limit)
    return placed.withColumn("of", F.count("*").over(Window.partitionBy(query_id))).where(F.col("rank") <= F.col("of") + limit).drop("of")


def search(index: Index, query: str, limit: int = 10) -> DataFrame:
    """rank, key, score, matched_terms, query_tokens of one query.

    Its terms are known before the scan, so a stored index sorted by term is read only where it holds them.
    """
    spark = index.docs.sparkSession
    tokens = spark.range(1).select(terms(F.lit(query))).first()[0]
    asked = spark.createDataFrame([(0, query)], "query_id int, query string")
    known = sorted(set(tokens))
    if len(known) <= FILTER_TERMS:
        idf, weights = index.idf.where(F.col("term").isin(known)), index.weights_of(known)
        vectors = F.broadcast(weighted(query_terms(asked, "query_id", "query"), idf, "query_id"))
    else:
        weights, vectors = index.weights, query_vectors(asked, index.idf)
    hits = scores(vectors, weights, index.key)
    best = hits.orderBy(F.round("score", 9).desc(), index.key).limit(limit) if limit > 0 else hits
    return ranked(best, index.key, limit).withColumn("query_tokens", F.array(*map(F.lit, tokens)).cast("array<string>")).drop("query_id").orderBy("rank")


def with_publications(hits: DataFrame, publications: DataFrame, key: str = "publication_key") -> DataFrame:
    """The hits' publications; the limit came first, so hits without a publication leave gaps."""
    return publications.join(small(hits, BROADCAST_TERMS), key).orderBy("rank")


__all__ = ["damped", "inverse_frequency", "is_small", "query_terms", "query_vectors", "ranked", "scores", "search", "small", "with_publications"]
