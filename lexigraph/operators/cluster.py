"""Text clustering: Lloyd's k-means over sparse long vectors, summaries, assignment of unseen texts.

Points and centroids stay in long form (id, term, weight). A distance is |x|² + |c|² - 2 x·c, so only terms that a
point and a centroid share meet in a join; the centroids that share none with a point are told from one row that lists
their norms, so there is one row a point and no row a point and centroid. Centroids are broadcast while their rows and bytes are few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.session import cut, release

from .index import build, damped, term_frequencies
from .search import small

# Defaults of a fit and of a summary.
CLUSTERS, RANDOM_STATE, MAX_ITER, TOP_TERMS = 3, 42, 100, 8
#: Centroid entries up to which centroids are broadcast; distances are compared at this many digits.
BROADCAST_CENTROIDS, DIGITS = 2_000_000, 9


def seeds(n: int, k: int, random_state: int) -> list[int]:
    """Row numbers of the first centroids."""
    return [int(i) for i in np.random.default_rng(random_state).choice(n, size=k, replace=False)]


def square_norms(points: DataFrame, by: str) -> DataFrame:
    return points.groupBy(by).agg(F.sum(F.col("weight") * F.col("weight")).alias("square"))


def assign(ids: DataFrame, points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(id, cluster, distance): the nearest centroid of each id, ties to the lowest; an id without terms is the zero vector.

    ``centroids`` has cluster, term, weight; a cluster without rows is the zero vector.
    """
    spark = ids.sparkSession
    held = small(centroids.select("cluster", "term", F.col("weight").alias("centre")), BROADCAST_CENTROIDS)
    norms = square_norms(centroids, "cluster").withColumnRenamed("square", "c2")
    # k rows, and one row that lists them by norm
    every = spark.range(k).select(F.col("id").cast("int").alias("cluster")).join(norms, "cluster", "left").fillna(0.0, "c2")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("c2", "cluster"))).alias("by_norm"))
    dots = points.join(held, "term").groupBy("id", F.col("cluster").cast("int").alias("cluster")).agg(F.sum(F.col("weight") * F.col("centre")).alias("dot"))
    met = dots.join(F.broadcast(every), "cluster").groupBy("id").agg(F.collect_list(F.struct("cluster", (F.col("c2") - 2 * F.col("dot")).alias("part"))).alias("met"))
    own = ids.select("id").join(square_norms(points, "id").withColumnRenamed("square", "x2"), "id", "left").fillna(0.0, "x2")
    whole = own.join(met, "id", "left").crossJoin(F.broadcast(listed))
    square = lambda part: F.round(F.sqrt(F.greatest(F.col("x2") + part, F.lit(0.0))), DIGITS)
    none = F.coalesce("met", F.array().cast("array<struct<cluster:int,part:double>>"))
    # At most k entries an id, in one row
    others = F.filter("by_norm", lambda c: ~F.array_contains(F.transform(none, lambda m: m["cluster"]), c["cluster"]))
    entries = F.concat(F.transform(none, lambda m: F.struct(square(m["part"]).alias("distance"), m["cluster"].alias("cluster"))), F.transform(others, lambda c: F.struct(square(c["c2"]).alias("distance"), c["cluster"].alias("cluster"))))
    return whole.select("id", F.array_min(entries).alias("near")).select("id", "near.cluster", "near.distance")


def update(points: DataFrame, labels: DataFrame, centroids: DataFrame) -> DataFrame:
    """Means over all members, zeros included; a cluster without members keeps its centroid."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("members"))
    sums = points.join(labels.select("id", "cluster"), "id").groupBy("cluster", "term").agg(F.sum("weight").alias("total"))
    means = sums.join(F.broadcast(sizes), "cluster").select("cluster", "term", (F.col("total") / F.col("members")).alias("weight"))
    return means.unionByName(centroids.join(F.broadcast(sizes.select("cluster")), "cluster", "left_anti").select("cluster", "term", "weight"))


@dataclass
class Model:
    labels: DataFrame
    centroids: DataFrame
    iterations: int
    clusters: int
    idf: DataFrame | None = None
    summaries: DataFrame | None = None


def fit_kmeans(ids: DataFrame, points: DataFrame, k: int = CLUSTERS, random_state: int = RANDOM_STATE, max_iter: int = MAX_ITER, first: list[int] | None = None) -> Model:
    """``ids`` has id and ordinal (0 to n - 1, which seeds refer to); ``points`` has id, term, weight.

    Stops when no label changes; the pass that shows it counts. ``first`` gives the ordinals to begin with instead of drawn
    ones; one that no id has begins as the zero vector.
    """
    if k <= 0:
        raise ValueError("the number of clusters must be positive")
    n = ids.count()
    if k > n:
        raise ValueError("more clusters than documents")
    points = cut(points.select("id", "term", "weight"))
    begin = ids.sparkSession.createDataFrame([(row, c) for c, row in enumerate(first or seeds(n, k, random_state))], "ordinal bigint, cluster int")
    centroids = cut(points.join(ids.join(F.broadcast(begin), "ordinal").select("id", "cluster"), "id").select("cluster", "term", "weight"))
    labels = None
    for iteration in range(1, max_iter + 1):
        new = cut(assign(ids, points, centroids, k))
        before, centroids = centroids, cut(update(points, new, centroids))
        release(before)
        if labels is not None and new.join(labels.select("id", F.col("cluster").alias("before")), "id").where("cluster <> before").isEmpty():
            return Model(new, centroids, iteration, k)
        if labels is not None:
            release(labels)
        labels = new
    return Model(labels, centroids, max_iter, k)


def top_terms(centroids: DataFrame, limit: int = TOP_TERMS) -> DataFrame:
    """(cluster, term, weight, rank): the heaviest terms of each centroid, ties in order of the term."""
    order = Window.partitionBy("cluster").orderBy(F.round("weight", DIGITS).desc(), "term")
    return centroids.where("weight > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def summaries(ids: DataFrame, labels: DataFrame, centroids: DataFrame, k: int, limit: int = TOP_TERMS) -> DataFrame:
    """cluster, documents, majority_category, category_counts, top_terms for each cluster; ``ids`` has id, ordinal, category."""
    counts = labels.join(ids, "id").groupBy("cluster", "category").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    by = counts.groupBy("cluster").agg(
        F.sum("n").alias("documents"), F.max_by("category", F.struct("n", -F.col("first"))).alias("majority_category"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"),
    )
    best = top_terms(centroids, limit).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("top"))
    every = ids.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    out = every.join(by, "cluster", "left").join(best, "cluster", "left")
    return out.select("cluster", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("majority_category", F.lit("Unknown")).alias("majority_category"), F.coalesce("category_counts", F.create_map().cast("map<string,bigint>")).alias("category_counts"), F.coalesce(F.transform("top", lambda t: t["term"]), F.array().cast("array<string>")).alias("top_terms"))


def fit_texts(docs: DataFrame, k: int = CLUSTERS, random_state: int = RANDOM_STATE, max_iter: int = MAX_ITER, first: list[int] | None = None) -> Model:
    """``docs`` has id, ordinal, category, text; a document without terms is a zero row."""
    index = build(docs, "id", F.col("text"))
    model = fit_kmeans(docs.select("id", "ordinal"), index.weights, k, random_state, max_iter, first)
    model.idf = cut(index.idf)
    model.summaries = summaries(docs.select("id", "ordinal", "category"), model.labels, model.centroids, k)
    return model


def vectorised(texts: DataFrame, idf: DataFrame, text: Column) -> DataFrame:
    """(id, term, weight) of unit length over the model's vocabulary."""
    tf = term_frequencies(texts, "id", text)
    raw = tf.join(idf.select("term", "idf"), "term").select("id", "term", (damped(F.col("tf")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("raw") / norm).alias("weight"))


def predict(texts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """id, cluster, majority_category, distance, top_terms; a text without known terms has no cluster and is Unknown."""
    points = cut(vectorised(texts, model.idf, F.col(text)))  # read three times
    known = points.select("id").distinct()
    near = assign(known, points, model.centroids, model.clusters)
    out = texts.select("id").join(near, "id", "left").join(model.summaries.select("cluster", "majority_category", "top_terms"), "cluster", "left")
    return out.select("id", "cluster", F.coalesce("majority_category", F.lit("Unknown")).alias("majority_category"), "distance", F.coalesce("top_terms", F.array().cast("array<string>")).alias("top_terms"))
