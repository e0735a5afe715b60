"""Approximate nearest neighbours by inner product: inverted lists, product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a sample: about as many lists as the square root of the rows (at most
MOST_LISTS), and SAMPLE_ROWS or LIST_SAMPLE rows a list; every row is assigned to its centroid's list and coded. A query
probes its best lists: within one, asymmetric distance tables rank the codes, and the best RERANK rows (more than are
asked for) are scored on the original vectors in double precision. So is every other row whose code's score still reaches
the k-th best with SPREAD standard deviations of its residual's error added (in few dimensions: the most that error can
add), so neither ties nor groups of near copies are cut. How many lists a query probes is the least number that finds
PROBE_RECALL of the sample's own neighbours, and as many more as hold enough rows. A few rows, the pilots, are always
scored; a row below the k-th best pilot of a query's lists cannot be among the k best found, so it is not sent on, nor is
a list asked whose centroid and radius leave it below that.

Lists are cut into blocks of rows and of queries, so that no task holds a list whole. Rows whose vector is null, empty,
zero, or holds null or non-finite components take no part, nor do those of another length than the commonest (of equally
common ones the greater). Rows that repeat a vec_id count as one, with the least of their vectors. Equal scores go by
vec_id. An empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SAMPLE_ROWS, LIST_SAMPLE, SAMPLE_QUERIES, MOST_LISTS = 20_000, 32, 256, 8192
#: Pilots are at most this many, and one row in so many.
PILOTS, PILOT_SHARE = 8192, 8
SUBSPACES, CODES, STEPS, RERANK, PROBE_RECALL, SPREAD = 16, 256, 8, 32, 0.985, 3.0
#: Rows and queries of a block, queries that are ranked at once, and pairs that are scored at once.
BLOCK_ROWS, BLOCK_QUERIES, STEP_QUERIES, STEP_PAIRS, SEED = 2048, 2048, 256, 100_000, 3


def valid(vectors: DataFrame, dims: int) -> DataFrame:
    return vectors.where(F.size("embedding") == dims)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding array<double> of the rows that take part, once each."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    e = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), e.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0.0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(STEPS):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    dims: int
    coarse: np.ndarray
    books: np.ndarray
    pilots: np.ndarray
    pilot_ids: np.ndarray
    pilot_lists: np.ndarray
    probes: int = 1
    sizes: np.ndarray | None = None
    radii: np.ndarray | None = None

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.books.shape[0] * self.books.shape[2] - self.dims)))

    def code(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        residual = self.padded(x - self.coarse[own])
        wide = self.books.shape[2]
        return np.stack([nearest(residual[:, m * wide : (m + 1) * wide], book) for m, book in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(subspaces, codes, queries): each query's inner product with each codeword."""
        return np.einsum("qmw,mcw->mcq", self.padded(q).reshape(len(q), *self.books.shape[::2]), self.books).astype(np.float32)

    def errors(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """How far each row of a list is from its code."""
        residual = self.padded(x - self.coarse[own]).reshape(len(x), *self.books.shape[::2])
        coded = np.stack([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return np.sqrt(((residual - coded) ** 2).sum((1, 2)))

    def lists(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """Each query's best lists: ``probes`` of them, more until they hold k rows besides the query's own."""
        best = np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")
        enough = (np.cumsum(self.sizes[best], axis=1) > k).argmax(1) + 1
        enough[self.sizes.sum() <= k] = len(self.coarse)
        return [b[: max(self.probes, n)] for b, n in zip(best, enough)]

    def floors(self, q: np.ndarray, ids: np.ndarray, lists: list[np.ndarray], k: int) -> np.ndarray:
        """For each query the k-th best score of the pilots in its lists, its own row apart; -inf if there are fewer."""
        out = np.full(len(q), -np.inf)
        for i, own in enumerate(lists):
            s = (self.pilots @ q[i])[np.isin(self.pilot_lists, own) & (self.pilot_ids != ids[i])]
            if len(s) >= k:
                least = np.partition(s, -k)[-k]
                out[i] = least - 1e-6 * max(1, abs(least))
        return out


    def reachable(self, q: np.ndarray, lists: list[np.ndarray], floors: np.ndarray) -> list[np.ndarray]:
        """The lists without those in which no row can reach the query's floor."""
        most = q @ self.coarse.T + np.sqrt((q**2).sum(1))[:, None] * self.radii * (1 + 1e-9)
        return [own[most[i, own] >= floors[i]] for i, own in enumerate(lists)]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def fit(rows: DataFrame, k: int) -> Index | None:
    """``rows`` as ``usable`` gives them; None if there are none."""
    common = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return None
    dims, there = common
    rows, lists = valid(rows, dims), max(1, min(MOST_LISTS, math.isqrt(there)))
    wanted = max(SAMPLE_ROWS, LIST_SAMPLE * lists)
    if there > wanted:
        rows = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * wanted / there))
    got = rows.toArrow()  # about as many rows as wanted
    ids, x = got["vec_id"].to_numpy(), matrix(got["embedding"].combine_chunks(), dims)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(np.argsort(ids))
    ids, x = ids[order], x[order]
    coarse = kmeans(x, lists, rng)
    own, wide = nearest(x, coarse), -(-dims // SUBSPACES)
    residual = np.pad(x - coarse[own], ((0, 0), (0, SUBSPACES * wide - dims)))
    books = [kmeans(residual[:, m * wide : (m + 1) * wide], CODES, rng) for m in range(SUBSPACES)]
    few = min(PILOTS, int(there) // PILOT_SHARE, len(x))
    index = Index(dims, coarse, np.stack(books), x[:few], ids[:few], own[:few])
    asked = rng.choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
    rank = np.argsort(np.argsort(-(x[asked] @ coarse.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], 1).ravel())
    index.probes = int(needed[min(len(needed) - 1, math.ceil(PROBE_RECALL * len(needed)))]) + 1
    return index


def assigned(rows: DataFrame, index: Index) -> DataFrame:
    """(vec_id, embedding, list, codes, apart) for every row; apart is its distance from the centroid."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), held.value.dims)
            own = nearest(x, held.value.coarse)
            codes = held.value.code(x, own)
            apart = np.sqrt(((x - held.value.coarse[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(apart)], ["vec_id", "embedding", "list", "codes", "apart"])

    return valid(rows, index.dims).mapInArrow(run, "vec_id bigint, embedding array<double>, list int, codes binary, apart double")


def probing(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, query, floor, list) for every query and list that it probes."""
    held = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(1), held.value.dims)
            lists = held.value.lists(q, k)
            floors = held.value.floors(q, batch.column(0).to_numpy(), lists, k)
            lists = held.value.reachable(q, lists, floors)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "query", "floor", "lists"])

    asked = valid(queries, index.dims).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return asked.mapInArrow(run, "query_id bigint, query array<double>, floor double, lists array<int>").select("query_id", "query", "floor", F.explode("lists").alias("list"))


def ranked(x: np.ndarray, ids: np.ndarray, codes: np.ndarray, spread: np.ndarray, pilots: np.ndarray, q: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, at: Index, own_list: int, k: int) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score) of the k best rows of a block for each query, as far as they reach its floor; ids ascend."""
    near = np.repeat((q @ at.coarse[own_list]).astype(np.float32)[None, :], len(ids), 0)
    for table, code in zip(at.tables(q), codes.T):
        near += table[code]
    lengths = np.sqrt((q**2).sum(1))
    place = np.searchsorted(ids, query_ids)
    own = np.flatnonzero(ids[np.minimum(place, len(ids) - 1)] == query_ids)
    near[place[own], own] = -np.inf
    few, by_query = min(max(RERANK, k + 1), len(ids)), np.ascontiguousarray(near.T)
    top = np.argpartition(by_query, len(ids) - few, axis=1)[:, len(ids) - few :]
    score = np.stack([x[t] @ q[j] for j, t in enumerate(top)])
    score[np.isneginf(np.take_along_axis(by_query, top, 1))] = -np.inf
    least = np.maximum(floors, np.partition(score, few - k, axis=1)[:, few - k]) if few >= k else floors
    # The slack is for rounding
    slack = 1e-5 * (1 + lengths * np.sqrt((x**2).sum(1)).max())
    least = least - slack
    wanted = by_query + lengths.astype(np.float32)[:, None] * spread.astype(np.float32) >= least.astype(np.float32)[:, None]
    np.put_along_axis(wanted, top, True, 1)
    wanted[:, pilots] = True
    wanted[own, place[own]] = False
    column, row = np.nonzero(wanted)
    score = np.concatenate([(x[row[a : a + STEP_PAIRS]] * q[column[a : a + STEP_PAIRS]]).sum(1) for a in range(0, len(row), STEP_PAIRS)] or [np.zeros(0)])
    good = score >= least[column]
    column, row, score = column[good], row[good], score[good]
    order = np.lexsort((row, -score, column))
    column, row, score = column[order], row[order], score[order]
    first = np.arange(len(column)) - np.searchsorted(column, column) < k
    return query_ids[column[first]], ids[row[first]], score[first]


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of ``vectors`` that ``is_query`` (on vec_id) picks."""
    spark = vectors.sparkSession
    rows = durable(usable(vectors), "vectors")
    index = fit(rows, k)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    coded = durable(assigned(rows, index), "coded")
    index.sizes, index.radii = np.zeros(len(index.coarse), np.int64), np.zeros(len(index.coarse))
    # MOST_LISTS rows at most
    for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect():
        index.sizes[r["list"]], index.radii[r["list"]] = r["n"], r["radius"]
    held = spark.sparkContext.broadcast(index)
    probes = durable(probing(rows.where(is_query), index, k), "probes")
    # One row a list, MOST_LISTS at most
    row_blocks = coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))
    query_blocks = probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    sizes = spark.createDataFrame(row_blocks.join(query_blocks, "list").toArrow().to_pylist() or [], "list int, row_blocks int, query_blocks int") if not probes.isEmpty() else None
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    salt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(SEED)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(F.broadcast(sizes), "list").withColumn("query_block", salt("query_id", "query_blocks")).withColumn("row_block", all_of("row_blocks"))
    right = coded.join(F.broadcast(sizes), "list").withColumn("row_block", salt("vec_id", "row_blocks")).withColumn("query_block", all_of("query_blocks"))
    key = ["list", "row_block", "query_block"]

    def scan(asked: pa.Table, there: pa.Table) -> pa.Table:
        at = held.value
        found: list[list[np.ndarray]] = [[], [], []]
        if asked.num_rows and there.num_rows:
            there = there.sort_by("vec_id")
            ids, x = there["vec_id"].to_numpy(), matrix(there["embedding"].combine_chunks(), at.dims)
            codes = np.frombuffer(b"".join(there["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            q, query_ids, floors = matrix(asked["query"].combine_chunks(), at.dims), asked["query_id"].to_numpy(), asked["floor"].to_numpy()
            own_list = asked["list"][0].as_py()
            pilots = np.flatnonzero(np.isin(ids, at.pilot_ids))
            spread = at.errors(x, own_list, codes) * min(1.0, SPREAD / math.sqrt(at.dims))
            for i in range(0, len(q), STEP_QUERIES):
                step = slice(i, i + STEP_QUERIES)
                for out, part in zip(found, ranked(x, ids, codes, spread, pilots, q[step], query_ids[step], floors[step], at, own_list, k)):
                    out.append(part)
        flat = [np.concatenate(f) if f else np.zeros(0) for f in found]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    found = left.select(*key, "query_id", "query", "floor").groupBy(*key).cogroup(right.select(*key, "vec_id", "embedding", "codes").groupBy(*key)).applyInArrow(scan, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
