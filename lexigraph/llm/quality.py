"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

A document's statistics (shares of character classes, repetition, word and line lengths) are standardised and mapped to
cosines, whose mean product approximates half a Gaussian kernel. Each partition sums its normal equations by fold; the sums, a few fixed-size
matrices, meet on the driver, which solves the ridge problem. Scores of rows out of their own fold give the calibration:
counts in a fixed number of score bins, made monotone by pooling neighbours.

Statistics and features are rounded to multiples of STEP before they are summed, so every sum is one of integers: it does
not depend on the order of rows or partitions, and a fit repeats to the last bit. Scores are rounded to DIGITS places.

Null texts are empty texts and get the score of an empty text. Repeated rows are scored each; equal texts score equally.
A table without usable labels gives every row the same score, the prior. Columns other than those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, durable, slices

#: Labelled rows that a fit uses at most, chosen by a hash of doc_id.
FIT_ROWS = 100_000
FEATURES, FOLDS, RIDGE, BINS, SUM_TASKS = 256, 5, 1e-3, 512, 16
#: Rows whose features a task holds at once.
STEP_ROWS = 2048
SEED, DIGITS = 11, 9
#: What features are rounded to: products are integers below 2 ** 29, so FIT_ROWS of them stay exact as doubles.
STEP = 2.0**-14
#: Units of a statistic in its sums; and what standardised statistics and directions are rounded to.
UNITS, GRID = 1 << 20, 2.0**-16
#: A document is kept from this score on.
KEEP_FROM = 0.3

#: Character classes of the statistics, by first byte.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".", ",", "!?", "|", "#%$&*@^~", "'\"()[]{}<>", "+-=_/\\:;`"]
NAMES = 26


def byte_classes() -> np.ndarray:
    table = np.full(256, len(CLASSES) + 1, np.uint8)
    table[:128] = len(CLASSES)
    for i, letters in enumerate(CLASSES):
        table[[ord(c) for c in letters]] = i
    return table


_CLASS = byte_classes()


def statistics(text: str) -> list[float]:
    """NAMES numbers that describe a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 2)
    words, lines = text.split(), text.split("\n")
    k = max(len(words), 1)
    repeated = sum(map(eq, words, words[1:])) / k
    distinct = len(set(words)) / k
    shouted = sum(map(str.isupper, words)) / k
    marked = sum(not w[-1].isalnum() for w in words) / k
    plain = sum(map(str.isalpha, words)) / k
    whole = sum(x.rstrip().endswith((".", "!", "?", ":")) for x in lines) / len(lines)
    longest = max(map(len, words), default=0)
    return [*(np.sqrt(kinds / n)).tolist(), repeated, distinct, shouted, marked, plain, whole, len(set(lines)) / len(lines), np.log1p(n), np.log1p(k), n / k / 10 if k > 1 else 0.0, min(longest, 100) / 100, kinds[4] / k]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<float>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([statistics(t or "") for t in batch.column(1).to_pylist()], np.float32)
            offsets = np.arange(0, rows.size + 1, NAMES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, stats array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    by_fold: list[np.ndarray]
    edges: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.round(np.clip((stats - self.mean) / self.scale, -6, 6) / GRID) * GRID
        z = np.round(np.cos(x @ self.directions + self.phases) / STEP) * STEP
        return np.hstack([z, np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = [(self.features(stats[a : a + STEP_ROWS]) * self.weights).sum(1) for a in range(0, len(stats), STEP_ROWS)]
        return self.calibrated(np.concatenate(raw or [np.zeros(0)]))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Piecewise linear between the pooled levels, with a slight slope so that order survives within a level."""
        level = np.interp(raw, self.edges, self.levels)
        return np.round(np.clip(0.998 * level + 0.002 * np.clip(raw, 0, 1), 0.0, 1.0), DIGITS)


def pooled(hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic regression of hits/counts over ordered bins (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for h, n in zip(hits, counts):
        blocks.append([h, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), h / n) for h, n, k in blocks])


def _stacked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().astype(np.float64).reshape(-1, NAMES)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", described_before: bool = False) -> Model:
    """``labels`` has doc_id and ``target`` (0 or 1); rows with other or null targets are ignored.

    ``docs`` has doc_id and text, or is what ``described`` gave.
    """
    usable = bounded_labels(labels, target, FIT_ROWS, SEED)
    # FIT_ROWS bounds this side: 16 bytes a row
    stats = docs if described_before else described(docs.join(F.broadcast(usable.select("doc_id")), "doc_id", "left_semi"))
    rows = stats.join(F.broadcast(usable), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int"))
    rows = durable(rows.repartition(SUM_TASKS), "fit")
    rng = np.random.default_rng(SEED)
    # Integers; their squares as decimals, which do not overflow
    whole = [F.round(F.col("stats")[i].cast("double") * UNITS).cast("bigint") for i in range(NAMES)]
    moments = rows.select(F.count("*"), F.sum(F.col("y").cast("bigint")), *(F.sum(w) for w in whole), *(F.sum(w.cast("decimal(19,0)") * w.cast("decimal(19,0)")) for w in whole)).first()
    n, prior = moments[0], (moments[1] / moments[0] if moments[0] else None)
    first, second = moments[2 : 2 + NAMES], moments[2 + NAMES :]
    mean = np.array([x / n / UNITS if n else 0.0 for x in first])
    scale = np.array([max(math.isqrt(int(y) * n - x * x) / n / UNITS, 1e-3) if n else 1.0 for x, y in zip(first, second)])
    width = np.sqrt(NAMES)
    model = Model(mean, scale, np.round(rng.normal(size=(NAMES, FEATURES)) / width / GRID) * GRID, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), [], np.array([0.0, 1.0]), np.full(2, 0.5 if prior is None else prior))
    if not n or prior in (0.0, 1.0):
        return model
    d = FEATURES + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for whole in batches:
            for a in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(a, STEP_ROWS)
                yield model.features(_stacked(batch, "stats")), batch.column(1).to_numpy(), batch.column(2).to_numpy()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, there = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d)), False
        for z, y, fold in parts(batches):
            there = True
            for f in range(FOLDS):
                own = z[fold == f]
                gram[f] += own.T @ own
                right[f] += own.T @ y[fold == f]
        if there:
            yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "right": [right.tobytes()]})

    gram, right = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d))
    # A row a task, about SUM_TASKS of them: their number of folds and features is fixed
    for row in rows.select("stats", "y", "fold").mapInArrow(summed, "gram binary, right binary").collect():
        gram += np.frombuffer(row[0]).reshape(gram.shape)
        right += np.frombuffer(row[1]).reshape(right.shape)
    penalty = np.diag(np.append(np.full(FEATURES, RIDGE * n / 2), RIDGE * n / FEATURES))
    model.weights = np.linalg.solve(gram.sum(0) + penalty, right.sum(0))
    model.by_fold = [np.linalg.solve(gram.sum(0) - gram[f] + penalty, right.sum(0) - right[f]) for f in range(FOLDS)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, counts = np.zeros(BINS), np.zeros(BINS)
        for z, y, fold in parts(batches):
            raw = (z * np.array(model.by_fold)[fold]).sum(1)
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            np.add.at(hits, at, y)
            np.add.at(counts, at, 1.0)
        yield pa.RecordBatch.from_pydict({"bin": np.arange(BINS), "hits": hits, "counts": counts})

    bins = rows.select("stats", "y", "fold").mapInArrow(binned, "bin bigint, hits double, counts double").groupBy("bin").agg(F.sum("hits"), F.sum("counts")).orderBy("bin").collect()
    hits, counts = np.array([r[1] for r in bins]), np.array([r[2] for r in bins])
    full = counts > 0
    model.edges, model.levels = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[full], pooled(hits[full] + 0.01 * prior, counts[full] + 0.01)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``described``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stacked(batch, "stats")))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id bigint, score double")


def scored_texts(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows of ``docs`` with a column ``name``, in one pass over their texts."""
    fields, names = docs.schema, docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = np.array([statistics(t or "") for t in batch.column(at).to_pylist()], np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(stats))], [*names, name])

    return docs.mapInArrow(run, type(fields)([*fields.fields]).add(name, "double"))


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0
