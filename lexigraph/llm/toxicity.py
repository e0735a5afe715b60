"""Toxicity categories by a classifier chain: one linear model a category, each fed the earlier categories' probabilities.

Features are words and word beginnings, chosen by how far their document counts among labelled toxic texts exceed what
independence gives; a text's value is log(1 + occurrences). Labels know toxic texts only, so the earlier categories are
learned: the toxic texts' features, centred, have a direction of most spread, and the texts on its either side form two
kinds of toxicity. The first category's model sees the features, each later one also the earlier probabilities. In
training these come from models that have not seen the row: a fold's features, kinds and models are all made from the
other folds. At scoring they come from the models of all rows.

Null and empty texts have no features and get the models' floor. Repeated rows are scored each; equal texts score
equally. Without any labels every probability is about 0. Columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, bounded_labels, durable, slices

#: Labelled rows that a fit uses at most, chosen by a hash of doc_id.
FIT_ROWS = 20_000
FEATURES, FOLDS, RIDGE, STEPS, SEED = 256, 4, 0.3, 30, 23
BEGINNINGS = (4, 5, 6, 7)
#: A document is toxic from this probability on.
TOXIC_FROM = 0.5
WORD = re.compile(r"[^\W\d_]+")

#: The chain in order: two kinds of toxic texts, then toxic itself.
CATEGORIES = ("kind_a", "kind_b", "toxic")


def tokens(chunk: str) -> tuple[str, ...]:
    """The features of a lower-case text without white space: its words, and each longer word's beginnings marked ^."""
    out = []
    for w in WORD.findall(chunk):
        out.append(w)
        out += [f"^{w[:n]}" for n in BEGINNINGS if len(w) > n]
    return tuple(out)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic weights by Newton steps; the last column of ``x`` is 1. Later steps keep curvatures for a while."""
    w = np.zeros(x.shape[1], np.float64)
    for turn in range(STEPS):
        p = sigmoid(x @ w.astype(x.dtype)).astype(np.float64)
        if turn < 4 or turn % 5 == 0:
            h = np.maximum(p * (1 - p), 1e-4).astype(x.dtype)
            back = np.linalg.inv(((x * h[:, None]).T @ x).astype(np.float64) + RIDGE * np.eye(len(w)))
        step = back @ (x.T @ (y - p).astype(x.dtype) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    names: list[str]
    features: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)

    def vectors(self, counts: list[Counter]) -> np.ndarray:
        x = np.zeros((len(counts), len(self.features) + 1), np.float32)
        x[:, -1] = 1
        for i, c in enumerate(counts):
            for j, n in c.items():
                x[i, j] = np.log1p(n)
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.names)))
        for k, w in enumerate(self.weights):
            out[:, k] = sigmoid(np.hstack([out[:, :k], x]) @ w)
        return out


class Counted:
    """Counts of known features in texts, through a bounded table of distinct chunks."""

    def __init__(self, features: dict[str, int]):
        self.features = features
        self.table = Table(lambda chunk: tuple(j for t in tokens(chunk) if (j := features.get(t)) is not None), 150_000)

    def __call__(self, text: str | None) -> Counter:
        c: Counter = Counter()
        for found in filter(None, map(self.table.__getitem__, (text or "").lower().split())):
            c.update(found)
        return c


def direction(x: np.ndarray) -> np.ndarray:
    """The direction of most spread of the rows, its greatest entry positive."""
    if len(x) < 2 or not x.shape[1]:
        return np.zeros(x.shape[1])
    apart = (x - x.mean(0)).astype(np.float64)
    found = np.linalg.eigh(apart.T @ apart)[1][:, -1]
    return found * np.sign(found[np.abs(found).argmax()] or 1.0)


def kinds(x: np.ndarray, toxic: np.ndarray, like: np.ndarray | None = None) -> np.ndarray:
    """(rows, categories) training labels: toxic rows above the mean along their direction, the other toxic rows, and all.

    The direction points the way of ``like``, so that the kinds of different folds go by one name.
    """
    found, own = direction(x[toxic > 0]), x[toxic > 0]
    if like is not None and found @ like < 0:
        found = -found
    above = x @ found > (float((own @ found).mean()) if len(own) else 0.0)
    return np.stack([toxic * above, toxic * ~above, toxic], 1).astype(np.float64)


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray, views: list[np.ndarray]) -> list[np.ndarray]:
    """The chain's weights; ``views`` has the columns chosen without each fold, then those chosen on all rows.

    ``x`` has a column of ones at its end.
    """
    ones, like = x.shape[1] - 1, np.zeros(x.shape[1])
    like[views[FOLDS]] = direction(x[y > 0][:, views[FOLDS]])
    before = np.zeros((len(x), len(CATEGORIES)))
    for f in range(FOLDS):
        own = fold == f
        if own.any() and (~own).any():
            z, rest = x[own][:, [*views[f], ones]], x[~own][:, [*views[f], ones]]
            at = np.zeros((len(z), 0))
            for w in chained(rest, kinds(rest[:, :-1], y[~own], like[views[f]])):
                at = np.hstack([at, sigmoid(np.hstack([at, z]) @ w)[:, None]])
            before[own] = at
    z = x[:, [*views[FOLDS], ones]]
    wanted = kinds(z[:, :-1], y)
    return [logistic(np.hstack([before[:, :k], z]).astype(np.float32), wanted[:, k]) for k in range(len(CATEGORIES))]


def chained(x: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """Weights of a chain whose later models see the earlier ones' probabilities on their own training rows."""
    out, before = [], np.zeros((len(x), 0))
    for k in range(wanted.shape[1]):
        z = np.hstack([before, x]).astype(np.float32)
        out.append(logistic(z, wanted[:, k]))
        before = np.hstack([before, sigmoid(z @ out[-1])[:, None]])
    return out


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Chain:
    """``labels`` has doc_id and ``target`` (0 or 1); rows with other or null targets are ignored."""
    usable = bounded_labels(labels, target, FIT_ROWS, SEED).withColumn("y", F.col("y").cast("int"))
    # FIT_ROWS bounds this side: 12 bytes a row
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = durable(rows.select("doc_id", "text", "y", fold), "toxic-fit")
    sizes = {r["fold"]: (r["n"], r["hits"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).collect()}
    chain = Chain([*CATEGORIES], {})
    if not sizes:
        chain.weights = [np.append(np.zeros(k), -30.0) for k in range(len(CATEGORIES))]
        return chain
    chosen = chosen_features(rows, sizes)
    union = sorted(set().union(*chosen))
    place = {t: j for j, t in enumerate(union)}

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counted(place)
        for batch in slices(batches):
            found = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), *batch.columns[2:]], ["doc_id", "at", "n", "y", "fold"])

    # At most FIT_ROWS rows of at most (FOLDS + 1) * FEATURES small integers come to the driver
    got = rows.mapInArrow(looked_up, "doc_id bigint, at array<int>, n array<int>, y int, fold int").toArrow().sort_by("doc_id")
    x = Chain([], place).vectors([Counter(dict(zip(a, b))) for a, b in zip(got["at"].to_pylist(), got["n"].to_pylist())])
    chain.features = {t: j for j, t in enumerate(chosen[FOLDS])}
    chain.weights = train(x, got["y"].to_numpy().astype(np.float64), got["fold"].to_numpy(), [np.array([place[t] for t in view], np.int64) for view in chosen])
    return chain


def chosen_features(rows: DataFrame, sizes: dict[int, tuple[int, int]]) -> list[list[str]]:
    """For each fold the FEATURES best features of the other folds' rows, then those of all rows."""
    columns = [f"{k}{f}" for f in range(FOLDS) for k in ("n", "h")]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            names = list(set().union(*counts))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in counts)], ["feature", *columns])

        counts = [Counter() for _ in columns]
        for batch in slices(batches):
            for text, y, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = {t for chunk in set(text.lower().split()) for t in tokens(chunk)}
                counts[2 * f].update(own)
                if y:
                    counts[2 * f + 1].update(own)
            if sum(map(len, counts)) > 400_000:
                yield flush()
                counts = [Counter() for _ in columns]
        yield flush()

    sums = rows.select("text", "y", "fold").mapInArrow(counted, "feature string, " + ", ".join(f"{c} bigint" for c in columns)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns))
    sums = durable(sums, "toxic-features")
    out = []
    for left_out in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left_out]
        n, hits = (sum(sizes.get(f, (0, 0))[k] for f in folds) for k in (0, 1))
        of = lambda k: sum((F.col(f"{k}{f}") for f in folds), F.lit(0))  # noqa: B023, E731
        expected = of("n") * (hits / max(n, 1))
        gain = F.round(F.pow(of("h") - expected, 2) / (expected + 1), 6)
        best = sums.where(of("h") > expected).orderBy(gain.desc(), "feature").limit(FEATURES)
        out.append([r["feature"] for r in best.select("feature").collect()])
    return out


def scored(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """The rows of ``docs`` with a column <prefix><category> for each category, in one pass over their texts."""
    fields, names = docs.schema, docs.columns
    at = names.index("text")
    schema = type(fields)([*fields.fields])
    for k in chain.names:
        schema = schema.add(f"{prefix}{k}", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counted(chain.features)
        for batch in slices(batches):
            p = chain.probabilities(chain.vectors([count(t) for t in batch.column(at).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(p.shape[1]))], [*names, *(f"{prefix}{k}" for k in chain.names)])

    return docs.mapInArrow(run, schema)
