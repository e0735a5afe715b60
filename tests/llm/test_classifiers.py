from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import quality, queries, toxicity

from ..conftest import SMALL

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels():
    t = pq.read_table(f"{LARGER}/labels.parquet").to_pydict()
    return {i: (q, x) for i, q, x in zip(t["doc_id"], t["quality"], t["toxic"])}


def test_quality_held_out(spark, labels):
    rows = queries.op3_quality_classifier(spark, LARGER).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], r["predicted"], labels[r["doc_id"]][0]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98
    assert np.mean([p == y for _, p, y in held]) > 0.95


def test_quality_reads_no_held_out_labels(spark):
    docs, marks = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = marks.withColumn("quality", F.when(quality.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda m: [r["score"] for r in quality.score(quality.described(docs), quality.fit(docs, m.where(~quality.is_held_out()))).orderBy("doc_id").collect()]
    assert score(marks) == score(turned)


def test_a_quality_fit_repeats_to_the_last_bit(spark):
    docs, marks = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    one = quality.fit(docs, marks)
    for n in (1, 3, 7, 2):
        other = quality.fit(docs.repartition(n), marks.repartition(n))
        assert all(np.array_equal(getattr(one, k), getattr(other, k)) for k in ("mean", "scale", "directions", "weights", "by_fold", "edges", "levels"))


def test_quality_against_a_plain_ridge_on_all_rows(spark):
    """One matrix of all labelled rows, least squares with the penalty as rows of its own, and isotonic regression by its max-min formula."""
    t, marks = pq.read_table(f"{LARGER}/documents.parquet").to_pydict(), pq.read_table(f"{LARGER}/labels.parquet").to_pydict()
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = quality.fit(docs, labels)
    text = dict(zip(t["doc_id"], t["text"]))
    folds = {r[0]: r[1] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED + 1)), F.lit(quality.FOLDS))).collect()}
    stats, fold, y = np.array([quality.statistics(text[i]) for i in marks["doc_id"]], np.float32).astype(float), np.array([folds[i] for i in marks["doc_id"]]), np.array(marks["quality"], float)
    assert model.mean == pytest.approx(stats.mean(0), abs=1e-5) and model.scale == pytest.approx(np.maximum(stats.std(0), 1e-3), abs=1e-5)
    z = np.cos(np.clip((stats - model.mean) / model.scale, -6, 6) @ model.directions + model.phases)
    z = np.hstack([z, np.ones((len(z), 1))])
    root = np.sqrt(np.append(np.full(quality.FEATURES, quality.RIDGE * len(y) / 2), quality.RIDGE * len(y) / quality.FEATURES))
    plain = lambda own: np.linalg.lstsq(np.vstack([z[own], np.diag(root)]), np.append(y[own], np.zeros(len(root))), rcond=None)[0]
    assert z @ model.weights == pytest.approx(z @ plain(fold >= 0), abs=2e-3)
    raw = np.zeros(len(y))
    for f in range(quality.FOLDS):
        raw[fold == f] = z[fold == f] @ plain(fold != f)
        assert z @ model.by_fold[f] == pytest.approx(z @ plain(fold != f), abs=2e-3)
    order = np.argsort(raw)
    ys, n = y[order], len(y)
    sums = np.append(0, np.cumsum(ys))
    low = [np.max([np.min((sums[k + 1 :] - sums[j])[: n - k] / (np.arange(k + 1, n + 1) - j)) for j in range(k + 1)]) for k in range(n)]
    assert np.mean(np.abs(np.interp(raw[order], model.edges, model.levels) - low)) < 0.03


def test_pooled_is_isotonic_regression():
    r = np.random.default_rng(2)
    hits, counts = r.integers(0, 5, 40).astype(float), np.full(40, 5.0)
    got = quality.pooled(hits, counts)
    assert (np.diff(got) >= -1e-12).all() and got @ counts == pytest.approx(hits.sum())
    best = np.array([max(hits[a : b + 1].sum() / counts[a : b + 1].sum() for a in [a]) for a, b in [(0, 39)]])
    assert got.min() <= best[0] <= got.max()
    want = [max(min(hits[a : b + 1].sum() / counts[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert got == pytest.approx(np.array(want))


def test_features_approximate_the_gaussian_kernel():
    r = np.random.default_rng(3)
    rng = np.random.default_rng(quality.SEED)
    old = quality.FEATURES
    try:
        quality.FEATURES = 6000
        width = np.sqrt(quality.NAMES)
        m = quality.Model(np.zeros(quality.NAMES), np.ones(quality.NAMES), rng.normal(size=(quality.NAMES, 6000)) / width, rng.uniform(0, 2 * np.pi, 6000), np.zeros(6001), [], np.zeros(2), np.zeros(2))
        x = r.normal(size=(20, quality.NAMES))
        z = m.features(x)[:, :-1]
    finally:
        quality.FEATURES = old
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * width**2))
    assert np.abs(z @ z.T * 2 / 6000 - want).max() < 0.08


def test_toxicity(spark, labels):
    rows = {r["doc_id"]: r for r in queries.op9_toxicity_chain(spark, LARGER).collect()}
    assert len(rows) == 1000
    hit = [rows[i]["toxic"] for i, (_, x) in labels.items() if x]
    false = [rows[i]["toxic"] for i, (_, x) in labels.items() if not x]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.01


def test_toxicity_on_unseen_documents(spark, labels):
    docs, marks = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    chain = toxicity.fit(docs, marks.where("doc_id % 3 <> 0"))
    rows = {r["doc_id"]: r["p_toxic"] >= toxicity.TOXIC_FROM for r in toxicity.scored(docs, chain).where("doc_id % 3 = 0").collect()}
    hit = [rows[i] for i, (_, x) in labels.items() if x and i in rows]
    false = [rows[i] for i, (_, x) in labels.items() if not x and i in rows]
    assert np.mean(hit) > 0.7 and np.mean(false) < 0.03
    assert [len(w) for w in chain.weights] == [len(chain.features) + 1 + k for k in range(3)]


def plain_logistic(x, y):
    """Ridge logistic weights by reweighted least squares, the penalty as rows of its own."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = np.sqrt(np.maximum(p * (1 - p), 1e-4))
        step = np.linalg.lstsq(np.vstack([x * h[:, None], np.eye(len(w)) * np.sqrt(toxicity.RIDGE)]), np.append((y - p) / h, -np.sqrt(toxicity.RIDGE) * w), rcond=None)[0]
        w = w + step
    return w


def test_chain_against_a_plain_one(spark, monkeypatch):
    """Features counted in dictionaries, kinds by singular vectors, each fold's chain from the other folds' rows alone."""
    monkeypatch.setattr(toxicity, "FEATURES", 24)
    docs, marks = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    chain = toxicity.fit(docs, marks)
    rows = docs.join(marks.select("doc_id", "toxic"), "doc_id").select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(toxicity.SEED + 1)), F.lit(toxicity.FOLDS)).alias("fold")).collect()
    counts = [Counter(t for c in r["text"].lower().split() for t in toxicity.tokens(c)) for r in rows]
    y, fold = np.array([r["toxic"] for r in rows], float), np.array([r["fold"] for r in rows])

    def best(own):
        docs_of, hits = Counter(t for i in own for t in counts[i]), Counter(t for i in own if y[i] for t in counts[i])
        share = sum(y[i] for i in own) / len(own)
        gain = {t: round((hits[t] - n * share) ** 2 / (n * share + 1), 6) for t, n in docs_of.items() if hits[t] > n * share}
        return sorted(gain, key=lambda t: (-gain[t], t))[:24]

    table = lambda terms: np.array([[np.log1p(c[t]) for t in terms] + [1.0] for c in counts])

    def split(x, own, like):
        tox = x[own][y[own] > 0, :-1]
        v = np.linalg.svd(tox - tox.mean(0))[2][0]
        v = v * np.sign(v[np.abs(v).argmax()]) if like is None else v * np.sign(v @ like)
        above = x[own, :-1] @ v > (tox @ v).mean()
        return np.stack([y[own] * above, y[own] * ~above, y[own]], 1), v

    everything = np.arange(len(rows))
    terms = best(everything)
    whole = table(terms)
    wanted, v = split(whole, everything, None)
    before = np.zeros((len(rows), 3))
    for f in range(toxicity.FOLDS):
        rest, own, own_terms = everything[fold != f], everything[fold == f], best(everything[fold != f])
        x = table(own_terms)
        kinds, _ = split(x, rest, np.array([dict(zip(terms, v)).get(t, 0.0) for t in own_terms]))
        seen, unseen = np.zeros((len(rest), 0)), np.zeros((len(own), 0))
        for k in range(3):
            w = plain_logistic(np.hstack([seen, x[rest]]), kinds[:, k])
            seen, unseen = (np.hstack([b, (1 / (1 + np.exp(-np.hstack([b, x[at]]) @ w)))[:, None]]) for b, at in ((seen, rest), (unseen, own)))
        before[own] = unseen
    assert list(chain.features) == terms
    for k in range(3):
        assert chain.weights[k] == pytest.approx(plain_logistic(np.hstack([before[:, :k], whole]), wanted[:, k]), abs=0.02)


def test_chain_feeds_earlier_probabilities():
    chain = toxicity.Chain(["a", "b"], {"x": 0}, [np.array([5.0, -2.0]), np.array([8.0, 0.0, -4.0])])
    p = chain.probabilities(chain.vectors([{0: 1}, {}]))
    first = 1 / (1 + np.exp(-(5 * np.log(2) - 2)))
    assert p[0] == pytest.approx([first, 1 / (1 + np.exp(-(8 * first - 4)))]) and p[1, 0] == pytest.approx(1 / (1 + np.exp(2)))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_odd_rows_and_missing_labels(spark, make_docs, odd_rows, kind):
    docs = make_docs(odd_rows)
    schema = "doc_id bigint, quality int, toxic int"
    some = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (6, 0, 1), (9, 1, 0), (None, 1, 1), (7, None, None), (99, 1, 1), (8, 7, 7)], schema)
    for marks in (some, some.limit(0), some.where("doc_id = 9")):
        if kind == "quality":
            got = quality.scored_texts(docs, quality.fit(docs, marks), "_s")
        else:
            got = toxicity.scored(docs, toxicity.fit(docs, marks), "_p_").withColumnRenamed("_p_toxic", "_s")
        rows = got.collect()
        assert len(rows) == len(odd_rows) and all(0 <= r["_s"] <= 1 and r["score"] == "x" for r in rows)
        by = {r["text"]: r["_s"] for r in rows}
        assert by[None] == by[""]
        assert got.limit(0).count() == 0
    none = docs.limit(0)
    assert (quality.scored_texts(none, quality.fit(none, some), "_s") if kind == "quality" else toxicity.scored(none, toxicity.fit(none, some))).count() == 0
