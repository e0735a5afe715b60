import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq

from lexigraph.llm import neardup, queries
from lexigraph.llm.graph import components

from ..conftest import SMALL


def plain_classes(texts, idf, threshold=0.8):
    """Connected components over all pairs, with the operator's similarity computed from dictionaries."""
    bags = []
    for t in texts:
        h, rare, times = neardup.shingles(neardup.word_hashes([t])[0], idf)
        bags.append({k: w * (1 + np.log(n)) for k, w, n in zip(h.tolist(), rare.tolist(), times.tolist())})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = bags[i], bags[j]
        both = sum(min(w, b[k]) for k, w in a.items() if k in b)
        either = sum(a.values()) + sum(b.values()) - both
        if (texts[i] or "") == (texts[j] or "") or either and both / either >= threshold:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for k in r.sample(range(len(words)), n):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


def run(docs):
    return {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}


def test_planted_copies_and_bystanders(make_docs, prose):
    base = prose(30)
    rows = list(base)
    for i, t in enumerate(base[:10]):
        rows += [t, t.upper(), edited(t, 1, i), edited(t, 2, 50 + i)]
    rows += [edited(t, 40, 99) for t in base[10:20]]
    got = run(make_docs(list(enumerate(rows))))
    for i in range(10):
        assert [got[30 + 4 * i + k] for k in range(4)] == [i] * 4
    assert all(got[i] == i for i in [*range(30), *range(70, 80)])


def test_against_all_pairs(spark, make_docs):
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain_classes(t["text"], neardup.document_frequencies(docs))
    got = run(docs)
    assert [got[i] for i in t["doc_id"]] == [t["doc_id"][k] for k in want]
    assert {r["doc_id"]: r["class_id"] for r in queries.op1_near_duplicates(spark, SMALL).collect()} == got


def test_large_group_of_near_copies_without_all_pairs(spark, make_docs, prose):
    """Copies of which many are not near each other: linked through their source, or rightly apart."""
    base = prose(1, 200, 7)[0]
    texts = [base] + [edited(base, 3 + i % 6, i) for i in range(150)]
    docs = make_docs(list(enumerate(texts)))
    got = run(docs)
    assert [got[i] for i in range(len(texts))] == plain_classes(texts, neardup.document_frequencies(docs))


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = neardup.classes(docs).collect()
    assert len(rows) == len(odd_rows)
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add(r["class_id"])
    assert got[0] == got[1] == {0} and got[2] == {2} and got[3] == got[4] == {3} and got[6] == {6} and len(got[9]) == 2 and 9 in got[9]
    assert max(got[None]) < 0 and min(got[9]) < 0
    by_class = defaultdict(list)
    for r in rows:
        by_class[r["class_id"]].append(r["kept"])
    assert all(sum(k) == 1 for k in by_class.values())
    kept = neardup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([0, 2, 3, 5, 6, 7, 8, 9, 9, None], key=str)
    assert neardup.classes(docs.limit(0)).count() == 0 and neardup.representatives(docs.limit(0)).count() == 0


def test_samples_collide_at_the_weighted_jaccard_rate():
    r = np.random.default_rng(0)
    sampler = neardup.Sampler(200, 4)
    h = np.sort(r.integers(1, 1 << 63, 300, dtype=np.uint64))
    w = r.choice([1.0, 2.0, 4.0], 300)
    a, b = (h[:220], w[:220]), (h[60:], w[60:] * np.where(r.random(240) < 0.5, 2.0, 1.0))
    both = {k: min(x, dict(zip(b[0].tolist(), b[1]))[k]) for k, x in zip(a[0].tolist(), a[1]) if k in set(b[0].tolist())}
    want = sum(both.values()) / (a[1].sum() + b[1].sum() - sum(both.values()))
    assert abs((sampler.samples(*a) == sampler.samples(*b)).mean() - want) < 0.07


def test_samples_of_long_texts_are_in_proportion_to_weight():
    """Rare words put in make the heaviest shingles; the rest must still be sampled as often as it weighs."""
    r = np.random.default_rng(1)
    vocabulary = neardup.mixed(r.integers(1, 1 << 63, 50_000, dtype=np.uint64))
    sampler = neardup.Sampler(64, 4)
    for n in (20_000, 200_000, 1_000_000):
        words = vocabulary[np.minimum(r.zipf(1.3, n) - 1, 49_999)]
        changed = words.copy()
        changed[::60] = neardup.mixed(r.integers(1, 1 << 63, len(changed[::60]), dtype=np.uint64))
        bags = [neardup.counted(w) for w in (words, changed)]
        known = set(bags[0][0].tolist())
        a, b = ((h, np.array([1.0 if k in known else 2.0 for k in h.tolist()]) * neardup.damped(times)) for h, times in bags)
        _, x, y = np.intersect1d(a[0], b[0], return_indices=True)
        both = np.minimum(a[1][x], b[1][y]).sum()
        want = both / (a[1].sum() + b[1].sum() - both)
        assert want > 0.7 and abs((sampler.samples(*a) == sampler.samples(*b)).mean() - want) < 0.08


def test_a_text_is_sampled_alike_alone_and_among_others():
    r = np.random.default_rng(2)
    texts = [(np.sort(r.integers(1, 1 << 63, n, dtype=np.uint64)), r.uniform(0.5, 6, n)) for n in (1, 2, 7, 300, 5000, 9000, 3)]
    sampler = neardup.Sampler()
    many = sampler.samples_of(texts)
    k = np.arange(len(sampler.odd))
    for i, (h, w) in enumerate(texts):
        u = neardup.bits_of((h >> np.uint64(32)).astype(np.uint32)[None], sampler.odd[:, None], sampler.shift[:, None])
        value, t = (x.reshape(len(k), -1) for x in sampler.drawn(np.tile(h, len(k)), np.tile(np.log(w), len(k)), u.ravel(), np.repeat(k, len(h))))
        best = value.argmin(1)
        assert (many[:, i] == neardup.mixed(h[best] + t[k, best].astype(np.uint64))).all() and (many[:, i] == sampler.samples(h, w)).all()


def test_word_hashes_do_not_depend_on_neighbours():
    long = "a" * (neardup.TEXT_BLOCK + 5000)
    got = neardup.word_hashes(["Hello, world! héllo", "", None, f"world {long} hello", long])
    assert [len(x) for x in got] == [3, 0, 0, 3, 1]
    assert got[0][0] == got[3][2] and got[0][1] == got[3][0] and got[3][1] == got[4][0]
    many = " ".join(f"w{i}" for i in range(100_000))
    assert len(set(neardup.word_hashes([many])[0].tolist())) == 100_000


def test_long_words_and_words_that_collide_in_polynomial_hashes(monkeypatch):
    word = "ab"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        mirror = word.translate(str.maketrans("ab", "ba"))
        a, b = neardup.word_hashes([word, mirror])
        assert a[0] != b[0]
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 300)
    monkeypatch.setattr(neardup, "LONGEST", 100)
    for n in (90, 100, 101, 250, 399, 400, 401, 5000):
        long = ("xyz" * n)[:n]
        want = neardup.word_hashes([long])[0]
        for before in (0, 1, 50, 299, 300, 301):
            got = neardup.word_hashes(["a " * before + long + " b", "c"])
            assert len(got[0]) == before + 2 and got[0][before] == want[0] and len(got[1]) == 1


def test_document_frequencies_of_shingles(spark):
    """Against counts in dictionaries; a table too small for them is told from chance."""
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    idf = neardup.document_frequencies(spark.read.parquet(f"{SMALL}/documents.parquet"))
    df = Counter(k for text in t["text"] for k in neardup.counted(neardup.word_hashes([text])[0])[0].tolist())
    n, entries = len(t["text"]), Counter()
    for k, c in df.items():
        entries[int(neardup.entry_of(np.array([k], np.uint64))[0])] += c
    chance = sum(entries.values()) / neardup.FREQUENCIES
    off = np.floor(chance + neardup.CHANCE * np.sqrt(chance))
    for e, c in entries.items():
        assert abs(idf[e] - (1 + np.log((n + 1) / (min(max(c - off, 1), n) + 1)) / np.log(n + 2))) < 1e-6
    assert 1 <= idf.min() and idf.max() < 2


def test_texts_that_share_a_doc_id(spark, make_docs, prose):
    a, b, c = prose(3, seed=11)
    rows = [(9, a), (9, b), (12, b), (12, c), (None, "x y z"), (None, "x y z"), (None, "q"), (3, a), (3, a)]
    got = defaultdict(set)
    kept = defaultdict(int)
    for r in neardup.classes(make_docs(rows)).collect():
        got[r["class_id"]].add((r["doc_id"], r["digest"]))
        kept[r["class_id"]] += r["kept"]
    texts = {d: t for t in (a, b, c, "x y z", "q") for d in [hashlib.sha256(t.encode()).digest()]}
    classes = {frozenset((i, texts[bytes(d)]) for i, d in members) for members in got.values()}
    assert classes == {frozenset({(9, a), (3, a)}), frozenset({(9, b), (12, b)}), frozenset({(12, c)}), frozenset({(None, "x y z")}), frozenset({(None, "q")})}
    assert set(kept.values()) == {1} and 3 in got and neardup.representatives(make_docs(rows)).count() == 5


def test_small_blocks_lose_no_link(make_docs, prose, monkeypatch):
    monkeypatch.setattr(neardup, "SCAN", 4)
    monkeypatch.setattr(neardup, "SCAN_BYTES", 3000)
    base = prose(1, 200, 8)[0]
    texts = [base] + [edited(base, 3 + i % 6, i) for i in range(60)]
    docs = make_docs(list(enumerate(texts)))
    got = run(docs)
    assert [got[i] for i in range(len(texts))] == plain_classes(texts, neardup.document_frequencies(docs))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (5, 5)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(chain, "a int, b int")).collect():
        got[r["component"]].add(r["node"])
    assert sorted(map(len, got.values())) == [2, 40, 61]
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
