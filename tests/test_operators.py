import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.functions.text import indexed_text
from lexigraph.operators import browse, cluster, index, search, store
from lexigraph.sources.corpus import corpus

TEXTS = {1: "cats chasing cats", 2: "dogs chasing rabbits", 3: "the of", 4: "", 5: "cats dogs rabbits rabbits rabbits"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()) + [(6, None)], "doc_id int, text string")


@pytest.fixture(scope="module")
def built(docs):
    return index.build(docs, "doc_id", F.col("text"))


def test_idf_by_hand(built):
    got = {r["term"]: (r["df"], r["idf"]) for r in built.idf.collect()}
    assert got["cats"][0] == 2
    assert got["cats"][1] == pytest.approx(math.log10(7 / 3) + 1)
    assert all(idf >= 1 for _, idf in got.values())


def test_vectors_have_unit_length_or_none(built):
    vectors = {r["doc_id"]: r["vector"] for r in built.vectors().collect()}
    assert vectors[3] == vectors[4] == vectors[6] == {}
    for doc in (1, 2, 5):
        assert sum(w * w for w in vectors[doc].values()) == pytest.approx(1)
    meta = built.metadata().first()
    assert (meta["document_count"], meta["vocabulary_size"]) == (6, 4)


def test_postings_and_counts(docs, built):
    got = {r["term"]: r for r in index.postings(index.positions(docs, "doc_id", F.col("text")), "doc_id").collect()}
    assert [(p["doc_id"], p["term_frequency"], p["positions"]) for p in got["rabbit"]["postings"]] == [(2, 1, [2]), (5, 3, [2, 3, 4])]
    parts = index.segmented_postings(index.positions(docs, "doc_id", F.col("text")), "doc_id", 1).collect()
    assert {(r["term"], p["doc_id"], p["term_frequency"]) for r in parts for p in r["postings"]} == {(t, p["doc_id"], p["term_frequency"]) for t, r in got.items() for p in r["postings"]}
    assert all(r["document_frequency"] == got[r["term"]]["document_frequency"] for r in parts) and len(parts) > len(got)
    counts = {r[0]: (r[1], r[2]) for r in index.token_counts(built.tf, docs, "doc_id").collect()}
    assert counts[5] == (5, 3) and counts[3] == (0, 0)
    norms = {r[0]: r[1] for r in index.norms(built.tf, built.idf, docs, "doc_id").collect()}
    assert norms[4] == 0 and norms[1] > 0


def test_search(built):
    got = search.search(built, "cats unknownword cats rabbits").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and all(0 < r["score"] <= 1 + 1e-9 for r in got)
    assert got[0]["doc_id"] == 5 and got[0]["query_tokens"] == ["cats", "unknownword", "cats", "rabbit"]
    assert {r["doc_id"]: r["matched_terms"] for r in got}[5] == ["cats", "rabbit"]
    assert search.search(built, "nothing known").count() == 0
    assert search.search(built, "").count() == 0
    assert search.search(built, "cats", 0).count() == 0
    assert search.search(built, "cats rabbits", -1).count() == 2


def test_hits_without_publication_leave_gaps(spark, built):
    hits = search.search(built, "cats rabbits")
    publications = spark.createDataFrame([(5, "five")], "doc_id int, title string")
    assert [(r["rank"], r["title"]) for r in search.with_publications(hits, publications, "doc_id").collect()] == [(hits.where("doc_id = 5").first()["rank"], "five")]


def test_empty_corpus(spark):
    empty = index.build(spark.createDataFrame([], "doc_id int, text string"), "doc_id", F.col("text"))
    assert empty.weights.count() == 0 and empty.metadata().first()["document_count"] == 0 and search.search(empty, "x cats").count() == 0


def lloyd(x, k, state=42):
    centres, labels = x[np.random.default_rng(state).choice(len(x), size=k, replace=False)].copy(), None
    for turn in range(1, 101):
        new = np.linalg.norm(x[:, None] - centres[None], axis=2).argmin(1)
        for c in range(k):
            if (new == c).any():
                centres[c] = x[new == c].mean(0)
        if labels is not None and (labels == new).all():
            return new, turn
        labels = new
    return labels, 100


def test_kmeans_matches_a_dense_loop(spark):
    x = np.random.default_rng(1).random((40, 5))
    ids = spark.createDataFrame([(i, i) for i in range(40)], "id bigint, ordinal bigint")
    points = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(5)], "id bigint, term int, weight double")
    model = cluster.fit_kmeans(ids, points, 3)
    labels, turns = lloyd(x, 3)
    assert [r["cluster"] for r in model.labels.orderBy("id").collect()] == labels.tolist() and model.iterations == turns
    for k in (0, -1, 41):
        with pytest.raises(ValueError):
            cluster.fit_kmeans(ids, points, k)


def test_empty_cluster_keeps_centroid(spark):
    points = spark.createDataFrame([(1, "a", 1.0)], "id int, term string, weight double")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "id int, cluster int")
    centroids = spark.createDataFrame([(0, "z", 1.0), (1, "b", 0.5)], "cluster int, term string, weight double")
    assert {(r["cluster"], r["term"], r["weight"]) for r in cluster.update(points, labels, centroids).collect()} == {(0, "a", 0.5), (1, "b", 0.5)}


def test_corpus_clusters_and_predicts(spark):
    docs = corpus(spark)
    rows = docs.orderBy("ordinal").collect()
    assert len(rows) == 135 and Counter(r["category"] for r in rows) == {"Economics": 45, "Entertainment": 45, "Politics": 45}
    assert rows[0]["text"].startswith("Economics finance market inflation, central banks, and interest rates inflation") and rows[134]["text"].startswith("Government political authority local government, planning rules")
    model = cluster.fit_texts(docs)
    got = model.summaries.orderBy("cluster").collect()
    assert [(r["majority_category"], r["documents"]) for r in got] == [("Entertainment", 45), ("Economics", 45), ("Politics", 45)]
    assert all(len(r["top_terms"]) == 8 for r in got)
    texts = spark.createDataFrame([(1, "central bank interest rates and inflation"), (2, "zzz qqq"), (3, "parliament election vote"), (4, None)], "id int, text string")
    found = {r["id"]: r for r in cluster.predict(texts, model).collect()}
    assert found[1]["majority_category"] == "Economics" and found[3]["majority_category"] == "Politics"
    assert found[2]["cluster"] is None and found[2]["majority_category"] == "Unknown" and found[2]["top_terms"] == [] and found[4]["distance"] is None


PUBLICATION = "publication_key string, title string, authors array<struct<name:string,profile_url:string,affiliation:string>>, publication_year int, source string, publication_type string, searchable_text string, updated_at timestamp"


@pytest.fixture(scope="module")
def publications(spark):
    rows = [("a", "Beta.", [("Jane Doe", "u", None)], 2001, "Journal", None, "x", None), ("b", "Alpha", [], None, None, "Book", "x", None), ("c", None, None, 2003, "", "Talk", "x", None), ("d", "betA two", [("J. Roe", None, None)], 2001, "J(1)", None, "x", None)]
    return spark.createDataFrame(rows, PUBLICATION)


def test_browse(publications):
    keys = lambda **kw: [r["publication_key"] for r in browse.browse(publications, **kw).collect()]
    assert keys() == ["c", "a", "d", "b"] and keys(sort_by="oldest") == ["b", "a", "d", "c"] and keys(sort_by="title")[0] == "c" and keys(sort_by="?") == keys()
    assert keys(year=2001, author_query="DOE") == ["a"] and keys(text_query="beta") == ["a", "d"] and keys(text_query="(1)") == ["d"] and keys(text_query=".") == ["a"]
    assert len(keys(limit=0)) == 4 and len(keys(limit=2)) == 2
    assert "searchable_text" not in browse.browse(publications).columns
    assert [r[0] for r in browse.years(publications).collect()] == [2003, 2001]


def test_display(publications):
    got = {i: r for i, r in enumerate(browse.displayed(publications).collect())}
    assert got[0]["authors"] == "[Jane Doe](u)" and got[1]["authors"] == "Unknown authors" and got[1]["source"] == "Book" and got[1]["year"] == "Unknown year" and got[2]["title"] == "Untitled publication" and got[2]["source"] == "Talk"


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.check()
    schema = "ord int, publication_url string, title string, authors array<struct<name:string,profile_url:string,affiliation:string>>, publication_year int, source string, publication_type string, abstract string, full_text string"
    batch = lambda *rows: spark.createDataFrame([(i, u, t, [(n, None, None)], 2001, None, None, None, "f") for i, (u, t, n) in enumerate(rows)], schema)
    assert s.read("publications").count() == 0 and s.version("publications") is None
    assert s.upsert_publications(batch(("u1", "old", "A"), ("u2", "two", "A"), ("u1", "new", "A"))) == 2
    before = {r["publication_url"]: r for r in s.read("publications").collect()}
    assert before["u1"]["title"] == "new"
    assert s.upsert_publications(batch(("u1", "newer", "A"), ("u3", "three", "B"))) == 2
    after = {r["publication_url"]: r for r in s.read("publications").collect()}
    assert set(after) == {"u1", "u2", "u3"} and after["u1"]["title"] == "newer" and after["u1"]["first_seen_at"] == before["u1"]["first_seen_at"] and after["u1"]["updated_at"] > before["u1"]["updated_at"]
    people = {r["name"]: r["publication_keys"] for r in s.read("authors").collect()}
    assert len(people["A"]) == 2 and len(people["B"]) == 1 and s.repeated_keys("publications", "publication_key").count() == 0
    built = index.build(s.read("publications"), "publication_key", indexed_text())
    assert search.search(built, "newer").count() == 1


def test_commits_and_appends(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.check()
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "name int, v string")
    s.replace_all({"a": rows(1, 2), "b": rows(3)})
    first = s.state()
    s.append("a", rows(4))
    assert sorted(r[0] for r in s.read("a").collect()) == [1, 2, 4] and s.version("a")[:1] == first[1]["a"] and len(s.version("a")) == 2
    with pytest.raises(Exception, match="exist"):  # another writer went first
        s._commit(first[0], {})
    with pytest.raises(ValueError):
        s.replace("index_metadata", rows(1, 1))
    assert s.commits() == [1, 2] and s.version("index_metadata") is None
    s.replace("b", rows(5, 6))
    s.vacuum(1)
    assert s.commits() == [3] and s.read("b").count() == 2 and s.read("a").count() == 3
    assert {f.name for f in (tmp_path / "db" / "b").iterdir()} == set(s.version("b")) and not list((tmp_path / "db" / "index_metadata").iterdir())
    with pytest.raises(RuntimeError):
        s.read("none")


def test_shared_folder_is_never_local_on_a_cluster(spark):
    from types import SimpleNamespace as Fake

    from lexigraph.session import shared_folder

    held = lambda empty: Fake(isEmpty=lambda: empty, get=lambda: "hdfs://x/")
    session = lambda master, empty, conf=None: Fake(conf=Fake(get=lambda *a: conf), sparkContext=Fake(master=master, _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: held(empty)))))
    with pytest.raises(RuntimeError):
        shared_folder(session("local-cluster[3,2,1000]", True))
    assert shared_folder(session("yarn", False)) == "hdfs://x" and shared_folder(session("yarn", True, "s3://y/")) == "s3://y"


@pytest.mark.parametrize("k", [1, 3, 5])
def test_assignment_against_all_distances(spark, k):
    """Sparse points and centroids with negative weights, empty points and centroids, ties."""
    import random

    r = random.Random(k)
    points = {i: {t: r.choice([-2.0, -1.0, 1.0, 3.0]) for t in r.sample("abcdefgh", r.randint(0, 3))} for i in range(40)}
    centres = {c: {t: r.choice([-1.0, 1.0, 2.0]) for t in r.sample("abcdefgh", r.randint(0, 2))} for c in range(k)}
    flat = lambda d: [(i, t, w) for i, own in d.items() for t, w in own.items()]
    got = cluster.assign(spark.createDataFrame([(i,) for i in points], "id int"), spark.createDataFrame(flat(points), "id int, term string, weight double"), spark.createDataFrame(flat(centres), "cluster int, term string, weight double"), k)
    square = lambda a, b: round(sum((a.get(t, 0) - b.get(t, 0)) ** 2 for t in {*a, *b}) ** 0.5, 9)
    assert {x["id"]: (x["distance"], x["cluster"]) for x in got.collect()} == {i: min((square(p, c), n) for n, c in centres.items()) for i, p in points.items()}
