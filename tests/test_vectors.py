import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.arrays import l2_normalize
from rankloom.operators import vectors as ops
from suite import vectors as suite


def table(spark, matrix, id_name="id", vector="embedding"):
    rows = [(int(i), [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{id_name} long, {vector} array<float>")


def data(seed=1, n=300, dim=16):
    return np.random.default_rng(seed).standard_normal((n, dim)).astype("float32")


def brute(docs, queries, k, allowed=None):
    d = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    scores = np.round((1 + q.astype("float64") @ d.astype("float64").T) / 2, 6)
    out = set()
    for i, row in enumerate(scores):
        ids = [j for j in range(len(docs)) if allowed is None or allowed(i, j)]
        out |= {(i, j, r + 1) for r, j in enumerate(sorted(ids, key=lambda j: (-row[j], j))[:k])}
    return out


def ranked(df):
    return {(r.query_id, r.id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("max_queries", [4096, 0])
def test_exact_search_matches_numpy(spark, max_queries):
    docs, queries = data(), data(2, 7)
    docs[5:90] = docs[4]  # many copies tie and must resolve by id
    got = ops.knn_exact(
        table(spark, docs).repartition(5), table(spark, queries, "query_id", "query_vector"), 12, max_queries=max_queries)
    want = brute(docs, queries, 12)
    assert ranked(got) == want


def test_grid_blocks_cover_every_pair(spark, monkeypatch):
    monkeypatch.setattr(ops, "MAX_QUERY_BLOCK", 3)
    monkeypatch.setattr(ops, "CORPUS_BLOCK", 50)
    docs, queries = data(3), data(4, 10)
    got = ops.knn_exact(table(spark, docs), table(spark, queries, "query_id", "query_vector"), 5, max_queries=0)
    assert ranked(got) == brute(docs, queries, 5)


def test_zero_vectors_never_match(spark):
    docs, queries = data(5, 10), data(6, 3)
    docs[2] = 0
    queries[1] = 0
    got = ops.knn_exact(table(spark, docs), table(spark, queries, "query_id", "query_vector"), 10)
    rows = ranked(got)
    assert {q for q, _, _ in rows} == {0, 2} and all(d != 2 for _, d, _ in rows) and len(rows) == 18


def test_filtered_search(spark):
    docs, queries = data(7, 120), data(8, 4)
    corpus = table(spark, docs).select(
        "*", F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("language"),
        F.lit("s").alias("source"), F.lit("blog").alias("file_type"),
        F.to_timestamp(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))).alias("created_at"))
    none = F.array().cast("array<string>")
    filters = spark.range(4).select(
        F.col("id").alias("query_id"),
        F.when(F.col("id") == 1, F.array(F.lit("en"))).otherwise(none).alias("filter_language"),
        none.alias("filter_source"), F.when(F.col("id") == 3, F.array(F.lit("pdf"))).otherwise(none).alias("filter_file_type"),
        F.when(F.col("id") == 2, F.to_timestamp(F.lit("2024-01-10"))).alias("date_from"),
        F.when(F.col("id") == 2, F.to_timestamp(F.lit("2024-01-20"))).alias("date_to"))

    def allowed(q, d):
        return {0: True, 1: d % 2 == 0, 2: 10 <= d % 28 + 1 <= 20, 3: False}[q]

    for max_queries in (4096, 0):
        got = ops.knn_filtered(
            corpus, table(spark, queries, "query_id", "query_vector"), filters, 9, max_queries=max_queries)
        assert ranked(got) == brute(docs, queries, 9, allowed)


def test_lsh_recall(spark):
    centers = np.random.default_rng(9).standard_normal((20, 32))
    docs = (np.repeat(centers, 40, axis=0) + 0.25 * np.random.default_rng(10).standard_normal((800, 32))).astype("float32")
    queries = centers[:10].astype("float32")
    asked, corpus = table(spark, queries, "query_id", "query_vector"), table(spark, docs)
    index = ops.tune_lsh(corpus, asked, 10, 32)
    met = ops.lsh_candidates(corpus, asked, index).count()
    assert met < 0.25 * 10 * 800  # buckets, not the whole product
    exact, near = ranked(ops.knn_exact(corpus, asked, 10)), ranked(ops.knn_lsh(corpus, asked, 10, dim=32))
    pairs = {(q, d) for q, d, _ in exact}
    assert len(pairs & {(q, d) for q, d, _ in near}) / len(pairs) >= 0.9


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_lsh_recall_on_the_given_tables(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    pairs = [{(r.query_id, r.id) for r in q(spark, folder).collect()} for q in (suite.knn_exact, suite.knn_lsh)]
    assert len(pairs[0]) == 500 and len(pairs[0] & pairs[1]) >= 0.9 * 500
    corpus, asked = suite._vectors(spark, folder), suite._centroids(spark, folder)
    index = ops.tune_lsh(corpus, asked, 50, suite.DIM)
    # these vectors hardly gather, so most buckets have to be looked into; still not all
    assert index is not None and ops.lsh_candidates(corpus, asked, index).count() < 0.9 * corpus.count() * asked.count()


def test_lsh_beside_its_bounds(spark):
    docs, queries = data(21, 90, 8), data(22, 5, 8)
    corpus, asked = table(spark, docs), table(spark, queries, "query_id", "query_vector")
    want = brute(docs, queries, 7)
    narrow = ops.SignIndex(8, 2, 16, 0)  # too few candidates: searched exactly
    assert ranked(ops.knn_lsh(corpus, asked, 7, 8, index=narrow)) == want
    assert ranked(ops.knn_lsh(corpus, asked, 7, 8, recall=1.1)) == want  # no setting is that good
    everything = ops.SignIndex(8, 2, 4, 2)
    got = ops.lsh_candidates(corpus.unionByName(corpus), asked, everything)
    assert got.count() == got.distinct().count()
    nothing = corpus.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert ops.knn_lsh(nothing, asked, 7, 8).count() == 0
    assert ops.knn_lsh(corpus, asked.limit(0), 7, 8).count() == 0


def test_documents_are_embedded_once(spark):
    docs = spark.createDataFrame([(str(i), f"title {i}", f"content {i} words") for i in range(20)], "id string, title string, content string")
    queries = spark.createDataFrame([(1, "title 3"), (2, " ")], "query_id long, query string")
    found = ops.knn_exact(ops.embed_docs(docs), ops.embed_query(queries), 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # titles and contents are embedded, then blended: one node each way, none repeated
    assert plan.count("ArrowEvalPython") == 2, plan
    assert {r.query_id for r in found.collect()} == {1}


@pytest.mark.parametrize("max_queries", [4096, 0])
def test_similarity_threshold(spark, max_queries):
    docs = data(11, 60, 4)
    unit = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    cosine = np.round(unit.astype("float64") @ unit.astype("float64").T, 6)
    want = {(i, j) for i, j in zip(*np.nonzero(cosine >= 0.7))}
    got = ops.similarity_matrix(table(spark, docs), 0.7, max_queries=max_queries)
    assert {(r.query_id, r.id) for r in got.collect()} == want


def test_pairs_far_apart_are_not_compared(spark, monkeypatch):
    """Groups far from each other: the pairs are those of a full product, few blocks are compared."""
    rng = np.random.default_rng(31)
    centers = rng.standard_normal((12, 24))
    docs = (np.repeat(centers, 30, axis=0) + 0.15 * rng.standard_normal((360, 24))).astype("float32")
    docs[7] = 0
    docs[40:80] = docs[41]  # copies fill several blocks of one pivot
    unit = docs / np.maximum(np.linalg.norm(docs, axis=1, keepdims=True), 1e-30)
    cosine = np.round(unit.astype("float64") @ unit.astype("float64").T, 6)
    monkeypatch.setattr(ops, "PIVOT_ROWS", 8)
    monkeypatch.setattr(ops, "MAX_QUERY_BLOCK", 16)
    for threshold in (0.8, 0.0, -1.0):
        want = {(i, j) for i, j in zip(*np.nonzero(cosine >= threshold)) if i != 7 and j != 7}
        rows = ops.similarity_matrix(table(spark, docs), threshold, max_queries=0).collect()
        assert len(rows) == len(want) and {(r.query_id, r.id) for r in rows} == want
    corpus = table(spark, docs).select("id", F.col("embedding").alias("vector"))
    pivots, placed = ops._around_pivots(corpus, 24, 360)
    held = {r.pivot: (r.n, r.radius) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    met = ops.near_pivots(pivots, {p: r for p, (_, r) in held.items()}, 0.8)
    verified = sum(held[p][0] * held[q][0] * (1 if p == q else 2) for p, q in met)
    assert verified < 0.5 * 359**2


def test_default_embedder(spark):
    rows = [("0", "", "Python web framework"), ("1", "", "Flask web development"), ("2", "", "Database optimization"), ("3", "", " ")]
    got = ops.embed_text(spark.createDataFrame(rows, "id string, title string, content string"), "content")
    v = {r.id: np.array(r.embedding) for r in got.collect()}
    assert len(v["0"]) == 384 and np.isclose(np.linalg.norm(v["0"]), 1.0, atol=1e-6)
    assert v["0"] @ v["1"] > v["0"] @ v["2"]
    assert not v["3"].any()


def test_document_blend(spark):
    df = spark.createDataFrame([("1", "alpha", "beta"), ("2", "", "beta"), ("3", "", "")], "id string, title string, content string")
    v = {r.id: np.array(r.embedding) for r in ops.embed_docs(df).collect()}
    assert np.isclose(np.linalg.norm(v["1"]), 1.0, atol=1e-6)
    nonzero = sorted(np.abs(v["1"][v["1"] != 0]))
    assert np.isclose(nonzero[1] / nonzero[0], 1.5, rtol=1e-5)
    assert np.isclose(np.linalg.norm(v["2"]), 1.0, atol=1e-6) and not v["3"].any()


def test_model_embedder_is_pluggable(spark):
    class Model:
        def encode(self, texts, batch_size):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("1", " abc ", "x")], "id string, title string, content string")
    got = ops.embed_text(df, "title", embedder=ops.model_embedder(Model)).first().embedding
    assert np.allclose(got, np.array([3.0, 1.0]) / np.sqrt(10))


def test_array_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "a array<double>")
    got = df.select(l2_normalize(F.col("a")).alias("n")).collect()
    assert got[0].n == [0.6, 0.8] and got[1].n == [0.0, 0.0]


def test_null_and_uneven_vectors(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    docs = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", None)], "id string, embedding array<double>")
    assert [r.id for r in ops.knn_exact(docs, asked, 5).collect()] == ["a"]
    uneven = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0] * 6)], "id string, embedding array<double>")
    with pytest.raises(Exception, match="a vector of length 4 was expected"):
        ops.knn_exact(uneven, asked, 5).collect()


def test_pivots_that_all_meet_share_cells(spark, monkeypatch):
    """Where no pair of pivots is ruled out, vectors are sent to few large cells, and the pairs stay the same."""
    every = [(p, q) for p in range(40) for q in range(p, 40)]
    assert len(set(ops.joined_cells(every, {p: 100 for p in range(40)}, 1000).values())) == 4
    alone = {p: p for p in range(40)}
    assert ops.joined_cells([(p, p) for p in range(40)], {p: 100 for p in range(40)}, 1000) == alone
    assert ops.joined_cells(every, {p: 5000 for p in range(40)}, 1000) == alone
    rng = np.random.default_rng(8)
    docs = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))]
    frame = spark.createDataFrame(docs, "id long, embedding array<double>")
    monkeypatch.setattr(ops, "PIVOT_ROWS", 8)
    sent = []
    for most in (60, 9):
        monkeypatch.setattr(ops, "MAX_QUERY_BLOCK", most)
        got = {(r.query_id, r.id, round(r.score, 6)) for r in ops.similarity_matrix(frame, 0.3, max_queries=0).collect()}
        sent.append(got)
    unit = [np.array(v) / np.linalg.norm(v) for _, v in docs]
    near = {(i, j) for i in range(200) for j in range(200) if unit[i] @ unit[j] >= 0.3}
    assert {(a, b) for a, b, _ in sent[0]} == near and sent[0] == sent[1]
