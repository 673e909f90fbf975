import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import extras, rerank as ops
from rankloom.operators.fusion import rrf_fusion
from rankloom.operators.lexical import topk_per_query
from rankloom.plans import search
from rankloom.plans.ingest import enrich
from rankloom.sources.synonyms import default_synonyms


def hits(spark, ids):
    return spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "query_id long, id string, rank int")


def test_fusion_fixture(spark):
    got = rrf_fusion(hits(spark, "abc"), hits(spark, "cd")).orderBy("rank").collect()
    assert [r.id for r in got] == ["c", "a", "b", "d"]
    assert [round(r.score, 6) for r in got] == [0.047646, 0.02439, 0.02381, 0.02381]
    assert max(r.score for r in got) <= 2 / 41


CANDIDATES = [
    (1, "1", "Docker Deployment Best Practices", "docker", 0.5, 0.45, 0.8, 1),
    (1, "2", "FastAPI Authentication Tutorial", "fastapi", 0.65, 0.9, 0.6, 2),
    (1, "3", "Python Web Framework Comparison", "python", 0.6, 0.7, 0.6, 3),
]


def candidates(spark):
    return spark.createDataFrame(
        CANDIDATES,
        "query_id long, id string, title string, content string, score double, popularity_score double, "
        "freshness_score double, orig_rank long",
    )


def test_rerank_fixture(spark):
    scored = ops.composite_score(candidates(spark).withColumn("pair_score", F.lit(0.5)))
    top = ops.rerank_topk(scored, 3)
    done = ops.rank_improvement(top, candidates(spark).select("query_id", "id", F.col("orig_rank").alias("rank")))
    rows = done.orderBy("new_rank").collect()
    assert [r.id for r in rows] == ["2", "3", "1"]
    assert [round(r.final_score, 6) for r in rows] == [0.35, 0.222222, 0.05]
    assert [r.improvement for r in rows] == [1, 1, -2]
    assert round(rows[1].score_breakdown.popularity, 6) == 0.555556
    lines = [r.line for r in ops.explanation(done).orderBy("new_rank").collect()]
    assert lines[0].startswith("1. FastAPI Authentication Tutorial... (+1)")
    summary = ops.rerank_summary(done, candidates(spark)).first()
    assert (summary.documents_processed, summary.results_returned, summary.improved) == (3, 3, 2)
    assert summary.avg_positive_change == 1.0


def test_results_missing_before_count_from_the_end(spark):
    new = spark.createDataFrame([(1, "z", 1)], "query_id long, id string, new_rank long")
    assert ops.rank_improvement(new, hits(spark, "abc")).first().improvement == 3


def test_constant_lists_scale_to_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "query_id long, v double")
    got = sorted((r.query_id, r.s) for r in ops.minmax_norm(df, {"v": "s"}).collect())
    assert got == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 1.0)]


def test_pair_text_and_scorers(spark):
    df = spark.createDataFrame([("api auth", "Api", "x" * 600)], "query string, title string, content string")
    assert len(df.select(ops.pair_text(F.col("title"), F.col("content"), 512).alias("t")).first().t) == 512
    assert ops.pair_score(df).first().pair_score == 0.5

    class Broken:
        def predict(self, pairs, batch_size):
            raise ValueError

    class Lengths:
        def predict(self, pairs, batch_size):
            return [float(len(q)) for q, _ in pairs]

    with pytest.raises(Exception, match="ValueError"):
        ops.pair_score(df, ops.model_scorer(Broken)).first()
    assert ops.pair_score(df, ops.model_scorer(Lengths)).first().pair_score == 8.0


def test_search_end_to_end(spark):
    rows = [
        ("1", "FastAPI tutorial", "build an api with fastapi and jwt", "tutorial", "2023-01-01", 900, 10, "en", ["api"], "docs"),
        ("2", "Docker guide", "deploy a container with docker", "documentation", "2024-01-01", 50, 10, "en", ["docker"], "docs"),
        ("3", "Guide de securite", "authentification des utilisateurs", "blog", "2022-01-01", 5, 10, "fr", ["auth"], "blog"),
    ]
    docs = spark.createDataFrame(
        rows,
        "id string, title string, content string, file_type string, d string, github_stars int, view_count int, "
        "language string, tags array<string>, source string",
    ).withColumns({"created_at": F.to_timestamp("d"), "modified_at": F.to_timestamp("d")}).drop("d")
    docs = enrich(docs, F.to_timestamp(F.lit("2024-07-01")))
    none = F.array().cast("array<string>")
    queries = spark.createDataFrame([(1, "FastAPI"), (2, "fastapy"), (3, "utilisateurs"), (4, "  ")], "query_id long, query string")
    queries = queries.select(
        "*", F.when(F.col("query_id") == 3, F.array(F.lit("fr"))).otherwise(none).alias("filter_language"),
        none.alias("filter_source"), none.alias("filter_file_type"),
        F.lit(None).cast("timestamp").alias("date_from"), F.lit(None).cast("timestamp").alias("date_to"))
    got = search.search(docs, queries, default_synonyms(spark), 2, filtered=True).orderBy("query_id", "new_rank").collect()
    best = {r.query_id: r.id for r in got if r.new_rank == 1}
    assert best == {1: "1", 2: "1", 3: "3"}
    assert {r.id for r in got if r.query_id == 3} == {"3"}


def test_chunks_cover_the_text(spark):
    words = [f"w{i}" for i in range(430)]
    df = spark.createDataFrame([("1", " ".join(words)), ("2", "a b"), ("3", "")], "id string, content string")
    rows = extras.chunk_docs(df, 200, 50).orderBy("id", "chunk_no").collect()
    first = [r.chunk.split() for r in rows if r.id == "1"]
    assert [c[0] for c in first] == ["w0", "w150", "w300"] and first[-1][-1] == "w429"
    assert [r.chunk for r in rows if r.id == "2"] == ["a b"] and not [r for r in rows if r.id == "3"]


def test_metrics(spark):
    ranked = hits(spark, "abcd").union(hits(spark, "xyz").withColumn("query_id", F.lit(2)))
    relevant = spark.createDataFrame([("b",), ("d",), ("q",)], "id string")
    got = {r.query_id: r for r in extras.retrieval_metrics(ranked, relevant, 2).collect()}
    assert got[1].precision_at_k == 0.5 and math.isclose(got[1].recall_at_k, 1 / 3) and got[1].reciprocal_rank == 0.5
    assert got[2].precision_at_k == 0 and got[2].reciprocal_rank == 0
    pairs = spark.createDataFrame([(1, "a"), (2, "q")], "query_id long, id string")
    got = {r.query_id: r for r in extras.retrieval_metrics(ranked, pairs, 2).collect()}
    assert got[1].recall_at_k == 1.0 and got[2].recall_at_k == 0.0


def test_metrics_rank_once(spark):
    """Ranked lists are sized, joined and counted; the ranking itself is not repeated for each."""
    rows = [(q, str(i), float(i % 7)) for q in (1, 2) for i in range(20)]
    ranked = topk_per_query(spark.createDataFrame(rows, "query_id long, id string, score double"), 5)
    relevant = spark.createDataFrame([("6",), ("13",)], "id string")
    found = extras.retrieval_metrics(ranked, relevant, 5)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.precision_at_k, r.recall_at_k, r.reciprocal_rank) for r in found.collect()} == {
        (1, 0.4, 1.0, 1.0), (2, 0.4, 1.0, 1.0)}
