"""Registered queries: sorting, tag search, boosts, chunks, retrieval metrics."""

from pyspark.sql import functions as F

from rankloom.operators import extras as ops
from rankloom.operators.analysis import analyze_query
from rankloom.operators.lexical import bm25, topk_per_query
from rankloom.operators.quality import freshness, popularity
from rankloom.sources.synonyms import default_synonyms

from .inputs import CORPUS, as_of, corpus, passages, table, with_ctes
from .lexical import BASE, CONTENT, TOP10, _FRESH, _POPULAR


def _scored(spark, sf_dir):
    analyzed = analyze_query(passages(spark, sf_dir), default_synonyms(spark))
    return bm25(corpus(spark, sf_dir), analyzed).select("query_id", "id", F.round("score", 6).alias("score"))


def _with_attributes(spark, sf_dir):
    docs = popularity(freshness(corpus(spark, sf_dir), as_of()))
    return _scored(spark, sf_dir).join(
        docs.select("id", "file_type", "github_stars", "created_at", "popularity_score", "freshness_score"), "id"
    )


def sort_modes(spark, sf_dir):
    matches = _with_attributes(spark, sf_dir)
    modes = [
        ops.sort_modes(matches, mode, 10).select(F.lit(mode).alias("mode"), "query_id", "id", "rank")
        for mode in ("relevance", "popularity", "date")
    ]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


def tag_search(spark, sf_dir):
    """Documents tagged with a source that has a labelled toxic document."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    wanted = table(spark, sf_dir, "documents").join(toxic, "doc_id").select(F.col("source").alias("tag"))
    return ops.tag_search(corpus(spark, sf_dir), wanted)


def boosted_score(spark, sf_dir):
    boosted = ops.boosted_score(F.col("score"), recent=1.5, popular=2.0, official=3.0)
    return _with_attributes(spark, sf_dir).select("query_id", "id", F.round(boosted, 5).alias("score"))


def chunk_docs(spark, sf_dir):
    return ops.chunk_docs(corpus(spark, sf_dir), 200, 50)


def retrieval_metrics(spark, sf_dir):
    relevant = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    metrics = ops.retrieval_metrics(topk_per_query(_scored(spark, sf_dir), 10), relevant, 5)
    return metrics.select("query_id", *[
        F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")
    ])


QUERIES = {f.__name__: f for f in (sort_modes, tag_search, boosted_score, chunk_docs, retrieval_metrics)}

ORACLE = {
    "sort_modes": with_ctes("""
        SELECT mode, query_id, id, row_number() OVER (
                 PARTITION BY mode, query_id ORDER BY CASE mode WHEN 'relevance' THEN score
                   WHEN 'popularity' THEN github_stars ELSE epoch(created_at) END DESC, id) AS rank
        FROM content_scores JOIN corpus USING (id), (VALUES ('relevance'), ('popularity'), ('date')) AS m(mode)
        QUALIFY rank <= 10""", *BASE, CONTENT),
    "tag_search": with_ctes("""
        SELECT tag, id FROM (SELECT id, unnest(tags) AS tag FROM corpus)
        WHERE tag IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""", CORPUS),
    "boosted_score": with_ctes(f"""
        SELECT query_id, id, round(score * (1 + 0.5::DOUBLE * {_FRESH}) * (1 + {_POPULAR})
                 * (CASE WHEN file_type = 'documentation' THEN 3 ELSE 1 END), 5) AS score
        FROM content_scores JOIN corpus USING (id)""", *BASE, CONTENT),
    "chunk_docs": with_ctes(r"""
        SELECT id, n AS chunk_no, array_to_string(words[n * 150 + 1 : n * 150 + 200], ' ') AS chunk
        FROM (SELECT id, list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '') AS words FROM corpus),
             LATERAL (SELECT unnest(range(0, greatest(len(words) - 51, 0) // 150 + 1)) AS n)
        WHERE len(words) > 0""", CORPUS),
    "retrieval_metrics": with_ctes("""
        SELECT query_id, round(count(*) FILTER (good AND rank <= 5) / 5.0, 6) AS precision_at_k,
               round(count(*) FILTER (good AND rank <= 5)
                     / (SELECT count(DISTINCT doc_id)::DOUBLE FROM labels WHERE quality = 1), 6) AS recall_at_k,
               round(coalesce(1.0::DOUBLE / min(rank) FILTER (good), 0), 6) AS reciprocal_rank
        FROM (SELECT query_id, rank, id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1) AS good FROM top10)
        GROUP BY query_id""", *BASE, CONTENT, TOP10),
}
