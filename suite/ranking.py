"""Registered queries: fusion, hybrid search, reranking and its explanation."""

from pyspark.sql import functions as F

from rankloom.operators import fusion, rerank as ops
from rankloom.operators.analysis import analyze_query
from rankloom.operators.lexical import bm25, topk_per_query
from rankloom.operators.present import attach_documents
from rankloom.operators.sizing import lookup_join
from rankloom.operators.vectors import embed_query, knn_exact
from rankloom.plans import search
from rankloom.plans.ingest import enrich
from rankloom.sources.synonyms import default_synonyms
from rankloom.workspace import materialize

from .inputs import CORPUS, as_of, corpus, passages, with_ctes
from .lexical import BASE, CONTENT, FUZZY_BASE, TOP10, _DATE_CONDITION, _FRESH, _POPULAR, _TERMS_CONDITION
from .vectors import DOC_VECTORS, KNN_DOCUMENTS, QUERY_VECTORS

SCALED = {
    "pair_score": "cross", "score": "original", "popularity_score": "popular", "freshness_score": "fresh",
}


def _docs(spark, sf_dir):
    return enrich(corpus(spark, sf_dir), as_of())


def _fused(spark, sf_dir):
    """BM25 over contents fused with the nearest documents."""
    queries = passages(spark, sf_dir)
    analyzed = analyze_query(queries, default_synonyms(spark))
    scored = bm25(corpus(spark, sf_dir), analyzed).withColumn("score", F.round("score", 6))
    near = knn_exact(_docs(spark, sf_dir), embed_query(queries), 10)
    return fusion.rrf_fusion(topk_per_query(scored, 10), near)


def _candidates(spark, sf_dir):
    fused = materialize(_fused(spark, sf_dir), "fused")
    with_docs = attach_documents(fused, _docs(spark, sf_dir))
    pairs = lookup_join(with_docs, passages(spark, sf_dir).select("query_id", "query"), ["query_id"], ["id"])
    return ops.pair_score(pairs), fused


def _reranked(spark, sf_dir):
    candidates, fused = _candidates(spark, sf_dir)
    scored = ops.composite_score(candidates).withColumnRenamed("rank", "orig_rank")
    return ops.rank_improvement(ops.rerank_topk(scored, 10), fused), fused


def _shown(fused):
    return fused.select("query_id", "id", "rank", F.round("score", 9).alias("score"), "original_score_type")


def rrf_fusion(spark, sf_dir):
    return _shown(_fused(spark, sf_dir))


def hybrid_search(spark, sf_dir):
    found = search.hybrid_search(_docs(spark, sf_dir), passages(spark, sf_dir), default_synonyms(spark))
    return _shown(found)


def hybrid_filtered(spark, sf_dir):
    found = search.hybrid_search(
        _docs(spark, sf_dir), passages(spark, sf_dir), default_synonyms(spark), filtered=True, as_of=as_of()
    )
    return _shown(found)


def pair_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", ops.pair_text(F.col("title"), F.col("content")).alias("pair_text"))


def pair_score(spark, sf_dir):
    candidates, _ = _candidates(spark, sf_dir)
    return candidates.select("query_id", "id", F.round("pair_score", 6).alias("pair_score"))


def minmax_norm(spark, sf_dir):
    candidates, _ = _candidates(spark, sf_dir)
    scaled = ops.minmax_norm(candidates, SCALED)
    return scaled.select("query_id", "id", *[F.round(c, 6).alias(c) for c in SCALED.values()])


def composite_score(spark, sf_dir):
    candidates, _ = _candidates(spark, sf_dir)
    part = F.col("score_breakdown")
    return ops.composite_score(candidates).select(
        "query_id", "id", F.round("final_score", 6).alias("final_score"),
        F.round(part["cross_encoder"], 6).alias("cross"), F.round(part["original_es"], 6).alias("original"),
        F.round(part["popularity"], 6).alias("popular"), F.round(part["freshness"], 6).alias("fresh"),
        part["weights"]["cross_encoder"].alias("cross_weight"), part["weights"]["original"].alias("original_weight"),
    )


def rerank_topk(spark, sf_dir):
    """The complete search: fuzzy multi-field text list, vector list, fusion, reranking."""
    found = search.search(_docs(spark, sf_dir), passages(spark, sf_dir), default_synonyms(spark), 10)
    return found.select(
        "query_id", "id", "title", "orig_rank", "new_rank", "improvement", F.round("score", 9).alias("score"),
        F.round("cross_encoder_score", 6).alias("cross_encoder_score"), F.round("final_score", 6).alias("final_score"),
    )


def search_own_sizes(spark, sf_dir):
    """The complete search in which every query names the size of its result, 1 to 50."""
    queries = passages(spark, sf_dir).withColumn("top_k", (F.col("query_id") * 7 % 50 + 1).cast("int"))
    found = search.search(_docs(spark, sf_dir), queries, default_synonyms(spark), None)
    return found.select("query_id", "id", "orig_rank", "new_rank", F.round("final_score", 6).alias("final_score"))


def no_rerank(spark, sf_dir):
    """The original order with only the cut applied."""
    found = search.rerank(
        _fused(spark, sf_dir), _docs(spark, sf_dir), passages(spark, sf_dir), 10, no_rerank=True
    )
    return found.select("query_id", "id", "orig_rank", "new_rank", "improvement")


def rank_improvement(spark, sf_dir):
    reranked, _ = _reranked(spark, sf_dir)
    return reranked.select("query_id", "id", "orig_rank", "new_rank", "improvement")


def rerank_summary(spark, sf_dir):
    reranked, fused = _reranked(spark, sf_dir)
    return ops.rerank_summary(reranked, fused).withColumn("avg_positive_change", F.round("avg_positive_change", 6))


def explanation(spark, sf_dir):
    reranked, _ = _reranked(spark, sf_dir)
    return ops.explanation(reranked)


QUERIES = {f.__name__: f for f in (
    rrf_fusion, hybrid_search, hybrid_filtered, pair_text, pair_score, minmax_norm, composite_score, rerank_topk,
    search_own_sizes, no_rerank, rank_improvement, rerank_summary, explanation,
)}

_VECTORS = (*DOC_VECTORS, *QUERY_VECTORS, KNN_DOCUMENTS)


def _fused_ctes(text: str, near: str) -> tuple:
    """``fused`` from two ranked lists."""
    return f"""stacked AS (
  SELECT query_id, id, 0 AS list_no, rank FROM {text} UNION ALL SELECT query_id, id, 1, rank FROM {near})""", """fused AS (
  SELECT query_id, id, sum(1.0::DOUBLE / (40 + rank)) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (40 + rank)), 9) DESC,
                            min({'list_no': list_no, 'rank': rank}), id) AS rank
  FROM stacked GROUP BY query_id, id)"""


def _top(source: str, name: str, size: int = 10) -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {source} QUALIFY rank <= {size})"""


_NEAR = _top("vector_scores", "near")
SIMPLE = (*BASE, CONTENT, TOP10, *_VECTORS, _NEAR, *_fused_ctes("top10", "near"))
FULL = (*FUZZY_BASE, _top("matches", "text_list"), *_VECTORS, _NEAR, *_fused_ctes("text_list", "near"))
_LARGEST = "(SELECT max(query_id * 7 % 50 + 1) FROM queries)"
_OWN = (*FUZZY_BASE, _top("matches", "text_list", _LARGEST), *_VECTORS, _top("vector_scores", "near", _LARGEST),
        *_fused_ctes("text_list", "near"))
_FILTERED = (
    *FUZZY_BASE,
    f"""filtered AS (SELECT query_id, id, score FROM matches JOIN corpus USING (id) JOIN queries USING (query_id)
  WHERE {_TERMS_CONDITION} AND {_DATE_CONDITION})""",
    _top("filtered", "text_list"), *_VECTORS,
    f"""near_allowed AS (SELECT query_id, id, score FROM vector_scores JOIN corpus USING (id) JOIN queries USING (query_id)
  WHERE {_TERMS_CONDITION} AND {_DATE_CONDITION})""",
    _top("near_allowed", "near"), *_fused_ctes("text_list", "near"))
_PAIR_TEXT = "title || '. ' || content"
RERANK = (f"""pairs_scored AS (
  SELECT query_id, id, title, content, score, rank AS orig_rank, {_POPULAR} AS popularity, {_FRESH} AS freshness,
         coalesce(len(list_filter(asked, lambda w: list_contains(found, w))) / nullif(len(asked), 0), 0.0) AS pair_score
  FROM (SELECT *, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS asked,
               list_distinct(regexp_extract_all(lower({_PAIR_TEXT}), '[\\p{{L}}\\p{{N}}]+')) AS found
        FROM fused JOIN corpus USING (id) JOIN (SELECT query_id, query FROM queries) USING (query_id)))""",
  "scaled AS (SELECT *, " + ", ".join(
      f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0.0::DOUBLE "
      f"ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {name}"
      for c, name in (("pair_score", "cross_s"), ("score", "original"), ("popularity", "popular"), ("freshness", "fresh"))
  ) + " FROM pairs_scored WINDOW w AS (PARTITION BY query_id))",
  """finals AS (
  SELECT *, 0.6::DOUBLE * cross_s + 0.25::DOUBLE * original + 0.1::DOUBLE * popular + 0.05::DOUBLE * fresh AS final_score
  FROM scaled)""", """reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, orig_rank) AS new_rank,
         orig_rank - new_rank AS improvement
  FROM finals QUALIFY new_rank <= 10)""")

_SHOW = "SELECT query_id, id, rank, round(score, 9) AS score, 'rrf_manual' AS original_score_type FROM fused"
ORACLE = {
    "rrf_fusion": with_ctes(_SHOW, *SIMPLE),
    "hybrid_search": with_ctes(_SHOW, *FULL),
    "hybrid_filtered": with_ctes(_SHOW, *_FILTERED),
    "pair_text": with_ctes(f"SELECT id, {_PAIR_TEXT} AS pair_text FROM corpus", CORPUS),
    "pair_score": with_ctes("SELECT query_id, id, round(pair_score, 6) AS pair_score FROM pairs_scored", *SIMPLE, *RERANK),
    "minmax_norm": with_ctes("""
        SELECT query_id, id, round(cross_s, 6) AS "cross", round(original, 6) AS original, round(popular, 6) AS popular,
               round(fresh, 6) AS fresh FROM scaled""", *SIMPLE, *RERANK),
    "composite_score": with_ctes("""
        SELECT query_id, id, round(final_score, 6) AS final_score, round(cross_s, 6) AS "cross",
               round(original, 6) AS original, round(popular, 6) AS popular, round(fresh, 6) AS fresh,
               0.6::DOUBLE AS cross_weight, 0.25::DOUBLE AS original_weight FROM finals""", *SIMPLE, *RERANK),
    "rerank_topk": with_ctes("""
        SELECT query_id, id, title, orig_rank, new_rank, improvement, round(score, 9) AS score,
               round(cross_s, 6) AS cross_encoder_score, round(final_score, 6) AS final_score
        FROM reranked""", *FULL, *RERANK),
    "search_own_sizes": with_ctes("""
        SELECT query_id, id, orig_rank, new_rank, round(final_score, 6) AS final_score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, orig_rank) AS new_rank
              FROM finals) WHERE new_rank <= query_id * 7 % 50 + 1""", *_OWN, *RERANK[:3]),
    "no_rerank": with_ctes("""
        SELECT query_id, id, rank AS orig_rank, rank AS new_rank, CAST(0 AS BIGINT) AS improvement FROM fused
        WHERE rank <= 10""", *SIMPLE),
    "rank_improvement": with_ctes(
        "SELECT query_id, id, orig_rank, new_rank, improvement FROM reranked", *SIMPLE, *RERANK),
    "rerank_summary": with_ctes("""
        SELECT query_id, any_value(n) AS documents_processed, count(*) AS results_returned,
               count(*) FILTER (improvement > 0) AS improved,
               round(avg(improvement) FILTER (improvement > 0), 6) AS avg_positive_change
        FROM reranked JOIN (SELECT query_id, count(*) AS n FROM fused GROUP BY query_id) USING (query_id)
        GROUP BY query_id""", *SIMPLE, *RERANK),
    "explanation": with_ctes("""
        SELECT query_id, new_rank, printf('%d. %s... %s original %.3f, final %.3f, relevance %.3f, popularity %.2f, freshness %.2f',
               new_rank, left(title, 50),
               CASE WHEN improvement > 0 THEN '(+' || improvement || ')' WHEN improvement < 0 THEN '(' || improvement || ')'
                    ELSE '(=)' END,
               original, final_score, cross_s, popular, fresh) AS line
        FROM reranked WHERE new_rank <= 5""", *SIMPLE, *RERANK),
}
