"""Hybrid search and reranking for a table of queries, as one composition."""

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.analysis import analyze_query
from ..operators.filters import date_condition, filter_matches, terms_condition
from ..operators.fusion import rrf_fusion
from ..operators.lexical import TextIndex, multi_match, topk_per_query
from ..operators.present import attach_documents
from ..operators.rerank import (
    WEIGHTS, composite_score, pair_score, rank_improvement, rerank_topk, term_share_scorer,
)
from ..operators.sizing import lookup_join
from ..operators.vectors import embed_query, knn_exact, knn_filtered
from ..workspace import materialize


def hybrid_lists(
    docs: DataFrame, queries: DataFrame, synonyms: DataFrame, k: int = 10, text_size: int = None,
    vector_size: int = None, fuzzy: bool = True, filtered: bool = False,
    as_of: Column = None, index: TextIndex = None, embedder=None,
) -> tuple:
    """The text and the vector list of each query; ``docs`` must carry ``embedding``.

    Both lists hold ``k`` rows unless they are given sizes of their own.
    """
    text_size, vector_size = text_size or k, vector_size or k
    asked = queries.filter(F.btrim("query") != "")
    analyzed = analyze_query(asked, synonyms)
    matches = multi_match(asked, analyzed, docs, index, fuzzy)
    vectors = embed_query(asked, embedder)
    if filtered:
        if as_of is not None:  # an open range ends at as_of for both lists
            open_end = F.when(F.col("date_from").isNotNull(), as_of)
            asked = asked.withColumn("date_to", F.coalesce("date_to", open_end))
        condition = terms_condition() & date_condition(as_of)
        matches = filter_matches(matches, docs, asked, condition)
        near = knn_filtered(docs, vectors, asked, vector_size)
    else:
        near = knn_exact(docs, vectors, vector_size)
    return topk_per_query(matches, text_size), near


def hybrid_search(docs: DataFrame, queries: DataFrame, synonyms: DataFrame, **options) -> DataFrame:
    """Text and vector lists fused by reciprocal rank."""
    return rrf_fusion(*hybrid_lists(docs, queries, synonyms, **options))


def rerank(
    fused: DataFrame, docs: DataFrame, queries: DataFrame, k: int,
    scorer=term_share_scorer, weights=WEIGHTS, no_rerank: bool = False,
) -> DataFrame:
    """Score the fused candidates, cut each list to ``k`` and report places gained."""
    fused = materialize(fused, "fused")
    candidates = attach_documents(fused, docs)
    asked = queries.select("query_id", "query")
    pairs = lookup_join(candidates, asked, ["query_id"], ["id"])
    scored = composite_score(pair_score(pairs, scorer), weights).withColumnRenamed("rank", "orig_rank")
    return rank_improvement(rerank_topk(scored, k, no_rerank=no_rerank), fused)


def search(docs: DataFrame, queries: DataFrame, synonyms: DataFrame, k: int = 10, **options) -> DataFrame:
    """Complete search: hybrid retrieval, fusion and reranking.

    The lists are as long as the result. With ``k`` None each query has the size in its own
    ``top_k``, and the lists that of the largest.
    """
    if k is not None:
        return rerank(hybrid_search(docs, queries, synonyms, k=k, **options), docs, queries, k)
    most = queries.agg(F.max("top_k")).first()[0] or 1
    found = rerank(hybrid_search(docs, queries, synonyms, k=most, **options), docs, queries, most)
    return found.join(queries.select("query_id", "top_k"), "query_id").filter("new_rank <= top_k").drop("top_k")
