"""Reranking of fused results with a pair scorer, popularity and freshness."""

from typing import Iterator, Tuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import tokens

# Weights of the composite score.
WEIGHTS = {"cross_encoder": 0.6, "original": 0.25, "popularity": 0.10, "freshness": 0.05}
PAIR_BATCH = 8


def pair_text(title: Column, content: Column, limit: int = None) -> Column:
    """What the pair scorer reads of a document: title and content, up to ``limit`` characters if given."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(content, F.lit("")))
    return joined if limit is None else F.left(joined, F.lit(limit))


def term_share_scorer(query: Column, text: Column) -> Column:
    """Default pair score: share of the distinct query terms that the text contains."""
    asked = F.array_distinct(tokens(query))
    found = F.array_intersect(asked, tokens(text))
    return F.coalesce(F.size(found) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def model_scorer(load_model, batch_size: int = PAIR_BATCH):
    """Pair scorer around ``load_model() -> model`` whose ``predict(pairs, batch_size)`` gives scores.

    The model is loaded once per task; a failing batch fails the task, so scores never depend on batches.
    """
    @F.pandas_udf("double")
    def predict(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load_model()
        for queries, texts in batches:
            yield pd.Series(model.predict(list(zip(queries, texts)), batch_size=batch_size), dtype="float64")

    return predict


def pair_score(candidates: DataFrame, scorer=term_share_scorer, limit: int = None) -> DataFrame:
    """Add ``pair_score`` for rows with ``query``, ``title`` and ``content``."""
    text = pair_text(F.col("title"), F.col("content"), limit)
    return candidates.withColumn("pair_score", scorer(F.col("query"), text))


def minmax_norm(df: DataFrame, columns: dict, group: str = "query_id") -> DataFrame:
    """Scale columns to 0-1 within each result list; a constant list becomes 0.

    ``columns`` maps a source column to the name of its scaled form.
    """
    per_list = Window.partitionBy(group)
    scaled = {}
    for source, into in columns.items():
        value = F.coalesce(F.col(source), F.lit(0.0))
        low, high = F.min(value).over(per_list), F.max(value).over(per_list)
        scaled[into] = F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low))
    return df.withColumns(scaled)


def composite_score(candidates: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Weighted sum of the scaled pair, retrieval, popularity and freshness scores."""
    scaled = minmax_norm(candidates, {
        "pair_score": "_cross", "score": "_original",
        "popularity_score": "_popular", "freshness_score": "_fresh",
    })
    final = (
        F.lit(weights["cross_encoder"]) * F.col("_cross")
        + F.lit(weights["original"]) * F.col("_original")
        + F.lit(weights["popularity"]) * F.col("_popular")
        + F.lit(weights["freshness"]) * F.col("_fresh")
    )
    breakdown = F.struct(
        F.col("_cross").alias("cross_encoder"), F.col("_original").alias("original_es"),
        F.col("_popular").alias("popularity"), F.col("_fresh").alias("freshness"),
        F.struct(*[F.lit(v).alias(k) for k, v in weights.items()]).alias("weights"),
    )
    return scaled.withColumns({
        "cross_encoder_score": F.col("_cross"),
        "final_score": final,
        "score_breakdown": breakdown,
    }).drop("_cross", "_original", "_popular", "_fresh")


def rerank_topk(scored: DataFrame, k: int, own_limit: str = None, no_rerank: bool = False) -> DataFrame:
    """The best ``k`` rows per query by final score; ``orig_rank`` breaks ties.

    With ``no_rerank`` the original order is kept and only the cut applies.
    """
    best = [F.asc("orig_rank")] if no_rerank else [F.desc(F.round("final_score", 9)), F.asc("orig_rank")]
    order = Window.partitionBy("query_id").orderBy(*best)
    kept = scored.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k)
    if own_limit:
        kept = kept.filter(F.col("new_rank") <= F.col(own_limit))
    return kept.withColumn("new_rank", F.col("new_rank").cast("long"))


def rank_improvement(reranked: DataFrame, original: DataFrame) -> DataFrame:
    """Add ``improvement``: places gained against the original list.

    A result the original list does not have counts from just after its end.
    """
    before = original.select("query_id", "id", F.col("rank").alias("_before"))
    sizes = original.groupBy("query_id").agg(F.count("*").alias("_size"))
    start = F.coalesce("_before", F.col("_size") + 1, F.lit(1))
    return (
        reranked.join(before, ["query_id", "id"], "left").join(sizes, "query_id", "left")
        .withColumn("improvement", (start - F.col("new_rank")).cast("long"))
        .drop("_before", "_size")
    )


def rerank_summary(reranked: DataFrame, original: DataFrame) -> DataFrame:
    """Per query: documents processed and returned, results that improved and by how much."""
    gained = F.col("improvement") > 0
    processed = original.groupBy("query_id").agg(F.count("*").alias("documents_processed"))
    summary = reranked.groupBy("query_id").agg(
        F.count("*").alias("results_returned"),
        F.count_if(gained).alias("improved"),
        F.avg(F.when(gained, F.col("improvement"))).alias("avg_positive_change"),
    )
    return processed.join(summary, "query_id", "left").select(
        "query_id", "documents_processed",
        F.coalesce("results_returned", F.lit(0)).alias("results_returned"),
        F.coalesce("improved", F.lit(0)).alias("improved"),
        "avg_positive_change",
    )


def explanation(reranked: DataFrame, shown: int = 5, title_size: int = 50) -> DataFrame:
    """One readable line for each of the first results of a query."""
    gain = F.col("improvement")
    change = F.when(gain > 0, F.format_string("(+%d)", gain)).when(gain < 0, F.format_string("(%d)", gain)).otherwise("(=)")
    parts = F.col("score_breakdown")
    line = F.format_string(
        "%d. %s... %s original %.3f, final %.3f, relevance %.3f, popularity %.2f, freshness %.2f",
        F.col("new_rank"), F.left("title", F.lit(title_size)), change, parts["original_es"], F.col("final_score"),
        parts["cross_encoder"], parts["popularity"], parts["freshness"],
    )
    return reranked.filter(F.col("new_rank") <= shown).select("query_id", "new_rank", line.alias("line"))
