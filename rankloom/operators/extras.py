"""Sorting, tag search, boosts, chunking and retrieval metrics."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bind
from ..workspace import materialize
from .lexical import topk_per_query
from .sizing import salted_join, fits


def sort_modes(matches: DataFrame, mode: str = "relevance", k: int = 10) -> DataFrame:
    """Rank matches by ``relevance``, ``popularity`` or ``date``; the best ``k`` per query."""
    keys = {
        "relevance": F.col("score"),
        "popularity": F.coalesce("github_stars", F.lit(0)).cast("double"),
        "date": F.unix_micros("created_at").cast("double"),
    }
    return topk_per_query(matches.withColumn("sort_key", keys[mode]), k, "sort_key")


def tag_search(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents carrying a wanted tag: ``(tag, id)``."""
    tagged = docs.select("id", F.explode("tags").alias("tag"))
    tags = wanted.select("tag").distinct()
    if fits(tags):
        return tagged.join(F.broadcast(tags), "tag").select("tag", "id")
    return salted_join(tagged, tags, ["tag"], ["id"]).select("tag", "id")


def boosted_score(
    score: Column, recent: float = 1.0, popular: float = 1.0, official: float = 1.0,
    official_types: tuple = ("documentation",),
) -> Column:
    """Score multiplied by recency, popularity and official-source boosts.

    A boost of b multiplies by up to b, in proportion to freshness and popularity.
    """
    def grow(boost, share):
        return F.lit(1.0) + F.lit(boost - 1.0) * F.coalesce(share, F.lit(0.0))

    is_official = F.when(F.col("file_type").isin(*official_types), 1.0).otherwise(0.0)
    return (
        score * grow(recent, F.col("freshness_score")) * grow(popular, F.col("popularity_score"))
        * grow(official, is_official)
    )


def chunk_docs(docs: DataFrame, size: int = 200, overlap: int = 50) -> DataFrame:
    """Overlapping chunks of ``size`` blank-separated words of each document."""
    step = size - overlap
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")

    def chunks(all_words):
        # a start is needed only while the previous chunk has not reached the end
        last = F.greatest(F.size(all_words) - overlap - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda start, n: F.struct(
                n.cast("long").alias("chunk_no"),
                F.array_join(F.slice(all_words, start + 1, size), " ").alias("chunk"),
            ),
        )

    return docs.select("id", F.inline(bind(words, chunks))).filter(F.col("chunk") != "")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Precision and recall at ``k`` and reciprocal rank per query.

    ``relevant`` lists ids that are relevant to every query, or ``(query_id, id)`` pairs.
    """
    keys = ["query_id", "id"] if "query_id" in relevant.columns else ["id"]
    good = relevant.select(*keys).distinct().withColumn("_good", F.lit(True))
    ranked = materialize(ranked.select("query_id", "id", "rank"), "ranked")  # sized, joined and listed below
    if fits(ranked):
        joined = good.join(F.broadcast(ranked), keys, "inner").select("query_id", "rank")
    else:
        joined = salted_join(ranked, good, keys, ["query_id", "id"], "inner").select("query_id", "rank")
    per_query = joined.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("hits_at_k"), F.min("rank").alias("first_hit")
    )
    queries = ranked.select("query_id").distinct().join(per_query, "query_id", "left")
    if len(keys) == 2:
        totals = good.groupBy("query_id").agg(F.count("*").alias("total"))
        queries = queries.join(totals, "query_id", "left")
    else:
        queries = queries.withColumn("total", good.agg(F.count("*").alias("total")).scalar())
    hits = F.coalesce("hits_at_k", F.lit(0))
    return queries.select(
        "query_id",
        (hits / F.lit(k)).alias("precision_at_k"),
        F.coalesce(hits / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"),
    )
