"""Reciprocal-rank fusion of ranked lists."""

from pyspark.sql import DataFrame, Window, functions as F

RANK_CONSTANT = 40


def rrf_fusion(*ranked: DataFrame, rank_constant: int = RANK_CONSTANT) -> DataFrame:
    """Fuse lists of ``(query_id, id, rank)``; each adds ``1 / (constant + rank)``.

    Ties keep the order of the first list that has the document, then its rank there.
    """
    stacked = None
    for number, hits in enumerate(ranked):
        part = hits.select(
            "query_id", "id",
            F.struct(F.lit(number).alias("list_no"), F.col("rank").cast("long").alias("rank")).alias("seen"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    fused = stacked.groupBy("query_id", "id").agg(
        F.sum(F.lit(1.0) / (F.lit(rank_constant) + F.col("seen.rank"))).alias("score"),
        F.min("seen").alias("first_seen"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("first_seen"), F.asc("id"))
    return fused.select(
        "query_id", "id", "score",
        F.row_number().over(order).cast("long").alias("rank"),
        F.lit("rrf_manual").alias("original_score_type"),
    )
