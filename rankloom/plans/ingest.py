"""Load raw records into the stored corpus."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.quality import accepted, pipeline_stats, prepare_docs, quarantined
from ..operators.vectors import embed_docs
from ..sources.corpus_table import upsert_table
from ..sources.files import load_json
from ..workspace import materialize


def load_and_index(
    spark: SparkSession, path: str, table_path: str, as_of: Column,
    layout: str = "lines", embedder=None,
) -> tuple:
    """Load, validate, score, embed and upsert; returns statistics and quarantined rows.

    The prepared batch is written once because statistics, quarantine and corpus read it. ``seq``
    orders the records of this load only; against other loads the later one wins.
    """
    raw = load_json(spark, path, layout).withColumn("seq", F.monotonically_increasing_id())
    prepared = materialize(prepare_docs(raw, as_of, keep=("seq",)), "prepared")
    upsert_table(table_path, embed_docs(accepted(prepared), embedder=embedder), "seq")
    return pipeline_stats(prepared), quarantined(prepared)


def enrich(docs: DataFrame, as_of: Column, embedder=None) -> DataFrame:
    """Scores and embeddings for documents that already have typed columns."""
    from ..operators.quality import freshness, popularity

    return embed_docs(popularity(freshness(docs, as_of)), embedder=embedder)
