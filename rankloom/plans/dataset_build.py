"""Assemble a corpus from forum posts and code documentation."""

from pyspark.sql import Column, DataFrame

from ..operators.dataset import (
    canonical_order, cast_id, clean_html, conform_code_docs, conform_forum_posts, sample_n, union_sources,
)


def build_dataset(posts: DataFrame, functions: DataFrame, loaded_at: Column, sample: int = None) -> DataFrame:
    """Code documentation, or ``sample`` rows of it, stacked on all forum posts, in corpus order."""
    forum = canonical_order(cast_id(clean_html(conform_forum_posts(posts))))
    code = conform_code_docs(functions, loaded_at)
    code = canonical_order(code if sample is None else sample_n(code, "id", sample))
    return union_sources(code, forum)
