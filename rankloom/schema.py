"""Schemas of the corpus, query and result tables."""

from pyspark.sql import types as T

REQUIRED_KEYS = ["id", "title", "content", "created_at", "language", "tags", "source"]

CANONICAL_ORDER = [
    "id", "title", "content", "file_type", "path", "created_at",
    "modified_at", "github_stars", "view_count", "language", "tags", "source",
]

EMBEDDING_DIM = 384

CORPUS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("modified_at", T.TimestampType()),
    T.StructField("github_stars", T.IntegerType()),
    T.StructField("view_count", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
    T.StructField("popularity_score", T.DoubleType()),
    T.StructField("freshness_score", T.DoubleType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("filter_language", T.ArrayType(T.StringType())),
    T.StructField("filter_source", T.ArrayType(T.StringType())),
    T.StructField("filter_file_type", T.ArrayType(T.StringType())),
    T.StructField("date_from", T.TimestampType()),
    T.StructField("date_to", T.TimestampType()),
])

FORUM_POSTS = T.StructType([
    T.StructField("row_no", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("creation_date", T.TimestampType()),
    T.StructField("last_activity_date", T.TimestampType()),
    T.StructField("comment_count", T.IntegerType()),
])
