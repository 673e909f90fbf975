"""Adapters from the supplied tables to corpus and query tables, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.operators.sizing import spread

AS_OF = "2024-07-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in corpus columns, on all cores even when stored as one small file."""
    number = F.col("doc_id")
    created = F.expr("timestamp'2024-01-01 00:00:00' - make_dt_interval(cast(doc_id % 900 as int))")
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        number.cast("string").alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("content"),
        F.when(number % 3 == 0, "documentation").when(number % 3 == 1, "tutorial").otherwise("blog").alias("file_type"),
        F.lit("").alias("path"),
        created.alias("created_at"),
        (created + F.expr("make_dt_interval(cast(doc_id % 60 as int))")).alias("modified_at"),
        (number * 37 % 15000).cast("int").alias("github_stars"),
        (number * 101 % 150000).cast("int").alias("view_count"),
        F.col("lang").alias("language"),
        F.array("lang", "source").alias("tags"),
        "source",
    )


CORPUS = r"""corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS content,
         CASE doc_id % 3 WHEN 0 THEN 'documentation' WHEN 1 THEN 'tutorial' ELSE 'blog' END AS file_type,
         '' AS path,
         TIMESTAMP '2024-01-01' - to_days(CAST(doc_id % 900 AS INTEGER)) AS created_at,
         TIMESTAMP '2024-01-01' - to_days(CAST(doc_id % 900 AS INTEGER))
           + to_days(CAST(doc_id % 60 AS INTEGER)) AS modified_at,
         CAST(doc_id * 37 % 15000 AS INTEGER) AS github_stars,
         CAST(doc_id * 101 % 150000 AS INTEGER) AS view_count,
         lang AS language, [lang, source] AS tags, source
  FROM documents)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` texts as queries, with filters that vary from query to query."""
    number = F.col("item_id")
    no_filter = F.array().cast("array<string>")
    return table(spark, sf_dir, "benchmark").select(
        number.alias("query_id"),
        F.col("text").alias("query"),
        F.lit(10).alias("top_k"),
        F.when(number % 4 == 0, no_filter)
        .when(number % 4 == 1, F.array(F.lit("en")))
        .when(number % 4 == 2, F.array(F.lit("en"), F.lit("fr")))
        .otherwise(F.array(F.lit("de"), F.lit("es"), F.lit("en"))).alias("filter_language"),
        F.when(number % 5 == 0, F.array(*[F.lit(f"src{i}") for i in range(12)]))
        .otherwise(no_filter).alias("filter_source"),
        F.when(number % 3 == 0, F.array(F.lit("documentation"), F.lit("tutorial")))
        .otherwise(no_filter).alias("filter_file_type"),
        F.when(number % 2 == 0, F.to_timestamp(F.lit("2022-06-01 00:00:00"))).alias("date_from"),
        F.when(number % 7 == 0, F.to_timestamp(F.lit("2023-12-01 00:00:00"))).alias("date_to"),
    )


QUERIES = r"""queries AS (
  SELECT item_id AS query_id, text AS query, 10 AS top_k,
         CASE item_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['en'] WHEN 2 THEN ['en', 'fr']
              ELSE ['de', 'es', 'en'] END AS filter_language,
         CASE WHEN item_id % 5 = 0 THEN list_transform(range(12), lambda i: 'src' || i)
              ELSE CAST([] AS VARCHAR[]) END AS filter_source,
         CASE WHEN item_id % 3 = 0 THEN ['documentation', 'tutorial']
              ELSE CAST([] AS VARCHAR[]) END AS filter_file_type,
         CASE WHEN item_id % 2 = 0 THEN TIMESTAMP '2022-06-01' END AS date_from,
         CASE WHEN item_id % 7 = 0 THEN TIMESTAMP '2023-12-01' END AS date_to
  FROM benchmark)"""


def with_ctes(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
