"""Registered queries: embeddings and vector search."""

from pyspark.sql import functions as F

from rankloom.functions.arrays import l2_normalize as unit
from rankloom.operators import vectors as ops

from .analysis import WORD
from .inputs import CORPUS, QUERIES as QUERIES_SQL, corpus, passages, table, with_ctes

DIM = 64


def _long(df, key, column):
    """Non-zero entries of a vector column, one per row."""
    return (
        df.select(key, F.posexplode(column).alias("bucket", "value"))
        .filter("value <> 0")
        .select(key, F.col("bucket").cast("long").alias("bucket"), F.round(F.col("value").cast("double"), 6).alias("value"))
    )


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _centroids(spark, sf_dir):
    """One query per label: the normalised mean of its vectors."""
    parts = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("cells"))
    mean = F.transform("cells", lambda c: c["x"])
    return rows.select(F.col("label").alias("query_id"), unit(mean).alias("query_vector"))


def _flagged(spark, sf_dir):
    """Vectors with the attributes that filters need."""
    lang = F.when(F.col("id") % 3 == 0, "en").when(F.col("id") % 3 == 1, "fr").otherwise("de")
    created = F.expr("timestamp'2024-01-01 00:00:00' - make_dt_interval(cast(id % 900 as int))")
    return _vectors(spark, sf_dir).select(
        "id", "embedding", lang.alias("language"),
        F.concat(F.lit("src"), (F.col("id") % 4).cast("string")).alias("source"),
        F.when(F.col("id") % 2 == 0, "documentation").otherwise("blog").alias("file_type"), created.alias("created_at"),
    )


def _filters(spark, sf_dir):
    none = F.array().cast("array<string>")
    return _vectors(spark, sf_dir).select(F.col("label").alias("query_id")).distinct().select(
        "query_id",
        F.when(F.col("query_id") % 2 == 0, F.array(F.lit("en"), F.lit("de"))).otherwise(none).alias("filter_language"),
        F.when(F.col("query_id") % 3 == 0, F.array(F.lit("src0"), F.lit("src1"))).otherwise(none).alias("filter_source"),
        F.when(F.col("query_id") % 5 == 1, F.array(F.lit("blog"))).otherwise(none).alias("filter_file_type"),
        F.when(F.col("query_id") % 4 == 1, F.to_timestamp(F.lit("2022-06-01 00:00:00"))).alias("date_from"),
        F.when(F.col("query_id") % 4 == 3, F.to_timestamp(F.lit("2023-10-01 00:00:00"))).alias("date_to"),
    )


def embed_text(spark, sf_dir):
    return _long(ops.embed_text(corpus(spark, sf_dir), "content"), "id", "embedding")


def embed_query(spark, sf_dir):
    return _long(ops.embed_query(passages(spark, sf_dir)), "query_id", "query_vector")


def embed_docs(spark, sf_dir):
    return _long(ops.embed_docs(corpus(spark, sf_dir)), "id", "embedding")


def l2_normalize(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5)).alias("embedding"),
    )
    return ops.normalize_rows(scaled).select("id", F.posexplode("embedding").alias("bucket", "value")).select(
        "id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


def knn_exact(spark, sf_dir):
    return ops.knn_exact(_vectors(spark, sf_dir), _centroids(spark, sf_dir), 50)


def knn_grid(spark, sf_dir):
    """The plan for query sets too large to send along."""
    return ops.knn_exact(_vectors(spark, sf_dir), _centroids(spark, sf_dir), 50, max_queries=0)


def knn_documents(spark, sf_dir):
    """Passages against the embedded documents."""
    docs = ops.embed_docs(corpus(spark, sf_dir))
    return ops.knn_exact(docs, ops.embed_query(passages(spark, sf_dir)), 10)


def knn_filtered(spark, sf_dir):
    return ops.knn_filtered(_flagged(spark, sf_dir), _centroids(spark, sf_dir), _filters(spark, sf_dir), 50)


def knn_lsh(spark, sf_dir):
    return ops.knn_lsh(_vectors(spark, sf_dir), _centroids(spark, sf_dir), 50, DIM)


def similarity_matrix(spark, sf_dir):
    found = ops.similarity_matrix(_vectors(spark, sf_dir), 0.5)
    return found.select(F.col("query_id").alias("left_id"), F.col("id").alias("right_id"), "score")


QUERIES = {f.__name__: f for f in (
    embed_text, embed_query, embed_docs, l2_normalize, knn_exact, knn_grid, knn_documents, knn_filtered, knn_lsh,
    similarity_matrix,
)}


def hashed_ctes(source: str, key: str, column: str, name: str) -> tuple:
    """``name(key, bucket, value)``: hashed unit vectors rounded to FLOAT."""
    return f"""{name}_raw AS (
  SELECT {key}, CAST(('0x' || md5(t)[1:8])::BIGINT % 384 AS BIGINT) AS bucket,
         sum(CASE WHEN md5(t)[9:9] < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS value
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({column}), {WORD})) AS t FROM {source})
  GROUP BY ALL)""", f"""{name} AS (
  SELECT {key}, bucket, CAST(value / sqrt(sum(value * value) OVER (PARTITION BY {key})) AS FLOAT) AS value
  FROM {name}_raw WHERE value <> 0)"""


DOC_VECTORS = (*hashed_ctes("corpus", "id", "title", "title_vec"), *hashed_ctes("corpus", "id", "content", "content_vec"),
  """blended AS (
  SELECT id, bucket, 0.4::DOUBLE * coalesce(t.value, 0)::DOUBLE + 0.6::DOUBLE * coalesce(c.value, 0)::DOUBLE AS value
  FROM title_vec t FULL JOIN content_vec c USING (id, bucket))""", """doc_vec AS (
  SELECT id, bucket, CAST(value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS FLOAT) AS value
  FROM blended)""")
QUERY_VECTORS = hashed_ctes("queries", "query_id", "query", "query_vec")
KNN_DOCUMENTS = """doc_unit AS (
  SELECT id, bucket, value::DOUBLE / sqrt(sum(value::DOUBLE * value::DOUBLE) OVER (PARTITION BY id)) AS value FROM doc_vec),
query_unit AS (
  SELECT query_id, bucket, value::DOUBLE / sqrt(sum(value::DOUBLE * value::DOUBLE) OVER (PARTITION BY query_id)) AS value FROM query_vec),
cosines AS (
  SELECT query_id, id, sum(q.value * d.value) AS cosine
  FROM query_unit q JOIN doc_unit d USING (bucket) GROUP BY query_id, id),
vector_scores AS (SELECT query_id, id, round((1 + cosine) / 2, 6) AS score FROM cosines)"""

_CENTROIDS = """means AS (
  SELECT label AS query_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
  FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
centroids AS (SELECT query_id, list(x ORDER BY i) AS v FROM means GROUP BY query_id)"""
_COSINES = """scored AS (
  SELECT query_id, vec_id AS id, round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)) / 2, 6) AS score
  FROM embeddings, centroids)"""
_TOP50 = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {source}
   QUALIFY rank <= 50"""
_FILTERED = """kept AS (
  SELECT query_id, id, score FROM scored
  WHERE (query_id % 2 <> 0 OR id % 3 IN (0, 2)) AND (query_id % 3 <> 0 OR id % 4 IN (0, 1))
    AND (query_id % 5 <> 1 OR id % 2 = 1)
    AND (query_id % 4 <> 1 OR TIMESTAMP '2024-01-01' - to_days(CAST(id % 900 AS INTEGER)) >= TIMESTAMP '2022-06-01')
    AND (query_id % 4 <> 3 OR TIMESTAMP '2024-01-01' - to_days(CAST(id % 900 AS INTEGER)) <= TIMESTAMP '2023-10-01'))"""

ORACLE = {
    "embed_text": with_ctes(
        "SELECT id, bucket, round(value::DOUBLE, 6) AS value FROM v", CORPUS, *hashed_ctes("corpus", "id", "content", "v")),
    "embed_query": with_ctes(
        "SELECT query_id, bucket, round(value::DOUBLE, 6) AS value FROM query_vec", QUERIES_SQL, *QUERY_VECTORS),
    "embed_docs": with_ctes(
        "SELECT id, bucket, round(value::DOUBLE, 6) AS value FROM doc_vec WHERE value <> 0", CORPUS, *DOC_VECTORS),
    "l2_normalize": """
        SELECT vec_id AS id, i - 1 AS bucket,
               CASE WHEN vec_id % 5 = 0 THEN 0.0::DOUBLE ELSE round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) END AS value
        FROM (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) * (vec_id % 5) AS x
              FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i))""",
    "knn_exact": with_ctes(_TOP50.format(source="scored"), _CENTROIDS, _COSINES),
    "knn_grid": with_ctes(_TOP50.format(source="scored"), _CENTROIDS, _COSINES),
    "knn_documents": with_ctes(
        _TOP50.format(source="vector_scores").replace("50", "10"),
        CORPUS, QUERIES_SQL, *DOC_VECTORS, *QUERY_VECTORS, KNN_DOCUMENTS),
    "knn_filtered": with_ctes(_TOP50.format(source="kept"), _CENTROIDS, _COSINES, _FILTERED),
    "similarity_matrix": """
        SELECT a.vec_id AS left_id, b.vec_id AS right_id,
               round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings a, embeddings b
        WHERE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) >= 0.5""",
}
