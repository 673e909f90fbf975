"""Registered queries: validation, scoring, cleaning."""

from pyspark.sql import functions as F

from rankloom.operators import quality as ops
from rankloom.sources.files import load_json
from rankloom.workspace import fresh_path

from .inputs import AS_OF, CORPUS, as_of, corpus, table, with_ctes


def raw_records(spark, sf_dir):
    """``documents`` as raw JSON records with missing keys, nulls and odd dates mixed in."""
    number = F.col("doc_id")

    def member(key, value, present):
        return F.when(present, F.concat(F.lit(f'"{key}":'), value))

    def quoted(value):
        # to_json escapes; the brackets of the one-element array are cut off again
        text = F.to_json(F.array(value))
        return F.substring(text, F.lit(2), F.char_length(text) - 2)

    moment = F.date_add(F.lit("2024-07-01"), (F.lit(40) - number % 500).cast("int")).cast("string")
    stamp = (
        F.when(number % 13 == 0, F.lit(""))
        .when(number % 13 == 1, F.concat(moment, F.lit("T10:00:00")))
        .when(number % 13 == 2, F.concat(moment, F.lit("T10:00:00.250+02:00")))
        .otherwise(F.concat(moment, F.lit("T10:00:00Z")))
    )
    line = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(
        member("id", quoted(number.cast("string")), F.lit(True)),
        member("title", F.when(number % 17 == 4, F.lit("null")).otherwise(quoted(F.split_part("text", F.lit("\n"), F.lit(1)))), number % 11 != 3),
        member("content", quoted(F.col("text")), number % 19 != 5),
        member("created_at", F.when(number % 37 == 9, F.lit('"garbage"')).otherwise(F.lit('"2022-01-01T00:00:00Z"')), F.lit(True)),
        member("modified_at", quoted(stamp), number % 7 != 6),
        member("language", quoted(F.col("lang")), F.lit(True)),
        member("tags", F.to_json(F.array("lang", "source")), number % 23 != 7),
        member("source", quoted(F.col("source")), F.lit(True)),
        member("github_stars", F.when(number % 9 == 2, F.lit("null")).otherwise((number * 37 % 15000).cast("string")), number % 9 != 1),
        member("view_count", (number * 101 % 150000).cast("string"), F.lit(True)),
    )), ","), F.lit("}"))
    line = F.when(number % 31 == 8, F.left(line, F.lit(20))).otherwise(line)  # cut off: no JSON
    path = fresh_path(spark, "raw")
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return load_json(spark, path)


def validate_docs(spark, sf_dir):
    checked = ops.validate_docs(raw_records(spark, sf_dir))
    return checked.select(F.variant_get("v", "$.id", "string").alias("id"), "missing_field")


def impute_modified(spark, sf_dir):
    typed = ops.typed_documents(raw_records(spark, sf_dir))
    return ops.impute_modified(typed).select("id", "modified_at")


def freshness(spark, sf_dir):
    scored = ops.freshness(corpus(spark, sf_dir), as_of())
    return scored.select("id", F.round("freshness_score", 6).alias("freshness_score"))


def norm_stars(spark, sf_dir):
    return ops.norm_stars(corpus(spark, sf_dir)).select("id", F.round("stars_norm", 6).alias("stars_norm"))


def norm_views(spark, sf_dir):
    return ops.norm_views(corpus(spark, sf_dir)).select("id", F.round("views_norm", 6).alias("views_norm"))


def popularity(spark, sf_dir):
    scored = ops.popularity(corpus(spark, sf_dir))
    return scored.select("id", F.round("popularity_score", 6).alias("popularity_score"))


def prepare_docs(spark, sf_dir):
    prepared = ops.prepare_docs(raw_records(spark, sf_dir), as_of())
    return prepared.select(
        "id", "missing_field", F.col("error").isNotNull().alias("failed"),
        F.round("freshness_score", 6).alias("freshness_score"),
        F.round("popularity_score", 6).alias("popularity_score"),
    )


def quarantine(spark, sf_dir):
    return ops.quarantined(ops.prepare_docs(raw_records(spark, sf_dir), as_of()))


def clean_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ops.clean_text(docs, "text")


def parse_date(spark, sf_dir):
    """Dates of many shapes built from ``events``."""
    number = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    shaped = (
        F.when(number % 5 == 0, F.concat(day, F.lit("T08:15:30Z")))
        .when(number % 5 == 1, F.concat(day, F.lit("T08:15:30+02:00")))
        .when(number % 5 == 2, F.concat(day, F.lit("T08:15:30.125-05:30")))
        .when(number % 5 == 3, F.concat(F.lit("not a date "), number.cast("string")))
        .otherwise(day)
    )
    return ops.parse_date(table(spark, sf_dir, "events").select("event_id", shaped.alias("moment")), "moment")


def pipeline_stats(spark, sf_dir):
    return ops.pipeline_stats(ops.prepare_docs(raw_records(spark, sf_dir), as_of()))


def count_check(spark, sf_dir):
    return ops.count_check(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")))


QUERIES = {f.__name__: f for f in (
    validate_docs, impute_modified, freshness, norm_stars, norm_views, popularity, prepare_docs, quarantine,
    clean_text, parse_date, pipeline_stats, count_check,
)}

_ID = "CASE WHEN doc_id % 31 <> 8 THEN CAST(doc_id AS VARCHAR) END"
_MISSING = """CASE WHEN doc_id % 31 = 8 THEN 'malformed record' WHEN doc_id % 11 = 3 THEN 'title' WHEN doc_id % 19 = 5 THEN 'content'
     WHEN doc_id % 23 = 7 THEN 'tags' END"""
_DAY = "CAST(DATE '2024-07-01' + CAST(40 - doc_id % 500 AS INTEGER) AS VARCHAR)"
_STAMP = f"""CASE WHEN doc_id % 7 = 6 OR doc_id % 13 = 0 THEN '2022-01-01T00:00:00Z'
     WHEN doc_id % 13 = 1 THEN {_DAY} || 'T10:00:00' WHEN doc_id % 13 = 2 THEN {_DAY} || 'T10:00:00.250+02:00'
     ELSE {_DAY} || 'T10:00:00Z' END"""
_PREPARED = f"""prepared AS (
  SELECT {_ID} AS id, {_MISSING} AS missing_field,
         missing_field IS NULL AND (stamp LIKE '%T10:00:00' OR doc_id % 37 = 9) AS failed, doc_id % 37 = 9 AS undated,
         CASE WHEN missing_field IS NULL AND NOT failed AND age >= 0 THEN exp(-age / 365.0) END AS fresh,
         CASE WHEN fresh IS NOT NULL AND doc_id % 9 <> 2 THEN
           0.7 * least(CASE WHEN doc_id % 9 = 1 THEN 0 ELSE doc_id * 37 % 15000 END / 10000.0, 1.0)
           + 0.3 * least((doc_id * 101 % 150000) / 100000.0, 1.0) END AS popular
  FROM (SELECT *, {_STAMP} AS stamp,
               CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(CAST(stamp AS TIMESTAMPTZ))) / 86400000000.0)
                    AS INTEGER) AS age
        FROM documents))"""
_AGE = f"CAST(date_diff('day', modified_at, TIMESTAMP '{AS_OF}') AS DOUBLE)"

ORACLE = {
    "validate_docs": f"SELECT {_ID} AS id, {_MISSING} AS missing_field FROM documents",
    "impute_modified": f"""
        SELECT {_ID} AS id, CASE WHEN doc_id % 31 = 8 THEN ''
               WHEN doc_id % 37 = 9 AND (doc_id % 7 = 6 OR doc_id % 13 = 0) THEN 'garbage' ELSE {_STAMP} END AS modified_at
        FROM documents""",
    "freshness": with_ctes(
        f"SELECT id, CASE WHEN {_AGE} >= 0 THEN round(exp(-{_AGE} / 365.0), 6) END AS freshness_score FROM corpus", CORPUS),
    "norm_stars": with_ctes("SELECT id, round(least(github_stars / 10000.0, 1.0), 6) AS stars_norm FROM corpus", CORPUS),
    "norm_views": with_ctes("SELECT id, round(least(view_count / 100000.0, 1.0), 6) AS views_norm FROM corpus", CORPUS),
    "popularity": with_ctes("""
        SELECT id, round(CAST(0.7 AS DOUBLE) * least(github_stars / 10000.0, 1.0)
                         + CAST(0.3 AS DOUBLE) * least(view_count / 100000.0, 1.0), 6) AS popularity_score
        FROM corpus""", CORPUS),
    "prepare_docs": with_ctes("""
        SELECT id, missing_field, failed, round(fresh, 6) AS freshness_score, round(popular, 6) AS popularity_score
        FROM prepared""", _PREPARED),
    "quarantine": with_ctes("""
        SELECT id, CASE WHEN missing_field = 'malformed record' THEN missing_field
                   WHEN missing_field IS NOT NULL THEN 'missing required field: ' || missing_field
                   WHEN undated THEN 'created_at is not a timestamp'
                   ELSE 'modified_at is not a zoned ISO-8601 timestamp' END AS reason
        FROM prepared WHERE missing_field IS NOT NULL OR failed""", _PREPARED),
    "clean_text": """
        SELECT doc_id, replace(replace(replace(replace(
            trim(strip_accents(text), ' ' || chr(9) || chr(10) || chr(13) || chr(160)),
            chr(10), ' '), chr(13), ''), chr(9), ' '), '  ', ' ') AS text
        FROM documents""",
    "parse_date": """
        SELECT event_id, CASE event_id % 5
            WHEN 0 THEN day || 'T08:15:30.000000Z' WHEN 1 THEN day || 'T06:15:30.000000Z'
            WHEN 2 THEN day || 'T13:45:30.125000Z' WHEN 3 THEN '' ELSE day || 'T00:00:00.000000Z' END AS moment
        FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events)""",
    "pipeline_stats": with_ctes("""
        SELECT count(*) AS documents_loaded, count(*) FILTER (missing_field IS NULL AND NOT failed) AS documents_processed,
               count(*) FILTER (missing_field IS NOT NULL) AS invalid, count(*) FILTER (failed) AS processing_errors,
               count(*) FILTER (fresh IS NULL AND missing_field IS NULL AND NOT failed) AS unscored
        FROM prepared""", _PREPARED),
    "count_check": """
        SELECT count(*) AS indexed, count(DISTINCT conv_id) AS stored, count(*) <> count(DISTINCT conv_id) AS mismatch
        FROM conversations""",
}
