"""Validation, scoring and statistics of raw documents.

Raw records arrive as one VARIANT column ``v`` because a missing key and a null value
mean different things here, and a typed schema cannot tell them apart.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores
from ..functions.text import clean_text as clean_text_column
from ..schema import REQUIRED_KEYS

ZONED = r"(Z|[+-]\d\d:?\d\d)$"


def _node(key: str) -> Column:
    return F.try_variant_get(F.col("v"), f"$.{key}", "variant")


MALFORMED = "malformed record"


def _value(key: str, kind: str) -> Column:
    return F.try_variant_get(F.col("v"), f"$.{key}", kind)


def has_key(key: str) -> Column:
    """Whether the record has the key at all; a null value counts as present."""
    return _node(key).isNotNull()


def validate_docs(raw: DataFrame, required=REQUIRED_KEYS) -> DataFrame:
    """Add ``missing_field``: the first required key that is absent, or null when complete.

    A record that could not be parsed counts as MALFORMED.
    """
    first_missing = F.coalesce(
        F.when(F.col("v").isNull(), F.lit(MALFORMED)), *[F.when(~has_key(key), F.lit(key)) for key in required]
    )
    return raw.withColumn("missing_field", first_missing)


def _typed_columns() -> list:
    def counter(key):
        return F.when(has_key(key), _value(key, "int")).otherwise(F.lit(0)).alias(key)

    text = ["id", "title", "content", "file_type", "path", "created_at", "modified_at", "language", "source"]
    return [
        *[_value(key, "string").alias(key) for key in text],
        _value("tags", "array<string>").alias("tags"),
        counter("github_stars"),
        counter("view_count"),
    ]


def typed_documents(raw: DataFrame, keep: tuple = ()) -> DataFrame:
    """Corpus columns of raw records, dates still as text.

    An absent counter is 0 and a null counter stays null, which later suppresses the
    popularity score.
    """
    return raw.select(*keep, *_typed_columns())


def impute_modified(docs: DataFrame) -> DataFrame:
    """An absent, null or empty ``modified_at`` becomes ``created_at``, else empty."""
    modified = F.nullif(F.col("modified_at"), F.lit(""))
    return docs.withColumn("modified_at", F.coalesce(modified, F.col("created_at"), F.lit("")))


def _text_date_state(docs: DataFrame) -> DataFrame:
    created = F.col("created_at")
    unusable = (F.length(created) > 0) & F.try_to_timestamp(created).isNull()
    given = (F.length(created) > 0) & (F.length(F.col("modified_at")) > 0)
    moment = F.try_to_timestamp(F.col("modified_at"))
    broken = given & (~F.col("modified_at").rlike(ZONED) | moment.isNull())
    return docs.withColumns({
        "_moment": F.when(given, moment),
        "error": F.when(unusable, F.lit("created_at is not a timestamp"))
        .when(broken, F.lit("modified_at is not a zoned ISO-8601 timestamp")),
    })


def freshness(docs: DataFrame, as_of: Column) -> DataFrame:
    """Add ``freshness_score`` from a timestamp column ``modified_at``."""
    return docs.withColumn("freshness_score", scores.freshness(F.col("modified_at"), as_of))


def popularity(docs: DataFrame) -> DataFrame:
    """Add ``popularity_score`` from stars and views."""
    return docs.withColumn("popularity_score", scores.popularity(F.col("github_stars"), F.col("view_count")))


def norm_stars(docs: DataFrame) -> DataFrame:
    """Add ``stars_norm``."""
    return docs.withColumn("stars_norm", scores.norm_stars(F.col("github_stars")))


def norm_views(docs: DataFrame) -> DataFrame:
    """Add ``views_norm``."""
    return docs.withColumn("views_norm", scores.norm_views(F.col("view_count")))


def score_documents(docs: DataFrame, as_of: Column) -> DataFrame:
    """Both scores for documents with text dates, and ``error`` where a date is unusable.

    Popularity is only given to documents that received a freshness score.
    """
    fresh = scores.freshness(F.col("_moment"), as_of)
    popular = scores.popularity(F.col("github_stars"), F.col("view_count"))
    return (
        _text_date_state(docs)
        .withColumn("freshness_score", F.when(F.col("error").isNull(), fresh))
        .withColumn("popularity_score", F.when(F.col("freshness_score").isNotNull(), popular))
        .drop("_moment")
    )


def prepare_docs(raw: DataFrame, as_of: Column, keep: tuple = ()) -> DataFrame:
    """Validate, impute and score raw records.

    Nothing is lost: ``missing_field`` marks invalid records and ``error`` those that
    failed while being processed.  Documents with neither go to the corpus.
    """
    typed = typed_documents(validate_docs(raw), keep=("missing_field", *keep))
    scored = score_documents(impute_modified(typed), as_of)
    valid = F.col("missing_field").isNull()
    return scored.withColumns({
        "error": F.when(valid, F.col("error")),
        "freshness_score": F.when(valid, F.col("freshness_score")),
        "popularity_score": F.when(valid, F.col("popularity_score")),
    })


def accepted(prepared: DataFrame) -> DataFrame:
    """Documents that go on to the corpus, with real timestamps."""
    return (
        prepared.filter(F.col("missing_field").isNull() & F.col("error").isNull())
        .drop("missing_field", "error")
        .withColumns({
            "created_at": F.try_to_timestamp("created_at"),
            "modified_at": F.try_to_timestamp("modified_at"),
        })
    )


def quarantined(prepared: DataFrame) -> DataFrame:
    """Rejected documents with the reason."""
    missing = F.when(F.col("missing_field") == MALFORMED, F.lit(MALFORMED)).otherwise(
        F.concat(F.lit("missing required field: "), F.col("missing_field"))
    )
    reason = F.coalesce(missing, F.col("error"))
    return prepared.filter(reason.isNotNull()).select("id", reason.alias("reason"))


def clean_text(docs: DataFrame, column: str) -> DataFrame:
    """Strip accents and flatten whitespace of one text column."""
    return docs.withColumn(column, clean_text_column(F.col(column)))


def parse_date(docs: DataFrame, column: str) -> DataFrame:
    """ISO-8601 text as UTC ``yyyy-MM-ddTHH:mm:ss.ffffffZ``; bad input gives an empty string."""
    moment = F.to_utc_timestamp(F.try_to_timestamp(F.col(column)), F.current_timezone())
    text = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return docs.withColumn(column, F.coalesce(text, F.lit("")))


def pipeline_stats(prepared: DataFrame) -> DataFrame:
    """One row of counts over a prepared batch."""
    valid = F.col("missing_field").isNull()
    failed = F.col("error").isNotNull()
    return prepared.agg(
        F.count("*").alias("documents_loaded"),
        F.count_if(valid & ~failed).alias("documents_processed"),
        F.count_if(~valid).alias("invalid"),
        F.count_if(valid & failed).alias("processing_errors"),
        F.count_if(F.col("freshness_score").isNull() & valid & ~failed).alias("unscored"),
    )


def count_check(indexed: DataFrame) -> DataFrame:
    """Rows sent against distinct identifiers stored; they differ when ids repeat."""
    per_id = indexed.groupBy("id").count()
    return per_id.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("indexed"),
        F.count("*").alias("stored"),
        (F.coalesce(F.sum("count"), F.lit(0)) != F.count("*")).alias("mismatch"),
    )
