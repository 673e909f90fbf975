"""Per-query filters that apply before ranking, on both result lists."""

from pyspark.sql import Column, DataFrame, functions as F

from .sizing import lookup_join

FILTER_FIELDS = {"filter_language": "language", "filter_source": "source", "filter_file_type": "file_type"}
FILTER_COLUMNS = [*FILTER_FIELDS, "date_from", "date_to"]


def terms_condition(columns=FILTER_FIELDS) -> Column:
    """Value listed in the query's filter; an empty or null filter admits everything."""
    cond = F.lit(True)
    for wanted, field in columns.items():
        free = F.col(wanted).isNull() | (F.size(wanted) == 0)
        cond = cond & (free | F.coalesce(F.array_contains(F.col(wanted), F.col(field)), F.lit(False)))
    return cond


def date_condition(as_of: Column = None) -> Column:
    """``created_at`` within the query's inclusive range, either side open.

    With ``as_of`` a range that has a start but no end stops there.
    """
    end = F.col("date_to") if as_of is None else F.coalesce(
        F.col("date_to"), F.when(F.col("date_from").isNotNull(), as_of)
    )
    after = F.col("date_from").isNull() | (F.col("created_at") >= F.col("date_from"))
    before = end.isNull() | (F.col("created_at") <= end)
    return F.coalesce(after & before, F.lit(False))


def filter_matches(matches: DataFrame, docs: DataFrame, queries: DataFrame, condition: Column) -> DataFrame:
    """Keep (query, document) rows whose document passes the query's filters.

    Filters do not change scores, so they act on the scored rows before the cut.  The
    attributes join on the unique document id, by which the scores are partitioned.
    """
    attributes = docs.select("id", "language", "source", "file_type", "created_at")
    wanted = queries.select("query_id", *FILTER_COLUMNS)
    joined = lookup_join(matches.join(attributes, "id"), wanted, ["query_id"], ["id"])
    return joined.filter(condition).select(*matches.columns)
