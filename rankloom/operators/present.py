"""What a hit looks like: highlights, snippets, metadata, empty results."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import WORD, bind
from .sizing import fits, lookup_join, salted_join

PIECES = rf"{WORD}|[^\p{{L}}\p{{N}}]+"
HIT_FIELDS = [
    "id", "title", "content", "file_type", "language", "tags", "created_at",
    "github_stars", "view_count", "popularity_score", "freshness_score", "source",
]


def hit_projection(docs: DataFrame) -> DataFrame:
    """The fields a hit returns."""
    return docs.select(*[c for c in HIT_FIELDS if c in docs.columns])


def attach_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Add document fields to hits.

    Hits are small in the usual case and are then brought to the corpus scan.  Otherwise
    the join shuffles on id, with documents that many queries hit split over tasks.
    """
    if fits(hits):
        return hit_projection(docs).join(F.broadcast(hits), "id")
    return salted_join(hits, hit_projection(docs), ["id"], ["query_id"])


def snippet(content: Column, size: int = 150) -> Column:
    """First characters of the content with an ellipsis when it is longer."""
    return F.when(F.char_length(content) > size, F.concat(F.left(content, F.lit(size)), F.lit("..."))).otherwise(content)


def fragments(text: Column, size: int) -> Column:
    """Cut a text into consecutive fragments of about ``size`` characters at blanks."""
    pattern = rf"(?s).{{1,{size}}}(?:\s|\z)|.{{{size}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def marked(text: Column, terms: Column) -> Column:
    """Text with every matching word inside ``<em>``."""
    words = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.array_join(
        F.transform(
            words,
            lambda w: F.when(
                F.array_contains(terms, F.lower(w)), F.concat(F.lit("<em>"), w, F.lit("</em>"))
            ).otherwise(w),
        ),
        "",
    )


def best_fragments(text: Column, terms: Column, size: int, count: int) -> Column:
    """Up to ``count`` marked fragments, most matches first, earlier ones on a tie."""
    def scored(pieces):
        return F.transform(
            pieces,
            lambda piece, i: F.struct(
                (-F.size(F.filter(
                    F.regexp_extract_all(F.lower(piece), F.lit(WORD), F.lit(0)),
                    lambda w: F.array_contains(terms, w),
                ))).alias("misses"),
                i.alias("at"),
                piece.alias("piece"),
            ),
        )

    ranked = F.array_sort(F.filter(bind(fragments(text, size), scored), lambda s: s["misses"] < 0))
    return F.transform(F.slice(ranked, 1, count), lambda s: F.btrim(marked(s["piece"], terms)))


def highlight(hits: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Replace title and content by their highlighted form.

    ``query_terms`` holds ``(query_id, terms ARRAY)``.  A title keeps its best fragment of
    100 characters, the content its best two of 150 joined by ``[...]``; without any match
    the plain title and the default snippet stay.
    """
    joined = lookup_join(hits, query_terms, ["query_id"], ["id"], "left")
    terms = F.coalesce(F.col("terms"), F.array().cast("array<string>"))
    title = best_fragments(F.col("title"), terms, 100, 1)
    content = best_fragments(F.col("content"), terms, 150, 2)
    return joined.withColumns({
        "title": bind(title, lambda t: F.when(F.size(t) > 0, F.get(t, F.lit(0))).otherwise(F.col("title"))),
        "content": bind(
            content,
            lambda c: F.when(F.size(c) > 0, F.array_join(c, " [...] ")).otherwise(snippet(F.col("content"))),
        ),
    }).drop("terms")


def hit_metadata(hits: DataFrame, score_digits: int = 2) -> DataFrame:
    """Hits with rounded score and a ``metadata`` struct that has no missing counters."""
    def number(name, default):
        return F.coalesce(F.col(name), F.lit(default))

    metadata = F.struct(
        "file_type", "language",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "created_at",
        number("github_stars", 0).alias("github_stars"),
        number("view_count", 0).alias("view_count"),
        F.round(number("popularity_score", 0.0), 3).alias("popularity_score"),
        F.round(number("freshness_score", 0.0), 3).alias("freshness_score"),
        "source",
    )
    kept = [c for c in hits.columns if c not in HIT_FIELDS[3:]]
    return hits.select(*kept, metadata.alias("metadata")).withColumn("score", F.round("score", score_digits))


def empty_query(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One status row per query: its hits, or zero and an error text."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    blank = F.coalesce(F.btrim("query") == "", F.lit(True))
    n = F.when(blank, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    error = F.when(n == 0, F.lit("no hits"))
    return queries.select("query_id", "query").join(counts, "query_id", "left").select(
        "query_id", "query", n.alias("total_hits"), error.alias("error")
    )
