"""Fuzzy terms: query terms against the vocabulary, never against the corpus."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.edits import (
    HALVED_TERM, SHORT_TERM, allowed_edits, piece_signatures, sorted_letters, swap_distance, with_deletions, with_halves,
)
from ..functions.sieve import close_terms
from ..workspace import materialize
from .sizing import MAX_BROADCAST_ROWS, in_parallel, lookup_join

SENT_TERMS = 20_000  # query terms whose signatures are sent to the vocabulary as hashes


def _of_length(df: DataFrame, column: str, low: int, high: int = None) -> DataFrame:
    size = F.char_length(column)
    return df.filter(size >= low) if high is None else df.filter(size.between(low, high))


def _short_pairs(wanted: DataFrame, words: DataFrame, max_rows: int) -> DataFrame:
    """Vocabulary terms of up to nine letters: a common string after some deletions."""
    asked = (
        with_deletions(_of_length(wanted, "query_term", 3, SHORT_TERM + 2), "query_term")
        .filter(F.col("depth") <= F.col("edits_allowed"))
        .drop("depth")
        .distinct()
    )
    offered = (
        with_deletions(_of_length(words, "term", 2, SHORT_TERM), "term")
        # two edits are only granted above five letters, which leave at least four
        .filter((F.col("depth") < 2) | (F.char_length("sig") > 3))
    )
    pairs = lookup_join(offered, asked, ["sig"], ["term"], max_rows=max_rows)
    return pairs.filter(F.col("depth") <= F.col("edits_allowed")).drop("sig", "depth")


def _halved_pairs(wanted: DataFrame, words: DataFrame, max_rows: int) -> DataFrame:
    """Vocabulary terms of medium length: one half with at most one edit."""
    asked = with_halves(_of_length(wanted, "query_term", SHORT_TERM - 1, HALVED_TERM + 2), "query_term", own=False)
    offered = with_halves(_of_length(words, "term", SHORT_TERM + 1, HALVED_TERM), "term", own=True)
    return lookup_join(offered, asked.distinct(), ["sig"], ["term"], max_rows=max_rows).drop("sig")


def _long_pairs(wanted: DataFrame, words: DataFrame, max_rows: int) -> DataFrame:
    """Very long vocabulary terms: one of five pieces is untouched."""
    asked = _of_length(wanted, "query_term", HALVED_TERM - 1).withColumn(
        "sig", F.explode(piece_signatures(F.col("query_term"), own=False))
    )
    offered = _of_length(words, "term", HALVED_TERM + 1).withColumn(
        "sig", F.explode(piece_signatures(F.col("term"), own=True))
    )
    return lookup_join(offered, asked, ["sig"], ["term"], max_rows=max_rows).drop("sig")


def _verified(candidates: DataFrame) -> DataFrame:
    """Candidates within the allowed edits, checked where the join finds them."""
    edits = swap_distance(*[F.col(c) for c in ("query_term", "term", "query_letters", "letters")])
    return (
        # exploding a one-element array keeps the optimizer from computing the distance twice
        candidates.select("query_term", "term", "edits_allowed", F.explode(F.array(edits)).alias("edits"))
        .filter(F.col("edits") <= F.col("edits_allowed"))
        .select("query_term", "term", "edits")
        .distinct()
    )


def fuzzy_match(
    query_terms: DataFrame, vocabulary: DataFrame,
    max_expansions: int = None, max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Vocabulary terms within the allowed edits of each query term, per field.

    ``query_terms`` has ``(field, query_term)`` and ``vocabulary`` ``(field, term)``.
    The result holds ``field, query_term, term, edits, boost``: all terms, or with
    ``max_expansions`` the best of each query term and field.  Candidates come from equality on signatures, so no pair of unrelated terms is ever formed.
    """
    query_terms = materialize(query_terms.select("field", "query_term").distinct(), "asked")
    wanted = query_terms.select("query_term").distinct().withColumns({
        "edits_allowed": allowed_edits(F.col("query_term")), "query_letters": sorted_letters(F.col("query_term")),
    })
    words = in_parallel(vocabulary.select("term"), "term").distinct().withColumn(
        "letters", sorted_letters(F.col("term"))
    )
    loose = wanted.filter("edits_allowed > 0")
    longest, asked = loose.agg(F.max(F.char_length("query_term")), F.count("*")).first()
    longest = longest or 0
    if asked <= min(SENT_TERMS, max_rows):
        sent = [(r.query_term, r.edits_allowed) for r in loose.select("query_term", "edits_allowed").collect()]
        close = words.select("term").mapInArrow(close_terms(sent), "query_term string, term string, edits int")
    else:
        close = _verified(_short_pairs(loose, words, max_rows))
        if longest >= SHORT_TERM - 1:
            close = close.unionByName(_verified(_halved_pairs(loose, words, max_rows)))
    if longest >= HALVED_TERM - 1:
        close = close.unionByName(_verified(_long_pairs(loose, words, max_rows)))
    same = wanted.filter("edits_allowed = 0").select(
        "query_term", F.col("query_term").alias("term"), F.lit(0).alias("edits")
    )
    shorter = F.least(F.char_length("query_term"), F.char_length("term"))
    boost = F.lit(1.0) - F.col("edits") / shorter
    found = (
        query_terms.join(close.unionByName(same), "query_term")
        .join(vocabulary.select("field", "term"), ["field", "term"], "left_semi")
        .withColumn("boost", boost)
        .filter("boost > 0")
        .select("field", "query_term", "term", "edits", "boost")
    )
    if max_expansions is None:
        return found
    best = Window.partitionBy("field", "query_term").orderBy(F.desc("boost"), F.asc("term"))
    return found.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= max_expansions).drop("_rn")
