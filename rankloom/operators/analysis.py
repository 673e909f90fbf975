"""Text analysis: index and query analyzers, postings and corpus statistics.

The two sides differ on purpose.  The index keeps accents and stop words; the query side
folds accents, expands synonyms and then drops stop words.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import STOP_WORDS, ascii_fold as fold_column, term_counts, tokens
from ..workspace import materialize
from .sizing import fits, in_parallel, lookup_join

TEXT_FIELDS = ("title", "content")
# Every (document, field) keeps one row with this term so that lengths of documents
# without any matching term still count in the averages.
LENGTH_MARK = ""


def analyze_index(docs: DataFrame, field: str = "content") -> DataFrame:
    """Tokens of one field with their positions."""
    return docs.select("id", F.posexplode(tokens(F.col(field))).alias("position", "token"))


def ascii_fold(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add the folded form of a column."""
    return df.withColumn(into, fold_column(F.col(column)))


def query_tokens(queries: DataFrame, fold: bool = True) -> DataFrame:
    """Lower-cased, folded tokens of each query with positions."""
    text = fold_column(F.lower(F.col("query"))) if fold else F.col("query")
    return queries.select("query_id", F.posexplode(tokens(text)).alias("position", "token"))


def synonym_runs(query_terms: DataFrame, inputs: DataFrame) -> DataFrame:
    """``query_id, position, words, lhs``: where queries hold rule inputs of several tokens.

    ``inputs`` has the column ``lhs``, tokens joined by blanks.  Queries are read from left to right;
    of the inputs that begin at a position the longest is taken, and the next one begins after it.
    Only tokens that occur in such an input move, so queries without any cost one semi join.
    """
    several = inputs.select("lhs", F.split("lhs", " ").alias("parts")).filter(F.size("parts") > 1).distinct()
    longest = several.agg(F.max(F.size("parts"))).first()[0] or 0
    members = several.select(F.explode("parts").alias("token")).distinct()
    tokens_ = query_terms.select("query_id", "position", "token")
    kept = lookup_join(tokens_, members, ["token"], ["query_id", "position"], "left_semi")
    # partitioned once, for the distinct rows and for the windows
    kept = in_parallel(kept, "query_id").distinct()
    ahead = Window.partitionBy("query_id").orderBy("position")
    # the tokens that follow without a gap
    following = [
        F.when(F.lead("position", n).over(ahead) == F.col("position") + n, F.lead("token", n).over(ahead))
        for n in range(1, longest)
    ]
    runs = kept.withColumn("words", F.array("token", *following)).select(
        "query_id", "position", F.explode(F.transform(
            F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("words"))), lambda n: F.slice("words", 1, n))).alias("words"),
    )
    runs = runs.filter(~F.exists("words", lambda w: w.isNull())).select(
        "query_id", "position", F.size("words").alias("words"), F.array_join("words", " ").alias("lhs"),
    )
    found = lookup_join(runs, several.select("lhs"), ["lhs"], ["query_id", "position"], "left_semi")
    # the matches of one query, longest first at each position
    match = F.struct("position", (-F.col("words")).alias("rank"), "words", "lhs")
    chosen = F.aggregate(
        "matches",
        F.struct(F.lit(-1).cast("long").alias("last"), F.filter("matches", lambda m: F.lit(False)).alias("taken")),
        lambda state, m: F.when(
            m["position"] > state["last"],
            F.struct((m["position"] + m["words"] - 1).cast("long").alias("last"), F.array_append(state["taken"], m).alias("taken")),
        ).otherwise(state),
        lambda state: state["taken"],
    )
    return (
        found.groupBy("query_id").agg(F.array_sort(F.collect_list(match)).alias("matches"))
        .select("query_id", F.inline(chosen)).drop("rank")
    )


def outside_runs(query_terms: DataFrame, runs: DataFrame, inputs: DataFrame) -> DataFrame:
    """The rows of ``query_terms`` that no run covers.

    Many runs are not brought to the queries; then only tokens that occur in an input of several
    tokens move, all others are outside of any run.
    """
    keys = ["query_id", "position"]
    covered = runs.select("query_id", F.explode(F.sequence("position", F.col("position") + F.col("words") - 1)).alias("position"))
    if fits(covered):
        return query_terms.join(F.broadcast(covered), keys, "left_anti")
    members = inputs.filter(F.contains("lhs", F.lit(" "))).select(F.explode(F.split("lhs", " ")).alias("token")).distinct()
    others = lookup_join(query_terms, members, ["token"], keys, "left_anti")
    held = lookup_join(query_terms, members, ["token"], keys, "left_semi")
    return others.unionByName(held.join(covered, keys, "left_anti"))


def synonym_expand(query_terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Replace tokens by their synonyms at the same position.

    A token without a rule stays; one with several rules gets the union.  Outputs are not expanded
    again.  A run of tokens that is an input of its own is replaced as a whole, before its tokens are
    looked at: the outputs take its first position and its other positions hold nothing.
    """
    rules = synonyms.select(F.col("lhs").alias("token"), "rhs")
    several = synonyms.select("lhs").filter(F.contains("lhs", F.lit(" "))).distinct()
    if not several.isEmpty():
        runs = materialize(synonym_runs(query_terms, several), "runs")
        rest = outside_runs(query_terms, runs, several)
        query_terms = rest.select("query_id", "position", "token").unionByName(
            runs.select("query_id", "position", F.col("lhs").alias("token"))
        )
    return (
        lookup_join(query_terms, rules, ["token"], ["query_id", "position"], "left")
        .select(
            "query_id", "position", "token",
            F.coalesce("rhs", "token").alias("term"),
            F.col("rhs").isNotNull().alias("expanded"),
        )
        .distinct()
    )


def stop_filter(terms: DataFrame, column: str = "term", stop_words=STOP_WORDS) -> DataFrame:
    """Drop stop words."""
    return terms.filter(~F.col(column).isin(*stop_words))


def analyze_query(queries: DataFrame, synonyms: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """Full query analyzer: tokens, lower case, folding, synonyms, stop words."""
    return stop_filter(synonym_expand(query_tokens(queries), synonyms), "term", stop_words)


def keyword_terms(docs: DataFrame) -> DataFrame:
    """Tags as exact terms, one row per value."""
    return docs.select("id", F.explode("tags").alias("term"))


def _field_entries(field: str, terms: Column, counts: Column, length: Column) -> Column:
    mark = F.struct(F.lit(LENGTH_MARK).alias("term"), F.lit(0).cast("long").alias("tf"))
    return F.struct(
        F.lit(field).alias("field"),
        F.array_append(counts, mark).alias("entries"),
        length.cast("long").alias("dl"),
        (F.size(terms) > 0).alias("filled"),
    )


def postings(
    docs: DataFrame, fields=(*TEXT_FIELDS, "tags"), keep_marks: bool = False, fold_index: bool = False,
) -> DataFrame:
    """Term counts ``(id, field, term, tf, dl)`` of every document.

    Terms are counted inside each row, so building postings needs no shuffle; ``id`` must
    be unique.  ``tags`` values are keyword terms: counted once, without a length.
    """
    parts = []
    for field in fields:
        if field == "tags":
            values = F.array_distinct(F.coalesce(F.col("tags"), F.array().cast("array<string>")))
            once = F.transform(values, lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("tf")))
            parts.append(_field_entries("tags", values, once, F.lit(None)))
        else:
            text = fold_column(F.lower(F.col(field))) if fold_index else F.col(field)
            words = tokens(text)
            parts.append(_field_entries(field, words, term_counts(words), F.size(words)))
    rows = (
        docs.select("id", F.explode(F.array(*parts)).alias("f"))
        .select("id", "f.field", "f.dl", "f.filled", F.explode("f.entries").alias("e"))
        .select("id", "field", "e.term", "e.tf", "dl", "filled")
    )
    if keep_marks:
        return rows
    return rows.filter(F.col("term") != LENGTH_MARK).drop("filled")


def field_len(docs: DataFrame, fields=TEXT_FIELDS) -> DataFrame:
    """Number of tokens per document and text field."""
    lengths = [
        F.struct(F.lit(field).alias("field"), F.size(tokens(F.col(field))).cast("long").alias("dl"))
        for field in fields
    ]
    return docs.select("id", F.inline(F.array(*lengths)))


def field_stats(marked: DataFrame) -> DataFrame:
    """Documents having each field and their average length, from marked postings."""
    return (
        marked.filter((F.col("term") == LENGTH_MARK) & F.col("filled"))
        .groupBy("field")
        .agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    )


def term_stats(post: DataFrame) -> DataFrame:
    """Document frequency of every (field, term)."""
    return (
        post.filter(F.col("term") != LENGTH_MARK)
        .groupBy("field", "term")
        .agg(F.count("*").alias("df"))
    )
