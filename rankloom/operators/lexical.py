"""BM25 retrieval for a whole table of queries.

Plan shape: postings are narrowed to the terms the queries use while the corpus is
scanned, then partitioned by document once.  The weighted query terms are brought to
them (broadcast when measured small), so every aggregate up to the per-document score
runs inside its partition and only the best k rows per query and partition move on.
A frequent term therefore never gathers in one task.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores
from ..workspace import materialize
from .analysis import LENGTH_MARK, TEXT_FIELDS, field_stats, postings, term_stats
from .fuzzy import fuzzy_match
from .scan import corpus_counts, scan_scores
from .sizing import MAX_BROADCAST_ROWS, fits, fitting_groups, hash_group, lookup_join, salted_join, tasks_for

# Field boosts and the share of query positions that must match.
FIELD_BOOSTS = {"title": 2.0, "content": 1.0, "tags": 1.0}
MIN_SHOULD_MATCH = 0.75
TERM_BUCKETS = 256
LEVELS = 16  # blocks of a term for each unit of contribution
SEED_POSTINGS = 20  # postings scored for each wanted hit before the rest is bounded
HOT_TERM = 1_000_000  # postings of one term that a single task may hold
LOOKUP_GAIN = 4  # lookups that cost as much as a scored match; candidates are counted once for each leading term they hold
QUERY_GROUPS = 64  # groups of queries that are scored one after the other, at most; a power of two
PAIRS_PER_TASK = 1_000_000  # postings times queries that ask for them, for one scoring task


@dataclass
class TextIndex:
    """Postings with length marks, document frequencies and field averages."""

    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    levels: DataFrame = None


class ScannedCorpus:
    """A ``TextIndex`` of a corpus that is scanned again; its postings, of ``terms`` only, are written if they are asked for."""

    levels = None

    def __init__(self, docs: DataFrame, fold_index: bool = False):
        self.docs, self.fold_index, self.terms = docs.select("id", *TEXT_FIELDS, "tags"), fold_index, None
        self.term_stats, self.field_stats = corpus_counts(self.docs, fold_index)

    @cached_property
    def postings(self) -> DataFrame:
        return narrowed_index(self.docs, self.terms, fold_index=self.fold_index).postings


def impact_levels(index: "TextIndex") -> DataFrame:
    """``field, term, level, n, peak``: the postings of a term in blocks of similar contribution.

    The contribution of a posting without its term's weight is below ``K1 + 1``; ``level`` counts its
    sixteenths and ``peak`` is the largest of the block.  A term has a few dozen blocks at most.
    """
    rows = index.postings.filter((F.col("term") != LENGTH_MARK) & F.col("dl").isNotNull())
    rows = rows.join(F.broadcast(index.field_stats), "field")  # one row per field
    part = scores.tf_norm(F.col("tf"), F.col("dl") / F.col("avgdl"))
    return rows.select("field", "term", part.alias("part")).groupBy("field", "term", _level(F.col("part")).alias("level")).agg(
        F.count("*").alias("n"), F.max("part").alias("peak")
    )


def _level(part: Column) -> Column:
    return F.floor(part * LEVELS).cast("int")


def text_index(docs: DataFrame, fold_index: bool = False) -> TextIndex:
    """Index tables as a plan over the corpus (nothing is written)."""
    marked = postings(docs, keep_marks=True, fold_index=fold_index)
    return TextIndex(marked, term_stats(marked), field_stats(marked))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str) -> None:
    """Store the index below ``path`` for many later searches.

    Postings are laid out by a hash bucket of the term, so a search reads only the
    buckets of its terms.  Rebalancing lets adaptive execution cut the bucket of a very
    frequent term into several files instead of giving it to one writer.
    """
    (
        postings(docs, keep_marks=True)
        .withColumn("bucket", _bucket(F.col("term")))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "field", "term")
        .write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    )
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    term_stats(stored).write.parquet(f"{path}/term_stats")
    field_stats(stored).write.parquet(f"{path}/field_stats")
    written = TextIndex(stored, None, docs.sparkSession.read.parquet(f"{path}/field_stats"))
    impact_levels(written).write.parquet(f"{path}/levels")


def read_index(spark, path: str) -> TextIndex:
    """Open a stored index."""
    return TextIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "term_stats", "field_stats", "levels")])


# ---------------------------------------------------------------------------
# query side


def query_clauses(analyzed: DataFrame, fields=TEXT_FIELDS) -> DataFrame:
    """Clauses of each query: the terms that share a position.

    Positions with the same terms become one clause that counts ``times``.  ``needed`` is
    the number of positions a field has to match and ``clause`` numbers the clauses of a
    query from 1.
    """
    positions = analyzed.groupBy("query_id", "position").agg(
        F.array_sort(F.collect_set("term")).alias("terms"), F.max("expanded").alias("expanded")
    )
    clauses = positions.groupBy("query_id", "terms", "expanded").agg(F.count("*").alias("times"))
    per_query = Window.partitionBy("query_id")
    needed = F.floor(F.lit(MIN_SHOULD_MATCH) * F.sum("times").over(per_query))
    numbered = clauses.withColumns({
        "clause": F.row_number().over(per_query.orderBy("terms", "expanded")),
        "needed": F.greatest(F.lit(1), needed).cast("long"),
    })
    return numbered.select(
        "query_id", "clause", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"),
        "terms", "expanded", "times", "needed",
    )


def keyword_clauses(queries: DataFrame) -> DataFrame:
    """The whole query string as the only term of the keyword field."""
    text = F.btrim(F.col("query"))
    return queries.filter(text != "").select(
        "query_id", F.lit(1).alias("clause"), F.lit("tags").alias("field"), F.array(text).alias("terms"),
        F.lit(False).alias("expanded"), F.lit(1).cast("long").alias("times"), F.lit(1).cast("long").alias("needed"),
    )


def clause_terms(clauses: DataFrame) -> DataFrame:
    """One row per clause and exact term, with boost 1."""
    return clauses.select(
        "query_id", "clause", "field", F.explode("terms").alias("term"),
        F.lit(1.0).alias("boost"), "expanded", "times", "needed",
    )


def fuzzy_clause_terms(
    clauses: DataFrame, vocabulary: DataFrame, max_expansions: int = None,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Clause terms in which every unexpanded term is replaced by its close terms."""
    exact = clause_terms(clauses.filter("expanded"))
    asked = clause_terms(clauses.filter(~F.col("expanded"))).withColumnRenamed("term", "query_term").drop("boost")
    found = fuzzy_match(
        asked.select("field", "query_term").distinct(), vocabulary, max_expansions, max_rows
    )
    close = asked.join(found.drop("edits"), ["field", "query_term"]).drop("query_term")
    return exact.unionByName(close)


def weigh_terms(terms: DataFrame, index: TextIndex) -> DataFrame:
    """Attach idf and average length; a clause uses the highest df of its terms.

    ``lone`` marks the clauses that have a single term in the index.
    """
    per_clause = Window.partitionBy("query_id", "clause", "field")
    fields = F.broadcast(index.field_stats)  # one row per field
    # the vocabulary may be large, the query terms are brought to it when measured small
    found = lookup_join(index.term_stats, terms, ["field", "term"], ["field", "term"])
    return (
        found.withColumns({"df": F.max("df").over(per_clause), "own_df": F.col("df"), "lone": F.count("*").over(per_clause) == 1})
        .join(fields, "field")
        .select(
            "query_id", "clause", "field", "term", "boost", "expanded", "lone", "times", "needed",
            (F.col("times") * scores.idf(F.col("n_docs"), F.col("df"))).alias("weight"), "avgdl", "own_df",
        )
    )


# ---------------------------------------------------------------------------
# scoring


def narrowed_index(docs: DataFrame, terms: DataFrame, fields=None, fold_index: bool = False) -> TextIndex:
    """Index of only the terms that ``terms`` (field, term) names, written once.

    One pass over the corpus feeds document frequencies, averages and scoring.
    """
    marks = terms.select("field").distinct().withColumn("term", F.lit(LENGTH_MARK))
    used = terms.select("field", "term").distinct().unionByName(marks)
    marked = postings(docs, fields or (*TEXT_FIELDS, "tags"), keep_marks=True, fold_index=fold_index)
    kept = lookup_join(marked, used, ["field", "term"], ["id"], "left_semi")
    kept = materialize(kept, "postings")
    return TextIndex(kept, term_stats(kept), field_stats(kept))


def _used_postings(index: TextIndex, weighted: DataFrame, small: bool) -> DataFrame:
    """Postings without length marks; those of a stored index only from the buckets of the terms."""
    rows = index.postings.filter(F.col("term") != LENGTH_MARK).drop("filled")
    if "bucket" not in rows.columns:
        return rows
    # naming the bucket lets partition pruning skip the files of all other terms
    used = weighted.select("field", "term").distinct().withColumn("bucket", _bucket(F.col("term")))
    used = F.broadcast(used) if small else used
    return rows.join(used, ["bucket", "field", "term"], "left_semi").drop("bucket")


def _matches(index: TextIndex, weighted: DataFrame, max_rows: int) -> DataFrame:
    """Postings joined with weighted query terms, partitioned by document.

    ``own_df`` of ``weighted`` adds up to the rows of the result.  They, not the bytes of the postings,
    give the number of tasks: a posting becomes one row for every query that asks for its term.
    """
    keys = ["field", "term"]
    small = fits(weighted, max_rows)
    rows = _used_postings(index, weighted, small)
    if small:
        tasks = tasks_for(weighted, F.sum("own_df"), PAIRS_PER_TASK)
        return rows.repartition(tasks, "id").join(F.broadcast(weighted.drop("own_df")), keys)
    hot = index.term_stats.filter(F.col("df") > HOT_TERM).select(
        *keys, F.ceil(F.col("df") / HOT_TERM).cast("int").alias("_splits")
    )
    return salted_join(rows, weighted.drop("own_df"), keys, ["id"], "inner", hot=hot)


def leading_clauses(weighted: DataFrame) -> DataFrame:
    """``query_id, field, clause`` of the clauses without which a field cannot match enough positions.

    Clauses are taken from the most frequent on while their positions stay below ``needed``.  A
    document that holds only such clauses matches too few, so it has to hold one of the others,
    the rarest.  Where all present clauses together stay below ``needed``, none is left.
    """
    clauses = weighted.groupBy("query_id", "field", "clause").agg(
        F.sum("own_df").alias("df"), F.max("times").alias("times"), F.max("needed").alias("needed")
    )
    frequent_first = Window.partitionBy("query_id", "field").orderBy(F.desc("df"), "clause")
    running = F.sum("times").over(frequent_first.rowsBetween(Window.unboundedPreceding, 0))
    leading = clauses.withColumn("reached", running).filter(F.col("reached") >= F.col("needed"))
    return leading.select("query_id", "field", "clause")


def leading_terms(weighted: DataFrame) -> DataFrame:
    """``query_id, field, term, own_df`` of the leading clauses."""
    keys = ["query_id", "field", "clause"]
    return weighted.join(leading_clauses(weighted), keys).select("query_id", "field", "term", "own_df")


def mark_leading(weighted: DataFrame) -> DataFrame:
    """Weighted terms with ``leads``, whether their clause is a leading one."""
    leading = leading_clauses(weighted).withColumn("leads", F.lit(True))
    return weighted.join(leading, ["query_id", "field", "clause"], "left").withColumn("leads", F.coalesce("leads", F.lit(False)))


def candidates(index: TextIndex, weighted: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Distinct ``query_id, id, field`` that can pass the 75 % rule: those that hold a leading term."""
    leading = materialize(leading_terms(weighted), "leading")
    return _matches(index, leading, max_rows).select("query_id", "id", "field").distinct()


def lookups_pay(weighted: DataFrame) -> bool:
    """Whether looking up the terms of all candidates is less work than forming every match.

    A candidate meets all terms of its query, also those that its document does not hold.  With a few
    dozen terms that is cheap, with the thousands of close terms of a fuzzy query it is a multiple of
    the matches.  Both sides are sums of document frequencies and need no look at the postings.
    """
    keys = ["query_id", "field"]
    asked = weighted.groupBy(*keys).agg(F.count("*").alias("terms"), F.sum("own_df").alias("matches"))
    found = leading_terms(weighted).groupBy(*keys).agg(F.sum("own_df").alias("found"))
    lookups, matches = asked.join(found, keys, "left").agg(
        F.sum(F.col("terms").cast("double") * F.col("found")), F.sum("matches")
    ).first()
    return (lookups or 0) <= LOOKUP_GAIN * (matches or 0)


def candidate_matches(
    index: TextIndex, weighted: DataFrame, found: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Postings of the candidates (``query_id, id, field``) with the weighted terms of their queries.

    Each candidate looks up the terms of its query, so the work is candidates times terms, not
    postings times queries; ``lookups_pay`` tells which is less.
    """
    keys = ["id", "field", "term"]
    found = materialize(found, "candidates")
    wanted = lookup_join(found, weighted, ["query_id", "field"], ["id"], max_rows=max_rows)
    rows = _used_postings(index, weighted, fits(weighted, max_rows))
    if fits(wanted, max_rows):
        return rows.join(F.broadcast(wanted), keys)
    rows = lookup_join(rows, found.select("id", "field").distinct(), ["id", "field"], ["term"], "left_semi", max_rows)
    return rows.join(wanted, keys)


def field_scores(
    index: TextIndex, weighted: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, found: DataFrame = None,
) -> DataFrame:
    """BM25 per query, document and field with the number of matched positions.

    Terms of a synonym clause count as one term: their frequencies add up.  Close terms of
    a fuzzy clause score one by one, each with its boost.  Clauses with a single term need
    no grouping of their own and share the group 0 of their document.  With ``found``, only
    these candidates (``query_id, id, field``) are scored.  A mark ``leads`` of terms tells in the
    result whether the document holds a marked one.
    """
    return _summed(_matches(index, weighted, max_rows) if found is None else candidate_matches(index, weighted, found, max_rows))


def _summed(matches: DataFrame) -> DataFrame:
    """The sums of ``field_scores`` over postings that are joined with weighted terms."""
    marks = ["leads"] if "leads" in matches.columns else []
    ratio = F.col("dl") / F.col("avgdl")
    pairs = matches.select(
        "query_id", "id", "field", F.when(F.col("lone"), 0).otherwise(F.col("clause")).alias("clause"),
        "lone", "expanded", "times", "needed", "tf", "weight", ratio.alias("ratio"),
        (F.col("weight") * F.col("boost") * scores.tf_norm(F.col("tf"), ratio)).alias("part"), *marks,
    )
    together = F.max("weight") * scores.tf_norm(F.sum("tf"), F.max("ratio"))
    per_clause = pairs.groupBy("query_id", "id", "field", "clause").agg(
        F.when(F.max(F.col("expanded") & ~F.col("lone")), together).otherwise(F.sum("part")).alias("part"),
        F.when(F.col("clause") == 0, F.sum("times")).otherwise(F.max("times")).alias("matched"),
        F.max("needed").alias("needed"), *[F.max(c).alias(c) for c in marks],
    )
    return per_clause.groupBy("query_id", "id", "field").agg(
        F.sum("part").alias("score"), F.sum("matched").alias("matched"), F.max("needed").alias("needed"),
        *[F.max(c).alias(c) for c in marks],
    )


def scored_in_groups(
    index: TextIndex, weighted: DataFrame, finish: Callable[[DataFrame], DataFrame], max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``finish`` of the ``field_scores``; queries whose terms cannot be broadcast at once are taken in groups.

    The scores of a query need its own terms only, and ``finish`` must look at single queries too.  The
    postings are partitioned by document once, with a number in place of field and term, and stay on the
    disks of the executors.  The terms of one group after the other are brought to them and its finished
    rows are written, so no match is shuffled and one group at a time is in memory.  Where ``QUERY_GROUPS``
    groups are too few, the salted join of ``field_scores`` takes all queries.
    """
    if isinstance(index, ScannedCorpus):
        found = _scanned(index, weighted, finish, max_rows)
        if found is not None:
            return found
    groups = fitting_groups(weighted, "query_id", QUERY_GROUPS, max_rows)
    if groups < 2:
        return finish(field_scores(index, weighted, max_rows))
    keys = ["field", "term"]
    used = weighted.select(*keys).distinct().withColumn("number", F.monotonically_increasing_id())
    used = materialize(used, "numbers")
    asked = lookup_join(weighted, used, keys, ["query_id"], max_rows=max_rows).drop("term")
    asked = materialize(asked.withColumn("group", hash_group("query_id", groups)), "asked")
    tasks = tasks_for(asked.groupBy("group").agg(F.sum("own_df").alias("pairs")), F.max("pairs"), PAIRS_PER_TASK)
    rows = index.postings.filter(F.col("term") != LENGTH_MARK)
    if "bucket" in rows.columns:  # of a stored index only the files of the terms are read
        keys, used = ["bucket", *keys], used.withColumn("bucket", _bucket(F.col("term")))
    rows = lookup_join(rows, used, keys, ["id"], max_rows=max_rows).select("id", "number", "tf", "dl")
    rows = rows.repartition(tasks, "id").persist(StorageLevel.DISK_ONLY)
    try:
        rows.count()  # once it is filled, its partitioning is known to the plans of the groups
        parts = []
        for group in range(groups):
            own = asked.filter(F.col("group") == group).drop("group", "own_df")
            parts.append(materialize(finish(_summed(rows.join(F.broadcast(own), "number"))), "scored"))
    finally:
        rows.unpersist()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _scanned(index: ScannedCorpus, weighted: DataFrame, finish: Callable, max_rows: int) -> DataFrame:
    """``scored_in_groups`` while the corpus is scanned; None where the distinct clauses cannot be broadcast.

    Rows that match too few positions are not given to ``finish``.  Rows of ids that are null or come
    twice count as one document; they are scored by their postings.
    """
    docs = index.docs
    several = materialize(docs.groupBy("id").count().filter(F.col("id").isNull() | (F.col("count") > 1)).select("id"), "several")
    alone = several.isEmpty()
    single = docs if alone else lookup_join(docs.filter(F.col("id").isNotNull()), several, ["id"], ["id"], "left_anti")
    scored = scan_scores(single, weighted, index.field_stats, max_rows, index.fold_index)
    if scored is None:
        return None
    found = finish(scored)
    if alone:
        return found
    rest = docs.filter(F.col("id").isNull()).unionByName(lookup_join(docs, several, ["id"], ["id"], "left_semi"))
    held = narrowed_index(rest, weighted, fold_index=index.fold_index)
    return found.unionByName(finish(field_scores(TextIndex(held.postings, index.term_stats, index.field_stats), weighted, max_rows)))


def min_should_match(scored: DataFrame) -> DataFrame:
    """Keep fields in which enough query positions matched."""
    return scored.filter(F.col("matched") >= F.col("needed"))


def best_fields(scored: DataFrame, boosts=FIELD_BOOSTS) -> DataFrame:
    """The best boosted field score of each document."""
    boost = F.lit(1.0)
    for field, value in boosts.items():
        boost = F.when(F.col("field") == field, F.lit(value)).otherwise(boost)
    return scored.groupBy("query_id", "id").agg(F.round(F.max(boost * F.col("score")), 6).alias("score"))


def topk_per_query(scored: DataFrame, k: int, score: str = "score", own_limit: str = None) -> DataFrame:
    """The best ``k`` rows per query by score, then id, with ``rank`` from 1.

    The constant limit is applied on the map side before the shuffle.  ``own_limit`` may
    name a column with a smaller limit of each query.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("id"))
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if own_limit:
        best = best.filter(F.col("rank") <= F.col(own_limit))
    return best.withColumn("rank", F.col("rank").cast("long"))


def total_hits(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact number of matching documents per query, zero included."""
    counts = scored.groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("total_hits")
    )


def bm25(docs: DataFrame, analyzed: DataFrame, fields=("content",)) -> DataFrame:
    """Plain BM25 of analysed queries over text fields, without the 75 % rule."""
    terms = clause_terms(materialize(query_clauses(analyzed, fields), "clauses"))
    index = narrowed_index(docs, terms, fields)
    return field_scores(index, materialize(weigh_terms(terms, index), "weights"))


def multi_match(
    queries: DataFrame, analyzed: DataFrame, docs: DataFrame = None, index: TextIndex = None,
    fuzzy: bool = True, max_expansions: int = None, fold_index: bool = False,
) -> DataFrame:
    """All documents matching each query over title, content and tags.

    Combines the 75 % rule, fuzzy terms and the best boosted field.  Give the corpus
    ``docs`` for a one-off search or a stored ``index`` to skip the pass over the corpus; a
    stored index keeps the folding it was written with.
    """
    if index and fold_index:
        raise ValueError("fold_index belongs to the writing of a stored index")
    clauses = materialize(query_clauses(analyzed).unionByName(keyword_clauses(queries)), "clauses")
    if fuzzy:
        index = index or ScannedCorpus(docs, fold_index)
        terms = materialize(fuzzy_clause_terms(clauses, index.term_stats, max_expansions), "clause_terms")
        index.terms = terms
    else:
        terms = clause_terms(clauses)
    index = index or narrowed_index(docs, terms, fold_index=fold_index)
    weighted = materialize(weigh_terms(terms, index), "weights")
    if lookups_pay(weighted):
        return best_fields(min_should_match(field_scores(index, weighted, found=candidates(index, weighted))))
    # every match is scored by document, and the candidates are those that hold a leading term
    marked = materialize(mark_leading(weighted), "marked")
    return scored_in_groups(index, marked, lambda scored: best_fields(min_should_match(scored.filter("leads"))))


def kept_levels(index: TextIndex, weighted: DataFrame, k: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``query_id, field, term, least, n, kept``: from which level on the postings of each term give candidates.

    Documents of the terms with the largest contributions are scored first; the k-th best of them is a
    score that a hit has to reach.  Then postings are left out, those of frequent terms first, while
    the largest contributions of what is left out add up to less: a document that occurs there only
    cannot be among the best.  Of the term at the border the lower levels go.  ``n`` counts the
    postings of the term and ``kept`` those that stay; a term that is left out whole has no row.
    """
    gains = weighted.groupBy("query_id", "field", "term").agg(F.sum(F.col("weight") * F.col("boost")).alias("gain"))
    levels = index.levels if index.levels is not None else impact_levels(index)
    blocks = lookup_join(levels, gains, ["field", "term"], ["level"], max_rows=max_rows).select(
        "query_id", "field", "term", "level", "n", (F.col("gain") * F.col("peak")).alias("top")
    )
    blocks = materialize(blocks, "blocks")
    terms = blocks.groupBy("query_id", "field", "term").agg(F.sum("n").alias("df"), F.max("top").alias("most"))
    strong = Window.partitionBy("query_id").orderBy(F.desc("most"), "field", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = terms.withColumn("before", F.coalesce(F.sum("df").over(strong), F.lit(0))).filter(F.col("before") < SEED_POSTINGS * k)
    seeds = materialize(seeds.select("query_id", "field", "term", F.col("df").alias("own_df")), "seeds")
    first = _matches(index, seeds, max_rows).select("query_id", "id", "field").distinct()
    scored = field_scores(index, weighted, max_rows, first)
    floor = topk_per_query(scored, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("hits"))
    # scores are compared after rounding to six digits
    floor = floor.filter(F.col("hits") == k).select("query_id", (F.col("floor") - 2e-6).alias("floor"))
    frequent = Window.partitionBy("query_id").orderBy(F.desc("df"), "field", "term")
    bounded = terms.withColumn("upto", F.sum("most").over(frequent.rowsBetween(Window.unboundedPreceding, 0)))
    bounded = lookup_join(bounded, floor, ["query_id"], ["term"], "left", max_rows)
    bounded = bounded.withColumn("room", F.col("floor") - (F.col("upto") - F.col("most"))).filter(
        F.col("floor").isNull() | (F.col("upto") >= F.col("floor"))
    )
    left = blocks.join(bounded.select("query_id", "field", "term", "room", "df"), ["query_id", "field", "term"])
    left = left.filter(F.col("room").isNull() | (F.col("top") >= F.col("room")))
    return left.groupBy("query_id", "field", "term").agg(
        F.min("level").alias("least"), F.max("df").alias("n"), F.sum("n").alias("kept")
    )


def bm25_topk(
    index: TextIndex, analyzed: DataFrame, k: int, field: str = "content", max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """The ``k`` best documents per query by plain BM25 over one field, without scoring every match.

    The result is that of ``topk_per_query`` over ``bm25``; postings whose blocks cannot lift a
    document into it are never looked at.
    """
    terms = clause_terms(materialize(query_clauses(analyzed, (field,)), "clauses"))
    weighted = materialize(weigh_terms(terms, index), "weights")
    least = materialize(kept_levels(index, weighted, k, max_rows), "least")
    part = scores.tf_norm(F.col("tf"), F.col("dl") / F.col("avgdl"))
    averages = F.broadcast(index.field_stats.select("field", "avgdl"))
    asked = least.select("query_id", "field", "term", "least", F.col("n").alias("own_df"))
    found = _matches(index, asked, max_rows).join(averages, "field")
    found = found.filter(_level(part) >= F.col("least")).select("query_id", "id", "field").distinct()
    scored = field_scores(index, weighted, max_rows, found)
    return topk_per_query(scored.select("query_id", "id", F.round("score", 6).alias("score")), k)
