"""Registered queries: BM25 retrieval, fuzzy terms, filters, hit presentation."""

from pyspark.sql import functions as F

from rankloom.operators import filters, lexical as ops, present
from rankloom.operators.analysis import analyze_query, postings, query_tokens, term_stats
from rankloom.operators.fuzzy import fuzzy_match as match_fuzzy
from rankloom.operators.quality import freshness, popularity
from rankloom.sources.synonyms import default_synonyms
from rankloom.workspace import fresh_path, materialize

from .analysis import (
    ANALYZED, EXPANDED, FIELD_LEN, FIELD_STATS, FIELD_TOKENS, POSTINGS, SYNONYMS, TERM_STATS, WORD, WORD_RULE, query_tokens_cte,
)
from .inputs import AS_OF, CORPUS, QUERIES as QUERIES_SQL, as_of, corpus, passages, with_ctes


def _analyzed(spark, sf_dir):
    return analyze_query(passages(spark, sf_dir), default_synonyms(spark))


def _content_scores(spark, sf_dir):
    scored = ops.bm25(corpus(spark, sf_dir), _analyzed(spark, sf_dir))
    return scored.select("query_id", "id", F.round("score", 6).alias("score"))


def bm25(spark, sf_dir):
    return _content_scores(spark, sf_dir)


def min_should_match(spark, sf_dir):
    analyzed = _analyzed(spark, sf_dir)
    scored = ops.bm25(corpus(spark, sf_dir), analyzed, ("title", "content"))
    return ops.min_should_match(scored).select("query_id", "id", "field", "matched", "needed")


def multi_match(spark, sf_dir):
    return ops.multi_match(passages(spark, sf_dir), _analyzed(spark, sf_dir), corpus(spark, sf_dir), fuzzy=False)


def indexed_search(spark, sf_dir):
    """The same search over a stored index."""
    path = fresh_path(spark, "index")
    ops.write_index(corpus(spark, sf_dir), path)
    index = ops.read_index(spark, path)
    return ops.multi_match(passages(spark, sf_dir), _analyzed(spark, sf_dir), index=index, fuzzy=False)


def multi_match_fuzzy(spark, sf_dir):
    return ops.multi_match(passages(spark, sf_dir), _analyzed(spark, sf_dir), corpus(spark, sf_dir))


def fuzzy_match(spark, sf_dir):
    asked = query_tokens(passages(spark, sf_dir)).select(
        F.lit("content").alias("field"), F.col("token").alias("query_term")
    ).distinct()
    vocabulary = term_stats(postings(corpus(spark, sf_dir), ("content",))).select("field", "term")
    vocabulary = materialize(vocabulary, "vocabulary")
    found = match_fuzzy(asked, vocabulary)
    return found.withColumns({"edits": F.col("edits").cast("long"), "boost": F.round("boost", 6)})


def topk_per_query(spark, sf_dir):
    return ops.topk_per_query(_content_scores(spark, sf_dir), 10)


def indexed_topk(spark, sf_dir):
    """The same hits from a stored index whose blocks of small contributions are skipped."""
    path = fresh_path(spark, "index")
    ops.write_index(corpus(spark, sf_dir), path)
    return ops.bm25_topk(ops.read_index(spark, path), _analyzed(spark, sf_dir), 10)


def total_hits(spark, sf_dir):
    return ops.total_hits(_content_scores(spark, sf_dir), passages(spark, sf_dir))


def terms_filter(spark, sf_dir):
    scored = _content_scores(spark, sf_dir)
    kept = filters.filter_matches(scored, corpus(spark, sf_dir), passages(spark, sf_dir), filters.terms_condition())
    return kept


def date_filter(spark, sf_dir):
    scored = _content_scores(spark, sf_dir)
    return filters.filter_matches(
        scored, corpus(spark, sf_dir), passages(spark, sf_dir), filters.date_condition(as_of())
    )


def hit_projection(spark, sf_dir):
    docs = popularity(freshness(corpus(spark, sf_dir), as_of()))
    return present.hit_projection(docs).withColumns({
        "tags": F.array_join("tags", ","), "created_at": F.date_format("created_at", "yyyy-MM-dd"),
        "popularity_score": F.round("popularity_score", 6), "freshness_score": F.round("freshness_score", 6),
    })


def _hits(spark, sf_dir, k):
    best = materialize(ops.topk_per_query(_content_scores(spark, sf_dir), k), "hits")
    docs = popularity(freshness(corpus(spark, sf_dir), as_of()))
    return present.attach_documents(best, docs)


def highlight(spark, sf_dir):
    terms = _analyzed(spark, sf_dir).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    marked = present.highlight(_hits(spark, sf_dir, 10), terms)
    return marked.select("query_id", "id", "rank", "title", "content")


def snippet(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", present.snippet(F.col("content")).alias("snippet"))


def hit_metadata(spark, sf_dir):
    shown = present.hit_metadata(_hits(spark, sf_dir, 10))
    return shown.select(
        "query_id", "id", "rank", "title", "content", "score", "metadata.file_type", "metadata.language",
        F.array_join("metadata.tags", ",").alias("tags"),
        F.date_format("metadata.created_at", "yyyy-MM-dd").alias("created_at"),
        "metadata.github_stars", "metadata.view_count", "metadata.popularity_score",
        "metadata.freshness_score", "metadata.source",
    )


def empty_query(spark, sf_dir):
    """Every fourth passage is blanked; the others keep their hits."""
    blanked = F.when(F.col("query_id") % 4 == 0, "  ").otherwise(F.col("query"))
    queries = passages(spark, sf_dir).withColumn("query", blanked)
    analyzed = analyze_query(queries, default_synonyms(spark))
    hits = ops.multi_match(queries, analyzed, corpus(spark, sf_dir), fuzzy=False)
    return present.empty_query(queries, hits)


QUERIES = {f.__name__: f for f in (
    bm25, min_should_match, multi_match, indexed_search, multi_match_fuzzy, fuzzy_match, topk_per_query, indexed_topk, total_hits,
    terms_filter, date_filter, hit_projection, highlight, snippet, hit_metadata, empty_query,
)}


def clause_ctes(queries: str = "queries") -> tuple:
    return SYNONYMS, query_tokens_cte(queries), EXPANDED, ANALYZED, """positions AS (
  SELECT query_id, position, list_sort(list_distinct(list(term))) AS terms, bool_or(is_synonym) AS expanded
  FROM analyzed GROUP BY query_id, position)""", """needed AS (
  SELECT query_id, greatest(1, CAST(floor(0.75 * count(*)) AS BIGINT)) AS needed FROM positions GROUP BY query_id)""", f"""clauses AS (
  SELECT query_id, (CASE WHEN expanded THEN '~' ELSE '=' END) || array_to_string(terms, ' ') AS clause,
         field, terms, expanded, count(*) AS times, any_value(needed) AS needed
  FROM positions JOIN needed USING (query_id), (VALUES ('title'), ('content')) AS f(field)
  GROUP BY query_id, terms, expanded, field
  UNION ALL
  SELECT query_id, trim(query), 'tags', [trim(query)], false, 1, 1 FROM {queries} WHERE trim(query) <> '')"""


EXACT_TERMS = """clause_terms AS (
  SELECT query_id, clause, field, unnest(terms) AS term, CAST(1.0 AS DOUBLE) AS boost, expanded, times, needed FROM clauses)"""
SCORES = """weighted AS (
  SELECT c.*, n_docs, avgdl, max(df) OVER (PARTITION BY query_id, clause, field) AS df
  FROM clause_terms c JOIN term_stats USING (field, term) JOIN field_stats USING (field)),
pairs AS (
  SELECT w.*, id, tf, coalesce(dl / avgdl, 1.0) AS ratio
  FROM weighted w JOIN postings USING (field, term)),
per_clause AS (
  SELECT query_id, id, field, clause, any_value(times) AS times, any_value(needed) AS needed,
         ln(1.0 + (any_value(n_docs) - any_value(df) + 0.5) / (any_value(df) + 0.5))
         * CASE WHEN bool_or(expanded)
             THEN sum(tf) * 2.2 / (sum(tf) + 1.2 * (0.25 + 0.75 * any_value(ratio)))
             ELSE sum(boost * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ratio))) END AS part
  FROM (SELECT query_id, id, field, clause, times, needed, CAST(n_docs AS DOUBLE) AS n_docs,
               CAST(df AS DOUBLE) AS df, expanded, CAST(boost AS DOUBLE) AS boost, CAST(tf AS DOUBLE) AS tf,
               CAST(ratio AS DOUBLE) AS ratio FROM pairs)
  GROUP BY query_id, id, field, clause),
field_scores AS (
  SELECT query_id, id, field, sum(times * part) AS score, CAST(sum(times) AS BIGINT) AS matched,
         max(needed) AS needed
  FROM per_clause GROUP BY query_id, id, field)"""
BEST = """matches AS MATERIALIZED (
  SELECT query_id, id, round(max(score * CASE field WHEN 'title' THEN 2.0 ELSE 1.0 END), 6) AS score
  FROM field_scores WHERE matched >= needed GROUP BY query_id, id)"""
INDEX = (CORPUS, FIELD_TOKENS, FIELD_LEN, POSTINGS, FIELD_STATS, TERM_STATS)
CONTENT = "content_scores AS (SELECT query_id, id, round(score, 6) AS score FROM field_scores WHERE field = 'content')"
BASE = (*INDEX, QUERIES_SQL, *clause_ctes(), EXACT_TERMS, SCORES)
TOP10 = """top10 AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM content_scores
  QUALIFY rank <= 10)"""

# Pairs at true distance 2 but plain distance 3 or more need one swap that no other edit touches.
SWAP_OK = """list_bool_or(list_transform(range(1, length(q)), lambda i: list_bool_or(list_transform([i - 1, i, i + 1],
    lambda j: j >= 1 AND j < length(t) AND q[i:i] = t[j+1:j+1] AND q[i+1:i+1] = t[j:j] AND (
      (left(q, i - 1) = left(t, j - 1) AND damerau_levenshtein(substr(q, i + 2), substr(t, j + 2)) <= 1)
      OR (damerau_levenshtein(left(q, i - 1), left(t, j - 1)) <= 1 AND substr(q, i + 2) = substr(t, j + 2)))))))"""


# DuckDB measures edits in bytes, so every accented letter is first mapped to one spare ASCII sign.
_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ"
_SPARE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+"


def fuzzy_ctes(asked: str, vocabulary: str) -> tuple:
    """``close(field, query_term, term, edits, boost)`` for asked(field, query_term), vocabulary(field, term)."""
    return f"""asked_terms AS (
  SELECT DISTINCT translate(query_term, '{_ACCENTED}', '{_SPARE}') AS q, query_term,
         CASE WHEN length(query_term) <= 2 THEN 0 WHEN length(query_term) <= 5 THEN 1 ELSE 2 END AS allowed
  FROM {asked})""", f"""words AS (
  SELECT DISTINCT translate(term, '{_ACCENTED}', '{_SPARE}') AS t, term FROM {vocabulary})""", """asked_lengths AS (
  SELECT q, query_term, allowed, unnest(range(length(q) - allowed, length(q) + allowed + 1)) AS size
  FROM asked_terms WHERE allowed > 0)""", """word_lengths AS (SELECT t, term, length(t) AS size FROM words)""", """pairs_close AS MATERIALIZED (
  SELECT q, t, query_term, term, dl, levenshtein(q, t) AS lev
  FROM (SELECT q, t, query_term, term, allowed, damerau_levenshtein(q, t) AS dl
        FROM asked_lengths JOIN word_lengths USING (size))
  WHERE dl <= allowed
  UNION ALL SELECT q, q, query_term, query_term, 0, 0 FROM asked_terms WHERE allowed = 0)""", f"""close_terms AS (
  SELECT query_term, term, CASE WHEN dl = 2 AND lev > 2 AND NOT {SWAP_OK} THEN 3 ELSE dl END AS edits
  FROM pairs_close)""", f"""close AS MATERIALIZED (
  SELECT field, query_term, term, edits, CAST(1.0 AS DOUBLE) - edits / least(length(query_term), length(term)) AS boost
  FROM {asked} JOIN close_terms USING (query_term)
       JOIN (SELECT DISTINCT field, term FROM {vocabulary}) v USING (field, term)
  WHERE edits <= 2 AND boost > 0)"""


FUZZY_TERMS = ("""asked AS (
  SELECT DISTINCT field, terms[1] AS query_term FROM clauses WHERE NOT expanded)""",
  *fuzzy_ctes("asked", "term_stats"), """clause_terms AS MATERIALIZED (
  SELECT query_id, clause, field, unnest(terms) AS term, CAST(1.0 AS DOUBLE) AS boost, expanded, times, needed
  FROM clauses WHERE expanded
  UNION ALL
  SELECT query_id, clause, c.field, close.term, boost, expanded, times, needed
  FROM clauses c JOIN close ON close.field = c.field AND close.query_term = terms[1] WHERE NOT expanded)""")
FUZZY_BASE = (*INDEX, QUERIES_SQL, *clause_ctes(), *FUZZY_TERMS, SCORES, BEST)

_TERMS_CONDITION = """(len(filter_language) = 0 OR list_contains(filter_language, language))
  AND (len(filter_source) = 0 OR list_contains(filter_source, source))
  AND (len(filter_file_type) = 0 OR list_contains(filter_file_type, file_type))"""
_DATE_CONDITION = f"""(date_from IS NULL OR created_at >= date_from)
  AND created_at <= coalesce(date_to, CASE WHEN date_from IS NOT NULL THEN TIMESTAMP '{AS_OF}' END, created_at)"""
_FRESH = f"exp(-CAST(date_diff('day', modified_at, TIMESTAMP '{AS_OF}') AS DOUBLE) / 365.0)"
_POPULAR = """(CAST(0.7 AS DOUBLE) * least(github_stars / 10000.0, 1.0)
               + CAST(0.3 AS DOUBLE) * least(view_count / 100000.0, 1.0))"""


def _filtered(condition):
    return f"""SELECT query_id, id, score FROM content_scores JOIN corpus USING (id) JOIN queries USING (query_id)
               WHERE {condition}"""


def _mark(piece):
    return f"""array_to_string(list_transform(regexp_extract_all({piece}, '{WORD_RULE}|[^\\p{{L}}\\p{{N}}]+'),
        lambda w: CASE WHEN list_contains(terms, lower(w)) THEN '<em>' || w || '</em>' ELSE w END), '')"""


def _fragments(column, size, count):
    pieces = f"regexp_extract_all({column}, '(?s).{{1,{size}}}(?:\\s|\\z)|.{{{size}}}')"
    hits = f"len(list_filter(regexp_extract_all(lower(p), {WORD}), lambda w: list_contains(terms, w)))"
    ranked = f"""list_sort(list_filter(list_transform({pieces}, lambda p, i: {{'misses': -{hits}, 'at': i, 'piece': p}}),
        lambda s: s.misses < 0))"""
    return f"list_transform(({ranked})[1:{count}], lambda s: trim({_mark('s.piece')}))"


ORACLE = {
    "bm25": with_ctes("SELECT * FROM content_scores", *BASE, CONTENT),
    "min_should_match": with_ctes(
        "SELECT query_id, id, field, matched, needed FROM field_scores WHERE matched >= needed AND field <> 'tags'", *BASE),
    "multi_match": with_ctes("SELECT * FROM matches", *BASE, BEST),
    "indexed_search": with_ctes("SELECT * FROM matches", *BASE, BEST),
    "multi_match_fuzzy": with_ctes("SELECT * FROM matches", *FUZZY_BASE),
    "fuzzy_match": with_ctes(
        "SELECT field, query_term, term, edits, round(boost, 6) AS boost FROM close",
        CORPUS, FIELD_TOKENS, POSTINGS, QUERIES_SQL, query_tokens_cte("queries"),
        "vocabulary AS (SELECT DISTINCT field, term FROM postings WHERE field = 'content')",
        "asked AS (SELECT DISTINCT 'content' AS field, token AS query_term FROM query_tokens)",
        *fuzzy_ctes("asked", "vocabulary")),
    "topk_per_query": with_ctes("SELECT query_id, id, score, rank FROM top10", *BASE, CONTENT, TOP10),
    "indexed_topk": with_ctes("SELECT query_id, id, score, rank FROM top10", *BASE, CONTENT, TOP10),
    "total_hits": with_ctes("""
        SELECT query_id, count(id) AS total_hits FROM queries LEFT JOIN content_scores USING (query_id)
        GROUP BY query_id""", *BASE, CONTENT),
    "terms_filter": with_ctes(_filtered(_TERMS_CONDITION), *BASE, CONTENT),
    "date_filter": with_ctes(_filtered(_DATE_CONDITION), *BASE, CONTENT),
    "hit_projection": with_ctes(f"""
        SELECT id, title, content, file_type, language, array_to_string(tags, ',') AS tags,
               strftime(created_at, '%Y-%m-%d') AS created_at, github_stars, view_count,
               round({_POPULAR}, 6) AS popularity_score, round({_FRESH}, 6) AS freshness_score, source
        FROM corpus""", CORPUS),
    "highlight": with_ctes(f"""
        SELECT query_id, id, rank, CASE WHEN len(marked_title) > 0 THEN marked_title[1] ELSE title END AS title,
               CASE WHEN len(marked_content) > 0 THEN array_to_string(marked_content, ' [...] ')
                    WHEN length(content) > 150 THEN left(content, 150) || '...' ELSE content END AS content
        FROM (SELECT *, {_fragments('title', 100, 1)} AS marked_title, {_fragments('content', 150, 2)} AS marked_content
              FROM top10 JOIN corpus USING (id)
                   JOIN (SELECT query_id, list(DISTINCT term) AS terms FROM analyzed GROUP BY query_id) USING (query_id))""",
        *BASE, CONTENT, TOP10),
    "snippet": with_ctes("""
        SELECT id, CASE WHEN length(content) > 150 THEN left(content, 150) || '...' ELSE content END AS snippet
        FROM corpus""", CORPUS),
    "hit_metadata": with_ctes(f"""
        SELECT query_id, id, rank, title, content, round(score, 2) AS score, file_type, language,
               array_to_string(tags, ',') AS tags, strftime(created_at, '%Y-%m-%d') AS created_at, github_stars,
               view_count, round({_POPULAR}, 3) AS popularity_score, round({_FRESH}, 3) AS freshness_score, source
        FROM top10 JOIN corpus USING (id)""", *BASE, CONTENT, TOP10),
    "empty_query": with_ctes("""
        SELECT query_id, query, count(id) AS total_hits,
               CASE WHEN count(id) = 0 THEN 'no hits' END AS error
        FROM some_queries LEFT JOIN matches USING (query_id) GROUP BY query_id, query""",
        *INDEX, QUERIES_SQL,
        "some_queries AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN '  ' ELSE query END AS query FROM queries)",
        *clause_ctes("some_queries"), EXACT_TERMS, SCORES, BEST),
}
