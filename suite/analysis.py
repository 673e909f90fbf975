"""Registered queries: text analysis and index statistics."""

from pyspark.sql import functions as F

from rankloom.functions.text import ascii_fold as fold_column, tokens
from rankloom.operators import analysis as ops
from rankloom.sources.synonyms import DEFAULT_RULES, default_synonyms, parse_rules

from .inputs import CORPUS, corpus, table, with_ctes


def utterances(spark, sf_dir):
    """Document titles and conversation turns as queries."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("query"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        (F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"),
    )
    return docs.unionByName(turns)


def analyze_index(spark, sf_dir):
    return ops.analyze_index(corpus(spark, sf_dir))


def ascii_fold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return ops.ascii_fold(docs, "text", "folded").select("doc_id", "folded")


def synonym_expand(spark, sf_dir):
    found = ops.query_tokens(utterances(spark, sf_dir))
    return ops.synonym_expand(found, default_synonyms(spark)).select("query_id", "position", "token", "term")


def synonym_phrases(spark, sf_dir):
    """Beginnings of the passages, two and three words long, as inputs that documents and turns may hold."""
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens(fold_column(F.lower("text"))).alias("w"))
    sides = [F.array_join(F.slice("w", 1, n), " ") for n in (2, 3)]
    lines = items.select(F.concat(sides[0], F.lit(", "), sides[1], F.lit(" => item"), F.col("item_id").cast("string")).alias("value"))
    found = ops.query_tokens(utterances(spark, sf_dir))
    return ops.synonym_expand(found, parse_rules(lines)).filter("expanded").select("query_id", "position", "token", "term")


def stop_filter(spark, sf_dir):
    return ops.stop_filter(ops.query_tokens(utterances(spark, sf_dir)), "token")


def analyze_query(spark, sf_dir):
    analyzed = ops.analyze_query(utterances(spark, sf_dir), default_synonyms(spark))
    return analyzed.select("query_id", "position", "term")


def keyword_term(spark, sf_dir):
    return ops.keyword_terms(corpus(spark, sf_dir))


def postings(spark, sf_dir):
    return ops.postings(corpus(spark, sf_dir))


def field_len(spark, sf_dir):
    return ops.field_len(corpus(spark, sf_dir))


def term_stats(spark, sf_dir):
    return ops.term_stats(ops.postings(corpus(spark, sf_dir), keep_marks=True))


def field_stats(spark, sf_dir):
    stats = ops.field_stats(ops.postings(corpus(spark, sf_dir), keep_marks=True))
    return stats.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


QUERIES = {f.__name__: f for f in (
    analyze_index, ascii_fold, synonym_expand, synonym_phrases, stop_filter, analyze_query, keyword_term, postings, field_len,
    term_stats, field_stats,
)}

# the word rules without look-around; the tables hold no script that is written without blanks
_INNER = r"[\p{L}\p{M}\p{N}_]"
_JOINED = r"(?:\p{L}\p{M}*(?:[.''’:·]\p{L}\p{M}*)+|\p{N}(?:[.,''’;]\p{N})+)"
WORD_RULE = rf"(?:[\p{{L}}\p{{N}}]{_INNER}*)?{_JOINED}(?:{_INNER}*{_JOINED})*{_INNER}*|[\p{{L}}\p{{N}}]{_INNER}*"
WORD = f"'{WORD_RULE}'"
_SHARP_S = "'ß', 'ss'"


def fold_sql(text: str) -> str:
    return f"replace(strip_accents({text}), {_SHARP_S})"


def _rules_sql() -> str:
    """The default rules as (lhs, rhs) rows, written out for SQL."""
    import re
    import unicodedata

    def words(entry):
        plain = "".join(c for c in unicodedata.normalize("NFD", entry.lower()) if unicodedata.category(c) != "Mn")
        return re.findall(r"[a-z0-9]+", plain)

    pairs = set()
    for line in DEFAULT_RULES.splitlines():
        if line.strip() and not line.startswith("#"):
            left, arrow, right = line.partition("=>")
            inputs = [words(e) for e in left.split(",")]
            outputs = [w for e in (right if arrow else left).split(",") for w in words(e)]
            pairs |= {(" ".join(i), o) for i in inputs if i for o in outputs}
    return "synonyms(lhs, rhs) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in sorted(pairs)) + ")"


SYNONYMS = _rules_sql()
STOP_LIST = "('" + "', '".join(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these "
    "they this to was will with".split()
) + "')"


def query_tokens_cte(source: str, name: str = "query_tokens") -> str:
    return f"""{name} AS (
  SELECT query_id, u.i - 1 AS position, words[u.i] AS token
  FROM (SELECT query_id, regexp_extract_all(lower({fold_sql('lower(query)')}), {WORD}) AS words FROM {source}),
       LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) u)"""


# inputs of two tokens, which cannot overlap in the default rules
EXPANDED = """two_words AS (SELECT DISTINCT lhs, split_part(lhs, ' ', 1) AS one, split_part(lhs, ' ', 2) AS two FROM synonyms WHERE contains(lhs, ' ')),
word_runs AS (
  SELECT a.query_id, a.position, lhs AS token
  FROM query_tokens a JOIN two_words ON a.token = one
       JOIN query_tokens b ON b.query_id = a.query_id AND b.position = a.position + 1 AND b.token = two),
runs_placed AS (
  SELECT t.query_id, t.position, t.token FROM query_tokens t
       ANTI JOIN (SELECT query_id, unnest([position, position + 1]) AS position FROM word_runs) r
       ON r.query_id = t.query_id AND r.position = t.position
  UNION ALL SELECT * FROM word_runs),
expanded AS (
  SELECT DISTINCT query_id, position, token, coalesce(rhs, token) AS term, rhs IS NOT NULL AS is_synonym
  FROM runs_placed LEFT JOIN synonyms ON token = lhs)"""
ANALYZED = f"""analyzed AS (SELECT * FROM expanded WHERE term NOT IN {STOP_LIST})"""

_UTTERANCES = """utterances AS (
  SELECT doc_id AS query_id, text AS query FROM documents
  UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, text FROM conversations)"""
FIELD_TOKENS = rf"""field_tokens AS (
  SELECT id, 'title' AS field, regexp_extract_all(lower(title), {WORD}) AS words FROM corpus
  UNION ALL SELECT id, 'content', regexp_extract_all(lower(content), {WORD}) FROM corpus)"""
FIELD_LEN = "field_len AS (SELECT id, field, CAST(len(words) AS BIGINT) AS dl FROM field_tokens)"
POSTINGS = """postings AS (
  SELECT id, field, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT id, field, unnest(words) AS term, CAST(len(words) AS BIGINT) AS dl FROM field_tokens)
  GROUP BY id, field, term
  UNION ALL
  SELECT DISTINCT id, 'tags', unnest(tags), 1, CAST(NULL AS BIGINT) FROM corpus)"""
FIELD_STATS = """field_stats AS (
  SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM field_len WHERE dl > 0 GROUP BY field
  UNION ALL SELECT 'tags', count(*) FILTER (len(tags) > 0), NULL FROM corpus)"""
TERM_STATS = "term_stats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term)"

ORACLE = {
    "analyze_index": with_ctes(f"""
        SELECT id, u.i - 1 AS position, words[u.i] AS token
        FROM (SELECT id, regexp_extract_all(lower(content), {WORD}) AS words FROM corpus),
             LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) u""", CORPUS),
    "ascii_fold": f"SELECT doc_id, {fold_sql('lower(text)')} AS folded FROM documents",
    "synonym_expand": with_ctes(
        "SELECT query_id, position, token, term FROM expanded",
        _UTTERANCES, SYNONYMS, query_tokens_cte("utterances"), EXPANDED),
    "synonym_phrases": "WITH RECURSIVE " + ",\n".join((_UTTERANCES, query_tokens_cte("utterances"), f"""items AS (SELECT item_id, regexp_extract_all(lower({fold_sql('lower(text)')}), {WORD}) AS w FROM benchmark),
        rules AS (
          SELECT DISTINCT array_to_string(w[1:k], ' ') AS lhs, 'item' || item_id AS rhs
          FROM items, (VALUES (2), (3)) r(k) WHERE len(w) > 0),
        ahead AS (
          SELECT *, token || ' ' || lead(token, 1) OVER w AS two, token || ' ' || lead(token, 1) OVER w || ' ' || lead(token, 2) OVER w AS three
          FROM query_tokens WINDOW w AS (PARTITION BY query_id ORDER BY position)),
        matches AS (
          SELECT query_id, position, 2 AS words, two AS lhs FROM ahead SEMI JOIN rules ON two = lhs
          UNION ALL SELECT query_id, position, 3, three FROM ahead SEMI JOIN rules ON three = lhs),
        longest AS (
          SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY query_id, position ORDER BY words DESC) = 1),
        chosen(query_id, position, words) AS (
          SELECT query_id, min(position), arg_min(words, position) FROM longest GROUP BY query_id
          UNION ALL
          SELECT l.query_id, min(l.position), arg_min(l.words, l.position) FROM chosen c JOIN longest l
            ON l.query_id = c.query_id AND l.position >= c.position + c.words GROUP BY l.query_id),
        covered AS (SELECT query_id, position + i AS position FROM chosen, range(3) r(i) WHERE i < words),
        placed AS (
          SELECT query_id, position, lhs AS token FROM chosen JOIN longest USING (query_id, position, words)
          UNION ALL SELECT query_id, position, token FROM query_tokens t ANTI JOIN covered USING (query_id, position))
        SELECT query_id, position, token, rhs AS term FROM placed JOIN rules ON token = lhs""")),
    "stop_filter": with_ctes(
        f"SELECT query_id, position, token FROM query_tokens WHERE token NOT IN {STOP_LIST}",
        _UTTERANCES, query_tokens_cte("utterances")),
    "analyze_query": with_ctes(
        "SELECT query_id, position, term FROM analyzed",
        _UTTERANCES, SYNONYMS, query_tokens_cte("utterances"), EXPANDED, ANALYZED),
    "keyword_term": with_ctes("SELECT id, unnest(tags) AS term FROM corpus", CORPUS),
    "postings": with_ctes("SELECT * FROM postings", CORPUS, FIELD_TOKENS, POSTINGS),
    "field_len": with_ctes("SELECT * FROM field_len", CORPUS, FIELD_TOKENS, FIELD_LEN),
    "term_stats": with_ctes("SELECT * FROM term_stats", CORPUS, FIELD_TOKENS, POSTINGS, TERM_STATS),
    "field_stats": with_ctes(
        "SELECT field, n_docs, round(avgdl, 6) AS avgdl FROM field_stats",
        CORPUS, FIELD_TOKENS, FIELD_LEN, FIELD_STATS),
}
