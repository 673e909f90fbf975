"""Registered queries: sources, sinks, upserts.

File operators write a supplied table to a fresh folder and read it back.
"""

from pyspark.sql import functions as F

from rankloom.sources import corpus_table, files
from rankloom.sources.synonyms import load_rules
from rankloom.streaming.upsert import stream_upsert as run_stream
from rankloom.workspace import fresh_path, materialize

from .analysis import WORD
from .inputs import CORPUS, corpus, table, with_ctes


def _values(raw):
    return raw.select(
        F.variant_get("v", "$.doc_id", "bigint").alias("doc_id"),
        F.variant_get("v", "$.text", "string").alias("text"),
        F.variant_get("v", "$.lang", "string").alias("lang"),
    )


def json_load(spark, sf_dir):
    path = fresh_path(spark, "json")
    files.write_json(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return _values(files.load_json(spark, path))


def json_load_array(spark, sf_dir):
    """Lines that each hold a JSON array: the paragraphs of a document."""
    path = fresh_path(spark, "json-array")
    number = F.col("doc_id")
    paragraphs = F.transform(
        F.split("text", "\n"), lambda line, i: F.struct(number.alias("doc_id"), i.alias("at"), line.alias("line"))
    )
    table(spark, sf_dir, "documents").select(F.to_json(paragraphs).alias("value")).write.text(path)
    elements = files.unnest_arrays(files.load_json(spark, path))
    return elements.select(
        F.variant_get("v", "$.doc_id", "bigint").alias("doc_id"),
        F.variant_get("v", "$.at", "bigint").alias("at"),
        F.variant_get("v", "$.line", "string").alias("line"),
    )


def csv_load(spark, sf_dir):
    path = fresh_path(spark, "csv")
    part = table(spark, sf_dir, "part")
    part.write.options(sep=";", header=True, quote='"', escape='"').csv(path)
    return files.load_csv(spark, path, part.schema)


def parquet_load(spark, sf_dir):
    return files.load_parquet(spark, f"{sf_dir}/conversations.parquet")


def synonym_rules(spark, sf_dir):
    """Rules written from page titles: groups of words, and one replacement per host."""
    path = fresh_path(spark, "rules")
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    words = F.array_join(F.split(F.regexp_replace(title, ",", " "), " +"), ", ")
    host = F.regexp_extract("url", r"//([a-z]+)", 1)
    lines = pages.select(F.explode(F.array(
        F.concat(F.lit("# page "), F.col("page_id").cast("string")), F.lit(""), words,
        F.concat(host, F.lit(" => "), words),
    )).alias("value"))
    lines.write.text(path)
    return load_rules(spark, path)


def url_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("url"))
    return files.url_table(pages, hosts).groupBy("url").agg(F.count("*").alias("n"))


def json_write(spark, sf_dir):
    """Two appends to one folder stay readable."""
    path = fresh_path(spark, "append")
    docs = table(spark, sf_dir, "labels")
    files.write_json(docs, path)
    files.write_json(docs.withColumn("quality", F.lit(None).cast("int")), path)
    back = spark.read.schema(docs.schema).json(path)
    return back.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"))


# ids of users begin here, so that documents and conversations keep some of theirs
FIRST_USER = 50


def _writes(spark, sf_dir):
    """``conversations`` as writes: one id per conversation, its turns in order."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("id"), F.col("role").alias("source"),
        F.col("text").alias("content"), F.col("turn").alias("seq"),
    )


def bulk_upsert(spark, sf_dir):
    """Documents overwritten by the last turn of the conversation with the same id."""
    existing = corpus(spark, sf_dir).select("id", "source", "content")
    return corpus_table.bulk_upsert(existing, _writes(spark, sf_dir), "seq")


def bulk_upsert_table(spark, sf_dir):
    """The same through a stored base and a change set."""
    path = fresh_path(spark, "corpus")
    existing = corpus(spark, sf_dir).select("id", "source", "content", F.lit(-1).cast("long").alias("seq"))
    corpus_table.upsert_table(path, existing, "seq")
    corpus_table.compact(spark, path)
    corpus_table.upsert_table(path, _writes(spark, sf_dir), "seq")
    return corpus_table.read_corpus(spark, path).drop("seq")


def upsert_stats(spark, sf_dir):
    blank = F.when(F.col("source") == "system", F.lit(None)).otherwise(F.col("id"))
    return corpus_table.upsert_stats(_writes(spark, sf_dir).withColumn("id", blank))


def stream_upsert(spark, sf_dir):
    """``events`` as arriving files; the last event of each user stays."""
    incoming, path, checkpoint = (fresh_path(spark, n) for n in ("incoming", "streamed", "offsets"))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("source"),
        F.col("props").alias("content"), F.col("event_id").alias("seq"),
    )
    events.repartitionByRange(3, "seq").write.json(incoming)
    run_stream(spark, incoming, events.schema, path, checkpoint, "seq", max_files=1)
    return corpus_table.read_corpus(spark, path, by_time=True).drop("seq")


def corpus_loads(spark, sf_dir):
    """Documents, then conversations with the same ids but smaller numbers, then a stream of events: the last load wins."""
    incoming, path, checkpoint = (fresh_path(spark, n) for n in ("incoming", "loads", "offsets"))
    docs = corpus(spark, sf_dir).select("id", "source", "content", (F.col("id").cast("long") + 10**6).alias("seq"))
    corpus_table.upsert_table(path, docs, "seq")
    corpus_table.compact(spark, path)
    corpus_table.upsert_table(path, _writes(spark, sf_dir), "seq")
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") + FIRST_USER).cast("string").alias("id"), F.col("event_type").alias("source"),
        F.col("props").alias("content"), (-F.col("event_id")).alias("seq"),
    )
    events.repartitionByRange(3, "seq").write.json(incoming)
    run_stream(spark, incoming, events.schema, path, checkpoint, "seq")
    return corpus_table.read_corpus(spark, path).drop("seq")


def csv_bodies(spark, sf_dir):
    """Quoted bodies over several lines."""
    path = fresh_path(spark, "bodies")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("</p>"), F.lit("</p>;\n\n")).alias("body"))
    pages.write.options(sep=";", header=True, quote='"', escape='"').csv(path)
    return files.load_csv(spark, path, pages.schema)


def corpus_write_mode(spark, sf_dir):
    """What each lifecycle call answers, and the rows left after the forced rewrite."""
    name = "corpus_" + fresh_path(spark, "t").rsplit("-", 1)[1]
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    answers = [
        ("delete missing", corpus_table.delete_corpus(spark, name)),
        ("create", corpus_table.create_corpus(docs, name)),
        ("create again", corpus_table.create_corpus(docs, name)),
        ("force", corpus_table.create_corpus(docs, name, force_recreate=True)),
    ]
    rows = materialize(spark.table(name).groupBy("lang").agg(F.count("*").alias("n")), "rows")
    answers.append(("delete", corpus_table.delete_corpus(spark, name)))
    said = F.map_from_arrays(F.array(*[F.lit(a) for a, _ in answers]), F.array(*[F.lit(b) for _, b in answers]))
    return rows.select("lang", "n", F.explode(said).alias("call", "answer"))


QUERIES = {f.__name__: f for f in (
    json_load, json_load_array, csv_load, parquet_load, synonym_rules, url_table, json_write, bulk_upsert,
    bulk_upsert_table, upsert_stats, stream_upsert, corpus_loads, csv_bodies, corpus_write_mode,
)}

_UPSERTED = with_ctes("""
    SELECT id, source, content FROM corpus WHERE id NOT IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations)
    UNION ALL
    SELECT CAST(conv_id AS VARCHAR), role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""", CORPUS)

ORACLE = {
    "json_load": "SELECT doc_id, text, lang FROM documents",
    "json_load_array": """
        SELECT doc_id, i - 1 AS at, lines[i] AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
             LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)""",
    "csv_load": "SELECT * FROM part",
    "parquet_load": "SELECT * FROM conversations",
    "synonym_rules": r"""
        WITH titles AS (
          SELECT page_id, regexp_extract(url, '//([a-z]+)', 1) AS host,
                 lower(strip_accents(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)))) AS title
          FROM pages),
        entries AS (
          SELECT page_id, host,
                 list_filter(list_transform(regexp_split_to_array(replace(replace(title, ',', ' '), 'ß', 'ss'), ' +'),
                   lambda w: regexp_extract_all(w, """ + WORD + r""")), lambda w: len(w) > 0) AS words
          FROM titles),
        outputs AS (SELECT page_id, unnest(flatten(words)) AS rhs FROM entries),
        inputs AS (
          SELECT page_id, array_to_string(w, ' ') AS lhs FROM (SELECT page_id, unnest(words) AS w FROM entries)
          UNION ALL SELECT page_id, host FROM entries WHERE host <> '')
        SELECT DISTINCT lhs, rhs FROM inputs JOIN outputs USING (page_id)""",
    "url_table": """
        SELECT url, count(*) AS n FROM (
          SELECT url FROM pages UNION ALL SELECT regexp_extract(url, '^(https?://[^/]+)', 1) FROM pages)
        GROUP BY url""",
    "json_write": "SELECT doc_id, count(*) * 2 AS n, CAST(sum(quality) AS BIGINT) AS quality FROM labels GROUP BY doc_id",
    "bulk_upsert": _UPSERTED,
    "bulk_upsert_table": _UPSERTED,
    "stream_upsert": """
        SELECT CAST(user_id AS VARCHAR) AS id, event_type AS source, props AS content FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "corpus_loads": with_ctes("""
        SELECT id, source, content FROM (
          SELECT id, source, content, 0 AS load, 0 AS seq FROM corpus
          UNION ALL SELECT CAST(conv_id AS VARCHAR), role, text, 1, turn FROM conversations
          UNION ALL SELECT CAST(user_id + 50 AS VARCHAR), event_type, props, 2, -event_id FROM events)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY load DESC, seq DESC) = 1""", CORPUS),
    "csv_bodies": "SELECT page_id, url, replace(html, '</p>', '</p>;' || chr(10) || chr(10)) AS body FROM pages",
    "upsert_stats": """
        SELECT count(*) AS total,
               count(DISTINCT CASE WHEN role <> 'system' THEN CAST(conv_id AS VARCHAR)
                     ELSE 'made:' || text || chr(1) || turn END) AS stored,
               count(*) FILTER (role = 'system') AS generated_ids
        FROM conversations""",
    "corpus_write_mode": """
        SELECT lang, count(*) AS n, call, answer FROM documents,
          (VALUES ('delete missing', false), ('create', true), ('create again', false), ('force', true),
                  ('delete', true)) AS t(call, answer)
        GROUP BY ALL""",
}
