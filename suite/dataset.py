"""Registered queries: dataset preparation."""

from pyspark.sql import functions as F

from rankloom.operators import dataset as ops
from rankloom.operators.sizing import spread

from .inputs import CORPUS, corpus, table, with_ctes

# The page hosts are invented, so the registered rules name parts of those hosts.
RULES = (("example.com", "Python"), ("kubernetes", "Kubernetes"), ("example.org", "Docker"), ("/en/", "JavaScript"))


def forum_posts(spark, sf_dir):
    """``pages`` and ``documents`` in the shape of a forum export."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("row_no"), F.col("page_id").alias("id"), F.col("url").alias("title"),
        F.col("html").alias("body"),
        F.concat_ws("|", F.lit("web"), (F.col("page_id") % 7).cast("string")).alias("tags"),
        F.to_timestamp(F.lit("2023-05-01 00:00:00")).alias("creation_date"),
        F.to_timestamp(F.lit("2023-06-01 00:00:00")).alias("last_activity_date"),
        F.lit(1).alias("comment_count"),
    )


def functions_table(spark, sf_dir):
    """``documents`` in the shape of a code-docstring table."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("fn"), F.col("doc_id")).alias("func_name"),
        F.col("text").alias("func_documentation_string"),
        F.concat(F.lit("https://code.example/"), F.col("doc_id")).alias("func_code_url"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, F.lit(""))
        .otherwise(F.col("lang")).alias("language"),
        F.col("source").alias("repository_name"),
    )


def _days(column):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def _flat(df):
    return df.select(
        "id", "title", "content", "file_type", "path", _days("created_at"), _days("modified_at"),
        "github_stars", "view_count", "language", F.array_join("tags", ",").alias("tags"), "source",
    )


def _loaded_at():
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))


def url_technology(spark, sf_dir):
    return ops.url_technology(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def group_count(spark, sf_dir):
    classified = ops.url_technology(table(spark, sf_dir, "pages").select("url"), RULES)
    return ops.group_count(classified, "language")


def stratified_topn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ops.stratified_topn(docs, "lang", "doc_id", 10)


def sample_n(spark, sf_dir):
    return ops.sample_n(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 5000)


def split_tags(spark, sf_dir):
    split = ops.split_tags(forum_posts(spark, sf_dir).select("id", "tags"))
    return split.select("id", F.posexplode("tag_list").alias("position", "tag"))


def conform_schema(spark, sf_dir):
    conformed = ops.conform_forum_posts(forum_posts(spark, sf_dir))
    return _flat(conformed).withColumn("id", F.col("id"))


def conform_code_docs(spark, sf_dir):
    return _flat(ops.conform_code_docs(functions_table(spark, sf_dir), _loaded_at()))


def html_text(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", F.col("html").alias("content"))
    return ops.clean_html(pages)


def page_metadata(spark, sf_dir):
    return ops.page_metadata(spread(table(spark, sf_dir, "pages"), "page_id")).select("page_id", "url", "title", "language", "text")


def page_links(spark, sf_dir):
    """Links of pages in all three forms of quoting."""
    link, form = r'href="([^"\s>]*)"', F.col("page_id") % 3
    html = F.when(form == 1, F.regexp_replace("html", link, "href='$1'")).when(
        form == 2, F.regexp_replace("html", link, "href = $1")).otherwise(F.col("html"))
    return ops.page_links(table(spark, sf_dir, "pages").withColumn("html", html)).groupBy("page_id", "link").agg(F.count("*").alias("n"))


def link_targets(spark, sf_dir):
    """Absolute targets of links written as five kinds of reference, by page."""
    link, page = r'href="/([^"#?:&/%.]+)"', F.col("page_id") % 5
    html = F.col("html")
    for n, form in ((1, "$1"), (2, "../$1?y=1"), (3, "//other.example/$1"), (4, "?q=$1#top")):
        html = F.when(page == n, F.regexp_replace("html", link, f'href="{form}"')).otherwise(html)
    pages = table(spark, sf_dir, "pages").withColumn("html", html)
    return ops.page_links(pages).groupBy("page_id", "target").agg(F.count("*").alias("n"))


def cast_id(spark, sf_dir):
    return ops.cast_id(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))


def canonical_order(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return _flat(ops.canonical_order(docs.select(*sorted(docs.columns))))


def union_sources(spark, sf_dir):
    code = ops.canonical_order(ops.conform_code_docs(functions_table(spark, sf_dir), _loaded_at()))
    forum = ops.canonical_order(ops.cast_id(ops.conform_forum_posts(forum_posts(spark, sf_dir))))
    return _flat(ops.union_sources(code, forum))


def dataset_build(spark, sf_dir):
    from rankloom.plans.dataset_build import build_dataset

    return _flat(build_dataset(forum_posts(spark, sf_dir), functions_table(spark, sf_dir), _loaded_at()))


def schema_diff(spark, sf_dir):
    return ops.schema_diff(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    url_technology, group_count, stratified_topn, sample_n, split_tags, conform_schema, conform_code_docs,
    html_text, page_metadata, page_links, link_targets, cast_id, canonical_order, union_sources, dataset_build, schema_diff,
)}

_CASE = (
    "CASE WHEN contains(url, 'example.com') THEN 'Python' WHEN contains(url, 'kubernetes') THEN 'Kubernetes' "
    "WHEN contains(url, 'example.org') THEN 'Docker' WHEN contains(url, '/en/') THEN 'JavaScript' END"
)


def html_text_sql(column: str) -> str:
    """SQL for the text of an HTML column whose only entities are those of the pages."""
    out = f"regexp_replace({column}, '<!--.*?-->', ' ', 'gs')"
    for tag in ("script", "style", "template", "pre", "code"):
        out = f"regexp_replace({out}, '<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'gsi')"
    out = f"regexp_replace({out}, '<[!?][^>]*>', ' ', 'g')"
    out = f"regexp_replace({out}, '</?[a-zA-Z][^>]*>', ' ', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace(replace({out}, chr(160), ' '), '\\s+', ' ', 'g'))"


_FORUM = """forum AS (
  SELECT page_id AS id, url AS title, html AS content, 'blog' AS file_type, '' AS path,
         '2023-05-01' AS created_at, '2023-06-01' AS modified_at, 0 AS github_stars, 0 AS view_count,
         'en' AS language, 'web,' || (page_id % 7) AS tags, 'Stack Overflow' AS source
  FROM pages)"""
_CODE = """code AS (
  SELECT 'doc_fn' || doc_id AS id, 'Docstring Documentation of fn' || doc_id AS title, text AS content,
         'repository' AS file_type, 'https://code.example/' || doc_id AS path, '2024-03-01' AS created_at,
         '2024-03-01' AS modified_at, 0 AS github_stars, 0 AS view_count, 'en' AS language,
         CASE WHEN doc_id % 5 IN (0, 1) THEN '' ELSE lang END AS tags, 'GitHub' AS source
  FROM documents)"""
_COLUMNS = (
    "title, content, file_type, path, created_at, modified_at, github_stars, view_count, language, tags, source"
)

ORACLE = {
    "url_technology": f"SELECT page_id, url, {_CASE} AS language FROM pages",
    "group_count": f"SELECT {_CASE} AS language, count(*) AS count FROM pages GROUP BY ALL",
    "stratified_topn": """
        SELECT doc_id, lang FROM documents
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 10""",
    "sample_n": "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 5000",
    "split_tags": """
        SELECT page_id AS id, u.i - 1 AS position, t[u.i] AS tag
        FROM (SELECT page_id, string_split('web|' || (page_id % 7), '|') AS t FROM pages),
             LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i) u""",
    "conform_schema": with_ctes("SELECT * FROM forum", _FORUM),
    "conform_code_docs": with_ctes("SELECT * FROM code", _CODE),
    "html_text": f"SELECT page_id, {html_text_sql('html')} AS content FROM pages",
    "page_metadata": f"""
        SELECT page_id, url,
               {html_text_sql("regexp_extract(html, '<title[^>]*>(.*?)</title', 1, 'is')")} AS title,
               regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, {html_text_sql('html')} AS text
        FROM pages""",
    "page_links": """
        SELECT page_id, link, count(*) AS n
        FROM (SELECT page_id, replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '&amp;', '&') AS link FROM pages)
        GROUP BY ALL""",
    "link_targets": r"""
        WITH links AS (
          SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS host, regexp_extract(url, '^(https?):', 1) AS scheme,
                 regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
                 unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS written
          FROM pages),
        folders AS (
          SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)[^/]*$', 1) END AS folder,
                 replace(written, '&amp;', '&') AS link,
                 CASE WHEN regexp_full_match(written, '/[^"#?:&/%.]+') THEN page_id % 5 ELSE 0 END AS form
          FROM links)
        SELECT page_id, CASE form WHEN 0 THEN host || link WHEN 1 THEN host || folder || link[2:]
                 WHEN 2 THEN host || regexp_replace(folder, '[^/]+/$', '') || link[2:] || '?y=1'
                 WHEN 3 THEN scheme || '://other.example' || link
                 ELSE host || path || '?q=' || link[2:] || '#top' END AS target, count(*) AS n
        FROM folders GROUP BY ALL""",
    "cast_id": "SELECT CAST(page_id AS VARCHAR) AS id, url FROM pages",
    "canonical_order": with_ctes("""
        SELECT id, title, content, file_type, path, strftime(created_at, '%Y-%m-%d') AS created_at,
               strftime(modified_at, '%Y-%m-%d') AS modified_at, github_stars, view_count, language,
               array_to_string(tags, ',') AS tags, source FROM corpus""", CORPUS),
    "union_sources": with_ctes(
        f"SELECT id, {_COLUMNS} FROM code UNION ALL SELECT CAST(id AS VARCHAR), {_COLUMNS} FROM forum", _FORUM, _CODE),
    "dataset_build": with_ctes(f"""
        SELECT id, {_COLUMNS} FROM code
        UNION ALL
        SELECT CAST(id AS VARCHAR), {_COLUMNS.replace('content', html_text_sql('content') + ' AS content')} FROM forum""",
        _FORUM, _CODE),
    "schema_diff": """
        SELECT column_name FROM (DESCRIBE documents) EXCEPT SELECT column_name FROM (DESCRIBE labels)""",
}
