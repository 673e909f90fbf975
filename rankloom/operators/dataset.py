"""Dataset preparation: classify, sample, conform, extract and combine sources."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.html import decode_entities, html_text
from ..functions.links import resolve
from ..schema import CANONICAL_ORDER
from ..workspace import materialize
from .sizing import fits

# The first substring found in a URL names its technology.
TECHNOLOGY_RULES = (
    ("python.org", "Python"),
    ("nextjs.org", "NextJS"),
    ("docker.com", "Docker"),
    ("kubernetes", "Kubernetes"),
    ("djangoproject.com", "Django"),
    ("pytorch", "Pytorch"),
    ("scikit-learn.org", "Scikit-Learn"),
    ("mozilla", "JavaScript"),
)


def technology_of(url: Column, rules=TECHNOLOGY_RULES) -> Column:
    """Technology of a URL by the first rule it contains; null when none does."""
    out = F.lit(None).cast("string")
    for needle, name in reversed(rules):
        out = F.when(F.contains(url, F.lit(needle)), F.lit(name)).otherwise(out)
    return out


def url_technology(urls: DataFrame, rules=TECHNOLOGY_RULES) -> DataFrame:
    """Add ``language`` to a table of URLs."""
    return urls.withColumn("language", technology_of(F.col("url"), rules))


def group_count(df: DataFrame, by: str) -> DataFrame:
    """Rows per value of ``by``; null counts as a value."""
    return df.groupBy(by).count()


def _shuffled(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def _first_by_hash(df: DataFrame, group: str, key: str, n: int, seed: str, edge_rows: int) -> DataFrame:
    """The ``n`` rows of each group with the smallest hashes, found by a threshold on the hashes.

    Counts by leading digits tell in which range of hashes the n-th row of a group lies; the range is
    narrowed, three digits at a time, until few rows are left in it.  Rows below it are filtered where
    they are read; only those inside it are ranked, so no task holds ``n`` rows.
    """
    hashed = df.withColumn("_h", F.coalesce(_shuffled(key, seed), F.lit("0" * 32)))  # null keys come first
    same = hashed[group].eqNullSafe(F.col("_group"))
    edge = None
    for digits in range(3, 33, 3):
        rest = hashed.withColumn("_need", F.lit(n)) if edge is None else hashed.join(
            F.broadcast(edge) if fits(edge) else edge, same & F.startswith("_h", "_prefix")
        ).drop("_group", "_prefix", "_rows")
        counts = rest.groupBy(F.col(group).alias("_group"), F.substring("_h", 1, digits).alias("_prefix")).agg(
            F.count("*").alias("_rows"), F.max("_need").alias("_need")
        )
        upto = F.sum("_rows").over(Window.partitionBy("_group").orderBy("_prefix"))
        found = counts.withColumn("_need", F.col("_need") - (upto - F.col("_rows")))
        edge = materialize(found.filter((F.col("_need") > 0) & (F.col("_need") <= F.col("_rows"))), "edge")
        if (edge.agg(F.max("_rows")).first()[0] or 0) <= edge_rows:
            break
    # a group without an edge has fewer than n rows and stays whole
    joined = hashed.join(F.broadcast(edge) if fits(edge) else edge, same, "left")
    inside = F.startswith("_h", "_prefix")
    sure = joined.filter(F.col("_prefix").isNull() | ((F.col("_h") < F.col("_prefix")) & ~inside))
    order = Window.partitionBy(group).orderBy("_h", key)
    near = joined.filter(inside).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= F.col("_need"))
    return sure.select(*df.columns).unionByName(near.select(*df.columns))


def stratified_topn(
    df: DataFrame, group: str, key: str, n: int = 10, seed: str = "", edge_rows: int = 10_000,
) -> DataFrame:
    """At most ``n`` random rows per group; a null group is one of its own.

    Rows with one key share their place, so which of them are taken is open.
    """
    return _first_by_hash(df, group, key, n, seed, edge_rows)


def sample_n(df: DataFrame, key: str, n: int, seed: str = "", edge_rows: int = 10_000) -> DataFrame:
    """``n`` random rows without replacement; a shorter table comes back whole."""
    return _first_by_hash(df.withColumn("_all", F.lit(0)), "_all", key, n, seed, edge_rows).drop("_all")


def split_tags(df: DataFrame, column: str = "tags", into: str = "tag_list") -> DataFrame:
    """Split a ``a|b|c`` string into an array."""
    return df.withColumn(into, F.split(F.col(column), r"\|"))


def conform_schema(df: DataFrame, drop: list, rename: dict, constants: dict) -> DataFrame:
    """Drop columns, rename others and add constant columns, in this order."""
    return df.drop(*drop).withColumnsRenamed(rename).withColumns(
        {name: F.lit(value) for name, value in constants.items()}
    )


def conform_forum_posts(posts: DataFrame) -> DataFrame:
    """Forum export to corpus columns; ``tags`` becomes an array."""
    return conform_schema(
        split_tags(posts),
        drop=["comment_count", "tags", "row_no"],
        rename={
            "creation_date": "created_at", "last_activity_date": "modified_at",
            "tag_list": "tags", "body": "content",
        },
        constants={
            "path": "", "file_type": "blog", "language": "en",
            "github_stars": 0, "view_count": 0, "source": "Stack Overflow",
        },
    )


def conform_code_docs(functions: DataFrame, loaded_at: Column) -> DataFrame:
    """Function docstrings to corpus columns; the programming language becomes the tag."""
    language = F.col("language")
    no_tags = F.array().cast("array<string>")
    return functions.select(
        F.concat(F.lit("doc_"), F.col("func_name")).alias("id"),
        F.concat(F.lit("Docstring Documentation of "), F.col("func_name")).alias("title"),
        F.col("func_documentation_string").alias("content"),
        F.lit("repository").alias("file_type"),
        F.col("func_code_url").alias("path"),
        loaded_at.alias("created_at"),
        loaded_at.alias("modified_at"),
        F.lit(0).alias("github_stars"),
        F.lit(0).alias("view_count"),
        F.lit("en").alias("language"),
        F.when(language.isNull() | (language == ""), no_tags).otherwise(F.array(language)).alias("tags"),
        F.lit("GitHub").alias("source"),
    )


def clean_html(df: DataFrame, column: str = "content") -> DataFrame:
    """Replace an HTML column by its text."""
    return df.withColumn(column, html_text(F.col(column)))


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title, language and text of each HTML page."""
    html = F.col("html")
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    lang = F.regexp_extract(html, r"""(?i)<html[^>]*\slang=["']?([A-Za-z-]+)""", 1)
    return pages.withColumns({
        "title": html_text(title),
        "language": F.nullif(lang, F.lit("")),
        "text": html_text(html),
    })


_HREF = r"""href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _unquoted(value: Column) -> Column:
    return decode_entities(F.regexp_replace(value, r"""(?s)^["'](.*)["']$""", "$1"))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link target of each page, repeated links kept.

    Targets stand in double, single or no quotes; entities in them are decoded, empty ones left out.
    ``target`` is the absolute address: the link resolved against ``<base href>``, which may itself
    be relative to ``url``, or against ``url`` alone.
    """
    links = F.regexp_extract_all(F.col("html"), F.lit(rf"(?i)<a\s(?:[^>]*?\s)?{_HREF}"), F.lit(1))
    stated = F.regexp_extract("html", rf"(?i)<base\s(?:[^>]*?\s)?{_HREF}", 1)
    base = F.when(stated == "", F.col("url")).otherwise(resolve(F.col("url"), _unquoted(stated)))
    found = pages.withColumn("_base", base).select("page_id", "url", "_base", F.explode(links).alias("link"))
    found = found.withColumn("link", _unquoted(F.col("link"))).filter(F.col("link") != "")
    return found.withColumn("target", resolve(F.col("_base"), F.col("link"))).drop("_base")


def cast_id(df: DataFrame) -> DataFrame:
    """Identifiers as strings."""
    return df.withColumn("id", F.col("id").cast("string"))


def canonical_order(df: DataFrame) -> DataFrame:
    """The twelve corpus columns in their fixed order."""
    return df.select(*CANONICAL_ORDER)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Stack sources by column name; duplicates stay."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source)
    return out


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names of the columns that only ``left`` has."""
    spark = left.sparkSession
    names = [spark.createDataFrame([(c,) for c in df.columns], "column_name string") for df in (left, right)]
    return names[0].exceptAll(names[1])
