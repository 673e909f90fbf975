from pyspark.sql import Window, functions as F

from rankloom.functions.html import html_text
from rankloom.operators import dataset as ops


def texts(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "n int, html string")
    return [r.t for r in df.select("n", html_text(F.col("html")).alias("t")).orderBy("n").collect()]


def test_url_rules(spark):
    urls = [
        "https://docs.python.org/3", "https://nextjs.org/docs", "https://docs.docker.com/a", "https://kubernetes.io/fr",
        "https://docs.djangoproject.com", "https://docs.pytorch.org/stable", "https://scikit-learn.org/stable",
        "https://developer.mozilla.org/fr", "https://example.com", "https://nextjs.org/python.org",
    ]
    df = ops.url_technology(spark.createDataFrame([(u,) for u in urls], "url string"))
    got = {r.url: r.language for r in df.collect()}
    assert [got[u] for u in urls] == [
        "Python", "NextJS", "Docker", "Kubernetes", "Django", "Pytorch", "Scikit-Learn", "JavaScript", None, "Python",
    ]


def test_html_basic(spark):
    assert texts(
        spark, "<p>How  to <b>use</b></p><pre>x=1</pre> it", "a<code>b</code>c", None,
        "a<!-- <p>no</p> -->b", "<p title=\"a>b\">x</p>", "1 < 2 &amp; 3 &gt; 2",
        "&eacute;&#233;&#xe9;&nbsp;&amp;lt;", "<script>var a='<p>';</script>z",
    ) == ["How to use it", "a c", "", "a b", "x", "1 < 2 & 3 > 2", "ééé &lt;", "z"]


def test_html_nested_and_open_tags_use_the_parser(spark):
    assert texts(
        spark, "a<pre>b<pre>c</pre>d</pre>e", "a<code>b", "x<code>y<code>z</code></code>w<pre>v</pre>u",
    ) == ["a e", "a", "x w u"]


def test_stratified_sample_bounds_every_group(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 990, "big").otherwise("small").alias("g"))
    got = {r.g: r["count"] for r in ops.stratified_topn(df, "g", "id", 15).groupBy("g").count().collect()}
    assert got == {"big": 15, "small": 10}


def test_sample_returns_all_when_short(spark):
    df = spark.range(7)
    assert ops.sample_n(df, "id", 10).count() == 7
    first = {r.id for r in ops.sample_n(spark.range(100), "id", 10, "a").collect()}
    second = {r.id for r in ops.sample_n(spark.range(100), "id", 10, "b").collect()}
    assert len(first) == len(second) == 10 and first != second


def test_code_docs_read_the_old_language(spark):
    rows = [("f", "doc", "u", "python"), ("g", "doc", "u", ""), ("h", "doc", "u", None)]
    df = spark.createDataFrame(rows, "func_name string, func_documentation_string string, func_code_url string, language string")
    got = ops.conform_code_docs(df, F.current_timestamp()).orderBy("id").collect()
    assert [r.tags for r in got] == [["python"], [], []]
    assert {r.language for r in got} == {"en"}
    assert got[0].title == "Docstring Documentation of f"


def test_schema_diff(spark):
    left, right = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 2)], "b int, c int")
    assert [r.column_name for r in ops.schema_diff(left, right).collect()] == ["a"]


def test_samples_by_threshold_equal_a_full_sort(spark):
    df = spark.range(4000).select(
        "id", F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") < 30, "few").otherwise("mid").alias("g"),
    )
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.md5(F.col("id").cast("string")), "id"))
    for n, edge_rows in ((1, 10_000), (15, 1), (700, 2), (5000, 1)):
        want = {r.id for r in df.withColumn("rn", rank).filter(F.col("rn") <= n).collect()}
        got = [r.id for r in ops.stratified_topn(df, "g", "id", n, edge_rows=edge_rows).collect()]
        assert set(got) == want and len(got) == len(want), (n, edge_rows)
        whole = {r.id for r in df.orderBy(F.md5(F.col("id").cast("string"))).limit(n).collect()}
        assert {r.id for r in ops.sample_n(df, "id", n, edge_rows=edge_rows).collect()} == whole


def test_samples_of_repeated_keys(spark):
    """A key that is repeated often is cut to the wanted number."""
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("g"))
    for n in (1, 100, 650, 899):
        assert ops.stratified_topn(df, "g", "k", n, edge_rows=1).count() == n
    assert ops.sample_n(df.limit(0), "k", 5).count() == 0
