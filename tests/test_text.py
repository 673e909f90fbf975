"""Word breaks and link resolution against tables of cases and the standard library."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from rankloom.functions.links import resolve
from rankloom.functions.text import tokens
from rankloom.operators.dataset import page_links
from rankloom.operators.present import marked

WORDS = {
    "हिन्दी भाषा": ["हिन्दी", "भाषा"],
    "Cafe\u0301 naïve": ["cafe\u0301", "naïve"],
    "3.14 and 1,000,000.5; 7": ["3.14", "and", "1,000,000.5", "7"],
    "don't stop, it\u2019s rock'n'roll 'quoted'": ["don't", "stop", "it\u2019s", "rock'n'roll", "quoted"],
    "U.S.A. a.b. example.com v1.2 x.1 1.x end.": ["u.s.a", "a.b", "example.com", "v1.2", "x", "1", "1", "x", "end"],
    "snake_case __init__ _x _ __": ["snake_case", "init__", "x"],
    "key:value 10:30 a: b CI/CD": ["key:value", "10", "30", "a", "b", "ci", "cd"],
    "漢字とかな abc漢1": ["漢", "字", "と", "か", "な", "abc", "漢", "1"],
    "カタカナ 한국어 ภาษาไทย": ["カタカナ", "한국어", "ภาษาไทย"],
    "a..b a.,b 1..2 1.,2 a.-b": ["a", "b", "a", "b", "1", "2", "1", "2", "a", "b"],
    "\u0301x \u0301 مَرْحَبًا": ["x", "مَرْحَبًا"],
    "": [], " .,;!? ": [],
}


def test_word_breaks(spark):
    df = spark.createDataFrame([(t,) for t in WORDS] + [(None,)], "t string").select("t", tokens(F.col("t")).alias("w"))
    got = {r.t: r.w for r in df.collect()}
    assert got.pop(None) == []
    assert got == WORDS


def test_long_runs_of_joints_and_low_lines(spark):
    texts = ["_" * 20_000, "a." * 20_000, "1," * 20_000, "x_" * 20_000, "'" * 20_000, "漢" * 5_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(tokens(F.col("t"))))
    assert [r[0] for r in df.collect()] == [0, 1, 1, 1, 0, 5000]


def test_marks_keep_the_text(spark):
    for text in WORDS:
        terms = F.array(F.lit("don't"), F.lit("漢"), F.lit("3.14"), F.lit("हिन्दी"))
        [row] = spark.range(1).select(marked(F.lit(text), terms)).collect()
        assert row[0].replace("<em>", "").replace("</em>", "") == text
    [row] = spark.range(1).select(marked(F.lit("I don't, 3.14"), terms)).collect()
    assert row[0] == "I <em>don't</em>, <em>3.14</em>"


BASES = ["http://a/b/c/d;p?q", "https://h.org", "https://h.org/", "http://h.org/x/y.html#top", "http://h.org/x/?a=b/c"]
REFERENCES = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..", "../",
    "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g",
    "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "mailto:x@y.org",
    "javascript:void(0)", "https://other.net/a/b?c#d", "//host/a/b", "été?q=ü", "%2e%2e/x",
]


def test_links_resolve_like_the_standard_library(spark):
    rows = [(b, r) for b in BASES for r in REFERENCES]
    df = spark.createDataFrame(rows, "b string, r string").select("b", "r", resolve(F.col("b"), F.col("r")).alias("t"))
    wrong = [(r.b, r.r, r.t, urljoin(r.b, r.r)) for r in df.collect() if r.t != urljoin(r.b, r.r)]
    assert wrong == [], wrong
    # dot segments go from addresses of their own too
    own = [("https://other.net/a/../b?c#d", "https://other.net/b?c#d"), ("//host/a/./b", "http://host/a/b"), ("HTTP://h/..", "http://h/")]
    for reference, want in own:
        assert spark.range(1).select(resolve(F.lit(BASES[0]), F.lit(reference))).first()[0] == want


def test_links_of_pages(spark):
    pages = [
        (1, "https://h.org/en/1.html", '<a href="/x">a</a> <a class=q href=\'y&amp;z\'>b</a> <A HREF=../w>c</a> <a href="">d</a>'),
        (2, "https://h.org/en/2", '<base href="/root/"><a href=" k\nl ">x</a><a href="//o.net">y</a><a href="#f">z</a>'),
        (3, "https://h.org/3", None), (4, None, "<a href='/q'>x</a>"),
    ]
    got = {(r.page_id, r.link, r.target) for r in page_links(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == {
        (1, "/x", "https://h.org/x"), (1, "y&z", "https://h.org/en/y&z"), (1, "../w", "https://h.org/w"),
        (2, " k\nl ", "https://h.org/root/kl"), (2, "//o.net", "https://o.net"), (2, "#f", "https://h.org/root/#f"),
        (4, "/q", None),
    }
