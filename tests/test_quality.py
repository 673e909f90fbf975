import json
import math

from pyspark.sql import functions as F

from rankloom.functions.text import clean_text
from rankloom.operators import quality as ops
from rankloom.plans.ingest import load_and_index
from rankloom.sources.corpus_table import read_corpus
from rankloom.sources.files import load_json

AS_OF = "2024-07-01 00:00:00"
FULL = {
    "id": "1", "title": "t", "content": "c", "created_at": "2023-01-01T00:00:00Z", "modified_at": "2023-07-02T00:00:00Z",
    "language": "en", "tags": ["a"], "source": "s", "github_stars": 12000, "view_count": 250000,
}


def changed(number, drop=(), **values):
    doc = {**FULL, "id": str(number), **values}
    return {k: v for k, v in doc.items() if k not in drop}


DOCS = [
    changed(1),
    changed(2, drop=["title"]),
    changed(3, title=None),
    changed(4, modified_at=""),
    changed(5, drop=["modified_at"]),
    changed(6, modified_at="2024-07-01T01:00:00Z"),
    changed(7, modified_at="2024-01-01T00:00:00"),
    changed(8, github_stars=None),
    changed(9, drop=["github_stars"], view_count=50000),
    changed(10, modified_at="nonsense"),
    changed(11, drop=["title", "source"]),
]


def prepared(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text("\n".join(json.dumps(d) for d in DOCS))
    as_of = F.to_timestamp(F.lit(AS_OF))
    return {int(r.id): r for r in ops.prepare_docs(load_json(spark, str(path)), as_of).collect()}


def test_prepare(spark, tmp_path):
    got = prepared(spark, tmp_path)
    assert got[1].popularity_score == 1.0
    assert math.isclose(got[1].freshness_score, math.exp(-1), rel_tol=1e-12)
    assert got[2].missing_field == "title" and got[11].missing_field == "title"
    assert got[3].missing_field is None and got[3].title is None and got[3].freshness_score is not None
    for n in (4, 5):
        assert got[n].modified_at == FULL["created_at"]
    assert got[6].error is None and got[6].freshness_score is None and got[6].popularity_score is None
    assert got[7].error and got[10].error
    assert got[8].freshness_score is not None and got[8].popularity_score is None
    assert math.isclose(got[9].popularity_score, 0.15)


def test_load_and_index_counts_and_stores(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text("\n".join(json.dumps(d) for d in [*DOCS, changed(1, content="newer")]))
    stats, rejected = load_and_index(spark, str(path), str(tmp_path / "corpus"), F.to_timestamp(F.lit(AS_OF)))
    row = stats.first()
    assert (row.documents_loaded, row.documents_processed, row.invalid, row.processing_errors) == (12, 8, 2, 2)
    assert {r.id for r in rejected.collect()} == {"2", "7", "10", "11"}
    corpus = {r.id: r for r in read_corpus(spark, str(tmp_path / "corpus")).collect()}
    assert set(corpus) == {"1", "3", "4", "5", "6", "8", "9"}
    assert corpus["1"].content == "newer"
    assert math.isclose(sum(x * x for x in corpus["1"].embedding), 1.0, rel_tol=1e-5)


def test_array_files_and_missing_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOCS[:3], indent=1))
    got = load_json(spark, str(tmp_path / "a.json"), layout="array")
    assert {r.id for r in got.select(F.variant_get("v", "$.id", "string").alias("id")).collect()} == {"1", "2", "3"}
    assert load_json(spark, str(tmp_path / "none.json")).count() == 0


def test_clean_text(spark):
    rows = ["  Été\tà\r\nla   plage \n", None, "ﬁ ½ Ａ", "ẹ́", "straße“x”"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "n int, t string")
    got = [r.c for r in df.select("n", clean_text(F.col("t")).alias("c")).orderBy("n").collect()]
    assert got == ["Ete a la  plage", "", "fi 1⁄2 A", "e", "straße“x”"]


def test_parse_date(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00+02:00",), ("2024-01-01T10:00:00.5Z",), ("x",), (None,)], "d string")
    assert [r.d for r in ops.parse_date(df, "d").collect()] == [
        "2024-01-01T08:00:00.000000Z", "2024-01-01T10:00:00.500000Z", "", ""]


def test_count_check(spark):
    row = ops.count_check(spark.createDataFrame([("a",), ("a",), ("b",)], "id string")).first()
    assert (row.indexed, row.stored, row.mismatch) == (3, 2, True)
