import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

NO_SQL = {"knn_lsh"}


def test_every_query_has_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {key for key in set(queries) - set(sql) if not re.match(r"op\d+_|pipeline$", key)} == NO_SQL


def test_entry_works_without_the_training_data_operators(tmp_path):
    """The subpackage and the pipeline may be deleted together; any other missing module is an error."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in ("rankloom", "corpus_pipeline.py", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "rankloom")
    for name in os.listdir(f"{root}/rankloom"):
        if name != "llm":
            os.symlink(f"{root}/rankloom/{name}", tmp_path / "rankloom" / name)
    os.unlink(tmp_path / "__spark_entry__.py")
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25' in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("key", ["analyze_query", "bm25", "knn_exact", "rerank_topk"])
def test_smallest_tables_against_sql(spark, sf_dir, key):
    duckdb = pytest.importorskip("duckdb")
    from tools.compare import TABLES, bag

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    df = entry.queries()[key](spark, sf_dir)
    cursor = con.execute(entry.oracle_sql()[key])
    theirs = cursor.fetchall()
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag([d[0] for d in cursor.description], theirs)
