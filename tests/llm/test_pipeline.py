"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

import os
import re
import subprocess
import sys

import pyarrow as pa
import pytest

import corpus_pipeline
from rankloom.llm import decontamination, quality, suffixes
from rankloom.llm.shared import BATCH_ROWS, materialize, short_batches

from .test_small import _UPPER, _WORD, _classes, _fingerprint, _targets, _word_count


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before the first and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), "stage"))
    return [{r["doc_id"]: r for r in df.collect()} for df in out], [df.columns for df in out]


def test_columns(stages):
    columns = stages[1]
    assert all(c == columns[0] for c in columns[:-1]) and set(columns[0]) <= set(columns[-1])


def test_rejected_documents_go(spark, sf_dir, stages):
    before, after = stages[0][:2]
    judged = quality.score(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))).collect()
    assert set(after) == {r["doc_id"] for r in judged if r["predicted"] == 1}
    assert all(after[d] == before[d] for d in after)


def test_one_of_each_group_stays(stages):
    before, after = stages[0][1:3]
    ids = sorted(before)
    classes = _classes([_fingerprint(before[i]["text"]) for i in ids], lambda a, b: (a ^ b).bit_count() <= 3)
    assert set(after) == {ids[c] for c in set(classes)}


def test_repeats_are_cut(stages):
    before, after = stages[0][2:4]
    assert set(before) == set(after)
    seen: set = set()
    for i in sorted(before):
        text = before[i]["text"].encode()
        windows = {text[k:k + 50] for k in range(len(text) - 49)}
        if not windows & seen:
            assert after[i] == before[i]
        else:
            assert len(after[i]["text"]) < len(before[i]["text"]) and after[i]["n_chars"] == len(after[i]["text"])
        seen |= windows


def test_benchmark_is_cut(spark, sf_dir, stages):
    before, after = stages[0][3:5]
    windows = set()
    for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = _WORD.findall(row["text"].translate(_UPPER))
        windows |= {tuple(words[k:k + 10]) for k in range(max(len(words) - 9, 1))}
    sizes = {len(w) for w in windows}

    def held(text):
        words = _WORD.findall(text.translate(_UPPER))
        return any(tuple(words[k:k + n]) in windows for n in sizes for k in range(len(words) - n + 1))

    assert set(before) == set(after)
    for i, row in before.items():
        assert (after[i] != row) == held(row["text"]) and not held(after[i]["text"])


def test_mix_takes_near_its_targets(stages):
    before, after = stages[0][4:6]
    sizes, largest, taken = {}, {}, {}
    for row in before.values():
        n = _word_count(row["text"])
        sizes[row["source"]] = sizes.get(row["source"], 0) + n
        largest[row["source"]] = max(largest.get(row["source"], 0), n)
    for row in after.values():
        assert row["taken"] == row["copies"] * row["size"] and row["size"] == _word_count(row["text"]) and 1 <= row["copies"] <= 3
        taken[row["source"]] = taken.get(row["source"], 0) + row["taken"]
    for source, target in _targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= largest[source]


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == stages[0][-1]
    assert all(re.fullmatch(r"[a-z -]+", name) for name, _ in corpus_pipeline.STAGES)


def test_workers_get_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    try:
        docs = spark.range(0, 3 * BATCH_ROWS, 1, 1).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
        corpus_pipeline.without_repeats(spark, docs, None)
        assert max(r["n"] for r in docs.mapInArrow(rows, "n long").collect()) <= BATCH_ROWS
        spark.conf.set(name, 7)
        short_batches(docs)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)


def test_stages_do_not_load_pandas():
    code = "import corpus_pipeline, sys; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(corpus_pipeline.__file__)).returncode == 0


def test_cut_texts_keep_nulls_and_whole_characters(spark):
    passage = "\u00e4\u00f6\u20ac" * 30
    rows = [(1, "a " + passage), (2, None), (3, passage + " z"), (4, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffixes.cut_repeats(docs).collect()}
    assert got == {1: "a " + passage, 2: None, 3: " z", 4: "", None: None}
    items = spark.createDataFrame([("x", "one two three four five six seven eight nine ten")], "item_id string, text string")
    rows = [(1, "\u20ac, One two three four five six seven eight nine TEN. \u00e4"), (2, None), (3, "one two")]
    cut = decontamination.cut_benchmark(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "\u20ac, . \u00e4", 2: None, 3: "one two"}
