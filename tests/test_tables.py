import json

from pyspark.sql import functions as F

from rankloom.operators import sizing
from rankloom.sources import corpus_table as ops, files
from rankloom.streaming.upsert import stream_upsert

SCHEMA = "id string, content string, seq long"


def rows(df):
    return {(r.id, r.content) for r in df.collect()}


def test_upsert_last_write_wins_and_repeats_are_harmless(spark):
    existing = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, content string")
    batch = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("c", "new", 3), (None, "anon", 4)], SCHEMA)
    once = ops.bulk_upsert(existing, batch)
    assert {c for i, c in rows(once)} == {"two", "old", "new", "anon"} and once.count() == 4
    assert rows(ops.bulk_upsert(once, batch)) == rows(once)
    stats = ops.upsert_stats(batch).first()
    assert (stats.total, stats.stored, stats.generated_ids) == (4, 3, 1)


def test_stored_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert ops.read_corpus(spark, path) is None
    ops.upsert_table(path, spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], SCHEMA))
    ops.upsert_table(path, spark.createDataFrame([("a", "2", 5), ("c", "2", 2)], SCHEMA))
    want = {("a", "2"), ("b", "1"), ("c", "2")}
    assert rows(ops.read_corpus(spark, path)) == want
    ops.compact(spark, path)
    assert rows(ops.read_corpus(spark, path)) == want
    # the later load wins whatever its numbers; a load with a key is applied once
    for _ in range(2):
        last = ops.upsert_table(path, spark.createDataFrame([("a", "late", 4), ("b", "3", 9)], SCHEMA), key="k")
    assert last == 3  # two loads and a compaction stand before it
    assert rows(ops.read_corpus(spark, path)) == {("a", "late"), ("b", "3"), ("c", "2")}
    # times of events hold across loads
    assert rows(ops.read_corpus(spark, path, by_time=True)) == {("a", "2"), ("b", "3"), ("c", "2")}
    assert ops.compact(spark, path) == ops.compact(spark, path) == 4
    assert rows(ops.read_corpus(spark, path)) == {("a", "late"), ("b", "3"), ("c", "2")}
    # an empty load and a load with further columns
    ops.upsert_table(path, spark.createDataFrame([], SCHEMA))
    ops.upsert_table(path, spark.createDataFrame([("c", "4", 0, "x"), (None, "anon", 1, "y")], f"{SCHEMA}, extra string"))
    got = {(r.content, r.extra) for r in ops.read_corpus(spark, path).collect()}
    assert got == {("late", None), ("3", None), ("4", "x"), ("anon", "y")}


def test_a_failed_load_is_repaired_by_its_repetition(spark, tmp_path):
    path = str(tmp_path / "corpus")
    batch = spark.createDataFrame([(str(i), "1", i) for i in range(40)], SCHEMA)
    ops.upsert_table(path, spark.createDataFrame([("0", "0", 0)], SCHEMA))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # several files
    try:
        number = ops.upsert_table(path, batch, key="k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ops.upsert_table(path, spark.createDataFrame([("1", "later", 0)], SCHEMA))
    [folder] = (tmp_path / "corpus" / f"_load={number}").iterdir()
    next(folder.glob("part-*")).unlink()  # as if the writer had died while it published its files
    assert ops.upsert_table(path, batch, key="k") == number
    want = {(str(i), "1") for i in range(40)} - {("1", "1")} | {("1", "later")}
    assert rows(ops.read_corpus(spark, path)) == want


def test_stream_beside_batch_loads(spark, tmp_path):
    path, incoming = str(tmp_path / "corpus"), tmp_path / "in"
    ops.upsert_table(path, spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], SCHEMA))
    ops.compact(spark, path)
    ops.upsert_table(path, spark.createDataFrame([("b", "2", 0)], SCHEMA))
    incoming.mkdir()
    (incoming / "1.json").write_text(json.dumps({"id": "c", "content": "3", "seq": 0}) + "\n" + json.dumps({"id": "a", "content": "3", "seq": 0}))
    stream_upsert(spark, str(incoming), SCHEMA, path, str(tmp_path / "marks"))
    assert rows(ops.read_corpus(spark, path)) == {("a", "3"), ("b", "2"), ("c", "3")}


def test_stream_applies_each_file_once(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    path, marks = str(tmp_path / "corpus"), str(tmp_path / "marks")

    def arrive(name, *docs):
        (incoming / name).write_text("\n".join(json.dumps(dict(zip(("id", "content", "seq"), d))) for d in docs))

    arrive("1.json", ("a", "1", 1), ("b", "1", 2))
    stream_upsert(spark, str(incoming), SCHEMA, path, marks)
    arrive("2.json", ("a", "2", 3))
    stream_upsert(spark, str(incoming), SCHEMA, path, marks)
    stream_upsert(spark, str(incoming), SCHEMA, path, marks)
    assert rows(ops.read_corpus(spark, path)) == {("a", "2"), ("b", "1")}


def test_stream_of_several_batches(spark, tmp_path):
    """Five micro-batches and a batch load between them; the same stream again changes nothing."""
    incoming, path, marks = tmp_path / "in", str(tmp_path / "corpus"), str(tmp_path / "marks")
    incoming.mkdir()
    events = [(str(i % 7), f"e{i}", i) for i in range(50)]
    for n in range(5):
        (incoming / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("id", "content", "seq"), e))) for e in events[n::5]))
    ops.upsert_table(path, spark.createDataFrame([("x", "kept", 0), ("3", "old", 10**6)], SCHEMA))
    stream_upsert(spark, str(incoming), SCHEMA, path, marks, max_files=1)
    want = {("x", "kept")} | {(str(k), max(((s, c) for i, c, s in events if i == str(k)))[1]) for k in range(7)}
    assert rows(ops.read_corpus(spark, path, by_time=True)) == want - {("3", "e45")} | {("3", "old")}
    loads = ops._loads(ops._stored(spark, path))
    assert len(loads) == 6
    stream_upsert(spark, str(incoming), SCHEMA, path, marks, max_files=1)
    assert ops._loads(ops._stored(spark, path)) == loads


def test_lifecycle(spark):
    docs = spark.range(3)
    assert ops.delete_corpus(spark, "c1") is False
    assert ops.create_corpus(docs, "c1") is True
    assert ops.create_corpus(docs, "c1") is False
    assert ops.create_corpus(spark.range(5), "c1", force_recreate=True) is True
    assert spark.table("c1").count() == 5
    assert ops.create_corpus(spark.table("c1").filter("id > 1"), "c1", force_recreate=True) is True
    assert spark.table("c1").count() == 3
    assert ops.delete_corpus(spark, "c1") is True


def test_csv_and_json_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"'), (2, None)], "n int, t string")
    df.write.options(sep=";", header=True, quote='"', escape='"').csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, files.load_csv(spark, str(tmp_path / "csv"), df.schema).collect()), key=str) == [(1, 'a;"b"'), (2, None)]
    files.write_json(df, str(tmp_path / "json"))
    files.write_json(df, str(tmp_path / "json"))
    raw = files.load_json(spark, str(tmp_path / "json"))
    assert raw.count() == 4
    # a null value stays a present key
    assert raw.filter(F.try_variant_get("v", "$.t", "variant").isNotNull()).count() == 4


def test_salted_join_equals_a_plain_join(spark):
    big = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("n"))
    other = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, big.join(other, "k", how).collect()), key=str)
        salted = sorted(map(tuple, sizing.salted_join(big, other, ["k"], ["n"], how, target_rows=100).collect()), key=str)
        assert plain == salted
    hot = sizing.hot_keys(big, ["k"], 100).collect()
    assert [(r.k, r._splits) for r in hot] == [(7, 18)]


def test_fits_measures_rows_and_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit("a")).alias("l"))
    assert sizing.fits(df, 100) and not sizing.fits(df, 99) and not sizing.fits(df, 100, 50_000)
    assert not sizing.fits(df, 0)


def test_spread_leaves_large_scans_alone(spark):
    assert sizing.spread(spark.range(10, numPartitions=1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sizing.spread(spark.range(10, numPartitions=64), "id").rdd.getNumPartitions() == 64
