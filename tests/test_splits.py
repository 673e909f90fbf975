"""Records cut out of files by many tasks, against readers that take a file in one piece."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rankloom.sources import files, splits


@pytest.fixture(params=[900, 1 << 27])
def block_bytes(spark, request):
    """Blocks of a few lines, and one block for a whole file."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_equals_the_one_task_reader(spark, tmp_path, block_bytes):
    rng = random.Random(3)
    parts = ["a", "é", ";", '""', "\n", "\r\n", " ", "x,y", "\n\n", "日本", "{"]
    for n in range(4):
        lines = ["n;t;u"]
        for i in range((0, 1, 120, 90)[n]):
            quoted = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
            lines.append(f'{i};"{quoted}";{rng.choice(["", "plain", "1.5"])}')
        (tmp_path / f"{n}.csv").write_bytes(("\n".join(lines) + rng.choice(["", "\n"])).encode())
    schema = "n int, t string, u string"
    options = dict(sep=";", header=True, multiLine=True, quote='"', escape='"')
    want = sorted(map(tuple, spark.read.schema(schema).options(**options).csv(str(tmp_path)).collect()), key=str)
    got = files.load_csv(spark, str(tmp_path), schema)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 100
    pieces = splits._pieces(spark, str(tmp_path), splits.LINES)
    assert (pieces.select("file", "block").distinct().count() > 8) == (block_bytes == 900)
    assert (pieces.rdd.getNumPartitions() > 8) == (block_bytes == 900)


def _value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice(["a", '"', "\\", "}", "{", "]", "[", ",", "\n", "é", "}}", "\\\""]) for _ in range(rng.randint(0, 9)))
    if kind < 5:
        return rng.choice([1, 2.5, None, True, -7])
    if kind == 5:
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}": _value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def _loaded(spark, path):
    rows = files.load_json(spark, str(path), layout="array").select(F.to_json("v")).collect()
    return sorted(json.dumps(json.loads(r[0]), sort_keys=True) if r[0] is not None else "malformed" for r in rows)


def test_arrays_equal_the_json_module(spark, tmp_path, block_bytes):
    rng = random.Random(5)
    arrays = [[{"id": i, "v": _value(rng)} for i in range(60)], [_value(rng) for _ in range(80)], [], [1, 2, [3]], [{}], [[], {}, "}"]]
    arrays += [[1, {"a": "]"}, 2], ["x" * 500, {"y": "z" * 500}]]
    want = []
    for n, array in enumerate(arrays):
        text = json.dumps(array, indent=rng.choice([None, 1]), ensure_ascii=n % 2 == 0)
        (tmp_path / f"{n}.json").write_text(rng.choice(["", "\n "]) + text + rng.choice(["", "\n", " \n\n"]), encoding="utf-8")
        want += [json.dumps(v, sort_keys=True) for v in array]
    (tmp_path / "blank.json").write_text(" \n")
    assert _loaded(spark, tmp_path) == sorted(want)


def test_malformed_elements_stay(spark, tmp_path, block_bytes):
    (tmp_path / "a.json").write_text('[{"a": 1}, {bad}, {"b": 2},\n {"c": tru}, {"d": [1, 2]}]')
    assert _loaded(spark, tmp_path) == ["malformed", "malformed", '{"a": 1}', '{"b": 2}', '{"d": [1, 2]}']
    (tmp_path / "a.json").write_text('[{"a": 1}, {"b": ')
    assert _loaded(spark, tmp_path) == ["malformed", '{"a": 1}']
    (tmp_path / "a.json").write_text("no json")
    assert _loaded(spark, tmp_path) == ["malformed"]
