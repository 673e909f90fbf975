"""Fingerprints against the same rule in plain Python, and their likeness against true resemblance."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import fingerprint as fp

_DOC = "doc_id long, text string, fingerprint string, next_text string, _range int, n_chars long"


def _words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "")
    return [w for w in text.split(" ") if w]


def _shingles(text):
    words = _words(text)
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _plain(text):
    bins = [None] * fp.BINS
    for hashed in sorted((hashlib.md5(s.encode()).hexdigest() for s in _shingles(text)), reverse=True):
        bins[int(hashed[:2], 16) >> 1] = hashed[30:]
    if not any(bins):
        return ""
    out = []
    for i, own in enumerate(bins):
        mixed = i * 2654435761 >> 16
        start, step, turn = mixed & 255, mixed >> 8 & 255 | 1, 0
        while own is None:
            own = bins[(start + turn * step) % fp.BINS]
            turn += 1
        out.append(own)
    return "".join(out)


def _near(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = sum(a[i:i + 2] == b[i:i + 2] for i in range(0, len(a), 2))
    return max(256 * same - 128, 0) / 32640


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)] + ["Ärger", "日本", "É", "x\x00y"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    found = [(i, prose(rng.choice([1, 2, 4, 5, 6, 9, 40, 300]))) for i in range(80)]
    found += [(100, None), (101, ""), (102, " \t\n"), (103, "One"), (104, prose(9000)), (105, "same " * 4000), (106, "é" * 501)]
    found += [(110 + i, found[7][1]) for i in range(9)]
    found += [(5, found[5][1])] * 3 + [(6, "other text")] + [(None, None)] * 20 + [(None, prose(30))] + [(None, found[3][1])] * 5
    return found


def test_fingerprints_follow_the_rule(spark, rows):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i int, text string")
    got = dict(df.select("i", fp.fingerprint(F.col("text"))).collect())
    assert got == {i: _plain(t) for i, (_, t) in enumerate(rows)}
    assert len({len(v) for v in got.values()}) == 2 and got[80] == ""  # null


def test_likeness_is_near_the_resemblance(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(120):
        words = [f"v{rng.randrange(3000)}" for _ in range(400)]
        cut = rng.randrange(401)
        other = words[:cut] + [f"u{rng.randrange(3000)}" for _ in range(400 - cut)]
        pairs.append((" ".join(words), " ".join(other)))
    df = spark.createDataFrame(pairs, "a string, b string").select(
        *[fp.fingerprint(F.col(c)).alias(c) for c in "ab"]).select(fp.likeness(F.col("a"), F.col("b")))
    got = np.array([r[0] for r in df.collect()])
    true = np.array([len(_shingles(a) & _shingles(b)) / len(_shingles(a) | _shingles(b)) for a, b in pairs])
    assert abs(got - true).mean() < 0.04 and abs((got - true).mean()) < 0.015


def _edit(text, following):
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def test_followers_and_edits(spark, tmp_path, rows):
    """Rows of an id are ordered by a digest, so the texts beside each other are compared as pairs."""
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(d, t, "f", "n", 1, 2) for d, t in rows], _DOC).repartition(5).write.parquet(path)
    stored = spark.read.parquet(path)
    digest = {r["text"]: r["h"] for r in stored.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, digest[r[1]]))
    want = sorted((str(d), t, f) for (d, t), (_, f) in zip(order, order[1:] + order[:1]))
    for width in ("4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            got = fp.followed(stored, {"size": F.char_length("text")}).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got) == want
        assert all(r["next_size"] == len(r["next_text"]) for r in got)
    query = fp.op12_fingerprint(spark, str(tmp_path))
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in query.collect())
    told = sorted(
        (d, len(t), hashlib.sha256(_edit(t, f).encode()).hexdigest(), _plain(t), _plain(_edit(t, f)),
         _near(_plain(t), _plain(_edit(t, f))), _near(_plain(t), _plain(f))) for d, t, f in want
    )
    assert got == told


def test_small_tables(spark, tmp_path):
    def run(name, rows):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        return fp.op12_fingerprint(spark, path).collect()

    assert run("none", []) == []
    [row] = run("one", [(3, "a b c d e f g h")])
    assert row["near_next"] == 1.0 and row["n_chars"] == 15
    assert row["edited_sha256"] == hashlib.sha256(b"a b c d a b c d").hexdigest()
