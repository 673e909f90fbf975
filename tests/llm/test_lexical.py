"""Ranked search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import lexical

_DOC = "doc_id long, text string, item_id long, q int, score long, n long, rank int"
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, k):
    own = [(d, Counter(_terms(t)), len(_terms(t))) for d, t in docs]
    own = [x for x in own if x[2]]
    total, length = len(own), sum(x[2] for x in own)
    out = Counter()
    for item, text in items:
        scored = []
        for d, tf, n in own:
            m = 75 + (25 * n * total) // length
            score = 0
            for term, times in Counter(_terms(text)).items():
                df = sum(term in c for _, c, _ in own)
                if df:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
                    score += times * w * ((1_000_000_000 * tf[term]) // (1000 * tf[term] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort(key=lambda r: r[:3])
        out.update((item, i, r[3], -r[0]) for i, r in enumerate(scored[:k], 1))
    return out


def _docs():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["Ünïcode", "x's", "A1", "日本語", "the"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, " .,;\n"), (403, "the " * 5000), (404, "w1 " * 3000 + "日本語")]
    docs += [(500 + i, docs[3][1]) for i in range(30)]  # ties
    docs += [(7, docs[8][1]), (7, docs[7][1]), (None, docs[9][1]), (None, "the")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "never-seen"), (93, docs[3][1]), (93, docs[3][1]), (None, "the w1 the"), (94, "THE")]
    return docs, items


@pytest.mark.parametrize("k", [1, 20])
def test_ranking_matches_brute_force(spark, k):
    docs, items = _docs()
    table = spark.createDataFrame([(*d, 0, 0, 0, 0, 0) for d in docs], _DOC)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in lexical.search(table.repartition(5), asked, k).collect())
    assert got == _brute(docs, items, k)


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    docs, items = _docs()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 30)
    got = Counter(tuple(r) for r in lexical.search(table, asked).collect())
    assert got == _brute(docs, items, 20)
    assert len(lexical._blocks(asked.select("text").distinct())) > 1


def test_accumulators_are_limited():
    """Frequent terms make no accumulators once rare ones have filled the list, and scores stay exact."""
    rng = np.random.default_rng(1)
    n_docs, k = 5000, 10
    lists = [np.sort(rng.choice(n_docs, size, replace=False)) for size in (40, 300, 4000)]
    impact = [np.full(40, 9000) + rng.integers(0, 99, 40), np.full(300, 500), rng.integers(1, 50, 4000)]
    starts = np.cumsum([0, 40, 300, 4000])
    queries = [(np.array([0, 1, 2]), np.array([1, 1, 2]))]
    scanned = [0, 0]
    floors = np.zeros(1, np.int64)
    [(_, best, scores)] = lexical.rank_chunk(starts, np.concatenate(lists), np.concatenate(impact), n_docs, queries, floors, k, scanned)
    sums = np.zeros(n_docs, np.int64)
    for own, part, times in zip(lists, impact, (1, 1, 2)):
        sums[own] += part * times
    order = np.argsort(-scores, kind="stable")[:k]
    assert sorted(scores[order]) == sorted(np.sort(sums)[-k:]) and (sums[best] == scores).all()
    assert scanned[0] <= 340 < 4000 < scanned[1]
    assert floors[0] == np.sort(sums)[-k]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    got = lexical.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
