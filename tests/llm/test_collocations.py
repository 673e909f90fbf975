"""Phrases against plain counting, chunk graphs against their windows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom.llm import collocations as co

_DOC = "doc_id long, text string, lang string, source string, n long, word string, weight long, x long"


def _pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split("[.,;:!?\n\x0b\x0c\r]", text) if (w := re.findall("[^\x20\x09]+", p))]


def _brute(docs, least, absorbed, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        for words in _pieces(text):
            totals[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = Counter()
    for lang, f in counts.items():
        chosen = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in chosen.items():
            if any(len(h) > len(g) and 100 * b >= absorbed * a and g in (h[:2], h[1:]) for h, b in chosen.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[g[:j]] * f[g[j:]]), j, f[g[:j]], f[g[j:]]) for j in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        found.sort()
        out.update(
            (lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)
        )
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    words = [f"t{i}" for i in range(12)] + ["The", "of", "Été", "日本", "a\x1fb", "ÀB"]

    def prose(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b"]) for _ in range(n))

    base = " ".join(f"q{i}" for i in range(40))
    found = [(i, prose(rng.randint(1, 60)), rng.choice(["en", "de", None, "fr"])) for i in range(150)]
    found += [(200 + i, base, "en") for i in range(15)] + [(300, None, "en"), (301, "", None), (302, ".,;\n \t", "xx"), (303, "one", "one")]
    found += [(400, "the " * 9000, "de"), (401, prose(4000), "fr")] + [(5, "of the of the", "en")] * 12 + [(None, base, None)] * 11
    return found


def _table(spark, docs):
    return spark.createDataFrame([(*d, "s", 1, "w", 2, 3) for d in docs], _DOC)


@pytest.mark.parametrize("listed, chunk", [(1 << 18, 1 << 20), (6, 50), (0, 700)])
def test_phrases_match_plain_counting(spark, docs, monkeypatch, listed, chunk):
    monkeypatch.setattr(co, "CHUNK_WORDS", chunk)
    got = co.collocations(_table(spark, docs).repartition(3), listed=listed)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(tuple(r) for r in got.collect()) == _brute(docs, 10, 50, 2000)


def test_other_thresholds(spark, docs):
    got = co.collocations(_table(spark, docs), least=3, absorbed=90, top=25)
    assert Counter(tuple(r) for r in got.collect()) == _brute(docs, 3, 90, 25)


def test_empty_table(spark):
    assert co.collocations(_table(spark, [])).count() == 0


def test_paths_hold_the_edges_once():
    """Paths give each distinct edge once with its count, and a repeated passage is a single path."""
    rng = random.Random(1)
    parts = [[rng.randint(1, 9) for _ in range(rng.randint(1, 30))] for _ in range(40)] + [list(range(20, 60))] * 7
    sequence = np.array([w for p in parts for w in (*p, 0, 0)])
    start, edges, weight = co.compact(sequence)
    got = Counter()
    for s, m, c in zip(start, edges, weight):
        for i in range(s, s + m):
            assert tuple(sequence[i:i + 3]) not in got
            got[tuple(sequence[i:i + 3])] = c
    want = Counter(tuple(sequence[i:i + 3]) for i in range(len(sequence) - 2) if sequence[i])
    assert got == want
    assert any(m == 40 and c == 7 for m, c in zip(edges, weight))
    assert len(start) < len(want)


def test_the_listing_is_brought_to_the_words_once(spark):
    """Readers of the coded words do not broadcast the list of words again."""
    words = spark.createDataFrame([("en", f"w{i}", 1 + i) for i in range(40)], "lang string, word string, n long")
    coded, codes, seed = co.dictionary(words, 16)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "LocalTableScan" not in plan, plan
    got = {r.word: r.code for r in coded.collect()}
    assert len(set(got.values())) == 40 and codes["en"]
    assert all(got[w.decode()] == code for w, code in codes["en"].items())


def test_shuffled_joins_do_not_multiply_the_plan(spark, docs, monkeypatch):
    """Joins that split hot keys read their large side twice; a chain of them must not double at each step."""
    monkeypatch.setattr(co, "MAX_SENT", 0)
    found = co.collocations(_table(spark, docs), 2, 50, 50)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") <= 4
    assert Counter(tuple(r) for r in found.collect()) == _brute(docs, 2, 50, 50)
