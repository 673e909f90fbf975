import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.functions.words import ended, letter_classes, word_cutter
from rankloom.operators import fuzzy, lexical as ops
from rankloom.operators.analysis import analyze_query, field_stats, postings, term_stats
from rankloom.operators.scan import corpus_counts
from rankloom.sources.synonyms import parse_rules


def corpus_rows():
    rng = random.Random(21)
    pool = [a + b + c for a in ("mel", "mol", "mal") for b in ("t", "d", "r") for c in ("er", "ar", "or", "ir")] + ["red", "fox", "é", "don't"]
    rows = [(str(i), " ".join(rng.choices(pool, k=3)), " ".join(rng.choices(pool, k=12)), [rng.choice(pool), None]) for i in range(50)]
    rows += [("odd", None, "", None), ("tag", "", "melter", [""]), (None, "red fox", "melter moltar", ["fox"]), (None, "red", "malder", [])]
    return rows + rows[:8], pool, rng


def corpus(spark):
    rows, pool, rng = corpus_rows()
    queries = [(q, " ".join(rng.choices(pool, k=5))) for q in range(10)] + [(3, "red fox"), (None, "melter"), (20, "fox"), (21, "red fox fox melder")]
    return (
        spark.createDataFrame(rows, "id string, title string, content string, tags array<string>"),
        spark.createDataFrame(queries, "query_id long, query string"),
    )


def test_cut_words_are_those_of_the_expression(spark):
    rng = random.Random(1)
    signs = "aZ9_.,'’:·; \n-́é漢字が゙゚ー〇٣Ⅷ²ßİΣ\U00020000\U0001F600\U00010400क्षिab12"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(4000)] + [None, "", "a" * 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, t string")
    got = df.select("n", tokens(F.col("t")).alias("w"), ended(F.col("t")).alias("e")).orderBy("n").toArrow()
    classes, cut = letter_classes(spark), []
    for _, words, lengths in word_cutter(500)(got.column("e").combine_chunks(), classes):
        words = iter(words.to_pylist())
        cut += [[next(words) for _ in range(n)] for n in lengths]
    assert cut == got.column("w").to_pylist()


def test_counts_are_those_of_the_postings(spark):
    docs, _ = corpus(spark)
    for fold in (False, True):
        marked = postings(docs, keep_marks=True, fold_index=fold)
        terms, fields = corpus_counts(docs, fold)
        assert {tuple(r) for r in terms.collect()} == {tuple(r) for r in term_stats(marked).collect()}
        got, want = ({r.field: (r.n_docs, r.avgdl) for r in df.collect()} for df in (fields, field_stats(marked)))
        assert got == want


@pytest.mark.parametrize("rules", ["red => fox, melter", "nothing => nothing"])
def test_fuzzy_search_needs_no_postings(spark, monkeypatch, rules):
    """The hits of the scan are those of the postings; ids that are null or come twice are one document in both."""
    docs, queries = corpus(spark)
    analyzed = analyze_query(queries, parse_rules(spark.createDataFrame([(rules,)], "value string")))
    monkeypatch.setattr(ops, "lookups_pay", lambda weighted: False)
    asked = []
    narrowed = ops.narrowed_index
    monkeypatch.setattr(ops, "narrowed_index", lambda docs, *a, **k: asked.append(docs.count()) or narrowed(docs, *a, **k))
    scanned = {tuple(r) for r in ops.multi_match(queries, analyzed, docs).collect()}
    assert asked == [18]  # eight ids come twice, two rows have none
    assert None in {r[1] for r in scanned} and None not in {r[0] for r in scanned}
    monkeypatch.setattr(ops, "_scanned", lambda *_: None)
    assert {tuple(r) for r in ops.multi_match(queries, analyzed, docs).collect()} == scanned
    assert asked == [18, docs.count()] and len(scanned) > 50


def test_close_terms_are_not_joined_by_signatures(spark, monkeypatch):
    """Few query terms meet the vocabulary as hashes, many as rows; both find the same."""
    rng = random.Random(5)
    sizes = [rng.randint(1, 14) for _ in range(250)] + [rng.randint(60, 68) for _ in range(10)]
    pool = sorted({"".join(rng.choices("abé", k=n)) for n in sizes})
    varied = [w[:2] + w[3:] for w in pool] + [w[:-2] + w[-1:] + w[-2:-1] for w in pool] + [w + "a" for w in pool]
    vocabulary = spark.createDataFrame([(f, w) for f in ("title", "content") for w in sorted(set(pool[::2] + varied[::3])) if w], "field string, term string")
    asked = spark.createDataFrame([("title", w) for w in pool[::3]] + [("content", w) for w in pool[1::3]], "field string, query_term string")
    joined = {tuple(r) for r in fuzzy.fuzzy_match(asked, vocabulary, max_rows=100).collect()}

    def refuse(*_):
        raise AssertionError("a row for each signature")

    monkeypatch.setattr(fuzzy, "_short_pairs", refuse)
    monkeypatch.setattr(fuzzy, "_halved_pairs", refuse)
    assert {tuple(r) for r in fuzzy.fuzzy_match(asked, vocabulary).collect()} == joined and len(joined) > 100
