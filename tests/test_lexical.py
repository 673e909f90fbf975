import math
import random
import re

from pyspark.sql import functions as F

from rankloom.functions.edits import swap_distance
from rankloom.functions.text import term_counts
from rankloom.operators import analysis, lexical as ops
from rankloom.operators.analysis import analyze_query, query_tokens, synonym_expand
from rankloom.operators.fuzzy import fuzzy_match
from rankloom.operators.present import best_fragments, empty_query, snippet
from rankloom.sources.synonyms import default_synonyms, parse_rules


def distance(a, b):
    """Restricted Damerau-Levenshtein distance, the plain textbook table."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def words(seed, count, low, high, letters="abcé"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(count)})


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (["x"],)], "t array<string>")
    got = [[(e.term, e.tf) for e in r.c] for r in df.select(term_counts(F.col("t")).alias("c")).collect()]
    assert got == [[("a", 1), ("b", 3)], [], [("x", 1)]]


def test_swap_distance_matches_the_table(spark):
    rng = random.Random(3)
    pool = words(3, 400, 1, 9)
    pairs = [(rng.choice(pool), rng.choice(pool)) for _ in range(3000)] + [("ca", "abc"), ("abcd", "badc"), ("ab", "ba")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("d", swap_distance(F.col("a"), F.col("b"))).collect():
        true = distance(r.a, r.b)
        assert r.d == true if true <= 2 else r.d > 2, (r.a, r.b, r.d, true)


def expansions(query, vocabulary, limit):
    allowed = 0 if len(query) <= 2 else 1 if len(query) <= 5 else 2
    close = []
    for term in vocabulary:
        edits = distance(query, term) if allowed else (0 if term == query else 9)
        boost = 1 - edits / min(len(query), len(term))
        if edits <= allowed and boost > 0:
            close.append((-boost, term, edits))
    return {(query, t, e) for _, t, e in sorted(close)[:limit]}


def test_fuzzy_match_against_brute_force(spark):
    vocabulary = sorted(set(
        words(1, 900, 1, 8) + words(2, 700, 9, 12, "ab") + words(4, 60, 23, 30) + words(7, 40, 62, 68)
        + ["x" * 64, "x" * 66, "x" * 25 + "y", "x" * 24 + "yz", "x" * 26]
    ))
    rng = random.Random(5)
    asked = rng.sample([t for t in vocabulary if len(t) < 13], 70) + ["x" * 26, "x" * 65, "a" * 25, "zzzzzz"]
    for term in rng.sample([t for t in vocabulary if len(t) > 8], 60):
        at = rng.randrange(len(term) - 1)
        asked.append(term[:at] + term[at + 1] + term[at] + term[at + 2:])
        asked.append(term[:at] + term[at + 2:])
        cut = len(term) // 2
        swapped = term[:cut - 1] + term[cut] + term[cut - 1] + term[cut + 1:]
        asked += [swapped[1:], swapped + "q", "q" + swapped]
    voc = spark.createDataFrame([("content", t) for t in vocabulary], "field string, term string")
    ask = spark.createDataFrame([("content", t) for t in sorted(set(asked))], "field string, query_term string")
    want = set().union(*[expansions(q, vocabulary, 50) for q in set(asked)])
    for max_rows in (10**6, 0):  # broadcast signatures, then shuffled ones
        got = {(r.query_term, r.term, r.edits) for r in fuzzy_match(ask, voc, 50, max_rows).collect()}
        assert got == want


def test_synonym_fixture(spark):
    queries = spark.createDataFrame(
        [(1, "auth"), (2, "authentification"), (3, "sécurité"), (4, "containerization"), (5, "the test")], "query_id long, query string")
    rows = analyze_query(queries, default_synonyms(spark)).collect()
    terms = {}
    for r in rows:
        terms.setdefault(r.query_id, set()).add(r.term)
    assert terms[1] == {"auth", "authentication", "authorization", "login", "signin", "credentials"}
    assert terms[2] == {"authentication", "auth", "login"}
    assert terms[3] == {"security", "secure", "protection"}
    assert "docker" not in terms[4] and {"deploy", "ci", "cd"} <= terms[4]
    assert terms[5] == {"test", "testing", "unit", "integration", "qa", "validation"}


def test_rule_lines(spark):
    lines = spark.createDataFrame([("# c",), ("",), (" a, B ",), ("x => y, z w",), ("d e, f",)], "value string")
    got = {(r.lhs, r.rhs) for r in parse_rules(lines).collect()}
    assert got == {
        ("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("x", "y"), ("x", "z"), ("x", "w"), ("f", "d"), ("f", "e"), ("f", "f"),
        ("d e", "d"), ("d e", "e"), ("d e", "f")}


DOCS = [
    ("1", "red fox", "the red fox jumps over red dogs", ["animals"]),
    ("2", "blue", "a blue fox", ["red fox"]),
    ("3", "green", "nothing here at all about them", []),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "id string, title string, content string, tags array<string>")


def greedy(tokens, rules):
    """Left to right, the longest input at each place; (position, token, term) of every output."""
    out, at = set(), 0
    while at < len(tokens):
        for n in range(max((len(k) for k in rules), default=1), 0, -1):
            run = tuple(tokens[at:at + n])
            if len(run) == n and run in rules:
                out |= {(at, " ".join(run), term) for term in rules[run]}
                break
        else:
            n = 1
            out.add((at, tokens[at], tokens[at]))
        at += n
    return out


def test_synonym_inputs_of_several_tokens(spark):
    lines = ["machine learning, ml", "deep nets => neural", "# note", "a b, a b c => long", "b c d => mid", "c => see", "a a, x", "CI/CD, pipeline"]
    rules = {("machine", "learning"): "machine learning ml", ("ml",): "machine learning ml", ("deep", "nets"): "neural",
             ("a", "b"): "long", ("a", "b", "c"): "long", ("b", "c", "d"): "mid", ("c",): "see", ("a", "a"): "a x", ("x",): "a x",
             ("ci", "cd"): "ci cd pipeline", ("pipeline",): "ci cd pipeline"}
    rules = {k: set(v.split()) for k, v in rules.items()}
    rng = random.Random(6)
    texts = [" ".join(rng.choice("aaabbbccdx") for _ in range(rng.randint(1, 25))) for _ in range(120)]
    texts += ["Machine  Learning for ML", "the deep nets, deep", "machine", "a", "", "ci cd ci", "machine. learning"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    parsed = parse_rules(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {}
    for r in synonym_expand(query_tokens(queries), parsed).collect():
        got.setdefault(r.query_id, set()).add((r.position, r.token, r.term))
    want = {i: greedy(re.findall("[a-z]+", t.lower()), rules) for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w}


def no_synonyms(spark):
    return spark.createDataFrame([], "lhs string, rhs string")


def expected_bm25(term, text, field):
    corpus = [d[field].split() for d in DOCS]
    avg = sum(map(len, corpus)) / len(corpus)
    df = sum(term in d for d in corpus)
    tf = text.split().count(term)
    idf = math.log(1 + (len(corpus) - df + 0.5) / (df + 0.5))
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(text.split()) / avg))


def test_bm25_by_hand(spark):
    queries = spark.createDataFrame([(1, "red fox")], "query_id long, query string")
    got = {r.id: r.score for r in ops.bm25(docs(spark), analyze_query(queries, no_synonyms(spark))).collect()}
    first = expected_bm25("red", DOCS[0][2], 2) + expected_bm25("fox", DOCS[0][2], 2)
    assert math.isclose(got["1"], first, rel_tol=1e-9)
    assert math.isclose(got["2"], expected_bm25("fox", DOCS[1][2], 2), rel_tol=1e-9)
    assert set(got) == {"1", "2"}


def test_large_query_sets_take_the_salted_join(spark):
    queries = spark.createDataFrame([(i, "red fox blue") for i in range(5)], "query_id long, query string")
    terms = ops.clause_terms(ops.query_clauses(analyze_query(queries, no_synonyms(spark))))
    index = ops.narrowed_index(docs(spark), terms)
    weighted = ops.weigh_terms(terms, index)
    small = {tuple(r) for r in ops.field_scores(index, weighted).collect()}
    large = {tuple(r) for r in ops.field_scores(index, weighted, max_rows=0).collect()}
    assert small == large and len(small) > 0


def test_rare_clauses_choose_the_candidates(spark):
    """The 75 % rule by candidates gives what scoring every match gives, from far fewer documents."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, weights, k=n))

    corpus_rows = [(str(i), prose(3), prose(40), ["en"]) for i in range(600)]
    texts = [prose(rng.randint(1, 9)) for _ in range(40)] + ["w0 w0 w0 w399", "unseen words w1", "unseen", ""]
    texts += [" ".join(corpus_rows[i][2].split()[:12]) for i in range(10)]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    corpus = spark.createDataFrame(corpus_rows, "id string, title string, content string, tags array<string>")
    terms = ops.clause_terms(ops.query_clauses(analyze_query(queries, default_synonyms(spark))))
    index = ops.narrowed_index(corpus, terms)
    weighted = ops.weigh_terms(terms, index)

    def rows(df):
        return {(r.query_id, r.id, r.field, round(r.score, 9), r.matched) for r in ops.min_should_match(df).collect()}

    every = ops.field_scores(index, weighted)
    want = rows(every)
    assert len(want) > 50
    for max_rows in (10**6, 0):
        assert rows(ops.field_scores(index, weighted, max_rows, ops.candidates(index, weighted, max_rows))) == want
    chosen = ops.candidates(index, weighted).count()
    assert len(want) <= chosen < every.count() / 2


def test_best_hits_without_scoring_every_match(spark, tmp_path):
    """Blocks of small contributions are skipped and the best hits stay, ties included."""
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(500)]
    weights = [1 / (i + 1) ** 0.9 for i in range(500)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, weights, k=n))

    corpus_rows = [(str(i), prose(2), prose(rng.randint(5, 120)), ["en"]) for i in range(800)]
    corpus_rows += [(f"copy{i}", "x", corpus_rows[3][2], ["en"]) for i in range(12)]
    texts = [prose(rng.randint(1, 8)) for _ in range(15)] + ["w0 w1 w2 w400", "w0", "nothing", "web api w3", ""]
    texts += [" ".join(corpus_rows[i][2].split()[:25]) for i in range(3, 11)]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    corpus = spark.createDataFrame(corpus_rows, "id string, title string, content string, tags array<string>")
    analyzed = analyze_query(queries, default_synonyms(spark))
    path = str(tmp_path / "index")
    ops.write_index(corpus, path)
    index = ops.read_index(spark, path)
    every = ops.bm25(corpus, analyzed)
    for k in (1, 10):
        want = {tuple(r) for r in ops.topk_per_query(every.select("query_id", "id", F.round("score", 6).alias("score")), k).collect()}
        assert {tuple(r) for r in ops.bm25_topk(index, analyzed, k).collect()} == want
    assert {tuple(r) for r in ops.bm25_topk(index, analyzed, 10, max_rows=0).collect()} == want
    assert {tuple(r) for r in ops.bm25_topk(ops.text_index(corpus), analyzed, 10).collect()} == want
    terms = ops.clause_terms(ops.query_clauses(analyzed, ("content",)))
    weighted = ops.weigh_terms(terms, index)
    kept = ops.kept_levels(index, weighted, 10).agg(F.sum("kept")).first()[0]
    postings = weighted.select("query_id", "field", "term").distinct().join(index.term_stats, ["field", "term"]).agg(F.sum("df")).first()[0]
    assert kept < 0.7 * postings, (kept, postings)


def test_keyword_field_matches_the_whole_query(spark):
    queries = spark.createDataFrame([(1, "red fox"), (2, "red foz"), (3, "RED FOX")], "query_id long, query string")
    analyzed = analyze_query(queries, no_synonyms(spark))
    exact = ops.multi_match(queries, analyzed, docs(spark), fuzzy=False)
    fuzzy = ops.multi_match(queries, analyzed, docs(spark))
    assert ("2" in {r.id for r in exact.filter("query_id = 1").collect()})
    # 75 % of two positions rounds down to one, so "red" alone finds document 1
    assert {r.id for r in exact.filter("query_id = 2").collect()} == {"1"}
    assert {r.id for r in fuzzy.filter("query_id = 2").collect()} == {"1", "2"}


def test_stored_index_gives_the_same(spark, tmp_path):
    queries = spark.createDataFrame([(1, "red fox"), (2, "blue dogs"), (3, "foxx")], "query_id long, query string")
    analyzed = analyze_query(queries, no_synonyms(spark))
    path = str(tmp_path / "index")
    ops.write_index(docs(spark), path)
    for fuzzy in (False, True):
        direct = {tuple(r) for r in ops.multi_match(queries, analyzed, docs(spark), fuzzy=fuzzy).collect()}
        stored = ops.multi_match(queries, analyzed, index=ops.read_index(spark, path), fuzzy=fuzzy)
        assert {tuple(r) for r in stored.collect()} == direct


def test_top_k_grows_with_k(spark):
    queries = spark.createDataFrame([(1, "fox")], "query_id long, query string")
    scored = ops.bm25(docs(spark), analyze_query(queries, no_synonyms(spark)))
    one = [r.id for r in ops.topk_per_query(scored, 1).collect()]
    two = [r.id for r in ops.topk_per_query(scored, 2).orderBy("rank").collect()]
    assert two[:1] == one and len(two) == 2


def test_query_folding_is_one_sided(spark):
    queries = spark.createDataFrame([(1, "Été ß")], "query_id long, query string")
    assert [r.token for r in query_tokens(queries).orderBy("position").collect()] == ["ete", "ss"]


def test_snippet_and_fragments(spark):
    text = "word " * 40 + "needle " + "word " * 40
    df = spark.createDataFrame([(text, ["needle"]), ("short", ["none"])], "t string, terms array<string>")
    got = df.select(snippet(F.col("t")).alias("s"), best_fragments(F.col("t"), F.col("terms"), 150, 2).alias("f")).collect()
    assert got[0].s == text[:150] + "..." and got[1].s == "short"
    assert len(got[0].f) == 1 and "<em>needle</em>" in got[0].f[0] and got[1].f == []


def test_blank_queries_report_an_error(spark):
    queries = spark.createDataFrame([(1, "fox"), (2, "  "), (3, None)], "query_id long, query string")
    hits = ops.bm25(docs(spark), analyze_query(queries.filter("query_id = 1"), no_synonyms(spark)))
    got = {r.query_id: (r.total_hits, r.error is None) for r in empty_query(queries, hits).collect()}
    assert got == {1: (2, True), 2: (0, False), 3: (0, False)}


def test_close_terms_are_not_looked_up_for_every_candidate(spark, monkeypatch):
    """A fuzzy search has far more terms than a document holds; its matches are formed by document."""
    rng = random.Random(15)
    vocabulary = [a + b + c for a in ("mel", "mol", "mal", "mul") for b in ("t", "d", "r", "n") for c in ("er", "ar", "or", "ir", "en", "an")]
    corpus_rows = [(str(i), " ".join(rng.choices(vocabulary, k=2)), " ".join(rng.choices(vocabulary, k=9)), ["en"]) for i in range(60)]
    corpus_rows += corpus_rows[::3]  # ids that come twice count their matches twice in either plan
    corpus = spark.createDataFrame(corpus_rows, "id string, title string, content string, tags array<string>")
    texts = [" ".join(rng.choices(vocabulary, k=6)) for _ in range(5)]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    analyzed = analyze_query(queries, no_synonyms(spark))

    def hits(**options):
        return {tuple(r) for r in ops.multi_match(queries, analyzed, corpus, **options).collect()}

    with monkeypatch.context() as patch:
        patch.setattr(ops, "lookups_pay", lambda weighted: True)
        want = hits()
    assert want

    def refuse(*_):
        raise AssertionError("candidates times terms")

    monkeypatch.setattr(ops, "candidate_matches", refuse)
    assert hits() == want


def test_many_close_terms_are_scored_in_groups_of_queries(spark, monkeypatch):
    """Terms beyond the broadcast bound: the same hits, postings partitioned once, no match shuffled."""
    rng = random.Random(8)
    pool = words(8, 300, 4, 7, "abc")
    texts = [(str(i), rng.choice(pool), " ".join(rng.choices(pool, k=12)), [rng.choice("xyz")]) for i in range(120)]
    corpus = spark.createDataFrame(texts, "id string, title string, content string, tags array<string>")
    queries = spark.createDataFrame([(q, " ".join(rng.choices(pool, k=3))) for q in range(12)], "query_id int, query string")
    analyzed = analyze_query(queries, no_synonyms(spark))
    monkeypatch.setattr(ops, "lookups_pay", lambda weighted: False)
    want = {tuple(r) for r in ops.multi_match(queries, analyzed, corpus).collect()}
    assert len(want) > 50

    scored, plans = ops.scored_in_groups, []

    def bounded(index, weighted, finish):
        def watched(sums):
            plans.append(sums._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0])
            return finish(sums)

        return scored(index, weighted, watched, max_rows=weighted.count() // 3)

    def refuse(*args, **kwargs):
        raise AssertionError("every match is shuffled")

    monkeypatch.setattr(ops, "scored_in_groups", bounded)
    monkeypatch.setattr(ops, "salted_join", refuse)
    assert {tuple(r) for r in ops.multi_match(queries, analyzed, corpus).collect()} == want
    assert len(plans) >= 4
    for plan in plans:
        assert "BroadcastHashJoin" in plan and not re.search(r"(?<!Broadcast)Exchange hashpartitioning\(query_id", plan), plan


def test_scoring_tasks_follow_the_number_of_pairs(spark, monkeypatch):
    """Many queries that share their terms multiply the postings; the tasks grow with the products."""
    corpus = spark.createDataFrame(
        [(str(i), "x", f"red fox w{i}", ["en"]) for i in range(100)], "id string, title string, content string, tags array<string>"
    )
    counts = []
    for n in (1, 40):
        queries = spark.createDataFrame([(i, "red fox") for i in range(n)], "query_id long, query string")
        terms = ops.clause_terms(ops.query_clauses(analyze_query(queries, no_synonyms(spark)), ("content",)))
        index = ops.narrowed_index(corpus, terms, ("content",))
        weighted = ops.weigh_terms(terms, index)
        monkeypatch.setattr(ops, "PAIRS_PER_TASK", 200)
        scored = ops.field_scores(index, weighted)
        assert scored.count() == 100 * n
        counts.append(scored.rdd.getNumPartitions())
    assert counts == [4, 40]


def test_runs_are_found_once(spark, monkeypatch):
    """Windows over the queries are not part of the plan that replaces tokens; many runs take a join of their own."""
    texts = ["a b c a b", "b a", "a b", "c c", ""]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    parsed = parse_rules(spark.createDataFrame([("a b => x",)], "value string"))

    def expanded():
        return synonym_expand(query_tokens(queries), parsed)

    plan = expanded()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan, plan
    want = {tuple(r) for r in expanded().collect()}
    assert (0, 0, "a b", "x", True) in want and (0, 4, "b", "b", False) not in want and (1, 0, "b", "b", False) in want
    monkeypatch.setattr(analysis, "fits", lambda *_: False)
    assert {tuple(r) for r in expanded().collect()} == want
