"""Small tables against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import chat, decontamination, hnsw, licenses, lm, mixing, quality, simhash, suffixes, toxicity
from rankloom.llm.components import components

_ROW = "doc_id long, text string, source string, lang string, n_chars long, score double, key string, component_id long, start long"
_UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def rows():
    """Documents with every awkward case, and columns whose names the operators use themselves."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "été", "x1", "delta", "of", "the", "longer-word", "Zeta."]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = prose(120)
    found = [(i, prose(rng.randint(1, 60))) for i in range(60)]
    found += [(60 + i, base) for i in range(20)]  # copies
    found += [(80 + i, base.replace("gamma", "gamma" + "s" * (i % 2), 1)) for i in range(10)]  # near copies
    found += [(100, None), (101, ""), (102, "   \n\t"), (103, "é"), (104, prose(6000)), (105, "word " * 3000)]
    found += [(5, found[5][1])] * 3 + [(6, prose(30)), (None, prose(40)), (None, base), (None, None)]  # repeated ids, null ids
    found += [(200 + i, f"{prose(20)}\nReleased under the MIT License.\n{prose(5)}") for i in range(3)]
    sources = ["s2", "s1", "S", "ß", None, "s1", "s1"]
    return [
        (d, t, sources[i % 7], "en", len(t) if t is not None else None, 0.5, "k", 7, 9) for i, (d, t) in enumerate(found)
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, _ROW)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], _ROW)


def _bag(found):
    return Counter(tuple(r) for r in found)


# --- chat -------------------------------------------------------------------------------------------


def test_chats_read_back(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "~0~1<~1<|", "<", "|>", "a\n\nb", "", None, "é<|im_start|>user\n"]
    turns = [(c, t, r, hard[(c + t) % len(hard)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "user\n~2", None])]
    turns += [(None, 0, "user", "x"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, None, "assistant", "first")]
    df = spark.createDataFrame([(*t, "z", "m") for t in turns], "conv_id long, turn long, role string, text string, messages string, prompt string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(chat.canonical_turns(df))).collect()}
    by = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        row = got[c]
        assert row["n_turns"] == len(own) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_layouts_of_json_rows(spark):
    payloads = {
        1: '{"prompt":"p","completion":"c","more":{"role":1}}', 2: '{"instruction":"i","input":"","output":"o"}',
        3: '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}',
        4: '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}',
        5: "no json", 6: None, 7: '{"messages":[]}', 8: '{"instruction":"i","input":"k","output":"o"}', 9: '{"other":1}',
    }
    turns, rest = chat.json_turns(spark.createDataFrame(list(payloads.items()), "conv_id long, payload string"))
    got = {}
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"], r["n"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {
        1: [("user", "p"), ("assistant", "c")], 2: [("user", "i"), ("assistant", "o")], 3: [("user", "a"), ("assistant", "")],
        4: [("user", "h"), ("assistant", "g")], 8: [("user", "i\n\nk"), ("assistant", "o")],
    }
    assert {r["conv_id"] for r in rest.collect()} == {5, 6, 7, 9}


def test_unknown_layout_is_refused(spark):
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1).select(F.lit(1).alias("conv_id"), F.lit("x").alias("nothing")))


# --- mixing -----------------------------------------------------------------------------------------


def _targets(sizes, cycle=(1, 2, 3), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > limit * sizes[s] + 1e-9}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_its_targets(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += _word_count(r[1])
    want = _targets(sizes)
    assert _bag((r["doc_id"], r["source"], r["size"]) for r in got) == _bag((r[0], r[2], _word_count(r[1])) for r in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert _bag(got) == _bag(mixing.mix(docs.repartition(7)).collect())


def test_newton_settles_on_the_dual(spark):
    cells = spark.createDataFrame([("a", 100, 5.0), ("b", 100, 300.0), ("c", 0, 10.0), ("d", 7, 0.0)], "source string, source_size long, target double")
    rates = {r["source"]: r["rate"] for r in mixing.solve(cells).collect()}
    assert rates["a"] == pytest.approx(0.05) and rates["b"] == pytest.approx(3) and rates["c"] == rates["d"] == 0


# --- classifiers ------------------------------------------------------------------------------------


def _labelled(spark, docs, column, test):
    labels = [(r["doc_id"], int(test(r["text"] or ""))) for r in docs.select("doc_id", "text").distinct().collect()]
    return spark.createDataFrame(labels, f"doc_id long, {column} int")


def test_trees_learn_and_defined_edges(spark, docs, empty):
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((quality.fit_trees(x[:1500], y[:1500]).probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    labels = _labelled(spark, docs, "quality", lambda t: len(t) < 300)
    got = quality.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    assert quality.score(empty, labels).count() == 0
    none = quality.score(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_noisy_or_finds_the_sentence(spark, empty):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    made = []
    for i in range(600):
        parts = [[rng.choice(vocabulary) for _ in range(6)] for _ in range(rng.randint(1, 6))]
        bad = rng.random() < 0.3
        at = rng.randrange(len(parts))
        if bad:
            parts[at].insert(2, rng.choice(["Vile", "nasty!"]))
        made.append((i, ". ".join(" ".join(p) for p in parts), int(bad), at))
    df = spark.createDataFrame([m[:2] for m in made] + [(700, None), (701, ""), (None, "w1")], "doc_id long, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in made] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, labels).collect()}
    right = sum(got[i]["predicted"] == bad for i, _, bad, _ in made)
    assert right / len(made) > 0.97
    placed = [got[i]["worst_sentence"] == at for i, t, bad, at in made if bad and "!" not in t]
    assert np.mean(placed) > 0.95
    assert got[700]["score"] == got[701]["score"] == 0 and got[700]["predicted"] == 0
    assert toxicity.score(empty, labels).count() == 0
    assert toxicity.score(df, labels.limit(0)).count() == df.count()


# --- near copies ------------------------------------------------------------------------------------


def _fingerprint(text):
    words = (text or "").translate(_UPPER).encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_against_all_pairs(docs, rows, empty):
    prints = [_fingerprint(r[1]) for r in rows]
    classes = _classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for c, r in zip(classes, rows):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], p, least.get(c)) for r, p, c in zip(rows, prints, classes))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("hot", [20_000, 3])
def test_anchors_lose_no_link(spark, hot):
    rng = random.Random(8)
    values = set()
    while len(values) < 400:
        v = rng.getrandbits(64) if not values or rng.random() < 0.3 else rng.choice(sorted(values))
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), hot_anchor=hot)
    got = {r["node"]: r["component"] for r in components(found).collect()}
    classes = _classes(values, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    least = {}
    for c, v in zip(classes, values):
        least[c] = min(least.get(c, v), v)
    assert all(got.get(v, v) == least[c] for c, v in zip(classes, values))
    assert found.count() <= 64 * len(values)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000), (2002, 2000), (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {2000: 2000, 2001: 2000, 2002: 2000}


# --- repeated windows -------------------------------------------------------------------------------


def _cut_bytes(pairs, depth=50):
    first = {}
    for d, t in sorted(pairs):
        for i in range(len(t) - depth + 1):
            first.setdefault(t[i:i + depth], d)
    out = Counter()
    for d, t in pairs:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if first[t[i:i + depth]] < d:
                gone[i:i + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_windows_against_brute_force(docs, rows, empty):
    want = _cut_bytes([((1 << 63) - 1 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows])
    got = Counter(
        ((1 << 63) - 1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, suffixes.digest(docs).collect())
    )
    assert got == want
    assert suffixes.digest(empty).count() == 0
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_windows_of_pieces_and_frequent_grams(monkeypatch):
    """Long texts in pieces, several units, and keys of long grams, within one process."""
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "UNIT", 700)
    rng = random.Random(4)
    words = [b"ab ", b"the of ", b"x", "é".encode(), b"foo bar baz "]
    pairs = []
    for i in range(60):
        t = b"".join(rng.choice(words) for _ in range(rng.randint(0, 150)))
        if pairs and rng.random() < 0.6:
            o = rng.choice(pairs)[1]
            a = rng.randint(0, len(o))
            t = t[:30] + o[a:a + 300] + t[30:]
        pairs.append((rng.randint(0, 50) * 60 + i, t))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.int64()), pa.array([0] * len(pairs), pa.int64()), pa.array([p[1] for p in pairs], pa.binary())],
        ["_id", "_slot", "text"],
    )
    none = np.zeros(0, np.uint64)
    keys = np.unique(np.concatenate([suffixes.Unit(p, 50).runs(50, none)[3] for p in suffixes._pieces(iter([batch]), 50)]))
    for hot in (none, keys[::2]):
        blobs, ranges = {}, {}
        for out in suffixes._deal(3, 50, hot)(iter([batch])):
            for g, settled, blob in zip(*(out.column(i).to_pylist() for i in range(3))):
                if settled:
                    for d, _, a, b in zip(*suffixes._unpack(blob, *suffixes._RANGE_ARRAYS)):
                        ranges.setdefault(d, []).append({"start": a, "end": b})
                else:
                    blobs.setdefault(g, []).append(blob)
        for own in blobs.values():
            for d, _, a, b in zip(*suffixes._settle_group(own, 50)):
                ranges.setdefault(d, []).append({"start": a, "end": b})
        got = Counter()
        for d, t in pairs:
            kept, spans = suffixes._cut(t, ranges.get(d))
            got[d, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()] += 1
        assert got == _cut_bytes(pairs)


def test_cut_text_keeps_whole_characters(spark):
    shared = "é" * 40
    df = spark.createDataFrame([(1, "a" + shared, 41), (2, "xx" + shared + "ü", 43), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in suffixes.cut_repeats(df).collect()}
    assert got == {1: ("a" + shared, 41), 2: ("xxü", 3), 3: (None, None)}


# --- decontamination --------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hits(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = _WORD.findall((t or "").translate(_UPPER))
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    lengths, out = {len(w) for w in windows}, Counter()
    for d, t in docs:
        w, hit, found = _WORD.findall((t or "").translate(_UPPER)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out[d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_benchmark_windows_against_brute_force(spark, docs, rows, empty, block_bytes):
    texts = [r[1] for r in rows if r[1]]
    items = [(i, " ".join(texts[i].split()[3:25])) for i in range(0, 60, 4)]
    items += [(90, "éTé"), (91, None), (92, ""), (93, "gamma of"), (None, "the the"), (4, items[1][1]), (4, items[1][1])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = _bag(decontamination.report(docs, bench, block_bytes=block_bytes).collect())
    assert got == _hits([(r[0], r[1]) for r in rows], items)
    assert decontamination.report(empty, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontamination.report(docs, bench.limit(0)).collect())
    assert decontamination.cut_benchmark(docs, bench).columns == docs.columns


def test_fm_index_finds_every_place(monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 3000)
    index = decontamination.FMIndex(text)
    for size in (1, 3, 6):
        phrases = rng.integers(1, 7, (40, size))
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high):
            places = [i for i in range(len(text) - size + 1) if (text[i:i + size] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 50)  # a long text over several shards
    words = rng.choice(list("abcd"), 1000)
    phrases = decontamination.Phrases([(str(i), " ".join(rng.choice(list("abcd"), 4)).encode()) for i in range(9)], 10)
    (count, spans, _), = decontamination._find([" ".join(words).encode()], phrases)
    hit = np.zeros(1000, bool)
    for size, (windows, _) in phrases.by_size.items():
        encoded = phrases.encode(" ".join(words).encode())
        for window in windows:
            for i in range(1000 - size + 1):
                hit[i:i + size] |= (encoded[i:i + size] == window).all()
    assert count == 1000 and sum(b - a for a, b in spans) == hit.sum()


# --- embeddings -------------------------------------------------------------------------------------


def test_graphs_against_all_pairs(spark):
    rng = random.Random(2)
    made = []
    for _ in range(300):
        v = [rng.gauss(0, 1) for _ in range(8)]
        c = rng.random()
        if c < 0.3 and made:
            o = rng.choice(made)[1]
            if o and len(o) == 8 and None not in o:
                v = [x + rng.gauss(0, 0.25) for x in o]
        elif c < 0.34:
            v = None
        elif c < 0.38:
            v = [0.0] * 8
        elif c < 0.42:
            v[3] = rng.choice([None, float("nan"), float("inf")])
        elif c < 0.45:
            v = v[:4]
        elif c < 0.47:
            v = []
        made.append((rng.randint(0, 250) if rng.random() < 0.97 else None, v))
    made += [(1000 + i, [1.0] * 8) for i in range(40)]  # copies
    unit = [np.array(v, float) / np.linalg.norm(v) if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v in made]

    def near(a, b):
        return a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9

    classes = _classes(unit, near)
    least = {}
    for c, (i, _) in zip(classes, made):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter(
        (i, sum(near(u, o) for o in unit) - (u is not None), least.get(c)) for (i, _), u, c in zip(made, unit, classes)
    )
    df = spark.createDataFrame([(*m, 1, "x") for m in made], "vec_id long, embedding array<double>, label int, node string")
    got = hnsw.near_duplicates(df).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall_on_close_groups():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 48))
    x[2000:] = x[rng.integers(0, 40, 1000)] + 0.05 * rng.standard_normal((1000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    shard = hnsw.Shard(np.arange(3000), np.ones(3000, int), x, 0.9)
    nodes, counts, _ = shard.answer(np.arange(3000), x)
    truth = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert counts.sum() / truth.sum() >= 0.95 and (counts <= truth[nodes]).all()


@pytest.mark.parametrize("linked", [0, 4, 300])
def test_audit_does_not_count_self_matches(monkeypatch, linked):
    """A graph in which vectors only find themselves passes no audit, however few links the audit meets."""

    def selves(self, queries, *rest):
        return np.nonzero(queries.astype(np.float32) @ self.x.T >= 0.9999)

    monkeypatch.setattr(hnsw.Graph, "within", selves)
    monkeypatch.setattr(hnsw.Graph, "nearest", lambda self, queries, *rest: np.argmax(queries @ self.x.T, axis=1)[:, None], raising=False)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 48))
    x[700 - linked:] = x[:linked] + 0.02 * rng.standard_normal((linked, 48))
    others = x[100:150] + 0.02 * rng.standard_normal((50, 48))  # of another shard
    x, others = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, others))
    shard = hnsw.Shard(np.arange(700), np.ones(700, int), x, 0.9)
    nodes, counts, _ = shard.answer(np.arange(700, 750), others)
    assert nodes.tolist() == list(range(700, 750)) and counts.tolist() == (others @ x.T >= 0.9).sum(axis=1).tolist()


def test_good_graphs_pass_their_audit():
    """Links of vectors of other shards are enough for the narrow beam; the shard is then not scanned."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 16))
    others = x[:200] + 0.02 * rng.standard_normal((200, 16))
    x, others = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, others))
    shard = hnsw.Shard(np.arange(2000), np.ones(2000, int), x, 0.9, (np.arange(2000, 2200), others))
    assert shard.beam is not None
    nodes, counts, _ = shard.answer(np.arange(2000, 2200), others)
    assert counts.sum() >= 0.98 * (others @ x.T >= 0.9).sum()


# --- language model ---------------------------------------------------------------------------------


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(4)
    model = lm.Attention(np.log(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)))
    model.p = {k: (v.astype(float) + 0.1 * rng.standard_normal(v.shape)) for k, v in model.p.items()}
    inputs, goals = rng.integers(0, 30, (3, lm.SPAN)), rng.integers(0, 30, (3, lm.SPAN))
    goals[0, 5:] = -1

    def loss():
        model.prepare()
        p, total, n = model.p, 0.0, (goals >= 0).sum()
        for line, goal in zip(inputs, goals):
            for t in np.flatnonzero(goal >= 0):
                x = p["E"][line[:t + 1]]
                w = x[t] @ p["Q"] @ (x @ p["K"]).T * lm.WIDTH**-0.5 + p["R"][t - np.arange(t + 1)]
                w = np.exp(w - w.max())
                h = x[t] + (w / w.sum()) @ (x @ p["V"]) @ p["O"]
                y = h + np.maximum(h @ p["A"] + p["a"], 0) @ p["B"]
                kind, place = divmod(int(goal[t]), lm.PER_CLASS)
                for logit, at in ((y @ p["C"] + p["c"], kind), (y @ p["M"][kind] + p["m"][kind], place)):
                    total -= logit[at] - np.log(np.exp(logit).sum())
        return total / n

    gradients = model._gradients(inputs, goals)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        at = int(np.abs(gradients[name]).reshape(-1).argmax())
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert gradients[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-7), name


def test_model_keeps_its_size():
    """A smaller vocabulary or width changes scores on every input; cost is no reason for one."""
    assert (lm.CLASSES * lm.PER_CLASS, lm.WIDTH) == (4096, 32)
    counts = np.arange(5001, 0, -1)
    assert len(set(lm.Symbols(counts, 5000).of[:4094].tolist())) == 4094


def test_known_words_cost_no_walk_over_all_words(monkeypatch):
    subwords = lm.Subwords(lm.read_ranks(lm.TOKENIZER))
    monkeypatch.setattr(subwords, "encode", lambda word: list(word))
    many = [b"%d" % i for i in range(lm._CACHE)]
    assert subwords.numbers(many)[1] == many
    began = time.process_time()
    for word in many[:3000]:
        assert subwords.ids([word, word]).tolist() == [*word, *word]
    assert time.process_time() - began < 1
    # one word more than are kept: the next call begins anew
    assert subwords.numbers([b"new", b"0", b"new"])[0].tolist() == [lm._CACHE, 0, lm._CACHE]
    at, new = subwords.numbers([b"b", b"a", b"b"])
    assert at.tolist() == [0, 1, 0] and new == [b"b", b"a"] and subwords.spell(at).tolist() == list(b"bab")


def test_steps_are_those_of_adam():
    rng = np.random.default_rng(3)
    inputs, goals = rng.integers(0, 90, (70, lm.SPAN)), rng.integers(0, 90, (70, lm.SPAN))
    model, plain = (lm.Attention(np.log(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS))) for _ in range(2))
    model.train([(inputs, goals)], rate=0.01, batch=64, warm=1)
    order = np.random.default_rng(11).permutation(70)
    first = second = 0
    for step, own in enumerate((order[:64], order[64:]), 1):
        found = plain._gradients(inputs[own], goals[own])
        g = np.concatenate([found[k].ravel() for k in plain.p]).astype(float)
        first, second = 0.9 * first + 0.1 * g, 0.98 * second + 0.02 * g * g
        move = 0.01 * len(own) / 64 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-8)
        plain.load(plain.flat() - move)
    assert np.allclose(model.flat(), plain.flat(), atol=1e-4)


def test_windows_score_each_symbol_once():
    rng = np.random.default_rng(6)
    model = lm.Attention(np.log(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)))
    model.prepare()
    texts = [rng.integers(0, 50, n).astype(np.int32) for n in (1, 5, lm.HALF, lm.HALF + 1, 100)]
    together = model.log_chances(texts)
    assert len(together) == sum(map(len, texts))
    assert np.allclose(together, np.concatenate([model.log_chances([t]) for t in texts]), atol=1e-4)
    # later symbols never change what was scored before
    longer = np.concatenate([texts[3], rng.integers(0, 50, 40).astype(np.int32)])
    assert np.allclose(model.log_chances([longer])[: len(texts[3])], model.log_chances([texts[3]]), atol=1e-4)
    # all continuations of a text have probability 1 together
    total = sum(np.exp(model.log_chances([np.append(texts[1], s).astype(np.int32)])[-1]) for s in range(0, lm.SYMBOLS, 1))
    assert total == pytest.approx(1, abs=1e-3)


def test_all_documents_train_the_model_whole(spark, monkeypatch):
    rng = random.Random(8)
    made = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(n))) for i, n in enumerate([3000] + [5] * 5600)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    held = sum(zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in made)
    seen, inner = [], lm._round
    monkeypatch.setattr(lm, "MAX_PASSES", 1)
    monkeypatch.setattr(lm, "SHARES", 5000, raising=False)
    monkeypatch.setattr(lm, "_round", lambda texts, *rest: seen.append((texts.count(), inner(texts, *rest))))
    counts = []
    subwords = lm._subword_counts
    monkeypatch.setattr(lm, "_subword_counts", lambda *rest: counts.append(subwords(*rest)) or counts[-1])
    assert lm.score(docs).filter("score < 0").count() == len(made)
    assert len(made) - held - 10 <= sum(n for n, _ in seen) <= len(made) - held
    assert counts[0].sum() * 0.98 <= sum(n for _, n in seen) <= counts[0].sum()


def test_training_in_tasks_lowers_the_loss(spark):
    text = "the quick brown fox jumps over the lazy dog and " * 10
    ranks = lm.read_ranks(lm.TOKENIZER)
    ids = lm.Subwords(ranks).ids(text.encode().split())
    counts = np.bincount(ids, minlength=max(ranks.values()) + 2) * 200
    texts = spark.createDataFrame([(i, i, text) for i in range(200)], "_id long, _slot long, text string")
    symbols, model, share = lm.train(texts, ranks, counts, {}, -5.0)
    plain = lm.Attention(symbols.log_unigram)
    model.prepare(), plain.prepare()
    line = [symbols.of[ids]]
    assert model.log_chances(line).mean() > plain.log_chances(line).mean() + 0.5 and 0.02 <= share < 0.5


def test_lm_scores(docs, rows, empty):
    got = lm.score(docs, max_rows=50, max_subwords=20_000).collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2:
            counts.update((r[1] or "").translate(_UPPER).encode().split())
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        words = [*(r[1] or "").translate(_UPPER).encode().split(), None]
        base = sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        want[r[0], len(words), sum(counts[w] > 0 for w in words), total, round(base, 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score(empty, max_rows=5).count() == 0


# --- licences ---------------------------------------------------------------------------------------


def _pairs(text):
    w = re.sub("[^a-z0-9]+", " ", text.translate(_UPPER)).strip().split(" ")
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def test_licenses_against_every_template(spark, docs, empty):
    texts = [t for _, t in licenses.TEMPLATES]
    made = [(1, texts[4].replace(". ", ".\n") + "\n\nReleased under THE mit license"), (2, texts[9][:-40]), (3, None), (4, ""), (5, "by by"), (1, "GPL")]
    made += [(6, "\n".join(texts)), (6, "\n".join(texts)), (None, texts[0] + " " + "word " * 3), (7, "x" * 30000)]
    df = spark.createDataFrame([(*m, "MIT", 1) for m in made], "doc_id long, text string, license string, place long")
    want = set()
    for d, t in made:
        if t is None:
            continue
        parts = [("line", i, p) for i, p in enumerate(t.split("\n"))]
        parts += [("paragraph", i, p) for i, p in enumerate(re.split("\n[ \t]*\n", t)) if "\n" in p.strip(" ")]
        for unit, place, part in parts:
            own = _pairs(part)
            scored = [(-2 * len(own & _pairs(x)) / (len(own) + len(_pairs(x))), name) for name, x in licenses.TEMPLATES if own]
            if scored and min(scored)[0] <= -0.8:
                want.add((d, unit, place, min(scored)[1], round(-min(scored)[0], 9)))
    got = [(*tuple(r)[:4], round(r["dice"], 9)) for r in licenses.scan(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs).filter("license = 'MIT'").count() == 3


def test_suffix_hashes_are_ordered_and_grams_found():
    """Equal hashes are neighbours also where only their low bits differ; places and keys hold for hot grams too."""
    u = np.uint64
    clash = np.array([5 << 20 | 1, 5 << 20 | 2, 5 << 20 | 1, 5 << 20 | 2, 9 << 40], u)
    assert suffixes._order(clash).tolist() == [0, 2, 1, 3, 4]
    some = np.random.default_rng(1).integers(0, 50, 3000).astype(u) * u(0x9E3779B97F4A7C15)
    assert suffixes._order(some).tolist() == np.argsort(some, kind="stable").tolist()
    text = b" ".join(random.Random(4).choices([b"one", b"twenty", b"of the many"], k=400))
    spans = suffixes.Spans(text)
    short, long = spans.every(10), spans.every(32)
    least = [short[i:i + 41].min() for i in range(len(text) - 49)]
    hot = np.unique(least)[::2]
    keys, is_long, grams = suffixes._keys(spans, 50, hot)
    want = [long[i:i + 19].min() if k in hot else k for i, k in enumerate(least)]
    assert keys.tolist() == [int(k) for k in want] and is_long.tolist() == [k in hot for k in least]
    begin = np.arange(len(keys))
    places = suffixes._gram_places(spans, grams, begin, keys, is_long, 50)
    assert suffixes._keys_at(spans, begin, places, 50).tolist() == keys.tolist()


def test_suffix_memory_is_that_of_one_stretch(monkeypatch):
    """Hashes of a unit and of a group are held by stretches; blobs of a group are given up as they are read."""
    u, rng = np.uint64, random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=3000)).encode() for _ in range(6)]
    texts[4] = texts[4][:900] + texts[1][200:9000] + texts[4][900:]
    sizes = []

    class Watched(suffixes.Spans):
        def __init__(self, data):
            sizes.append(len(data))
            super().__init__(data)

    monkeypatch.setattr(suffixes, "Spans", Watched)
    found = []
    for stretch in (4096, 1 << 20):
        monkeypatch.setattr(suffixes, "_SORT_BYTES", stretch)
        sizes.clear()
        unit = [(i, 0, 0, x) for i, x in enumerate(texts)]
        monkeypatch.setattr(suffixes, "_pieces", lambda batches, depth: iter([list(unit)]))
        covered, blobs = [], []
        for out in suffixes._deal(1, 50, np.zeros(0, u))(iter([])):
            for settled, blob in zip(out.column("settled").to_pylist(), out.column("blob").to_pylist()):
                if settled:
                    covered += zip(*suffixes._unpack(blob, *suffixes._RANGE_ARRAYS))
                else:
                    blobs.append(blob)
        assert stretch > 1 << 16 or max(sizes) < 2 * stretch
        covered += zip(*suffixes._settle_group(blobs, 50))
        assert not blobs
        found.append({i for d, _, a, b in covered for i in range(a, b) if d == 4})
        assert {d for d, *_ in covered} == {4}
    assert found[0] == found[1] and found[0] >= set(range(900, 900 + 8800))


def test_suffix_groups_do_not_share_tasks(spark, monkeypatch):
    """Each group is a task of its own, not several by the chance of a hash."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=900))) for i in range(60)], "doc_id long, text string")

    def counting(depth):
        def count(batches):
            import pyarrow as pa

            groups = {g for b in batches for g in b.column("grp").to_pylist()}
            kinds = [pa.array([len(groups)], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(kinds, ["_id", "_slot", "start", "end"])

        return count

    size = sum(len(r["text"]) for r in docs.collect())
    monkeypatch.setattr(suffixes, "GROUP_BYTES", size // 11)
    monkeypatch.setattr(suffixes, "_settle", counting)
    found = [r["start"] for r in suffixes.removed_ranges(suffixes.keyed(docs)).collect()]
    assert sum(found) >= 11 and max(found) == 1
