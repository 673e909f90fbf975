"""Phrase mining on a weighted de Bruijn graph of words.

Nodes are pairs of neighbouring words, edges are the runs of three words that join two of them, and a
piece of text ends in edges to an end mark.  A task builds the graph of its texts chunk by chunk and
compacts the paths whose inner nodes have one way in and one way out of equal weight: each path goes
to Spark once, with its weight.  There the paths are cut into edges and only these are summed up over
the corpus.  All shorter counts follow from the flow: a node weighs what its edges out weigh, the
edges to the end mark included, and a word weighs what the nodes that begin with it weigh.

Words travel as numbers.  The most frequent ones, a bounded list, have small numbers, so that an edge
between them is one number of 63 bits; all others have 64-bit hashes, which are checked to be distinct.
"""

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.operators.sizing import lookup_join

from .shared import frugal, give_back, materialize, slices, spread, table

MIN_COUNT = 10
#: a phrase goes if a longer one around it has this share of its count, in per cent
ABSORBED = 50
TOP = 2000
#: words with small numbers; their list goes to every task
LISTED = 1 << 18
#: words of a chunk, whose graph a task holds at once; a longer piece is a chunk of its own
CHUNK_WORDS = 1 << 19
#: words or pairs that are sent to the phrases that hold them; more are joined by shuffling
MAX_SENT = 200_000
UNKNOWN = "und"
END = 0
_BITS = 21
_PACKED = 1 << 2 * _BITS
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _BREAKS, bytes(range(97, 123)) + b"\n" * len(_BREAKS))


def pieces(text: bytes) -> list:
    """The words of each piece of a text, A-Z folded."""
    return [own for part in text.translate(_FOLD).split(b"\n") if (own := part.split())]


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang")
    return spread(docs.select("doc_id", "text", lang), "doc_id").select("text", "lang")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of every word of a language."""
    def scan(batches):
        held, size = defaultdict(Counter), 0
        for batch, found in slices(batches):
            for text, lang in zip(found, batch.column("lang").to_pylist()):
                words = text.translate(_FOLD).split()
                held[lang].update(words)
                size += len(words)
            if size > CHUNK_WORDS:
                yield from rows(held)
                held, size = defaultdict(Counter), 0
        yield from rows(held)

    def rows(held):
        for lang, words in held.items():
            names = pa.array(list(words), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), names, pa.array(list(words.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    counted = _rows(docs).mapInArrow(frugal(scan), "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hash(lang: bytes, word: bytes, seed: int) -> int:
    """A negative number for a word that is not listed; the same as ``_hashed`` gives."""
    value = xxhash.xxh64_intdigest(b"%d %b %b" % (seed, lang, word), 42) & ((1 << 63) - 1)
    return value - (1 << 63)


def _hashed(seed: int) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{seed} "), "lang", F.lit(" "), "word")).bitwiseOR(F.lit(-(1 << 63)))


def dictionary(words: DataFrame, listed: int = LISTED) -> tuple[DataFrame, dict, int]:
    """The words with their ``code``, the codes of the listed words by language, and the seed of the others' hashes.

    Listed are all words from a least count on that keeps them within ``listed``.  Should two words
    share a hash, the next seed is taken.
    """
    step = F.floor(F.log2("n") * 16).alias("step")
    steps = sorted(words.groupBy(step).count().collect(), key=lambda r: -r["step"])
    least, total = None, 0
    for row in steps:
        total += row["count"]
        if total > listed:
            break
        least = row["step"]
    spark = words.sparkSession
    top = F.floor(F.log2("n") * 16) >= least if least is not None else F.lit(False)
    known = words.filter(top).select("lang", "word", "n").toArrow()
    known = known.sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")]).drop_columns("n")
    known = known.append_column("listed", pa.array(np.arange(1, known.num_rows + 1)))
    listing = spark.createDataFrame(known)
    codes = defaultdict(dict)
    for batch in known.to_batches(max_chunksize=1 << 12):
        for lang, word, code in zip(*(column.to_pylist() for column in batch.columns)):
            codes[lang][word.encode()] = code
    del known
    give_back()
    for seed in range(8):
        coded = words.join(F.broadcast(listing), ["lang", "word"], "left").select(
            "lang", "word", "n", F.coalesce("listed", _hashed(seed)).alias("code")
        )
        # written once: the listing is brought to the words a single time, not by each reader
        coded = materialize(coded, "coded")
        if coded.groupBy("code").count().filter("count > 1").isEmpty():
            return coded, dict(codes), seed
    raise RuntimeError("words share their hashes under every seed")


def compact(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The graph of a chunk as paths: (first places, numbers of edges, weights).

    ``sequence`` holds word numbers from 1; each piece ends in two end marks.  The path at ``place``
    with ``m`` edges consists of the ``m + 2`` numbers from there.
    """
    x, y, z = sequence[:-2], sequence[1:-1], sequence[2:]
    places = np.flatnonzero(x != END)
    base = int(sequence.max()) + 1
    _, node = np.unique(x[places] * base + y[places], return_inverse=True)
    _, first, edge, weight = np.unique(node * base + z[places], return_index=True, return_inverse=True, return_counts=True)
    n_nodes = int(node.max()) + 1
    ways_out = np.bincount(node[first], minlength=n_nodes)
    # what follows an edge is the window at the next place, as long as a piece goes on
    goes_on = np.zeros(len(places), bool)
    goes_on[:-1] = places[1:] == places[:-1] + 1
    inner = first[goes_on[first]]
    ways_in = np.bincount(node[inner + 1], minlength=n_nodes)
    joined = np.zeros(len(places), bool)
    following = node[inner + 1]
    joined[inner] = (ways_in[following] == 1) & (ways_out[following] == 1) & (weight[edge[inner]] == weight[edge[inner + 1]])
    first = np.sort(first)
    opens = np.ones(len(first), bool)
    opens[1:] = ~(joined[first[:-1]] & (first[1:] == first[:-1] + 1))
    starts = np.flatnonzero(opens)
    return places[first[starts]], np.diff(np.append(starts, len(first))), weight[edge[first[starts]]]


def paths(docs: DataFrame, codes: dict, seed: int) -> DataFrame:
    """(words, weight): the compacted paths of the graphs of all chunks, words as codes and 0 for an end."""
    known = docs.sparkSession.sparkContext.broadcast(codes)

    def graph(numbers, sequence):
        names = np.zeros(sum(map(len, numbers.values())) + 1, np.int64)
        for lang, words in numbers.items():
            listed, tag = known.value.get(lang, {}), lang.encode()
            for word, number in words.items():
                code = listed.get(word)
                names[number] = _hash(tag, word, seed) if code is None else code
        sequence = np.array(sequence, np.int64)
        start, edges, weight = compact(sequence)
        size = edges + 2
        ends = np.cumsum(size)
        flat = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(names[sequence[flat]]))
        whole = pa.RecordBatch.from_arrays([lists, pa.array(weight, pa.int64())], ["words", "weight"])
        for at in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(at, 1 << 16)

    def scan(batches):
        def fresh():
            number = count(1).__next__
            return defaultdict(lambda: defaultdict(number)), []

        numbers, sequence = fresh()
        for batch, found in slices(batches):
            for text, lang in zip(found, batch.column("lang").to_pylist()):
                for own in pieces(text):
                    sequence.extend(map(numbers[lang].__getitem__, own))
                    sequence += (END, END)
                    if len(sequence) > CHUNK_WORDS:
                        yield from graph(numbers, sequence)
                        numbers, sequence = fresh()
        if sequence:
            yield from graph(numbers, sequence)

    return _rows(docs).mapInArrow(frugal(scan), "words array<long>, weight long")


def _key(x: Column, y: Column, z: Column) -> list:
    """Three columns for a run of words: one number and two zeros if all are listed or ends."""
    packed = (x > 0) & (y >= 0) & (z >= 0)
    one = F.shiftleft(x, 2 * _BITS).bitwiseOR(F.shiftleft(y, _BITS)).bitwiseOR(z)
    return [
        F.when(packed, one).otherwise(x).alias("p"), F.when(packed, F.lit(0)).otherwise(y).alias("q"),
        F.when(packed, F.lit(0)).otherwise(z).alias("r"),
    ]


def _words() -> tuple[Column, Column, Column]:
    """The three words of a key."""
    p, mask = F.col("p"), F.lit((1 << _BITS) - 1)
    packed = p >= _PACKED
    return (
        F.when(packed, F.shiftright(p, 2 * _BITS)).otherwise(p),
        F.when(packed, F.shiftright(p, _BITS).bitwiseAND(mask)).otherwise(F.col("q")),
        F.when(packed, p.bitwiseAND(mask)).otherwise(F.col("r")),
    )


def gram_counts(docs: DataFrame, codes: dict, seed: int, least: int) -> DataFrame:
    """(size, x, y, z, n): runs of one to three words with their counts, from ``least`` on.

    Only edges are counted in the texts.  Their sums feed the nodes and those of the nodes the words;
    each step keeps what it has already, so the three sums are one job.  An end is 0.
    """
    zero = F.lit(END).cast("long")
    at = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.struct(*[F.get("words", i + k).alias(c) for k, c in enumerate("xyz")]),
    )
    cut = paths(docs, codes, seed).select(F.inline(at), "weight")
    edges = cut.select(*_key(F.col("x"), F.col("y"), F.col("z")), "weight").groupBy("p", "q", "r").agg(F.sum("weight").alias("n"))

    def row(size, key, kept):
        return F.struct(F.lit(size).alias("size"), *key, F.col("n"), kept.alias("kept"))

    def regroup(grams, own, shorter):
        sent = grams.select(F.inline(F.array(own, shorter))).filter("kept")
        return sent.groupBy("size", "p", "q", "r").agg(F.sum("n").alias("n"))

    x, y, z = _words()
    enough = F.col("n") >= least
    same = [F.col(c) for c in "pqr"]
    nodes = regroup(edges, row(3, same, enough & (z != END)), row(2, _key(x, y, zero), F.lit(True)))
    isnode = F.col("size") == 2
    own = F.struct("size", *same, "n", (enough & (~isnode | (y != END))).alias("kept"))
    words = regroup(nodes, own, row(1, _key(x, zero, zero), isnode))
    return words.filter(enough).select("size", x.alias("x"), y.alias("y"), z.alias("z"), "n")


def _score(a: str, left: str, right: str) -> Column:
    big = [f"cast({c} AS decimal(15, 0))" for c in (a, a, left, right)]
    return F.expr(f"(1000000 * ({big[0]} * {big[1]})) div ({big[2]} * {big[3]})")


def collocations(docs: DataFrame, least: int = MIN_COUNT, absorbed: int = ABSORBED, top: int = TOP, listed: int = LISTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    ``a`` counts the phrase within pieces, ``l`` and ``r`` count the parts of its lowest-scoring cut
    (the earlier one on ties), ``n`` all words of the language, and the score is a million times
    ``a * a / (l * r)``, rounded down.  Phrases counted fewer than ``least`` times are left out, and so
    are those inside a longer one that has ``absorbed`` per cent of their count or more.  Order: score,
    then count, both descending, then phrase by UTF-8 bytes.  A null lang is ``und``, null and blank
    texts hold no words, repeated rows count each, ids do not matter, further columns are ignored and
    an empty table gives an empty result.
    """
    words = materialize(word_counts(docs), "words")
    coded, codes, seed = dictionary(words, listed)
    counts = materialize(gram_counts(docs, codes, seed, least), "grams")
    del codes
    give_back()
    frequent = coded.filter(F.col("n") >= least)
    one = counts.filter("size = 1").select(F.col("x").alias("code"), F.col("n").alias("f"))
    one = materialize(lookup_join(frequent.drop("n"), one, ["code"], ["word"], max_rows=MAX_SENT), "frequent")
    two = counts.filter("size = 2").select("x", "y", F.col("n").alias("a"))
    three = counts.filter("size = 3").select("x", "y", "z", F.col("n").alias("a"))

    def joined(big, side, keys, spread_by, how="inner"):
        # written, as a join that splits hot keys reads its large side twice and such joins follow each other
        return materialize(lookup_join(big, side, keys, spread_by, how, max_rows=MAX_SENT), "joined")

    def with_word(df, at, *more):
        """Adds the word and the count of the code in column ``at``."""
        side = one.select(F.col("code").alias(at), F.col("word").alias(f"w{at}"), F.col("f").alias(f"f{at}"), *more)
        return joined(df, side, [at], [c for c in "xyz" if c in df.columns and c != at])

    def with_pair(df, one_, other):
        side = two.select(F.col("x").alias(one_), F.col("y").alias(other), F.col("a").alias(f"f{one_}{other}"))
        return joined(df, side, [one_, other], [c for c in "xyz" if c not in (one_, other)])

    around = three.select("x", "y", "a").unionByName(three.select(F.col("y").alias("x"), F.col("z").alias("y"), "a"))
    around = around.groupBy("x", "y").agg(F.max("a").alias("longer"))
    around = materialize(around, "around")
    pairs = joined(two, around, ["x", "y"], ["a"], "left").filter(
        (100 * F.coalesce("longer", F.lit(0)) < absorbed * F.col("a"))
    )
    pairs = with_word(with_word(pairs, "x", "lang"), "y").select(
        "lang", F.concat_ws(" ", "wx", "wy").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"),
        _score("a", "fx", "fy").alias("score"),
    )
    runs = with_pair(with_pair(three, "x", "y"), "y", "z")
    runs = with_word(with_word(with_word(runs, "x", "lang"), "y"), "z")
    runs = runs.withColumns({"early": _score("a", "fx", "fyz"), "late": _score("a", "fxy", "fz")})
    first = F.col("early") <= F.col("late")
    runs = runs.select(
        "lang", F.concat_ws(" ", "wx", "wy", "wz").alias("phrase"), "a",
        F.when(first, F.col("fx")).otherwise(F.col("fxy")).alias("l"),
        F.when(first, F.col("fyz")).otherwise(F.col("fz")).alias("r"), F.least("early", "late").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = pairs.unionByName(runs).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    """The first 2,000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(parts) AS part FROM cut)
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 4) r(k) WHERE len(w) >= k)
), counted AS (
  SELECT lang, k, phrase, any_value(g) AS g, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS (SELECT * FROM counted WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, c.g, u.j, l.f AS l, r.f AS r,
         CAST((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM candidates c, LATERAL (SELECT unnest(range(1, c.k)) AS j) u
       JOIN counted l ON l.lang = c.lang AND l.k = u.j AND l.phrase = array_to_string(c.g[1:u.j], ' ')
       JOIN counted r ON r.lang = c.lang AND r.k = c.k - u.j AND r.phrase = array_to_string(c.g[u.j + 1:c.k], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(g[1:2], ' ') AS phrase, f FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(g[2:3], ' '), f FROM candidates WHERE k = 3) GROUP BY lang, phrase
), kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longer o ON c.k = 2 AND o.lang = c.lang AND o.phrase = c.phrase
  WHERE o.f IS NULL OR 100 * o.f < 50 * c.a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
     JOIN totals USING (lang)
WHERE rank <= 2000
"""
