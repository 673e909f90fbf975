"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the words and word
beginnings it holds, and the document's is their noisy-or, so document labels alone train the
sentence scores, which then locate the offending sentences.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .quality import agreed_labels
from .shared import bounded_rows, fold_hash, materialize, slices, table, texts

FOLDS = 3
THRESHOLD = 0.7
MAX_ROWS = 20_000
MAX_WORDS = 4096
LEAST_DOCS = 4
#: bytes of the word beginnings that are features beside the whole words
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_GAIN = 8.0

_END, _SPACE = 10, 32


def _fold(code: int) -> int:
    if code in b".!?\n\r":
        return _END
    if 65 <= code <= 90:
        return code + 32
    return code if code >= 128 or 97 <= code <= 122 or 48 <= code <= 57 else _SPACE


_FOLDED = bytes(_fold(c) for c in range(256))


def sentences(text: bytes) -> list:
    """Word lists of the sentences of one text; sentences end at ``.!?`` and line breaks, empty ones do not count."""
    return [words for part in text.translate(_FOLDED).split(b"\n") if (words := part.split())]


def features(words: list) -> set:
    """Whole words and, marked by a trailing ``*``, their beginnings."""
    found = set(words)
    for size in BEGINNINGS:
        found |= {word[:size] + b"*" for word in words if len(word) > size}
    return found


def _document_words(sample: DataFrame) -> DataFrame:
    def scan(batches):
        for batch, found in slices(batches):
            words = [list(features([w for part in sentences(t) for w in part])) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.binary())), batch.column("y")], ["words", "y"])

    return sample.select("text", "y").mapInArrow(scan, "words array<binary>, y int")


def choose_words(sample: DataFrame, max_words: int = MAX_WORDS, least_docs: int = LEAST_DOCS) -> list:
    """Words and beginnings more frequent in documents of label 1, those with the best likelihood ratios."""
    totals = dict(sample.groupBy("y").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return []
    counts = (
        _document_words(sample).select(F.explode("words").alias("word"), "y")
        .groupBy("word").agg(F.sum("y").alias("k1"), F.count("*").alias("n")).filter(F.col("n") >= least_docs)
    )
    share = bad / (bad + good)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    k1, k0 = F.col("k1"), F.col("n") - F.col("k1")
    gain = (
        part(k1, F.col("n") * share) + part(k0, F.col("n") * (1 - share))
        + part(F.lit(bad) - k1, (F.lit(bad + good) - F.col("n")) * share)
        + part(F.lit(good) - k0, (F.lit(bad + good) - F.col("n")) * (1 - share))
    )
    best = counts.filter(k1 > F.col("n") * share).withColumn("gain", gain).filter(F.col("gain") > LEAST_GAIN)
    return [bytes(row["word"]) for row in best.orderBy(F.desc("gain"), "word").limit(max_words).select("word").collect()]


def _bags(sample: DataFrame, words: list) -> list:
    """(y, number of sentences, sentence numbers, word numbers) of each sampled document, in a stable order."""
    place = {word: i for i, word in enumerate(words)}

    def scan(batches):
        for batch, found in slices(batches):
            many, at, which = [], [], []
            for text in found:
                parts = sentences(text)
                hits = [(i, place[w]) for i, part in enumerate(parts) for w in features(part) if w in place]
                many.append(len(parts))
                at.append([i for i, _ in hits])
                which.append([k for _, k in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(many, pa.int32()),
                 pa.array(at, pa.list_(pa.int32())), pa.array(which, pa.list_(pa.int32()))],
                ["doc_id", "y", "many", "at", "which"],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.select("doc_id", "text", "y").mapInArrow(
        scan, f"doc_id {kind}, y int, many int, at array<int>, which array<int>"
    ).toArrow().sort_by([("doc_id", "ascending"), ("many", "ascending")])
    return found


class NoisyOr:
    """Weights of words, a bias, and the plain sentence's log-chance of being harmless."""

    def __init__(self, weights: dict, bias: float):
        self.weights, self.bias = weights, bias
        self.plain = float(-np.logaddexp(0, bias))

    def document(self, text: bytes) -> tuple:
        """(probability, number of the worst sentence or -1, its probability)."""
        parts, get = sentences(text), self.weights.get
        quiet, worst, top = 0.0, -1, -np.inf
        for i, part in enumerate(parts):
            hit = [v for v in map(get, features(part)) if v is not None]
            if hit:
                z = self.bias + sum(hit)
                quiet -= float(np.logaddexp(0, z))
                if z > top:
                    worst, top = i, z
            else:
                quiet += self.plain
        chance = 1 / (1 + np.exp(-top)) if worst >= 0 else 0.0
        return -np.expm1(quiet), worst, float(chance)


def fit(sample: DataFrame, max_words: int = MAX_WORDS, steps: int = 400, penalty: float = 2e-5) -> NoisyOr:
    """Fit the noisy-or on a bounded table (doc_id, text, y) by full-batch Adam in numpy."""
    words = choose_words(sample, max_words)
    if not words:
        share = sample.agg(F.avg("y")).first()[0]
        return NoisyOr({}, -12.0 if share is None or share < 0.5 else 2.0)
    bags = _bags(sample, words)
    y = bags.column("y").to_numpy().astype(float)
    many = bags.column("many").to_numpy().astype(np.int64)
    hits = np.array([len(x) for x in bags.column("at")], np.int64)
    doc = np.repeat(np.arange(len(y)), hits)
    at = bags.column("at").combine_chunks().flatten().to_numpy().astype(np.int64)
    which = bags.column("which").combine_chunks().flatten().to_numpy().astype(np.int64)
    # sentences without a chosen word all look alike and are only counted
    key, sentence = np.unique(doc << 32 | at, return_inverse=True)
    owner = key >> 32
    plain = many - np.bincount(owner, minlength=len(y))
    theta = np.zeros(len(words) + 1)
    theta[-1] = -5.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(sentence, w[which], len(key))
        quiet = -np.logaddexp(0, b) * plain - np.bincount(owner, np.logaddexp(0, z), len(y))
        loud = np.maximum(-np.expm1(quiet), 1e-9)
        pull = np.where(y > 0, np.exp(quiet) / loud, -1.0) / len(y)
        slope = pull[owner] / (1 + np.exp(-z))
        gradient = np.append(
            np.bincount(which, slope[sentence], len(w)) - penalty * w,
            slope.sum() + (pull * plain).sum() / (1 + np.exp(-b)),
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    return NoisyOr({word: float(v) for word, v in zip(words, theta)}, float(theta[-1]))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, y) of about ``max_rows`` labelled rows outside the held-out fold, one row for each id."""
    known = agreed_labels(labels, "toxic").filter(fold_hash("doc_id", FOLDS) != 1)
    chosen = materialize(bounded_rows(known, F.col("doc_id"), max_rows), "sample")
    # the sample's size is bounded by max_rows, so it may be broadcast and no text moves
    joined = texts(docs).join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_sentence, worst_score) for every row of ``docs``.

    Labels of rows whose crc32(doc_id) mod 3 is not 1 train the model; at most about ``max_rows`` of
    them are used. ``worst_sentence`` is the number of the sentence that weighs most, -1 where no
    sentence holds a word the model knows. Null and empty texts have no sentence and score 0. With
    labels of one class only, or none, there are no words to choose and only the prior is scored.
    """
    sample = materialize(training_sample(docs, labels, max_rows), "training")
    model = fit(sample)
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        for batch, found in slices(batches):
            results = [model.document(text) for text in found]
            columns = [pa.array([r[i] for r in results], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", "score", "worst_sentence", "worst_score"]
            )

    scored = rows.mapInArrow(apply, f"doc_id {kind}, score double, worst_sentence int, worst_score double")
    return scored.select(
        "doc_id", (fold_hash("doc_id", FOLDS) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_sentence", "worst_score",
    )


def op3_toxicity(spark, sf_dir):
    """Toxicity scores of all documents."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
