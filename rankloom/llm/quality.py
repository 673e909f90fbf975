"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed once for every whole text on the executors.  The trees are fitted on a
bounded sample of labelled rows (``max_rows``, a parameter) and kept as flat arrays: complete trees
of equal depth whose nodes 2i+1 and 2i+2 follow node i, so a whole Arrow batch walks down all trees
by index arithmetic.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import bounded_rows, fold_hash, frugal, materialize, slices, table, texts

FOLDS = 5
THRESHOLD = 0.3
MAX_ROWS = 20_000
SEED = 7

STATISTICS = (
    "bytes", "words", "lines", "letters", "upper", "digits", "spaces", "high", "punctuation", "symbols", "bars",
    "word_mean", "word_spread", "word_longest", "distinct", "top_share", "repeated_next", "repeated_pairs",
    "line_copies", "line_mean", "sentence_mean", "entropy", "marked_words", "short_words",
)

_CODES = np.arange(256)
_KINDS = {
    "upper": (_CODES >= 65) & (_CODES <= 90),
    "letters": ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)),
    "digits": (_CODES >= 48) & (_CODES <= 57),
    "spaces": (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)),
    "high": _CODES >= 128,
    "punctuation": np.isin(_CODES, list(b".,;:!?'\"()-")),
    "symbols": np.isin(_CODES, list(b"#$%&*@^~<>=+_/\\{}[]")),
    "bars": _CODES == 124,
}
_ENDS = bytes(32 if chr(c) in ".!?" else c for c in range(128)) + bytes(range(128, 256))


def statistics(text: bytes) -> list:
    """The numbers of STATISTICS for one whole text; an empty text gives zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = {name: float(counts[mask].sum()) / size for name, mask in _KINDS.items()}
    p = counts[counts > 0] / size
    words = text.lower().split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    sentences = int(counts[[33, 46, 63]].sum()) + 1
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        tally: dict = {}
        for word in words:
            tally[word] = tally.get(word, 0) + 1
        repeated = sum(map(bytes.__eq__, words, words[1:]))
        pairs = n - 1 - len(set(zip(words, words[1:]))) if n > 1 else 0
        marked = sum(1 for word in words if not 97 <= word[-1] <= 122 and word[-1] < 128)
        of_words = [
            lengths.mean(), lengths.std(), lengths.max(), len(tally) / n, max(tally.values()) / n,
            repeated / n, pairs / n,
        ]
        tail = [marked / n, float((lengths <= 2).mean())]
    else:
        of_words, tail = [0.0] * 7, [0.0, 0.0]
    kept = len(lines) or 1
    return [
        float(size), float(n), float(len(lines)), share["letters"], share["upper"], share["digits"], share["spaces"],
        share["high"], share["punctuation"], share["symbols"], share["bars"], *map(float, of_words),
        1 - len(set(lines)) / kept, size / kept, n / sentences, float(-(p * np.log2(p)).sum()), *tail,
    ]


@dataclass
class Trees:
    """Complete trees of one depth: feature and cut of inner nodes, values of leaves, and the prior's log-odds."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        trees, inner = self.features.shape
        depth = (inner + 1).bit_length() - 1
        rows, order = np.arange(len(x))[:, None], np.arange(trees)
        at = np.zeros((len(x), trees), np.int64)
        for _ in range(depth):
            right = x[rows, self.features[order, at]] > self.cuts[order, at]
            at = 2 * at + 1 + right
        return out + self.leaves[order, at - inner].sum(axis=1) if trees else out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15,
    bins: int = 64, smoothing: float = 5.0, least_rows: int = 10,
) -> Trees:
    """Boost on the logistic loss; every split comes from histograms of gradients over quantile bins."""
    inner = 2**depth - 1
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), prior)
    if len(y) < 2 * least_rows or y.min() == y.max():
        return empty
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    margin = np.full(len(y), prior)
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        features, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            slot = node - first
            best = np.full(many, 1e-6)
            for f in range(width):
                key = slot * bins + binned[:, f]
                g = np.bincount(key, gradient, many * bins).reshape(many, bins).cumsum(axis=1)
                h = np.bincount(key, weight, many * bins).reshape(many, bins).cumsum(axis=1)
                c = np.bincount(key, minlength=many * bins).reshape(many, bins).cumsum(axis=1)
                gr, hr, cr = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                gain = g**2 / (h + smoothing) + gr**2 / (hr + smoothing) - g[:, -1:] ** 2 / (h[:, -1:] + smoothing)
                gain[(c < least_rows) | (cr < least_rows)] = -1
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                top = gain[np.arange(many), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                features[first + better], cuts[first + better] = f, edges[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[node]] > cuts[node])
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, weight, inner + 1)
        leaves = rate * g / (h + smoothing)
        margin += leaves[leaf]
        all_features.append(features)
        all_cuts.append(cuts)
        all_leaves.append(leaves)
    return Trees(np.array(all_features), np.array(all_cuts), np.array(all_leaves), prior)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for every row; a null text counts as empty."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch, found in slices(batches):
            stats = pa.array([statistics(text) for text in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], ["doc_id", "stats"])

    return rows.mapInArrow(frugal(scan), f"doc_id {kind}, stats array<double>")


def agreed_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one label for each id. Null labels and ids labelled both ways are left out."""
    return (
        labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("_other"))
        .filter("y = _other").select("doc_id", F.col("y").cast("int").alias("y"))
    )


def _sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, y) of the rows to learn from, about ``max_rows`` at most."""
    known = agreed_labels(labels, "quality").filter(fold_hash("doc_id", FOLDS) != 0)
    return bounded_rows(known, F.col("doc_id"), max_rows)


def _fit(labelled: DataFrame) -> Trees:
    """Trees for rows (doc_id, stats, y); of several texts with one id the one with the least statistics counts."""
    training = labelled.groupBy("doc_id", "y").agg(F.min("stats").alias("stats")).toArrow()
    order = np.argsort(training.column("doc_id").to_numpy(), kind="stable")
    x = np.array(training.column("stats").to_pylist(), float).reshape(-1, len(STATISTICS))[order]
    return fit_trees(x, training.column("y").to_numpy().astype(float)[order])


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels of rows whose crc32(doc_id) mod 5 is not 0 train the trees; at most about ``max_rows`` of
    them, chosen by a hash of the id, are brought to the driver as 24 numbers each. Without labels, or
    with one class only, every score is the smoothed share of the class. Empty and null texts are
    scored by their (zero) statistics; equal texts get equal scores; repeated ids keep their rows.
    """
    stats = materialize(document_statistics(docs), "statistics")
    sample = _sample(labels, max_rows)
    model = _fit(stats.join(sample, "doc_id"))
    kind = stats.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            values = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            found = np.concatenate([model.probability(values[i:i + 4096]) for i in range(0, len(values), 4096)] or [[]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(apply, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (fold_hash("doc_id", FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose own text is not rejected.

    The model is that of ``score``.  Each row is judged where it is read and only its text visits a
    Python worker, so nothing is shuffled.  Rows that share a doc_id, also a null one, are judged one
    by one.
    """
    sample = _sample(labels, max_rows)
    model = _fit(document_statistics(docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")).join(sample, "doc_id"))

    def judge(columns):
        for texts_ in columns:
            found = [statistics(text.as_py() or b"") for text in texts_.cast(pa.large_binary())]
            values = np.array(found, float).reshape(-1, len(STATISTICS))
            yield pa.array(np.concatenate([model.probability(values[i:i + 4096]) for i in range(0, len(values), 4096)] or [[]]))

    @F.arrow_udf("double")
    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from frugal(judge)(columns)

    return docs.filter(judged(F.col("text")) >= threshold)


def op4_quality(spark, sf_dir):
    """Quality scores of all documents."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
