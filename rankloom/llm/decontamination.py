"""Benchmark decontamination with an FM-index for each shard of training text.

Each task lays the documents of a shard end to end as word numbers, sorts the suffixes, and keeps the
Burrows-Wheeler transform in a wavelet matrix.  All benchmark windows are searched backwards together,
occurrences are located from sampled suffix positions, and the spans they cover are merged.  Documents
never move; only the benchmark's windows travel, in blocks of bounded size.

Words that no window of the block holds are all one separator symbol, and so are stretches of other
words too short for the shortest window; neither can be part of an occurrence.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import frugal, slices, spread, table

WINDOW = 10
SHARD_WORDS = 1 << 19
SAMPLE = 16
#: benchmark text shipped to the tasks at once; a larger benchmark is searched in several blocks
BLOCK_BYTES = 16 << 20
_OTHER = 1
_PIECE = 4 << 20

_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)
_BORDER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_WORD_PLACES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z folded."""
    return text.translate(_WORDS).split()


class FMIndex:
    """Counts and places of any phrase in one sequence of symbols (1 and up)."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols.astype(np.int64), 0)
        order = _suffix_order(text)
        last = text[order - 1]
        self.size = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels, self.bits = [], range(max(1, int(text.max()).bit_length()) - 1, -1, -1)
        for bit in self.bits:
            ones = (last >> bit) & 1
            self.levels.append((np.concatenate([[0], np.cumsum(ones)]).astype(np.int32), int(len(ones) - ones.sum())))
            last = np.concatenate([last[ones == 0], last[ones == 1]])
        sampled = order % SAMPLE == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.places = order[sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the transform before ``row``."""
        start = np.zeros_like(row)
        for bit, (ones, zeros) in zip(self.bits, self.levels):
            one = (symbol >> bit & 1).astype(bool)
            row = np.where(one, zeros + ones[row], row - ones[row])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return row - start

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix that begins one symbol earlier."""
        symbol = np.zeros_like(row)
        start = np.zeros_like(row)
        for ones, zeros in self.levels:
            one = ones[row + 1] > ones[row]
            symbol = symbol * 2 + one
            row = np.where(one, zeros + ones[row], row - ones[row])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return self.before[symbol] + row - start

    def search(self, phrases: np.ndarray) -> tuple:
        """First row and row after the last of the suffixes that begin with each phrase (one per line)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.flatnonzero((phrases < len(self.before) - 1).all(axis=1))
        high[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(high, low)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Start of the suffix in each row, by steps back to a sampled one."""
        out = np.zeros(len(row), np.int64)
        open_, at, steps = np.arange(len(row)), row.astype(np.int64), 0
        while len(open_):
            known = self.sampled[at + 1] > self.sampled[at]
            out[open_[known]] = self.places[self.sampled[at[known]]] + steps
            open_, at = open_[~known], self.step_back(at[~known])
            steps += 1
        return out


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence that ends in its only 0, by doubling."""
    size, width = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        later = np.zeros(size, np.int64)
        later[: size - width] = rank[width:] + 1 if width < size else 0
        key = rank * (size + 1) + later
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.zeros(size, np.int64)
        fresh[1:] = key[1:] != key[:-1]
        rank[order] = np.cumsum(fresh)
        if fresh.sum() == size - 1:
            return order
        width *= 2


class Phrases:
    """The windows of a block of the benchmark as word numbers, and the items that hold each."""

    def __init__(self, items: list, window: int):
        self.numbers: dict = {}
        found: dict = {}
        for item, text in items:
            words = words_of(text or b"")
            size = min(window, len(words))
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words]
            for i in range(len(words) - size + 1) if size else ():
                found.setdefault(tuple(numbers[i:i + size]), set()).add(item)
        self.by_size = {}
        for size in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == size]
            self.by_size[size] = np.array(own, np.int64), [sorted(x for x in found[w] if x is not None) for w in own]
        self.shortest, self.longest = (min(self.by_size), max(self.by_size)) if found else (0, 0)

    def encode(self, text: bytes) -> np.ndarray:
        get, other = self.numbers.get, _OTHER
        parts, at = [], 0
        while at < len(text):
            border = _BORDER.search(text, at + _PIECE)  # pieces are cut between words
            end = border.start() if border else len(text)
            words = words_of(text[at:end])
            parts.append(np.fromiter((get(w, other) for w in words), np.int32, len(words)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _shard_hits(parts: list, phrases: Phrases):
    """Occurrences in one shard: (part, first word, words, window size, window number) arrays."""
    sizes = np.array([len(p) for p in parts], np.int64)
    joined = np.concatenate([x for p in parts for x in (p, [_OTHER])])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    # one separator for each stretch of words that cannot belong to an occurrence
    other = joined == _OTHER
    edges = np.flatnonzero(np.diff(np.concatenate([[True], other, [True]])))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return []
    many = end - begin + 1
    first = np.cumsum(many) - many
    index = np.repeat(begin - first, many) + np.arange(many.sum())
    symbols = joined[index].astype(np.int64)
    symbols[first + many - 1] = _OTHER
    fm, out = FMIndex(symbols), []
    for size, (windows, _) in phrases.by_size.items():
        low, high = fm.search(windows)
        count = high - low
        which = np.repeat(np.arange(len(windows)), count)
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = index[fm.locate(rows)]
        part = np.searchsorted(starts, at, side="right") - 1
        out.append((part, at - starts[part], size, which))
    return out


def _find(texts: list, phrases: Phrases):
    """For each text: (number of words, merged word spans, items)."""
    encoded = [phrases.encode(t) for t in texts]
    found = [(len(e), [], set()) for e in encoded]
    if phrases.by_size:
        parts, owners, total = [], [], 0
        step = phrases.longest - 1
        for i, numbers in enumerate(encoded):
            for base in range(0, max(len(numbers) - step, 1), SHARD_WORDS):
                parts.append(numbers[base:base + SHARD_WORDS + step])
                owners.append((i, base))
                total += len(parts[-1])
                if total >= SHARD_WORDS:
                    _note(parts, owners, phrases, found)
                    parts, owners, total = [], [], 0
        if parts:
            _note(parts, owners, phrases, found)
    return [(n, _merged(spans), items) for n, spans, items in found]


def _note(parts, owners, phrases, found) -> None:
    for part, first, size, which in _shard_hits(parts, phrases):
        items = phrases.by_size[size][1]
        for p, w in {(int(p), int(w)) for p, w in zip(part, which)}:
            found[owners[p][0]][2].update(items[w])
        for p, at in zip(part.tolist(), first.tolist()):
            text, base = owners[p]
            found[text][1].append((base + at, base + at + size))


def _merged(spans) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_STATE = "_words long, _spans array<struct<start:bigint,end:bigint>>, _items array<string>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _grouped(batches, many: int = 2048, size: int = 4 << 20):
    """Slices joined to shards of some MB of text."""
    held, texts, total = [], [], 0
    for batch, found in slices(batches):
        held.append(batch)
        texts += found
        total += sum(map(len, found))
        if total >= size or len(texts) >= many:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts
            held, texts, total = [], [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts


def _search(rows: DataFrame, phrases: Phrases) -> DataFrame:
    """Add the block's hits to the word spans and items that the rows already have."""
    names = rows.columns

    def scan(batches):
        for batch, found in _grouped(batches):
            results = _find(found, phrases)
            old_spans, old_items = (batch.column(n).to_pylist() for n in ("_spans", "_items"))
            spans = [
                [{"start": a, "end": b} for a, b in _merged([*((s["start"], s["end"]) for s in old), *map(tuple, new)])]
                for old, (_, new, _) in zip(old_spans, results)
            ]
            items = [sorted(set(old) | new) for old, (_, _, new) in zip(old_items, results)]
            arrays = {
                "_words": pa.array([r[0] for r in results], pa.int64()), "_spans": pa.array(spans, _SPAN),
                "_items": pa.array(items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([arrays.get(n, batch.column(n)) for n in names], names)

    return rows.mapInArrow(frugal(scan), rows.schema)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Lists of (item_id as text, text) whose texts have about ``block_bytes`` together."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    many = max(1, -(-size // block_bytes))
    block: Column = F.pmod(F.xxhash64("item", "text"), F.lit(many))
    for i in range(many):
        own = items if many == 1 else items.filter(block == i)
        yield [(row["item"], bytes(row["text"] or b"")) for row in own.distinct().toLocalIterator()]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with _words, _spans (merged word spans inside benchmark windows) and _items (their items)."""
    rows = spread(docs, "doc_id").selectExpr(
        "*", "0L AS _words", "CAST(array() AS array<struct<start:bigint,end:bigint>>) AS _spans",
        "CAST(array() AS array<string>) AS _items",
    )
    for items in blocks(benchmark, block_bytes):
        rows = _search(rows, Phrases(items, window))
    return rows


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    Null and empty texts have no words. Benchmark rows without words have no window; equal rows count
    once; a row with a null item_id marks words but is no item. An empty benchmark marks nothing.
    Repeated documents are judged one by one, and further columns are ignored.
    """
    rows = hits(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return rows.select(
        "doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _without(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def one(data, found):
        if data is None or not found:
            return data
        places = [m.span() for m in _WORD_PLACES.finditer(data)]
        out, at = [], 0
        for s in found:
            out.append(data[at:places[s["start"]][0]])
            at = places[s["end"] - 1][1]
        return b"".join([*out, data[at:]])

    def work(columns):
        for texts, spans in columns:
            found = zip(texts.cast(pa.large_binary()), spans)
            yield pa.array([one(text.as_py(), own.as_py()) for text, own in found], pa.binary()).cast(pa.string())

    yield from frugal(work)(columns)


def cut_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the merged benchmark spans cut out of their texts; all rows and other columns stay.

    n_chars, where there is such a column, follows the new text.
    """
    cut = F.arrow_udf(_without, "string")
    rows = hits(docs, benchmark, window).withColumn("text", F.when(F.size("_spans") > 0, cut("text", "_spans")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op8_decontamination(spark, sf_dir):
    """Benchmark windows in all documents."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
