"""Ranked lexical search, term at a time, with limited accumulators.

One scan of the corpus keeps, for each document, its length and the counts of the terms that the
queries use; this narrow table feeds the document frequencies and the ranking.  A task ranks its
documents chunk by chunk: the terms of a query are taken rarest first, a document gets an accumulator
when it first holds one, and no further accumulators are made once the largest contributions of the
remaining terms together cannot reach the k-th best partial score.  Documents that have an accumulator
are then updated with every remaining term, so their scores are exact.  The k best of each chunk meet
in a window per query, which ranks within tasks before it shuffles.
"""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .shared import materialize, slices, table, texts

TOP = 20
#: bounds of one block of query texts, which every task holds
BLOCK_BYTES = 4 << 20
BLOCK_QUERIES = 20_000
#: bounds of a chunk of documents, whose postings are ranked together
CHUNK_DOCS = 1 << 16
CHUNK_POSTINGS = 4_000_000
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: bytes) -> list:
    """Runs of ASCII letters, ASCII digits and characters beyond ASCII; A-Z folded, nothing else."""
    return _TERM.findall(text.lower())


def _count(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """(doc_id, n, terms, counts): length and counts of the vocabulary's terms of every row."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches):
        number = known.value
        for batch, found in slices(batches):
            lengths, offsets, ids, counts = [], [0], [], []
            for text in found:
                words = terms(text)
                lengths.append(len(words))
                for word, times in Counter(words).items():
                    at = number.get(word)
                    if at is not None:
                        ids.append(at)
                        counts.append(times)
                offsets.append(len(ids))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())),
            ], ["doc_id", "n", "terms", "counts"])

    return rows.mapInArrow(scan, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def rank_chunk(starts, where, impact, n_docs, queries, floors, k, scanned=None):
    """Yield (query number, document numbers, scores) of the documents that may be among the k best.

    ``starts`` delimits the postings of each term in ``where`` (document numbers) and ``impact``.
    ``queries`` holds (terms, times) in the order of rising document frequency.  ``floors`` holds a
    score that k documents are known to reach, by query, and is raised here.  ``scanned``, if given,
    counts [accumulators made, documents that hold a query term].
    """
    filled = starts[1:] > starts[:-1]
    peak = np.zeros(len(starts) - 1, np.int64)
    if len(impact):
        peak[filled] = np.maximum.reduceat(impact, starts[:-1][filled])
    sums = np.zeros(n_docs, np.int64)
    for number, (own, times) in enumerate(queries):
        held = filled[own]
        own, times = own[held], times[held]
        if not len(own):
            continue
        left = np.cumsum((peak[own] * times)[::-1])[::-1]
        sums[:] = 0
        reached, alive = floors[number], None
        for i, term in enumerate(own):
            at = slice(starts[term], starts[term + 1])
            found, part = where[at], impact[at] * times[i]
            if alive is None and left[i] < reached:
                alive = sums > 0  # a new document could not reach the k-th score any more
            if alive is not None:
                kept = alive[found]
                found, part = found[kept], part[kept]
            sums[found] += part
            if alive is None:
                reached = max(reached, _kth(sums, k))
        if scanned is not None:
            every = np.unique(np.concatenate([where[starts[t]:starts[t + 1]] for t in own]))
            scanned[0] += int((sums > 0).sum())
            scanned[1] += len(every)
        floors[number] = reached = max(floors[number], _kth(sums, k))
        best = np.flatnonzero(sums >= max(reached, 1))
        if len(best):
            yield number, best, sums[best]


def _rank(counted: DataFrame, queries: list, weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(q, doc_id, score): at least the ``k`` best documents of every query."""
    kind = counted.schema["doc_id"].dataType.simpleString()
    shared = counted.sparkSession.sparkContext.broadcast((queries, weights))

    def ranked(held, floors):
        queries, weights = shared.value
        chunk = pa.Table.from_batches(held).combine_chunks()
        ids = chunk.column("doc_id").combine_chunks()
        n = chunk.column("n").to_numpy()
        lists, tf = chunk.column("terms").combine_chunks(), chunk.column("counts").combine_chunks().flatten().to_numpy()
        term = lists.flatten().to_numpy()
        where = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
        m = 75 + (25 * n * total) // length
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[where]))
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        place = np.empty(len(n), np.int64)
        place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(n))
        out_q, out_d, out_s = [], [], []
        for number, best, scores in rank_chunk(starts, where[order], impact[order], len(n), queries, floors, k):
            first = np.lexsort((place[best], -scores))[:k]
            out_q.append(np.full(len(first), number))
            out_d.append(best[first])
            out_s.append(scores[first])
        if out_q:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(out_q), pa.int32()), ids.take(pa.array(np.concatenate(out_d))),
                pa.array(np.concatenate(out_s), pa.int64()),
            ], ["q", "doc_id", "score"])

    def run(batches):
        floors = np.zeros(len(shared.value[0]), np.int64)
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            size += len(batch.column("terms").flatten())
            if rows >= CHUNK_DOCS or size >= CHUNK_POSTINGS:
                yield from ranked(held, floors)
                held, rows, size = [], 0, 0
        if rows:
            yield from ranked(held, floors)

    return counted.mapInArrow(run, f"q int, doc_id {kind}, score long")


def _blocks(asked: DataFrame) -> list:
    """The distinct query texts in filters that select a bounded block each."""
    rows, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(1, -(-rows // (BLOCK_QUERIES // 2)), -(-size // (BLOCK_BYTES // 2)))
    return [F.pmod(F.xxhash64("text"), F.lit(count)) == i for i in range(count if rows else 0)]


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 of each item.

    Equal scores go by ascending doc_id, null ids last; rows with one doc_id are ranked one by one.
    Null or blank texts hold no term: such documents are never found and not counted, such items have
    no rows.  Items with the same text share their search; each row of ``items`` gets its own list,
    also if its item_id repeats or is null.  Further columns are ignored and empty tables give an
    empty result.  Query texts travel to the tasks in blocks of bounded size, one pass over the
    documents for each; a single text must fit one task.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").filter("text IS NOT NULL")
    asked = materialize(items.select("text").distinct(), "asked")
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    found = None
    for block in _blocks(asked):
        wanted = sorted(r["text"] for r in asked.filter(block).collect())
        words = [Counter(terms(text.encode())) for text in wanted]
        vocabulary = {word: i for i, word in enumerate(sorted(set().union(*words)))}
        counted = materialize(_count(docs, vocabulary), "counted")
        total, length = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not vocabulary or not total:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, count in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = count
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df])
        queries = []
        for own in words:
            number = np.array([vocabulary[w] for w in own], np.int64)
            times = np.array(list(own.values()), np.int64)
            order = np.lexsort((number, df[number]))
            queries.append((number[order], times[order]))
        by_query = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = (
            _rank(counted, queries, weights, total, length, k)
            .withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
        )
        best = materialize(best, "best")  # k rows for each text of the block at most
        named = spark.createDataFrame(list(enumerate(wanted)), "q int, text string")
        part = (
            items.join(F.broadcast(named), "text").join(F.broadcast(best), "q")
            .select("item_id", "rank", "doc_id", "score")
        )
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def op11_lexical(spark, sf_dir):
    """The 20 best documents of all for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS words FROM documents
), filled AS (
  SELECT row_id, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM doc_terms WHERE len(words) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM filled
), query_terms AS (
  SELECT item_row, item_id, term, CAST(count(*) AS BIGINT) AS times
  FROM (SELECT row_number() OVER () AS item_row, item_id, unnest({_WORDS}) AS term FROM benchmark)
  GROUP BY item_row, item_id, term
), counts AS (
  SELECT row_id, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row_id, doc_id, n, unnest(words) AS term FROM filled)
  WHERE term IN (SELECT term FROM query_terms)
  GROUP BY row_id, doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
), impacts AS (
  SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))) AS part
  FROM counts JOIN weights USING (term), totals
), scored AS (
  SELECT item_row, item_id, row_id, doc_id, CAST(sum(part * times) AS BIGINT) AS score
  FROM impacts JOIN query_terms USING (term) GROUP BY item_row, item_id, row_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scored WHERE score > 0)
WHERE rank <= 20
"""
