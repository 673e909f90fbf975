"""Embeddings and vector search.

Exact search scores blocks of the corpus with one matrix product per Arrow batch and
keeps the best k rows per query and task, so no (query, document) pair table exists.
Queries travel to the corpus when they are measured small; larger query sets use a grid
of bounded blocks instead.  Approximate search joins queries and documents by buckets
of sign signatures and compares only pairs that share one.
"""

from dataclasses import dataclass
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import l2_normalize
from ..functions.words import ended, letter_classes, word_cutter
from ..schema import EMBEDDING_DIM
from ..workspace import materialize
from .lexical import topk_per_query
from .sizing import MAX_BROADCAST_BYTES, lookup_join

MAX_QUERY_BLOCK = 4096
CORPUS_BLOCK = 65_536
#: vectors around which others are gathered, and how many rows call for one more of them
MAX_PIVOTS = 1024
PIVOT_ROWS = 512
MAX_TABLES = 48
MAX_BITS = 16
FILTERS = {"filter_language": "language", "filter_source": "source", "filter_file_type": "file_type"}


# ---------------------------------------------------------------------------
# embedding


def _hash_vectors(dim: int, classes):
    """Vectors of ended texts; ``classes`` is the broadcast of the classes of letters."""
    cut = word_cutter()

    @F.arrow_udf("array<float>")
    def vectors(texts):
        import hashlib

        import numpy as np
        import pyarrow as pa

        matrix = np.zeros((len(texts), dim))
        for first, words, lengths in cut(texts, classes.value):
            coded = words.dictionary_encode()
            digests = [hashlib.md5(t.encode()).hexdigest() for t in coded.dictionary.to_pylist()]
            bucket = np.array([int(d[:8], 16) % dim for d in digests], dtype=np.int64)
            sign = np.array([1.0 if d[8] < "8" else -1.0 for d in digests])
            codes = coded.indices.to_numpy()
            cells = np.repeat(np.arange(len(lengths)) * dim, lengths) + bucket[codes]
            some = np.bincount(cells, weights=sign[codes], minlength=len(lengths) * dim)
            matrix[first:first + len(lengths)] = some.reshape(-1, dim)
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        offsets = pa.array(np.arange(0, len(texts) * dim + 1, dim), type=pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype("float32").ravel()))

    return vectors


def hashing_embedder(dim: int = EMBEDDING_DIM):
    """Default embedder: signed hashed token counts scaled to length one.

    The bucket of a token is its MD5 prefix modulo ``dim`` and the next hex digit gives
    the sign.  An embedder is a function from a text column to an ``ARRAY<FLOAT>`` column
    of unit vectors; pass a model-backed one to the functions below to replace it.
    """
    spark = SparkSession.active()
    classes = spark.sparkContext.broadcast(letter_classes(spark))
    return lambda text: _hash_vectors(dim, classes)(ended(text))


def _blend_vectors(weight: float):
    @F.arrow_udf("array<float>")
    def blended(first, second):
        import numpy as np
        import pyarrow as pa

        def matrix(column):
            return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)

        if len(first) == 0:
            return pa.array([], pa.list_(pa.float32()))
        left, right = matrix(first), matrix(second)
        if left.shape != right.shape:
            raise ValueError("embedding sizes differ")
        mixed = weight * left + (1.0 - weight) * right
        length = np.sqrt((mixed * mixed).sum(axis=1, keepdims=True))
        mixed = np.divide(mixed, length, out=np.zeros_like(mixed), where=length > 0)
        offsets = pa.array(np.arange(0, mixed.size + 1, mixed.shape[1]), type=pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(mixed.astype("float32").ravel()))

    return blended


def model_embedder(load_model, batch_size: int = 32):
    """Embedder around ``load_model() -> model`` whose ``encode(list, batch_size)`` gives rows.

    The model is loaded once per task, on first use.
    """
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        model = load_model()
        for texts in batches:
            rows = np.asarray(model.encode(texts.fillna("").str.strip().tolist(), batch_size=batch_size), dtype=float)
            length = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
            yield pd.Series(list(rows.astype("float32")))

    return encode


def embed_text(df: DataFrame, column: str, into: str = "embedding", embedder=None) -> DataFrame:
    """Unit vector of a text column."""
    embedder = embedder or hashing_embedder()
    return df.withColumn(into, embedder(F.btrim(F.col(column))))


def embed_query(queries: DataFrame, embedder=None) -> DataFrame:
    """``query_id, query_vector`` of the queries that are not blank."""
    asked = queries.filter(F.btrim("query") != "")
    return embed_text(asked, "query", "query_vector", embedder).select("query_id", "query_vector")


def embed_docs(docs: DataFrame, weight_title: float = 0.4, embedder=None) -> DataFrame:
    """Add ``embedding``: the normalised blend of title and content vectors."""
    embedder = embedder or hashing_embedder()
    title, content = (embedder(F.btrim(F.col(c))) for c in ("title", "content"))
    return docs.withColumn("embedding", _blend_vectors(weight_title)(title, content))


def normalize_rows(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Scale a vector column to length one."""
    return df.withColumn(column, l2_normalize(F.col(column)))


# ---------------------------------------------------------------------------
# block scoring (runs inside tasks)


def _block_scorer(k, threshold, filters, size):
    """Function ``(docs table, queries table) -> result table`` for one block pair.

    Self-contained so that it reaches Python workers by value.  ``k`` keeps the best k rows
    per query, ``threshold`` keeps every row at or above it.  Rows without a vector match
    nothing; a vector of another length than ``size`` fails the job with its length.
    """
    def checked(table, name):
        import pyarrow.compute as pc

        table = table.filter(pc.is_valid(table.column(name)))
        lengths = pc.list_value_length(table.column(name))
        wrong = lengths.filter(pc.not_equal(lengths, size))
        if len(wrong):
            raise ValueError(f"a vector of length {size} was expected, not {wrong[0].as_py()}")
        return table

    def unit_rows(column):
        import numpy as np

        sizes = np.diff(column.offsets.to_numpy())
        if len(sizes) == 0:
            return np.zeros((0, 0)), np.zeros(0, dtype=bool)
        matrix = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(sizes), -1)
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0), length[:, 0] > 0

    def allowed(docs, queries):
        """Which documents (columns) each query (row) may see, by codes of the filter values."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        mask = np.ones((queries.num_rows, docs.num_rows), dtype=bool)
        if filters is None:
            return mask
        for name, field in filters.items():
            coded = docs.column(field).combine_chunks().dictionary_encode()
            codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
            lists = queries.column(name).combine_chunks()
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
            place = pc.index_in(lists.flatten(), value_set=coded.dictionary)
            known = place.is_valid().to_numpy(zero_copy_only=False)
            wanted = np.zeros((len(sizes), len(coded.dictionary) + 1), dtype=bool)  # the last one is null
            wanted[np.repeat(np.arange(len(sizes)), sizes)[known], place.drop_null().to_numpy()] = True
            wanted[sizes == 0] = True
            mask &= wanted[:, codes]

        def moments(column, missing):
            times = column.combine_chunks().cast(pa.timestamp("us", "UTC")).cast(pa.int64())
            return times.fill_null(missing).to_numpy(), times.is_null().to_numpy(zero_copy_only=False)

        low, no_low = moments(queries.column("date_from"), -(1 << 62))
        high, no_high = moments(queries.column("date_to"), 1 << 62)
        created, unknown = moments(docs.column("created_at"), 0)
        mask &= (created >= low[:, None]) & (created <= high[:, None])
        mask[np.ix_(~(no_low & no_high), unknown)] = False
        return mask

    def best_of(values):
        """Row and column numbers of the best k finite values per row, left ones on ties."""
        import numpy as np

        if values.shape[1] > k:
            kth = np.partition(values, values.shape[1] - k, axis=1)[:, -k][:, None]
            rows, cols = np.nonzero((values >= kth) & np.isfinite(values))
        else:
            rows, cols = np.nonzero(np.isfinite(values))
        order = np.lexsort((cols, -values[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        starts = np.searchsorted(rows, np.arange(len(values)))
        place = np.arange(len(rows)) - starts[rows]
        return rows[place < k], cols[place < k]

    def score(docs, queries):
        import numpy as np
        import pyarrow as pa

        docs, queries = checked(docs, "vector"), checked(queries, "query_vector")
        ids = np.asarray(docs.column("id").to_pylist(), dtype=object)
        docs = docs.take(pa.array(np.argsort(ids, kind="stable")))  # ties go to the smaller id
        doc_rows, doc_ok = unit_rows(docs.column("vector").combine_chunks())
        query_rows, query_ok = unit_rows(queries.column("query_vector").combine_chunks())
        where_q, where_d, scores = [], [], []
        for at in range(0, len(query_rows) if len(doc_rows) else 0, 512):
            some = slice(at, at + 512)
            part = queries.slice(at, 512)
            mask = allowed(docs, part) & doc_ok[None, :] & query_ok[some, None]
            cosine = query_rows[some] @ doc_rows.T
            values = np.round(cosine if threshold is not None else (1.0 + cosine) / 2.0, 6)
            values[~mask] = -np.inf
            rows, cols = np.nonzero(values >= threshold) if threshold is not None else best_of(values)
            where_q.append(rows + at)
            where_d.append(cols)
            scores.append(values[rows, cols])
        if not scores:
            return {"query_id": [], "id": [], "score": []}
        return {
            "query_id": queries.column("query_id").take(pa.array(np.concatenate(where_q))),
            "id": docs.column("id").take(pa.array(np.concatenate(where_d))),
            "score": pa.array(np.concatenate(scores), type=pa.float64()),
        }

    return score


def _scan_with_queries(docs: DataFrame, asked: DataFrame, scorer, k, schema: str) -> DataFrame:
    """Score the corpus as it is scanned; the queries are measured to be small."""
    table = docs.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        queries = table.value
        held = None
        for batch in batches:
            found = scorer(pa.Table.from_batches([batch]), queries)
            if not len(found["query_id"]):
                continue
            found = pa.table(found)
            if k is None:
                yield from found.to_batches()
                continue
            held = found if held is None else pa.concat_tables([held, found])
            held = held.sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")])
            asked_ids = held.column("query_id").combine_chunks()
            change = np.ones(len(asked_ids), dtype=bool)
            if len(asked_ids) > 1:
                codes = asked_ids.dictionary_encode().indices.to_numpy()
                change[1:] = codes[1:] != codes[:-1]
            starts = np.flatnonzero(change)
            place = np.arange(len(change)) - np.repeat(starts, np.diff(np.append(starts, len(change))))
            held = held.filter(pa.array(place < k))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def _scan_on_grid(docs: DataFrame, asked: DataFrame, scorer, schema: str, query_block: int, corpus_block: int) -> DataFrame:
    """Score bounded corpus blocks against bounded query blocks.

    Each row is repeated once per block of the other side and block pairs meet by an
    equi-join on their numbers, so both sides of every task are of bounded size.
    """
    doc_blocks = max(1, -(-docs.count() // corpus_block))
    query_blocks = max(1, -(-asked.count() // query_block))

    def pieces(df, key, own, own_count, other, other_count):
        return df.withColumns({
            own: F.pmod(F.xxhash64(key), F.lit(own_count)).cast("int"),
            other: F.explode(F.sequence(F.lit(0), F.lit(other_count - 1))),
        })

    left = pieces(docs, "id", "_d", doc_blocks, "_q", query_blocks)
    right = pieces(asked, "query_id", "_q", query_blocks, "_d", doc_blocks)

    def run(doc_table, query_table):
        import pyarrow as pa

        found = scorer(doc_table, query_table)
        if not len(found["query_id"]):
            return pa.table({
                "query_id": pa.array([], doc_type(query_table, "query_id")),
                "id": pa.array([], doc_type(doc_table, "id")),
                "score": pa.array([], pa.float64()),
            })
        return pa.table(found)

    def doc_type(table, name):
        import pyarrow as pa

        return table.schema.field(name).type if name in table.schema.names else pa.string()

    return left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInArrow(run, schema)


def _search(docs, asked, k, threshold, filters, max_queries):
    """Score ``docs`` against ``asked``.  Vectors may be computed columns: those of ``docs`` are computed once."""
    rows, length, size = asked.agg(
        F.count("*"), F.coalesce(F.sum(F.size("query_vector").cast("long")), F.lit(0)), F.max(F.size("query_vector"))
    ).first()
    id_type = docs.schema["id"].dataType.simpleString()
    query_type = asked.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score double"
    scorer = _block_scorer(k, threshold, filters, size)
    if rows <= max_queries and length * 16 <= MAX_BROADCAST_BYTES:
        return _scan_with_queries(docs, asked, scorer, k, schema)
    return _scan_on_grid(docs, asked, scorer, schema, MAX_QUERY_BLOCK, CORPUS_BLOCK)


def knn_exact(
    docs: DataFrame, query_vectors: DataFrame, k: int, vector: str = "embedding",
    max_queries: int = MAX_QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` nearest documents per query by cosine; score ``(1 + cos) / 2``.

    Zero vectors have no direction and never match.
    """
    corpus = docs.select("id", F.col(vector).alias("vector"))
    found = _search(corpus, query_vectors.select("query_id", "query_vector"), k, None, None, max_queries)
    return topk_per_query(found, k)


def knn_filtered(
    docs: DataFrame, query_vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding",
    max_queries: int = MAX_QUERY_BLOCK,
) -> DataFrame:
    """Exact search in which each query sees only documents passing its filters."""
    corpus = docs.select("id", F.col(vector).alias("vector"), *FILTERS.values(), "created_at")
    asked = query_vectors.join(queries.select("query_id", *FILTERS, "date_from", "date_to"), "query_id")
    found = _search(corpus, asked, k, None, FILTERS, max_queries)
    return topk_per_query(found, k)


@dataclass
class SignIndex:
    """How vectors are put into buckets: ``tables`` signatures of ``bits`` signs each.

    A query looks into the buckets within ``radius`` signs of its own.  The planes follow from the
    seed; fewer tables or bits are a part of more, so settings can be compared on one set of planes.
    """

    dim: int
    tables: int
    bits: int
    radius: int
    seed: int = 7

    def planes(self):
        import numpy as np

        return np.random.default_rng(self.seed).standard_normal((MAX_TABLES, MAX_BITS, self.dim))[: self.tables, : self.bits]

    def flips(self) -> list:
        """Every mask with at most ``radius`` bits set."""
        found = {0}
        for _ in range(self.radius):
            found |= {mask ^ (1 << bit) for mask in found for bit in range(self.bits)}
        return sorted(found)

    def buckets(self, vector: Column, probes: bool = False) -> Column:
        """``ARRAY<BIGINT>``: the buckets of a vector, or those a query looks into; null for no vector."""
        planes, flips = self.planes(), self.flips() if probes else [0]
        tables, bits, dim = planes.shape

        @F.arrow_udf("array<long>")
        def signed(vectors):
            import numpy as np
            import pyarrow as pa

            valid = vectors.is_valid().to_numpy(zero_copy_only=False)
            matrix = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)
            side = np.einsum("nd,tbd->ntb", matrix, planes) >= 0
            own = side @ (1 << np.arange(bits)) + (np.arange(tables) << MAX_BITS)
            found = (own[:, :, None] ^ np.array(flips)).reshape(len(matrix), -1)
            sizes = np.where(valid, found.shape[1], 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            if valid.all():
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.ravel(), pa.int64()))
            return pa.array([row if ok else None for row, ok in zip(np.split(found.ravel(), offsets[1:-1]), valid)], pa.list_(pa.int64()))

        return signed(vector)


def tune_lsh(
    docs: DataFrame, query_vectors: DataFrame, k: int, dim: int, vector: str = "embedding", recall: float = 0.92, seed: int = 7,
) -> SignIndex:
    """The setting that compares the fewest vectors among those whose measured recall is at least ``recall``.

    Recall is measured on true neighbours: up to 64 queries (fewer for very large ``k``) are searched
    exactly, and the signatures of what they find tell which settings would have met it.  How many
    vectors a setting compares is estimated on up to 2,000 of them.  None if no setting is good enough.
    """
    import numpy as np

    def matrix(rows):
        return np.array(rows, dtype="float64").reshape(-1, dim)

    asked = query_vectors.filter(F.col("query_vector").isNotNull()).select("query_id", "query_vector")
    asked = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(max(1, min(64, 50_000 // max(k, 1))))
    asked = materialize(asked, "audit")
    corpus = docs.select("id", F.col(vector).alias("vector")).filter(F.col("vector").isNotNull())
    true = knn_exact(corpus, asked, k, "vector").select("query_id", "id")
    pairs = corpus.join(F.broadcast(true), "id").join(F.broadcast(asked), "query_id").select("vector", "query_vector").collect()
    some = corpus.orderBy(F.xxhash64("id"), "id").limit(2000).select("vector").collect()
    queries = asked.select("query_vector").collect()
    if not pairs or not some:
        return None
    planes = np.random.default_rng(seed).standard_normal((MAX_TABLES, MAX_BITS, dim))

    def sides(rows):
        return np.einsum("nd,tbd->ntb", matrix(rows), planes) >= 0

    apart = sides([p[0] for p in pairs]) != sides([p[1] for p in pairs])
    sample, asked_sides = sides([r[0] for r in some]), sides([r[0] for r in queries])
    best = None
    for bits in range(4, MAX_BITS + 1, 2):
        found = np.minimum.accumulate(apart[:, :, :bits].sum(axis=2), axis=1)
        nearest = [np.minimum.accumulate((sample[:, :, :bits] != q[:, :bits]).sum(axis=2), axis=1) for q in asked_sides]
        for radius in (0, 1, 2):
            for tables in (2, 4, 8, 12, 16, 24, 32, MAX_TABLES):
                if (found[:, tables - 1] <= radius).mean() < recall:
                    continue
                share = float(np.mean([(n[:, tables - 1] <= radius).mean() for n in nearest]))
                cost = share + 0.001 * tables  # rows of the index count too
                if best is None or cost < best[0]:
                    best = cost, SignIndex(dim, tables, bits, radius, seed)
    return best and best[1]


def lsh_candidates(docs: DataFrame, query_vectors: DataFrame, index: SignIndex, vector: str = "embedding") -> DataFrame:
    """Distinct ``query_id, id`` of queries and documents that share a bucket.

    Buckets meet by equality.  A crowded bucket is split by id when the queries do not fit a broadcast.
    """
    held = docs.filter(F.col(vector).isNotNull()).select("id", F.explode(index.buckets(F.col(vector))).alias("bucket"))
    asked = query_vectors.filter(F.col("query_vector").isNotNull()).select(
        "query_id", F.explode(index.buckets(F.col("query_vector"), probes=True)).alias("bucket")
    )
    return lookup_join(held, asked, ["bucket"], ["id"]).select("query_id", "id").distinct()


def _cosine(one: Column, other: Column) -> Column:
    @F.arrow_udf("double")
    def cosine(left, right):
        import numpy as np
        import pyarrow as pa

        def rows(column):
            return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)

        if len(left) == 0:
            return pa.array([], pa.float64())
        left, right = rows(left), rows(right)
        length = np.sqrt((left * left).sum(axis=1) * (right * right).sum(axis=1))
        value = np.divide((left * right).sum(axis=1), length, out=np.zeros(len(left)), where=length > 0)
        return pa.array(value, mask=length <= 0)

    return cosine(one, other)


def knn_lsh(
    docs: DataFrame, query_vectors: DataFrame, k: int, dim: int, vector: str = "embedding",
    index: SignIndex = None, recall: float = 0.92, seed: int = 7, max_queries: int = MAX_QUERY_BLOCK,
) -> DataFrame:
    """Approximate search: only documents that share a bucket with the query are compared.

    ``index`` says how buckets are formed; without one it is chosen by a measurement
    (``tune_lsh``), and where no setting reaches ``recall`` the search is exact.  Queries that meet
    fewer than ``k`` documents are searched exactly too.  Candidates are distinct pairs, whose
    cosine is computed once.
    """
    asked = materialize(query_vectors.select("query_id", "query_vector"), "asked")
    index = index or tune_lsh(docs, asked, k, dim, vector, recall, seed)
    if index is None:
        return knn_exact(docs, asked, k, vector, max_queries)
    pairs = materialize(lsh_candidates(docs, asked, index, vector), "candidates")
    met = pairs.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    full = materialize(lookup_join(asked, met, ["query_id"], ["query_id"], "left_semi"), "full")
    rest = lookup_join(asked, met, ["query_id"], ["query_id"], "left_anti")
    corpus = docs.select("id", F.col(vector).alias("vector"))
    # pairs are many and small; each side is brought to them, or they to it, as sizes allow
    both = lookup_join(lookup_join(corpus, pairs, ["id"], ["id"]), full, ["query_id"], ["id"])
    scored = both.withColumn("cosine", _cosine(F.col("vector"), F.col("query_vector"))).filter("cosine IS NOT NULL")
    near = scored.select("query_id", "id", F.round((1 + F.col("cosine")) / 2, 6).alias("score"))
    return topk_per_query(near, k).unionByName(knn_exact(docs, rest, k, vector, max_queries))


def _around_pivots(corpus: DataFrame, size: int, rows: int) -> tuple:
    """(pivots, corpus with ``pivot`` and ``angle``): every vector beside the nearest of a bounded set of vectors.

    Rows without a direction (null or zero vectors) are left out; a vector of another length than
    ``size`` fails the job.  Any pivots give right results, near ones prune more.
    """
    import numpy as np

    wanted = int(min(MAX_PIVOTS, max(1, rows // PIVOT_ROWS)))
    some = corpus.orderBy(F.xxhash64("id"), "id").limit(4 * wanted).select("vector").collect()
    found = [v for v in (np.array(r[0], dtype="float64") for r in some) if len(v) == size and np.any(v)][:wanted]
    pivots = np.array(found or [np.eye(1, max(size, 1))[0]])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    kind = corpus.schema["id"].dataType.simpleString()

    def nearest(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector"))
            wrong = lengths.filter(pc.not_equal(lengths, size))
            if len(wrong):
                raise ValueError(f"a vector of length {size} was expected, not {wrong[0].as_py()}")
            matrix = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size)
            length = np.linalg.norm(matrix, axis=1)
            ok = length > 0
            cosine = (matrix[ok] / length[ok, None]) @ pivots.T
            best = cosine.argmax(axis=1) if len(cosine) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1))
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), kept.column("vector").cast(pa.list_(pa.float64())), pa.array(best.astype("int32")), pa.array(angle)],
                ["id", "vector", "pivot", "angle"],
            )

    placed = corpus.mapInArrow(nearest, f"id {kind}, vector array<double>, pivot int, angle double")
    return pivots, materialize(placed, "around-pivots")


def near_pivots(pivots, radii: dict, threshold: float) -> list:
    """Pairs (p, q), p <= q, of pivots around which vectors may reach ``threshold``.

    Angles obey the triangle inequality: two vectors are at least as far apart as their pivots, less
    the distances to them.
    """
    import numpy as np

    held = sorted(radii)
    reach = np.arccos(np.clip(threshold - 1e-6, -1, 1)) + 1e-7  # scores are rounded to six digits
    radius = np.array([radii[p] for p in held])
    between = np.arccos(np.clip(pivots[held] @ pivots[held].T, -1, 1))
    first, second = np.nonzero(np.triu(between - radius[:, None] - radius[None, :] <= reach))
    return [(held[i], held[j]) for i, j in zip(first, second)]


def joined_cells(near: list, counts: dict, most: int) -> dict:
    """Cell of each pivot: neighbours in the list of pivots share one while it holds at most ``most`` vectors.

    A vector is sent to all cells that may hold similar ones, so where distances rule out few pairs of
    pivots larger cells send less and compare the same.  Where they would compare clearly more vectors,
    each pivot stays a cell of its own.
    """
    cells, held, cell = {}, 0, None
    for pivot in sorted(counts):
        if cell is None or held + counts[pivot] > most:
            cell, held = pivot, 0
        cells[pivot], held = cell, held + counts[pivot]
    sizes = dict.fromkeys(cells.values(), 0)
    for pivot, cell in cells.items():
        sizes[cell] += counts[pivot]
    apart = sum(counts[p] * counts[q] for p, q in near)
    together = sum(sizes[c] * sizes[d] for c, d in {(cells[p], cells[q]) for p, q in near})
    return cells if together <= 1.5 * apart else {pivot: pivot for pivot in counts}


def _similar_pairs(corpus: DataFrame, threshold: float, size: int, rows: int) -> DataFrame:
    """All pairs at or above ``threshold``, comparing only vectors whose pivots are near enough.

    The vectors of a pivot are split into blocks of bounded size; two blocks meet once and give their
    pairs in both directions.
    """
    spark = corpus.sparkSession
    pivots, placed = _around_pivots(corpus, size, rows)
    known = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    near = near_pivots(pivots, {p: r["radius"] for p, r in known.items()}, threshold)
    cells = joined_cells(near, {p: r["n"] for p, r in known.items()}, MAX_QUERY_BLOCK)
    blocks = dict.fromkeys(cells.values(), 0)
    for p, cell in cells.items():
        blocks[cell] += known[p]["n"]
    blocks = {cell: -(-n // MAX_QUERY_BLOCK) for cell, n in blocks.items()}
    near = [(p, q, blocks[p], blocks[q]) for p, q in sorted({(cells[p], cells[q]) for p, q in near})]
    cell_of = F.broadcast(spark.createDataFrame(list(cells.items()), "pivot int, cell int"))  # at most MAX_PIVOTS rows
    placed = placed.join(cell_of, "pivot").drop("pivot").withColumnRenamed("cell", "pivot")
    pairs = F.broadcast(spark.createDataFrame(near, "p int, q int, _ps int, _qs int"))  # at most MAX_PIVOTS squared

    def own_block(count):
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    same = F.col("p") == F.col("q")
    left = placed.join(pairs, F.col("pivot") == F.col("p")).withColumn("s", own_block("_ps")).select(
        "id", "vector", "p", "q", "s", F.explode(F.sequence(F.when(same, F.col("s")).otherwise(0), F.col("_qs") - 1)).alias("t")
    )
    right = placed.join(pairs, F.col("pivot") == F.col("q")).withColumn("t", own_block("_qs")).select(
        F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("p").alias("p"), F.col("q").alias("q"),
        F.explode(F.sequence(F.lit(0), F.when(same, F.col("t")).otherwise(F.col("_ps") - 1))).alias("s"), "t",
    )
    kind = corpus.schema["id"].dataType.simpleString()
    scorer = _block_scorer(None, threshold, None, size)

    def run(key, docs, queries):
        import pyarrow as pa

        if not docs.num_rows or not queries.num_rows:
            return pa.table({"query_id": docs.column("id").slice(0, 0), "id": docs.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        found = scorer(docs, queries)
        one, other, score = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.values())
        p, q, s, t = (k.as_py() for k in key)
        if (p, s) != (q, t):
            one, other, score = (pa.concat_arrays(x) for x in ((one, other), (other, one), (score, score)))
        return pa.table({"query_id": one, "id": other, "score": score})

    keys = ["p", "q", "s", "t"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id {kind}, id {kind}, score double")


def similarity_matrix(
    vectors: DataFrame, threshold: float, vector: str = "embedding", max_queries: int = MAX_QUERY_BLOCK,
) -> DataFrame:
    """Cosine of all pairs of rows at or above ``threshold`` (``-1`` gives the full matrix).

    Beyond ``max_queries`` rows, vectors are gathered around pivots and pairs that cannot reach the
    threshold are not compared.
    """
    corpus = vectors.select("id", F.col(vector).alias("vector")).filter(F.col("vector").isNotNull())
    rows, size = corpus.agg(F.count("*"), F.max(F.size("vector"))).first()
    if rows > max_queries:
        return _similar_pairs(corpus, threshold, size, rows)
    asked = corpus.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return _search(corpus, asked, None, threshold, None, max_queries)
