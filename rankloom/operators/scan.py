"""Counting and scoring while the corpus is scanned.

Workers cut the words of Arrow batches, so neither postings nor matches become rows: counting gives
one row for each term of a piece of the corpus, scoring only the documents that match enough positions.
Terms that several clauses share are looked up and added once (a *shape* is the list of terms and
boosts of a clause), then counted for every query that asks for the shape.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores
from ..functions.text import ascii_fold
from ..functions.words import ended, letter_classes, word_cutter
from ..workspace import materialize
from .sizing import fits

TEXT_FIELDS = ("title", "content")
HELD_TERMS = 1_000_000  # terms that a counting task holds before it gives them away
CELLS = 1 << 17  # documents times queries that are counted at once
PAIRS = 1 << 20  # documents times shapes times queries, likewise


def _columns(docs: DataFrame, fold_index: bool, *more) -> DataFrame:
    def text(field: str) -> Column:
        return ended(ascii_fold(F.lower(F.col(field))) if fold_index else F.col(field))

    tags = F.array_distinct(F.coalesce(F.col("tags"), F.array().cast("array<string>")))
    return docs.select(*more, *[text(f).alias(f) for f in TEXT_FIELDS], tags.alias("tags"))


def _piece_reader():
    """Function ``(batch, classes) -> iterator of (field, first row, terms, terms per row)``; null tags are left out."""
    cut, fields = word_cutter(), TEXT_FIELDS

    def pieces(batch, classes):
        import numpy as np

        for field in fields:
            for first, words, lengths in cut(batch.column(field), classes):
                yield field, first, words, lengths
        tags = batch.column("tags")
        offsets = tags.offsets.to_numpy()
        terms = tags.values.slice(offsets[0], offsets[-1] - offsets[0])
        known = terms.is_valid().to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(known)])
        yield "tags", 0, terms.drop_null(), np.diff(upto[offsets - offsets[0]]), np.diff(offsets) > 0

    return pieces


def corpus_counts(docs: DataFrame, fold_index: bool = False) -> tuple:
    """``term_stats`` and ``field_stats`` of the corpus, of one scan that writes a row for each term."""
    pieces, most = _piece_reader(), HELD_TERMS
    classes = docs.sparkSession.sparkContext.broadcast(letter_classes(docs.sparkSession))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def together(parts):
            return pa.concat_tables(parts).group_by(["field", "term"]).aggregate([("df", "sum"), ("dl", "sum")]).rename_columns(
                ["field", "term", "df", "dl"]
            )

        def rows(field, terms, df, dl):
            return pa.table({
                "field": pa.array([field] * len(terms)).cast(pa.string()), "term": terms,
                "df": pa.array(df, pa.int64()), "dl": pa.array(dl, pa.int64()),
            })

        held, size = [], 0
        for batch in batches:
            for field, _, terms, lengths, *filled in pieces(batch, classes.value):
                coded = terms.dictionary_encode()
                kinds = max(1, len(coded.dictionary))
                row = np.repeat(np.arange(len(lengths)), lengths)
                seen = np.unique(row * kinds + coded.indices.to_numpy())
                df = np.bincount(seen % kinds, minlength=len(coded.dictionary))
                known = pa.array(np.asarray(coded.dictionary.to_numpy(zero_copy_only=False) != "", dtype=bool))
                # the empty term counts the documents that have the field and their words
                full = filled[0] if filled else lengths > 0
                marks = int(np.count_nonzero(full)) + int(df.sum() - df[known.to_numpy(zero_copy_only=False)].sum())
                part = rows(field, coded.dictionary.filter(known), df[known.to_numpy(zero_copy_only=False)], np.zeros(known.true_count, np.int64))
                held += [part, rows(field, pa.array([""]), [marks], [int(lengths.sum())])]
                size += len(part)
            if size > most:
                held = [together(held)]
                if len(held[0]) > most // 2:
                    yield from held.pop().to_batches()
                size = sum(map(len, held))
        if held:
            yield from together(held).to_batches()

    parts = _columns(docs, fold_index).mapInArrow(count, "field string, term string, df long, dl long")
    summed = parts.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))
    summed = materialize(summed, "counted")
    length = F.when(F.col("field") != "tags", F.col("dl") / F.col("df"))
    return (
        summed.filter(F.col("term") != "").select("field", "term", "df"),
        summed.filter((F.col("term") == "") & (F.col("df") > 0)).select("field", F.col("df").alias("n_docs"), length.alias("avgdl")),
    )


# ---------------------------------------------------------------------------
# scoring


def _shapes(weighted: DataFrame) -> tuple:
    """``shape, field, together, term, boost`` and ``query_id, field, shape, times, needed, weight, leads``, written once."""
    asker = ["query_id", "times", "needed", "weight", "leads"]
    clauses = weighted.filter(F.col("query_id").isNotNull()).groupBy("query_id", "field", "clause").agg(
        F.sort_array(F.collect_list(F.struct("term", "boost"))).alias("entries"),
        F.max(F.col("expanded") & ~F.col("lone")).alias("together"),
        *[F.max(c).alias(c) for c in asker[1:]],
    )
    shapes = clauses.groupBy("field", "entries", "together").agg(F.collect_list(F.struct(*asker)).alias("askers"))
    shapes = materialize(shapes.withColumn("shape", F.monotonically_increasing_id()), "shapes")
    return shapes.select("shape", "field", "together", F.inline("entries")), shapes.select("shape", "field", F.inline("askers"))


def _tables(terms, asked, averages) -> tuple:
    """What scoring needs of the shapes of each field, as arrays, and the ids of the queries."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ids = asked.column("query_id").combine_chunks().unique()
    by_field = {}
    for field, average in averages.items():
        own, pairs = terms.filter(pc.equal(terms["field"], field)), asked.filter(pc.equal(asked["field"], field))
        if not len(own):
            continue
        shapes, number = np.unique(own["shape"].to_numpy(), return_inverse=True)
        coded = own["term"].combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        joint = np.zeros(len(shapes), dtype=bool)
        joint[number] = own["together"].to_numpy(zero_copy_only=False)
        query = pc.index_in(pairs["query_id"], value_set=ids).to_numpy().astype(np.int64)
        shape = np.searchsorted(shapes, pairs["shape"].to_numpy())
        needed = np.full(len(ids), np.iinfo(np.int64).max)
        needed[query] = pairs["needed"].to_numpy()
        by_shape = np.argsort(shape, kind="stable")
        by_field[field] = {
            "average": average, "terms": coded.dictionary, "joint": joint, "needed": needed,
            "of_term": np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1)),
            "shape": number[order], "boost": own["boost"].to_numpy()[order],
            "of_shape": np.searchsorted(shape[by_shape], np.arange(len(shapes) + 1)), "query": query[by_shape],
            "times": pairs["times"].to_numpy().astype(np.float64)[by_shape], "weight": pairs["weight"].to_numpy()[by_shape],
            "leads": pairs["leads"].to_numpy(zero_copy_only=False).astype(np.float64)[by_shape],
        }
    return by_field, pa.array(ids)


def _scorer(cells: int, most_pairs: int, k1: float, b: float):
    """Function ``(terms, terms per row, table of the field) -> (rows, queries, scores, matched, leads)``."""
    def ranges(starts, sizes):
        import numpy as np

        before = np.cumsum(sizes) - sizes
        return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))

    def saturated(tf, ratio):
        return tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * ratio))

    def parts(terms, lengths, own):
        """Row, shape and contribution without weight of what occurs in the rows."""
        import numpy as np
        import pyarrow.compute as pc

        coded = terms.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=own["terms"]).fill_null(-1).to_numpy()
        number = place[coded.indices.to_numpy()].astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        used = number >= 0
        kinds = len(own["terms"])
        seen, tf = np.unique(row[used] * kinds + number[used], return_counts=True)
        row, number = np.divmod(seen, kinds)
        sizes = own["of_term"][number + 1] - own["of_term"][number]
        at = ranges(own["of_term"][number], sizes)
        key = np.repeat(row, sizes) * len(own["joint"]) + own["shape"][at]
        order = np.argsort(key, kind="stable")
        key, tf, boost = key[order], np.repeat(tf, sizes)[order].astype(np.float64), own["boost"][at][order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(starts):
            return key, key, boost
        row, shape = np.divmod(key[starts], len(own["joint"]))
        ratio = np.ones(len(lengths)) if own["average"] is None else lengths / own["average"]
        part = np.add.reduceat(boost * saturated(tf, np.repeat(ratio[row], np.diff(np.append(starts, len(key))))), starts)
        joint = own["joint"][shape]
        if joint.any():
            part = np.where(joint, saturated(np.add.reduceat(tf, starts), ratio[row]), part)
        return row, shape, part

    def score(terms, lengths, own):
        import numpy as np

        row, shape, part = parts(terms, lengths, own)
        queries = len(own["needed"])
        sizes = own["of_shape"][shape + 1] - own["of_shape"][shape]
        starts = np.searchsorted(row, np.arange(len(lengths) + 1))
        upto = np.concatenate([[0], np.cumsum(sizes)])[starts]  # pairs before each row
        first = 0
        while first < len(lengths):
            # as many rows as bounded counters and pairs allow, one at least
            last = int(np.searchsorted(upto, upto[first] + most_pairs, side="right")) - 1
            last = min(max(last, first + 1), first + max(1, cells // queries), len(lengths))
            some = slice(starts[first], starts[last])
            at = ranges(own["of_shape"][shape[some]], sizes[some])
            key = np.repeat((row[some] - first) * queries, sizes[some]) + own["query"][at]
            matched = np.bincount(key, weights=own["times"][at], minlength=(last - first) * queries)
            enough = (matched.reshape(-1, queries) >= own["needed"]).ravel()
            found = np.flatnonzero(enough)
            if len(found):
                kept = np.flatnonzero(enough[key])
                key, at = np.searchsorted(found, key[kept]), at[kept]
                value = np.repeat(part[some], sizes[some])[kept] * own["weight"][at]
                of_row, query = np.divmod(found, queries)
                yield (
                    of_row + first, query, np.bincount(key, weights=value, minlength=len(found)),
                    matched[found].astype(np.int64), np.bincount(key, weights=own["leads"][at], minlength=len(found)) > 0,
                )
            first = last

    return score


def scan_scores(docs: DataFrame, weighted: DataFrame, field_stats: DataFrame, max_rows: int, fold_index: bool = False):
    """The ``field_scores`` of rows that match enough positions, without postings; None where the terms are too many.

    ``docs`` must not hold an id twice.  ``weighted`` has the mark ``leads``.  Its terms are sent to
    the tasks, one row for each distinct clause and term, so they are measured before.
    """
    terms, asked = _shapes(weighted)
    if not (fits(terms, max_rows) and fits(asked, max_rows)):
        return None
    session = docs.sparkSession.sparkContext
    averages = {r.field: r.avgdl for r in field_stats.collect()}
    id_type, query_type = docs.schema["id"].dataType.simpleString(), weighted.schema["query_id"].dataType.simpleString()
    tables = session.broadcast(_tables(terms.toArrow(), asked.toArrow(), averages))
    classes = session.broadcast(letter_classes(docs.sparkSession))
    pieces, score = _piece_reader(), _scorer(CELLS, PAIRS, scores.K1, scores.B)

    def run(batches):
        import pyarrow as pa

        by_field, queries = tables.value
        for batch in batches:
            for field, first, words, lengths, *_ in pieces(batch, classes.value):
                own = by_field.get(field)
                if own is None:
                    continue
                for row, query, value, matched, leads in score(words, lengths, own):
                    yield pa.RecordBatch.from_pydict({
                        "query_id": queries.take(pa.array(query)), "id": batch.column("id").take(pa.array(row + first)),
                        "field": pa.array([field]).take(pa.array([0] * len(row), pa.int64())), "score": pa.array(value),
                        "matched": pa.array(matched), "needed": pa.array(own["needed"][query]), "leads": pa.array(leads),
                    })

    schema = f"query_id {query_type}, id {id_type}, field string, score double, matched long, needed long, leads boolean"
    return _columns(docs, fold_index, "id").mapInArrow(run, schema)
