"""Records that span lines, cut out of large files by several tasks.

Spark splits a text file at any delimiter.  Whether a delimiter ends a record depends on what stands
before it: an open quote, an open brace.  A first pass therefore sums up, for each block of a file,
what the block does to that state if it begins inside or outside a quoted part; the states at the
block borders follow from these few numbers.  In a second pass each block finds its own records.  Only
the first and the last part of a block move, to be joined with those of its neighbours.
"""

import re
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..workspace import materialize

_ESCAPED = re.compile(r"\\.", re.DOTALL)


@dataclass
class Rule:
    """How records end: at ``end``, outside quotes, where ``depth`` brackets are open."""

    end: str
    depth: int
    brackets: bool

    def measure(self, piece: str) -> tuple:
        """(whether quotes are left open, change of depth if it begins outside a quote, and if inside)."""
        if not self.brackets:
            return piece.count('"') & 1, 0, 0
        parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')

        def change(own):
            return sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in own)

        return (len(parts) - 1) & 1, change(parts[0::2]), change(parts[1::2])


LINES = Rule("\n", 0, False)
OBJECTS = Rule("}", 1, True)


def _pieces(spark: SparkSession, path: str, rule: Rule) -> DataFrame:
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", rule.end).text(path).select(*meta, "value")


def _by_block(batches):
    """((file, block), pieces) of the blocks of a task; a block's pieces follow each other."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")))

    for key, own in groupby(rows(), key=lambda r: r[:2]):
        yield key, (r[2] for r in own)


def _borders(pieces: DataFrame, rule: Rule) -> dict:
    """State at the start of each block, (open quote, depth, whether the file's last), by (file, block).

    There is one entry for each block of some 128 MB, as many as Spark itself lists.
    """
    def scan(batches):
        for (file, block), own in _by_block(batches):
            quote, outside, inside = 0, 0, 0
            for piece in own:
                q, o, i = rule.measure(piece + rule.end)
                if quote:
                    o, i = i, o
                quote, outside, inside = quote ^ q, outside + o, inside + i
            yield pa.RecordBatch.from_pydict(
                {"file": [file], "block": [block], "quote": [quote], "outside": [outside], "inside": [inside]}
            )

    sums = pieces.mapInArrow(scan, "file string, block long, quote long, outside long, inside long").collect()
    states = {}
    for file, own in groupby(sorted(sums), key=lambda r: r["file"]):
        quote, depth = 0, 0
        for row in own:
            states[file, row["block"]] = (quote, depth, False)
            last = file, row["block"]
            depth += row["inside"] if quote else row["outside"]
            quote ^= row["quote"]
        states[last] = (*states[last][:2], True)
    return states


def _cut(pieces: DataFrame, rule: Rule) -> DataFrame:
    """(file, block, at, ended, edge, value): records in their blocks; an edge goes on in another block."""
    states = pieces.sparkSession.sparkContext.broadcast(_borders(pieces, rule))
    names = ["file", "block", "at", "ended", "edge", "value"]

    def found(file, block, own):
        quote, depth, last = states.value[file, block]
        at, held, piece, before = 0, [], "", (quote, depth)
        for piece in own:
            # what ended is given when the next piece comes, as the file's last piece may be mended
            if held and not quote and depth == rule.depth:
                yield file, block, at, True, at == 0, "".join(held)
                at, held = at + 1, []
            before = quote, depth
            held.append(piece + rule.end)
            q, outside, inside = rule.measure(held[-1])
            depth += inside if quote else outside
            quote ^= q
        ended = not quote and depth == rule.depth
        if last and rule.brackets:
            # the last piece has no end of its own where all brackets are closed without it
            _, outside, inside = rule.measure(piece)
            if before[1] + (inside if before[0] else outside) == 0:
                held[-1], ended = piece, False
        yield file, block, at, ended, at == 0 or not ended, "".join(held)

    def cut(batches):
        out = []
        for (file, block), own in _by_block(batches):
            for row in found(file, block, own):
                out.append(row)
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))
                    out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    return pieces.mapInArrow(cut, "file string, block long, at long, ended boolean, edge boolean, value string")


def records(spark: SparkSession, path: str, rule: Rule) -> DataFrame:
    """(file, first, value): the records of all files, each with its end; ``first`` marks the first of a file.

    What follows the last end of a file is a record too.  The order of records is not kept.
    """
    cut = materialize(_cut(_pieces(spark, path, rule), rule), "records")
    order = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    # two edges a block; the parts of one record have the same number of ends before them
    edges = cut.filter("edge").withColumn("number", F.coalesce(F.sum(F.col("ended").cast("long")).over(order), F.lit(0)))
    joined = edges.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    joined = joined.select(
        "file", (F.col("number") == 0).alias("first"),
        F.array_join(F.transform("parts", lambda part: part["value"]), "").alias("value"),
    )
    return cut.filter("NOT edge").select("file", F.lit(False).alias("first"), "value").unionByName(joined)
