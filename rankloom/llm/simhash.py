"""SimHash near-duplicates found through the anchors of a covering code.

Two 64-bit fingerprints with at most three differing bits differ in at most one bit of their lower
or of their upper 31-bit half.  On each half the anchors are the words of the perfect [31, 26]
Hamming code: every value lies within distance 1 (the covering radius) of exactly one anchor, its
home, and a value at distance 1 (the threshold on the half) from another lies within distance 2 of
the other's home.  Each fingerprint is therefore sent to every anchor within distance 2 of it, and
the members of an anchor are compared with those at home there.  No link is lost.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.operators.sizing import lookup_join, salted_join

from .components import components
from .shared import fits, frugal, materialize, slices, table, texts

HALF = (1 << 31) - 1
HALF_STARTS = (0, 33)
MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: distinct fingerprints of one anchor beyond which the anchor is dealt out by 16-bit pieces
HOT_ANCHOR = 20_000
PIECES = (0, 16, 32, 48)
#: copies of one fingerprint beyond which its rows are split over tasks
HOT_COPIES = 100_000
#: ids that are sent to the documents to drop them, eight bytes each; more are joined by shuffling
MAX_GONE = 8_000_000
_HASHES = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text over word shingles (A-Z folded, repeats count)."""
    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, _HASHES):
        end = min(count, start + _HASHES)
        parts = [words[start + k:end + k] for k in range(min(shingle, len(words)))]
        values = np.array([digest(b" ".join(p), SEED) for p in zip(*parts)], dtype=">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row. Null or blank texts have fingerprint 0."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch, found in slices(batches):
            values = pa.array([fingerprint(text, shingle) for text in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "fp"])

    return rows.mapInArrow(frugal(scan), f"doc_id {kind}, fp long")


def _syndrome(value: Column) -> Column:
    """Exclusive or of the positions (1 to 31) of the set bits; 0 for a word of the code."""
    total = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        total = total + (F.bit_count(value.bitwiseAND(F.lit(mask))) % 2) * (1 << k)
    return total.cast("int")


def _flip(value: str, position: str) -> str:
    return f"({value} ^ shiftleft(1L, {position} - 1))"


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, home, fp): each distinct fingerprint at all anchors within distance 2, on both halves.

    ``anchor`` holds the half in its top bits.
    """
    parts = []
    for half, start in enumerate(HALF_STARTS):
        value = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit(HALF))
        parts.append(fps.select("fp", value.alias("v"), F.lit(half).alias("half")))
    rows = parts[0].unionByName(parts[1]).withColumn("s", _syndrome(F.col("v")))
    home = f"IF(s = 0, v, {_flip('v', 'greatest(s, 1)')})"
    others = (
        "IF(s = 0, array(), transform(filter(sequence(1, 31), i -> i < (i ^ s)"
        f" AND i != s), i -> {_flip(_flip('v', 'i'), '(i ^ s)')}))"
    )
    near = rows.select("fp", "half", F.expr(f"posexplode(concat(array({home}), {others}))").alias("n", "at"))
    return near.select(
        F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(F.col("at")).alias("anchor"),
        (F.col("n") == 0).alias("home"), "fp",
    )


def _forest(homes: np.ndarray, members: np.ndarray, max_bits: int):
    """Links between members that join what the homes reach, one fewer than the nodes at most."""
    root = np.arange(len(members))
    place = {int(v): i for i, v in enumerate(members)}
    bits = members.view(np.uint64)  # counts of signed numbers would be those of their absolute values

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for value in homes:
        near = np.flatnonzero(np.bitwise_count(bits ^ value.view(np.uint64)) <= max_bits)
        top = find(place[int(value)])
        for i in near:
            other = find(i)
            if other != top:
                low, high = (top, other) if top < other else (other, top)
                root[high] = top = low
    found = np.array([find(i) for i in range(len(members))])
    moved = found != np.arange(len(members))
    return members[moved], members[found[moved]]


def _compare(max_bits: int):
    def compare(batches):
        """Members of one key follow each other; a key is handled once the next one begins."""
        held: list[np.ndarray] = []

        def groups(keys, subs, homes, fps):
            ends = np.flatnonzero((keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])) + 1
            starts = np.concatenate([[0], ends])
            ends = np.concatenate([ends, [len(keys)]])
            out_a, out_b = [], []
            for i in np.flatnonzero(ends - starts > 1):
                own = slice(starts[i], ends[i])
                members = fps[own]
                if not homes[own].any():
                    continue
                a, b = _forest(members[homes[own]], members, max_bits)
                out_a.append(a)
                out_b.append(b)
            if out_a:
                arrays = [pa.array(np.concatenate(x)) for x in (out_a, out_b)]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "sub", "home", "fp")]
            if not len(new[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from groups(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held:
            yield from groups(*held)

    return compare


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within ``max_bits``.

    Per anchor only links that join two parts are given, so a group of n fingerprints yields fewer
    than n of them. An anchor with over ``hot_anchor`` members is dealt out by (piece, value) of the
    four 16-bit pieces: fingerprints three bits apart agree in one piece, so this too loses nothing.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the anchors cover distances of 0 to 3 bits")
    near = anchored(fps)
    hot = near.groupBy("anchor").count().filter(F.col("count") > hot_anchor).select("anchor", F.lit(True).alias("hot"))
    hot = materialize(hot, "hot-anchors")
    pieces = F.array(*[
        F.lit((k + 1) << 16).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit(65535)).cast("int"))
        for k, start in enumerate(PIECES)
    ])
    near = near.join(F.broadcast(hot) if fits(hot) else hot, "anchor", "left").select(
        "anchor", "home", "fp", F.explode(F.when(F.col("hot"), pieces).otherwise(F.array(F.lit(0)))).alias("sub")
    )
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = near.repartition(width, "anchor", "sub").sortWithinPartitions("anchor", "sub", "fp")
    return grouped.mapInArrow(frugal(_compare(max_bits)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): every row with its fingerprint and the smallest doc_id it can reach.

    Copies meet in one fingerprint before anything is compared, so their number does not matter.
    Blank and null texts share fingerprint 0. A null doc_id is never a component's smallest id
    unless all ids of the component are null; repeated ids keep one row each. Further columns are
    ignored, an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    named = materialize(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(smallest, "component").select("fp", "component_id")
    return salted_join(fps, by_fp, ["fp"], ["doc_id"], target_rows=HOT_COPIES).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` without those whose component has a smaller doc_id.

    Rows with a null doc_id stay, because they cannot be told from one another.
    """
    gone = near_duplicates(docs, shingle, max_bits).filter("component_id < doc_id").select("doc_id").distinct()
    # ids only: within the measured bound they are sent to the rows, and no text moves
    return lookup_join(docs, materialize(gone, "gone"), ["doc_id"], ["doc_id"], "left_anti", max_rows=MAX_GONE)


def op5_simhash(spark, sf_dir):
    """Fingerprints and components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
