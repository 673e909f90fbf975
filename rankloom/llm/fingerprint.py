"""One-permutation MinHash fingerprints of documents, in column functions only.

Every shingle of five words is hashed once.  The first seven bits of the hash choose one of 128 bins,
which keeps its smallest hash.  An empty bin takes over the value of the first filled bin in an
order of all bins that is its own (optimal densification), so two texts agree in a bin with a
probability that is their likeness.  Of each bin the low eight bits are stored: 256 hex digits a text.
Unequal values agree in eight bits once in 256 times, which the likeness is corrected for.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.text import bind

from .shared import spread, table

SHINGLE = 5
BINS = 128
VALUES = 256  # of the eight bits kept of a bin
#: steps of a walk taken one after the other before the rest of it is looked at as a whole
TRIES = 8
EMPTY = ""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "\t\n\x0b\x0c\r"


def walk(bin_: Column) -> Column:
    """The walk of an empty bin through all bins, as one number of 16 bits of a multiplicative hash.

    Bin ``start + turn * step`` modulo 128 comes in ``turn`` 0 to 127, where start is the lower and
    step the upper byte.  The upper byte is made odd, so the walk meets every bin once.
    """
    mixed = F.shiftright(bin_.cast("long") * F.lit(2654435761), 16).cast("int")
    return mixed.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(0x100))


def words(text: Column) -> Column:
    """Words of a text: A-Z folded, cut at blanks; null gives none."""
    plain = F.translate(text, _UPPER + _BLANKS, _UPPER.lower() + " " * len(_BLANKS))
    return F.filter(F.split(F.coalesce(plain, F.lit("")), " "), lambda word: word != "")


def shingle_hashes(found: Column, shingle: int = SHINGLE) -> Column:
    """MD5 of each run of ``shingle`` words joined by blanks; fewer words are one shorter run."""
    def runs(own):
        starts = F.sequence(F.lit(0), F.greatest(F.size(own) - shingle, F.lit(0)))
        return F.transform(
            starts, lambda i: F.md5(F.concat_ws(" ", *[F.get(own, i + k) for k in range(shingle)]).cast("binary"))
        )

    return bind(found, lambda own: F.when(F.size(own) > 0, runs(own)).otherwise(F.array().cast("array<string>")))


def _least(hashes: Column) -> Column:
    """The smallest hash for each two leading digits: after sorting, the first of each run."""
    def firsts(ordered):
        return F.filter(
            ordered,
            lambda x, i: (i == 0) | (F.substring(x, 1, 2) != F.substring(F.get(ordered, i - 1), 1, 2)),
        )

    return bind(F.sort_array(hashes), firsts)


def _dense(least: Column) -> Column:
    """The last two hex digits of every bin, empty bins filled."""
    def spaced(pairs):
        def value(pair, i):
            after = F.coalesce(F.get(pairs, i + 1)["bin"], F.lit(BINS))
            return F.concat(F.array(pair["low"]), F.array_repeat(F.lit(None).cast("string"), after - pair["bin"] - 1))

        leading = F.array_repeat(F.lit(None).cast("string"), F.get(pairs, F.lit(0))["bin"])
        return F.concat(leading, F.flatten(F.transform(pairs, value)))

    def densified(pairs, bins):
        low = F.lit(BINS - 1)

        def found(own):
            step = F.shiftright(own, 8)

            def turns(back):
                return F.transform(pairs, lambda p: F.struct(
                    ((p["bin"] - own) * back).bitwiseAND(low).alias("turn"), p["low"].alias("low"),
                ))

            # Newton steps for the inverse of the step: right in 3, 6 and then 12 bits
            near = (step * (2 - step * step)).bitwiseAND(low)
            back = (near * (2 - step * near)).bitwiseAND(low)
            tried = [F.get(bins, (own + step * n).bitwiseAND(low)) for n in range(TRIES)]
            return F.coalesce(*tried, F.array_min(bind(back, turns))["low"])

        return F.transform(bins, lambda value, i: F.when(value.isNotNull(), value).otherwise(bind(walk(i), found)))

    # two runs of leading digits make a bin, the first of them has the smaller hashes
    digits = F.transform(least, lambda x: F.struct(
        F.shiftright(F.conv(F.substring(x, 1, 2), 16, 10).cast("int"), 1).alias("bin"), F.substring(x, 31, 2).alias("low"),
    ))
    pairs = bind(digits, lambda all_: F.filter(all_, lambda p, i: (i == 0) | (p["bin"] != F.get(all_, i - 1)["bin"])))
    return bind(pairs, lambda own: bind(spaced(own), lambda bins: densified(own, bins)))


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column: two hex digits a bin.

    Texts without a word, null among them, have the empty fingerprint.
    """
    least = _least(shingle_hashes(words(text), shingle))
    return bind(least, lambda own: F.when(F.size(own) > 0, F.array_join(_dense(own), "")).otherwise(F.lit(EMPTY)))


def likeness(one: Column, other: Column) -> Column:
    """Estimated share of common shingles of two texts, from their fingerprints.

    With ``m`` equal bins of 128 it is (m / 128 - 1 / 256) / (1 - 1 / 256), at least 0.  Two empty
    fingerprints are alike, an empty and another one are not.
    """
    def equal(pair):
        same = F.filter(
            F.sequence(F.lit(1), F.lit(BINS)),
            lambda at: F.substring(pair["a"], at, F.lit(1)) == F.substring(pair["b"], at, F.lit(1)),
        )
        return F.greatest(VALUES * F.size(same) - BINS, F.lit(0)) / F.lit(float(BINS * (VALUES - 1)))

    one, other = (F.coalesce(x, F.lit(EMPTY)) for x in (one, other))
    pair = F.struct(F.unhex(one).alias("a"), F.unhex(other).alias("b"))
    return (
        F.when(one == other, F.lit(1.0)).when((one == EMPTY) | (other == EMPTY), F.lit(0.0))
        .otherwise(bind(pair, equal))
    )


def _literal(key, kind) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind.fields)])


def _range_of(key: Column, firsts: list, kind) -> Column:
    """Number of the last of the sorted ``firsts`` that is not above ``key``; two levels, so few are compared."""
    step = max(1, math.isqrt(len(firsts)))
    own = [_literal(f, kind) for f in firsts]
    groups = F.array(*[F.array(*own[i:i + step]) for i in range(0, len(own), step)])
    heads = F.array(*own[::step])

    def below(bounds):
        return F.greatest(F.size(F.filter(bounds, lambda b: b <= key)) - 1, F.lit(0))

    return bind(below(heads), lambda g: g * step + below(F.get(groups, g)))


def followed(docs: DataFrame, columns: dict) -> DataFrame:
    """(doc_id, text, <columns>, next_text, next_<columns>): every row beside the one that follows it by doc_id.

    The last row is followed by the first.  Null ids come first, rows with one id are ordered by a
    digest of their text; rows that agree in both are dealt out by their place in the table, so no
    group of them meets in one task.  ``columns`` are computed from doc_id and text before rows move.
    ``docs`` must be a stored table, because it is scanned twice: for the bounds of one range a
    shuffle partition, which are as many keys as there are partitions, and for the rows.  The first
    row of a range is sent to the range before it too; nothing else moves twice.
    """
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("place"))
    keyed = docs.select("doc_id", text.alias("text"), key.alias("_key"))
    kind = keyed.schema["_key"].dataType
    parts = keyed.select("_key").repartitionByRange(ranges, "_key").groupBy(F.spark_partition_id().alias("p"))
    firsts = [r[1] for r in parts.agg(F.min("_key")).collect()]
    # nulls first, as Spark orders them
    firsts.sort(key=lambda k: (k[0] is not None, 0 if k[0] is None else k[0], k[1], k[2]))
    rows = spread(keyed, "_key").withColumns(columns)
    if not firsts:
        return rows.drop("_key").select("*", *[F.col(c).alias(f"next_{c}") for c in ("text", *columns)])
    rows = rows.withColumn("_range", _range_of(F.col("_key"), firsts, kind))
    opening = F.col("_key") == F.get(F.array(*[_literal(f, kind) for f in firsts]), F.col("_range"))
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(firsts))).alias("r"), F.lit(True).alias("guest"))
    sent = rows.withColumn("_to", F.explode(F.when(opening, F.array(own, before)).otherwise(F.array(own))))
    sent = sent.withColumns({"_range": F.col("_to.r"), "_guest": F.col("_to.guest")}).drop("_to")
    in_order = Window.partitionBy("_range").orderBy("_guest", "_key")
    following = {f"next_{c}": F.lead(c).over(in_order) for c in ("text", *columns)}
    return (
        sent.repartitionById(len(firsts), F.col("_range")).withColumns(following)
        .filter(~F.col("_guest")).drop("_key", "_range", "_guest")
    )


def op12_fingerprint(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, whose last half is that of the next document."""
    rows = followed(table(spark, sf_dir, "documents"), {"fingerprint": fingerprint(F.col("text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    edited = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited", F.concat(kept, F.substring("next_text", F.lit(1), half))
    )
    marked = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return marked.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


_SAME = "lambda i: fingerprint[2 * i + 1:2 * i + 2] = {0}[2 * i + 1:2 * i + 2]"
_NEAR = f"""CAST(CASE WHEN fingerprint = {{0}} THEN 1.0 WHEN fingerprint = '' OR {{0}} = '' THEN 0.0
            ELSE greatest(256 * len(list_filter(range(0, 128), {_SAME})) - 128, 0) / CAST(32640 AS DOUBLE) END AS DOUBLE)"""

ORACLE = f"""
WITH sorted AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents
), paired AS (
  SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first(doc_id) OVER (ORDER BY doc_id)) AS next_id,
         coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS next_text
  FROM sorted
), edited AS (
  SELECT *, substring(text, 1, n_chars - n_chars // 2) || substring(next_text, 1, n_chars // 2) AS edited FROM paired
), worded AS (
  SELECT doc_id, kind, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM (SELECT doc_id, 'own' AS kind, text FROM edited UNION ALL SELECT doc_id, 'edited', edited FROM edited)
), hashed AS (
  SELECT doc_id, kind, md5(array_to_string(words[i + 1:i + 5], ' ')) AS h
  FROM (SELECT doc_id, kind, words, unnest(range(0, greatest(len(words) - 5, 0) + 1)) AS i FROM worded WHERE len(words) > 0)
), filled AS (
  SELECT doc_id, kind, bin, substring(min(h), 31, 2) AS low
  FROM (SELECT *, CAST('0x' || substring(h, 1, 2) AS INTEGER) // 2 AS bin FROM hashed) GROUP BY doc_id, kind, bin
), bins AS (
  SELECT i AS bin, turn, (((i * 2654435761) >> 16) + turn * (((i * 2654435761) >> 24) | 1)) & 127 AS other
  FROM range(128) a(i), range(128) b(turn)
  UNION ALL SELECT i, -1, i FROM range(128) a(i)
), complete AS (
  SELECT doc_id, kind, b.bin, arg_min(low, turn) AS low
  FROM filled f JOIN bins b ON f.bin = b.other GROUP BY doc_id, kind, b.bin
), printed AS (
  SELECT doc_id, kind, string_agg(low, '' ORDER BY bin) AS fingerprint FROM complete GROUP BY doc_id, kind
), compared AS (
  SELECT e.doc_id, e.next_id, e.n_chars, sha256(e.edited) AS edited_sha256,
         coalesce(o.fingerprint, '') AS fingerprint, coalesce(d.fingerprint, '') AS edited_fingerprint,
         coalesce(n.fingerprint, '') AS next_fingerprint
  FROM edited e LEFT JOIN printed o ON o.doc_id = e.doc_id AND o.kind = 'own'
       LEFT JOIN printed d ON d.doc_id = e.doc_id AND d.kind = 'edited'
       LEFT JOIN printed n ON n.doc_id = e.next_id AND n.kind = 'own'
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {_NEAR.format("edited_fingerprint")} AS near_edited,
       {_NEAR.format("next_fingerprint")} AS near_next
FROM compared
"""
