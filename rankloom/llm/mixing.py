"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r, the expected number of its copies.  Among all rates that meet the token
constraints sum(size * r) = target of each source, those nearest to keeping every token once (least
relative entropy, measured in tokens) are exponential tilts r = exp(lambda * c) of the constraints.
Newton steps on the convex dual sum(size * exp(lambda * c)) - lambda * target find lambda: every step is
an aggregate over the token counts of cells (documents with the same constraints), so documents are
scanned once.  Rates are then rounded into whole copies: all documents get the whole part, and along a
fixed pseudo-random order those up to the threshold that uses up the fractional part get one more.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import fits, materialize, table

MAX_COPIES = 3
TOLERANCE = 1e-12
MAX_STEPS = 60
_WORD = "[^\\x20\\x09-\\x0D]+"
_BINS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, order, bin): words of every row and its place in the pseudo-random order."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")).cast("binary"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), order.alias("order"))


def weigh(sources: DataFrame, cycle: tuple = (1, 2, 3)) -> DataFrame:
    """Add ``weight``: the sources by code point, null last, weigh the numbers of ``cycle`` in turn."""
    # one row for each source; strings compare by their UTF-8 bytes, which is code point order
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w).cast("long") for w in cycle])
    return sources.withColumn("weight", F.element_at(weights, (place % len(cycle) + 1).cast("int")))


def share_out(sources: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add ``target``: all tokens shared by weight, none above ``max_copies`` times its source's size.

    Sources are filled in the order in which they reach their limit while the common level rises; the
    level is the tokens left over the weights left of the first source that does not reach it.
    """
    limit = F.col("source_size") * max_copies
    order = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    filled = sources.select(
        "source", "source_size", "weight", limit.alias("cap"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"),
        F.row_number().over(order).alias("turn"),
    )
    below = F.col("cap") * F.col("weights") > F.col("left") * F.col("weight")
    first = F.min(F.when(below, F.struct("turn", "left", "weights"))).over(everything)
    open_ = filled.withColumn("first", first)
    level = F.col("weight") * F.col("first.left") / F.col("first.weights")
    target = F.when(F.col("first").isNull() | (F.col("turn") < F.col("first.turn")), F.col("cap").cast("double")).otherwise(level)
    return open_.select("source", "source_size", "weight", target.alias("target"))


def solve(cells: DataFrame, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
    """Add ``rate`` = exp(lambda) to (cell, source_size, target) by Newton steps on the dual.

    A cell's gradient is tokens * exp(lambda) - target and its curvature tokens * exp(lambda); cells of
    different sources share no constraint, so the Hessian is diagonal. A step down is held to 1, which
    keeps the iteration from leaving the region where it converges. A cell without tokens, or with
    target 0, has rate 0. Only the largest relative residual reaches the driver.
    """
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    state = materialize(cells.withColumn("lambda", F.lit(0.0)), "dual")
    for _ in range(max_steps):
        tilted = F.col("source_size") * F.exp("lambda")
        worst = state.filter(live).agg(F.max(F.abs(tilted - F.col("target")) / F.col("target"))).first()[0]
        if worst is None or worst <= tolerance:
            break
        step = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("target") - tilted) / tilted))
        state = materialize(state.withColumn("lambda", F.when(live, F.col("lambda") + step).otherwise(F.lit(0.0))), "dual")
    else:
        raise RuntimeError(f"the dual did not settle in {max_steps} steps")
    return state.withColumn("rate", F.when(live, F.exp("lambda")).otherwise(F.lit(0.0))).drop("lambda")


def _copies(rows: DataFrame, rates: DataFrame, max_copies: int) -> DataFrame:
    """Whole copies of each document, and one more up to the threshold in the source's order.

    The order is cut into bins by its first digits. Bins are summed before anything meets; whole bins are
    decided by the running sums over bins, and only the bin that holds the threshold is ordered row by row.
    """
    bin_ = F.conv(F.substring("order", 1, 3), 16, 10).cast("int")
    rows = rows.withColumn("bin", bin_)
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("tokens"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sums.select(
        "source", "bin", "tokens", F.coalesce(F.sum("tokens").over(running), F.lit(0)).alias("before")
    )
    whole = F.floor(F.col("rate") + 1e-9)
    extra = F.greatest(F.lit(0.0), (F.col("rate") - whole) * F.col("source_size"))
    same = bins["source"].eqNullSafe(rates["source"])
    cut = bins.join(F.broadcast(rates) if fits(rates) else rates, same).select(
        bins["source"].alias("_source"), F.col("bin").alias("_bin"), "source_size", "target", "rate",
        whole.cast("long").alias("whole"), "before", extra.alias("extra"),
        F.when(F.col("before") + F.col("tokens") <= F.col("extra"), 1).when(F.col("before") >= F.col("extra"), 0).alias("more"),
    )
    cut = materialize(cut, "bins")
    on = rows["source"].eqNullSafe(F.col("_source")) & (rows["bin"] == F.col("_bin"))
    known = rows.join(F.broadcast(cut) if fits(cut, max_rows=200_000) else cut, on)
    settled = known.filter("more IS NOT NULL").withColumn("more", F.col("more").cast("int"))
    # the documents of one bin of a source: a 4096th of it
    within = Window.partitionBy("_source", "_bin").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.col("before") + F.sum("size").over(within) - F.col("size") / 2
    border = known.filter("more IS NULL").withColumn("more", (reach <= F.col("extra")).cast("int"))
    return settled.unionByName(border).withColumn("copies", F.least(F.col("whole") + F.col("more"), F.lit(max_copies)))


def mix(docs: DataFrame, cycle: tuple = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row.

    ``taken`` is size times copies. Null texts and texts without words have size 0 and take nothing;
    a null source is a source of its own, listed last. Equal ids keep their rows and are ordered by
    size. The result depends on ids, sources and sizes only, so reruns agree. An empty table gives an
    empty result.
    """
    rows = materialize(sized(docs), "sized")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = solve(share_out(weigh(sources, cycle), max_copies))
    return _copies(rows, rates, max_copies).select(
        "doc_id", "source", "size", "source_size", "target", "rate", F.col("copies").cast("long").alias("copies"),
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def take(docs: DataFrame, cycle: tuple = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with ``copies`` and the figures of ``mix``; rows it does not take go.

    Rows that agree in id, source and size get the greatest number of copies of any of them.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    mixed = mix(docs, cycle, max_copies).groupBy("doc_id", "source", "size").agg(
        F.max("copies").alias("copies"), F.max("taken").alias("taken"),
        F.max("source_size").alias("source_size"), F.max("target").alias("target"),
    ).filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies", "taken", "source_size", "target")
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select(*own).withColumn("size", size)
    same = (
        rows["doc_id"].eqNullSafe(mixed["_id"]) & rows["source"].eqNullSafe(mixed["_source"])
        & (rows["size"] == mixed["_size"])
    )
    return rows.join(mixed, same).drop("_id", "_source", "_size")


def op2_mixing(spark, sf_dir):
    """Copies of all documents for weights 1, 2, 3 in turn."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix') AS ord
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS remaining,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights,
         row_number() OVER (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST) AS turn
  FROM sources
  WINDOW before AS (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT turn, remaining, weights FROM filled WHERE cap * weights > remaining * weight ORDER BY turn LIMIT 1
), targets AS (
  SELECT f.source, f.source_size,
         CASE WHEN l.turn IS NULL OR f.turn < l.turn THEN CAST(f.cap AS DOUBLE)
              ELSE CAST(f.weight * l.remaining AS DOUBLE) / CAST(l.weights AS DOUBLE) END AS target
  FROM filled f LEFT JOIN level l ON true
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
), placed AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, floor(r.rate + 1e-9) AS whole,
         greatest(0.0, (r.rate - floor(r.rate + 1e-9)) * r.source_size) AS extra,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, whole + CASE WHEN upto - size / 2 <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
