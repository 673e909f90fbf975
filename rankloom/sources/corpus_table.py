"""The stored corpus: keyed upserts as loads of a partitioned table, and table lifecycle."""

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sizing import fits
from ..workspace import materialize

#: partition columns of the stored corpus
LOAD = ("_load", "_key")


def with_generated_ids(batch: DataFrame) -> DataFrame:
    """Give rows without an id one derived from their content."""
    parts = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in batch.columns if c != "id"]
    return batch.withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("\u0001", *parts), 256)))


def latest_per_id(batch: DataFrame, seq: str) -> DataFrame:
    """The last write of each id.

    A partial maximum per task runs before the shuffle, so an id repeated in much of the
    batch costs one row per task.
    """
    row = F.struct(*[c for c in batch.columns if c not in ("id", seq)])
    last = batch.groupBy("id").agg(F.max_by(row, seq).alias("_row"), F.max(seq).alias(seq))
    return last.select("id", seq, "_row.*").select(*batch.columns)


def bulk_upsert(existing: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Existing rows overwritten and extended by the last write of each id in ``batch``."""
    last = latest_per_id(with_generated_ids(batch), seq).drop(seq)
    ids = last.select("id")
    ids = F.broadcast(ids) if fits(ids) else ids
    return existing.join(ids, "id", "left_anti").unionByName(last, allowMissingColumns=True)


def upsert_stats(batch: DataFrame) -> DataFrame:
    """Rows of a batch, distinct ids stored and rows that had to be given an id."""
    keyed = with_generated_ids(batch.withColumn("_no_id", F.col("id").isNull()))
    per_id = keyed.groupBy("id").agg(F.count("*").alias("n"), F.count_if("_no_id").alias("made"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("stored"),
        F.coalesce(F.sum("made"), F.lit(0)).alias("generated_ids"),
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All loads below ``path``, None when there are none."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _loads(stored: DataFrame | None) -> list:
    """The loads (number, key), oldest first; only the partition columns are read."""
    if stored is None:
        return []
    return sorted(tuple(r) for r in stored.select(*LOAD).distinct().collect())


def _write(rows: DataFrame, path: str, number: int, key: str) -> None:
    """Write one load as its own partition; the same load again replaces itself and nothing else."""
    (
        rows.withColumns({LOAD[0]: F.lit(number), LOAD[1]: F.lit(key)})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LOAD).parquet(path)
    )


def upsert_table(path: str, batch: DataFrame, seq: str = "seq", key: str = None) -> int:
    """Add ``batch`` to the stored corpus as one load and return its number.

    The corpus is a table partitioned by load, so only the batch is written.  A load with a ``key``
    that is already there is written over itself: repeated after a failure it leaves the rows that one
    complete run leaves.  Loads that run at the same time may share a number, then ``seq`` decides
    between them.  A batch without rows leaves nothing.
    """
    named = f"load-{uuid.uuid4().hex if key is None else hashlib.sha256(key.encode()).hexdigest()[:24]}"
    known = _loads(_stored(batch.sparkSession, path))
    number = next((n for n, k in known if k == named), max((n for n, _ in known), default=-1) + 1)
    _write(latest_per_id(with_generated_ids(batch), seq), path, number, named)
    return number


def read_corpus(spark: SparkSession, path: str, seq: str = "seq", by_time: bool = False) -> DataFrame:
    """The current rows: the base with all later loads applied; None when empty.

    The base is the last compaction, or else the first load.  For each id the last load wins and,
    inside a load, the greatest ``seq``.  With ``by_time`` the numbers in ``seq`` are times of events
    that hold across loads, and the greatest wins wherever it stands.  Changed ids are brought to the
    base scan when they are measured small, so reading does not shuffle the base.
    """
    stored = _stored(spark, path)
    loads = _loads(stored)
    if not loads:
        return None
    bases = [load for load in loads if load[1].startswith("base")]
    at = bases[-1] if bases else loads[0]
    is_base = (F.col(LOAD[0]) == at[0]) & (F.col(LOAD[1]) == at[1])
    base = stored.filter(is_base).drop(*LOAD)
    if loads[-1] == at:
        return base
    newer = stored.filter((F.col(LOAD[0]) >= at[0]) & ~is_base)
    order = F.struct(seq, *LOAD) if by_time else F.struct(LOAD[0], seq, LOAD[1])
    changed = latest_per_id(newer.withColumn("_order", order), "_order").drop("_order", *LOAD)
    changed = materialize(changed, "changed")

    def small(df):
        return F.broadcast(df) if fits(df) else df

    if by_time:
        heads = changed.select("id", F.col(seq).alias("_new_seq"))
        stale = base.select("id", seq).join(small(heads), "id").filter(F.col(seq) > F.col("_new_seq")).select("id")
        changed = changed.join(stale, "id", "left_anti")
    return base.join(small(changed.select("id")), "id", "left_anti").unionByName(changed, allowMissingColumns=True)


def compact(spark: SparkSession, path: str, seq: str = "seq", by_time: bool = False) -> int:
    """Write the current rows as a new base, from which on reads start; returns its number.

    Meant to run while nothing is loaded.  Earlier loads are no longer read and may be deleted.
    """
    loads = _loads(_stored(spark, path))
    number, key = loads[-1]
    if not key.startswith("base"):
        number += 1
        _write(materialize(read_corpus(spark, path, seq, by_time), "base"), path, number, f"base-{number}")
    return number


def create_corpus(docs: DataFrame, table: str, force_recreate: bool = False) -> bool:
    """Create a catalog table; an existing one is refused or, when forced, replaced."""
    spark = docs.sparkSession
    if spark.catalog.tableExists(table):
        if not force_recreate:
            return False
        # the old table stays until the new one is complete; ``docs`` may be read from it
        fresh = f"{table}_{uuid.uuid4().hex}"
        docs.write.mode("errorifexists").saveAsTable(fresh)
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
        return True
    docs.write.mode("errorifexists").saveAsTable(table)
    return True


def delete_corpus(spark: SparkSession, table: str) -> bool:
    """Drop a catalog table; False when it does not exist."""
    if not spark.catalog.tableExists(table):
        return False
    spark.sql(f"DROP TABLE {table}")
    return True
