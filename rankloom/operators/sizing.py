"""Join strategy helpers: broadcast only what is measured to be small, split hot keys."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 128 << 20


def _width(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.coalesce(F.octet_length(F.array_join(col, ",", "")) + 24 * F.size(col), F.lit(16))
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(col), F.lit(0)) * 16 + 16
    return F.lit(8)


def _amount(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates for the rows and the approximate bytes of ``df``."""
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + _width(field)
    return F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure whether ``df`` stays within the row and byte bounds.

    Counting is a partial aggregate: every task adds up its own rows and sends one line,
    so the check moves nothing and is safe on a table of any size.
    """
    if max_rows <= 0:
        return False
    rows, size = df.agg(*_amount(df)).first()
    return rows <= max_rows and size <= max_bytes


def fitting_groups(
    df: DataFrame, key: str, most: int, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES,
) -> int:
    """The least power of two of hash groups of ``key`` that each stay within the bounds of ``fits``.

    ``most`` is the largest number of groups, a power of two; 0 if even so many are too large.  One line
    for each of them is sent, whatever the size of the table.
    """
    if max_rows <= 0:
        return 0
    counted = df.groupBy(hash_group(key, most).alias("group")).agg(*_amount(df)).collect()
    groups = 1
    while groups <= most:
        rows, size = [0] * groups, [0] * groups
        for group, own_rows, own_size in counted:
            rows[group % groups] += own_rows
            size[group % groups] += own_size
        if max(rows) <= max_rows and max(size) <= max_bytes:
            return groups
        groups *= 2
    return 0


def hash_group(key: str, groups: int) -> Column:
    """The hash group of a key, from 0 to ``groups - 1``."""
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a table read from very few files one partition per core.

    Meant for a plain scan.  Once the scan has at least as many splits as there are cores,
    which any large table has, the table is returned as it is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def in_parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows that are small but costly to process over all cores.

    Adaptive execution sizes partitions by bytes and would put such rows in few tasks.  A
    following aggregate or join on the same keys reuses the partitioning.
    """
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted, *keys)


def tasks_for(df: DataFrame, rows: Column, per_task: int) -> int:
    """Tasks for as many rows as the aggregate ``rows`` counts over ``df``, one per core at least.

    For joins that multiply rows: adaptive execution knows only the bytes that go in.
    """
    total = df.agg(rows).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-int(total) // per_task))


def hot_keys(df: DataFrame, keys: list, target_rows: int) -> DataFrame:
    """Keys with more than ``target_rows`` rows and the number of splits each needs.

    There can be at most ``rows / target_rows`` such keys, whatever the data.
    """
    return (
        df.groupBy(*keys).count()
        .filter(F.col("count") > target_rows)
        .select(*keys, F.ceil(F.col("count") / target_rows).cast("int").alias("_splits"))
    )




def salted_join(
    big: DataFrame, other: DataFrame, keys: list, spread_by: list,
    how: str = "inner", target_rows: int = 1_000_000, hot: DataFrame = None,
) -> DataFrame:
    """Equi-join that spreads every hot key of ``big`` over several tasks.

    Rows of a hot key get a salt from a hash of ``spread_by``; the matching rows of
    ``other`` are repeated once per salt.  Keys that are not hot are left alone, so
    only the few hot keys cost extra rows.  ``how`` may be inner, left, left_semi or left_anti.
    """
    hot = hot_keys(big, keys, target_rows) if hot is None else hot
    # the hot-key list is bounded by rows/target_rows; it is broadcast only if measured small
    small_hot = F.broadcast(hot) if fits(hot) else hot
    splits = F.coalesce(F.col("_splits"), F.lit(1))
    salted = (
        big.join(small_hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), splits).cast("int"))
        .drop("_splits")
    )
    repeated = (
        other.join(small_hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("_splits")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame, small: DataFrame, keys: list, spread_by: list, how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS, target_rows: int = 1_000_000,
) -> DataFrame:
    """Join ``big`` with a side that is usually small.

    Within the measured bound the small side is broadcast and ``big`` does not move.
    Beyond it the join shuffles on the keys with hot keys split.
    """
    if fits(small, max_rows):
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, spread_by, how, target_rows)
