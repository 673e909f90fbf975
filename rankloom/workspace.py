"""Scratch tables that outlive an executor.

Intermediate results that several branches read are written once, as Parquet,
below the folder named by ``spark.checkpoint.dir``.  A written table survives
lost executors, cuts the lineage and gives the optimizer true sizes.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root = None


def root(spark: SparkSession) -> str:
    """Shared scratch folder of the session (a temporary one only in local mode)."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="rankloom-")
    return _local_root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder name below the scratch root that nobody has used yet."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader over the written files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whichever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop_path.getFileSystem(conf).exists(hadoop_path)
