"""Readers and writers for documents in files."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import FORUM_POSTS
from ..workspace import path_exists
from . import splits


def load_json(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Raw records as one VARIANT column ``v``; a record that is no JSON has a null ``v``.

    ``lines`` reads one record per line and splits large files over tasks; blank lines are no
    records.  ``array`` reads files that each hold one JSON array, which are split over tasks as
    well.  A missing path gives an empty table.
    """
    if not path_exists(spark, path):
        return spark.range(0).select(F.parse_json(F.lit("null")).alias("v"))
    if layout == "lines":
        return spark.read.text(path).filter(F.btrim("value") != "").select(F.try_parse_json("value").alias("v"))
    blank = F.lit(" \t\r\n")
    parts = splits.records(spark, path, splits.OBJECTS).select("first", F.btrim("value", blank).alias("value"))
    # a part is what stands between the ends of two elements: a comma, then mostly one element
    is_array = F.startswith("value", F.lit("["))
    own = F.when(F.col("first") & is_array, F.substr("value", F.lit(2))).when(
        ~F.col("first"), F.regexp_replace("value", r"^,", "")
    )
    inner = parts.withColumn("inner", own)
    rest = F.btrim(F.regexp_replace("inner", r"\]$", ""), blank)
    closing = ~F.endswith("inner", F.lit("}"))
    listed = inner.withColumn("inner", F.when(closing, rest).otherwise(F.col("inner")))
    raw = listed.filter("value <> '' AND (inner IS NULL OR inner <> '')").select(
        F.try_parse_json(F.when(F.col("inner").isNull(), F.col("value")).otherwise(F.concat(F.lit("["), "inner", F.lit("]")))).alias("v")
    )
    return unnest_arrays(raw.filter("v IS NOT NULL")).unionByName(raw.filter("v IS NULL"))


def unnest_arrays(raw: DataFrame) -> DataFrame:
    """One row per element of records that are JSON arrays."""
    return raw.sparkSession.sql(
        "SELECT e.value AS v FROM {raw}, LATERAL variant_explode(v) AS e", raw=raw
    )


def load_csv(spark: SparkSession, path: str, schema=FORUM_POSTS, sep: str = ";") -> DataFrame:
    """Delimited text with a header line and an explicit schema.

    Quoted values may hold line breaks and separators.  Large files are split over tasks at line ends
    outside quotes; quotes are doubled inside quoted values and open only at their start.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    rows = splits.records(spark, path, splits.LINES).filter("NOT first").select(F.regexp_replace("value", "\r?\n$", "").alias("value"))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    parsed = rows.filter(F.btrim("value") != "").select(F.from_csv("value", kind.toDDL(), options).alias("row"))
    return parsed.select("row.*")


def load_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One or several Parquet shards."""
    return spark.read.parquet(*paths)


def url_table(*lists: DataFrame) -> DataFrame:
    """Stack URL lists into one ``url`` column."""
    out = lists[0].select("url")
    for urls in lists[1:]:
        out = out.unionByName(urls.select("url"))
    return out


def write_json(df: DataFrame, path: str) -> None:
    """Append records as JSON lines; unlike appended arrays, the result stays readable."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)
