"""Upserts from files that arrive over time."""

from pyspark.sql import DataFrame, SparkSession

from ..sources.corpus_table import upsert_table


def stream_upsert(
    spark: SparkSession, incoming: str, schema, table_path: str, checkpoint: str,
    seq: str = "seq", max_files: int = None, transform=None,
) -> None:
    """Apply all JSON-lines files not yet seen to the stored corpus, then stop.

    Each micro-batch becomes one load under the next free number, beside batch loads. It carries
    the stream's checkpoint and the batch id as its key, so a batch that is repeated after a
    failure replaces itself.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.json(incoming)

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_table(table_path, transform(batch) if transform else batch, seq, f"{checkpoint}#{batch_id}")

    query = (
        files.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
