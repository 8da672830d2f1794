"""New documents as a stream: annotate each batch, append it, remember what has been done by the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave.sources.corpus import annotate


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, annotator: Callable[[DataFrame], DataFrame] = annotate, kind: str = "parquet"):
    """Starts a query that annotates all files that are there and stops; run again, it takes only new files.
    A batch that is repeated after a failure replaces its own folder, so its rows are not doubled."""
    stream = spark.readStream.schema(schema).format(kind).load(source)

    def batch(rows: DataFrame, number: int) -> None:
        annotator(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
