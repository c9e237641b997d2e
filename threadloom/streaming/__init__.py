"""Exports as they arrive: each micro-batch of new files is one run of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..archive import Archive


def watch(spark: SparkSession, folder: str, archive: Archive, checkpoint: str, available_now: bool = True):
    """Starts a query that ingests files as they come to `folder`.

    The query's id, which its checkpoint keeps, and the batch's number are the run's id: a batch that is replayed
    after a failure is skipped, and one of another query is not. A late, older snapshot never replaces a newer one, so no watermark is needed. Only paths are collected, a batch's files.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").load(folder).select("path")

    def ingest(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"].removeprefix("file:") for r in batch.collect())
        sources = [{"kind": "json_file", "path": p, "member": None, "origin": folder} for p in paths]
        if sources:
            query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
            result = archive.ingest(sources, f"batch-{query}-{number:08d}")
            if result["status"] == "failed":
                raise RuntimeError(f"batch {number} was not ingested: {result['errors'][:3]}")

    writer = files.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
