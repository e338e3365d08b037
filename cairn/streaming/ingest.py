"""Streaming import: location files that arrive in a folder are appended to a catalog, batch by batch."""

from __future__ import annotations

import functools
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.catalog import Catalog
from cairn.sources.readers import file_format, read_gpx, read_records, read_timeline

#: Batches that hold fewer bytes wait for others, as a merge has tens of jobs, however little it merges.
MERGE_BYTES = 64 << 20

_READERS = {"gpx": read_gpx, "records": read_records, "timeline": read_timeline}


def stream_imports(spark: SparkSession, folder: str, catalog: Catalog, source_id: str, checkpoint: str, files_per_batch: int = 100, materialise: bool = True) -> StreamingQuery | ImportQuery:
    """Starts a query that imports what is in folder and ends; run again with the same checkpoint it imports what is new.

    A batch is committed with its number, so one that is tried again replaces what it wrote before and counts once. Batches
    are merged into the catalog together, when they hold as many bytes as all that was merged before, and MERGE_BYTES, so the
    work grows with the input, not with its square; awaitTermination() of what is returned merges the last ones. Until then, or after a
    stream that was stopped, assets ask for materialise(). To cancel, see cancel_stream().
    """
    row = catalog.source(source_id)
    generation = row["generation"] if row and row["active"] and row["generation"] else catalog.prepare_import(source_id)
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).schema("value string").load(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).withColumn("format", file_format(F.col("content")))
    # Batches of another checkpoint aren't repetitions: they get numbers of their own.
    run = zlib.crc32(checkpoint.encode()) << 32

    def commit(batch: DataFrame, number: int) -> None:
        there = {r["format"] for r in batch.select("format").collect()}  # a short name a file, files_per_batch of them
        known = [name for name in _READERS if name in there] or ["gpx"]  # planning a reader takes longer than reading a few files
        parts = [_READERS[name](batch.filter(F.col("format") == name), source_id) for name in known]
        items = functools.reduce(DataFrame.unionByName, parts)
        with catalog.transaction():
            catalog.append(items, generation, run + number, source_id)
            merged, waiting = catalog.merged_bytes()
            if materialise and waiting > max(merged, MERGE_BYTES):
                catalog.materialise()

    query = files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return ImportQuery(query, catalog) if materialise else query


class ImportQuery:
    """A streaming query whose awaitTermination() merges the batches that wait; else as the query."""

    def __init__(self, query: StreamingQuery, catalog: Catalog):
        self.query, self.catalog = query, catalog

    def __getattr__(self, name: str):
        return getattr(self.query, name)

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        done = self.query.awaitTermination(timeout)
        if done is not False and not self.catalog.up_to_date():
            self.catalog.materialise()
        return done


def cancel_stream(query: StreamingQuery, catalog: Catalog, source_id: str, commit: int) -> None:
    """Stops an import and takes back what it committed: the source is again as it was at the commit before it began."""
    query.stop()
    catalog.rollback(source_id, commit)
