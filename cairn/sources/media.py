"""Media folders: files by content hash, image or video by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.values import basename, file_occurrence_id, media_kind
from cairn.operators.catalog import LOCATION, as_items


def read_media_folder(spark: SparkSession, root: str, source_id: str, label: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """Items of the images and videos under root, at any depth, or of some paths there; the time is the file's."""
    read = spark.read.format("binaryFile")
    files = read.load(paths) if paths else read.option("recursiveFileLookup", True).load(root)
    files = files.withColumn("kind", media_kind(F.lit(""), F.col("path"))).filter("kind is not null")
    absolute = F.regexp_replace("path", "^file:/+", "/")
    rel = F.regexp_replace(F.replace(absolute, F.lit(root.removeprefix("file:").rstrip("/")), F.lit("")), "^/+", "")
    rows = files.select(F.sha2("content", 256).alias("media_id"), "kind", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("timestamp_ms"), absolute.alias("absolute_path"), rel.alias("relative_path"))
    known = {"id": file_occurrence_id(F.lit(source_id), F.col("relative_path")), "source_id": F.lit(source_id), "source_label": F.lit(label or source_id), "root_path": F.lit(root), **{c: F.col(c) for c in ("relative_path", "absolute_path", "timestamp_ms")}}
    place = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOCATION])
    return as_items(rows.withColumns({"location": place, "source_id": F.lit(source_id), "display_name": basename(F.col("relative_path"))}))
