"""Re-scans of known folders: only files that came or changed since the last scan are read.

A source's listing (path, size, mtime, hash) is kept in the catalog. A scan lists the folder without reading it, compares the
two listings by a full outer join, hashes what is new or has another size or time, and imports files whose content differs.
What was imported from files that changed or went no longer counts. All of it is one version of the catalog.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.cancel import Cancellable, Cancelled
from cairn.operators.catalog import Catalog
from cairn.operators.tables import saved
from cairn.sources.media import read_media_folder
from cairn.sources.readers import read_locations

#: Paths that go to a reader at once.
FILES_PER_BATCH = 10_000
#: Errors that a summary shows; it counts all of them.
ERRORS_SHOWN = 100

#: (spark, paths, source id, label, root) to (items, (path, error) of unfit files or None).
Reader = Callable[[SparkSession, list[str], str, str, str], tuple[DataFrame, DataFrame | None]]


def media_files(spark: SparkSession, paths: list[str], source_id: str, label: str, root: str) -> tuple[DataFrame, DataFrame | None]:
    return read_media_folder(spark, root, source_id, label, paths), None


def location_files(spark: SparkSession, paths: list[str], source_id: str, label: str, root: str) -> tuple[DataFrame, DataFrame | None]:
    return read_locations(spark, paths, source_id, label)


def _plain(path: Column) -> Column:
    """A path as locations name it, whichever reader found it."""
    return F.regexp_replace(path, "^file:/+", "/")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, url, size, mtime in ms) of all files under root, at any depth; contents aren't read. url is what readers take."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_plain(F.col("path")).alias("path"), F.col("path").alias("url"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, url, size, mtime, hash: the old one) of two listings; change: added, changed, removed or same."""
    was = old.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), "hash", F.lit(True).alias("was"))
    both = was.join(new.withColumn("is", F.lit(True)), "path", "full_outer")
    equal = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(equal, "same").otherwise("changed")
    return both.select("path", change.alias("change"), "url", "size", "mtime", "hash")


def _batches(urls: DataFrame) -> Iterator[list[str]]:
    """Paths for readers, characters of patterns escaped, FILES_PER_BATCH at a time."""
    part: list[str] = []
    for r in urls.select("url").orderBy("url").toLocalIterator():
        part.append(re.sub(r"([\[\]{}*?\\])", r"\\\1", r["url"]))
        if len(part) == FILES_PER_BATCH:
            yield part
            part = []
    if part:
        yield part


def _hashes(spark: SparkSession, urls: DataFrame) -> DataFrame:
    out = spark.createDataFrame([], "path string, now string")
    for part in _batches(urls):
        out = out.unionByName(spark.read.format("binaryFile").load(part).select(_plain(F.col("path")).alias("path"), F.sha2("content", 256).alias("now")))
    return out


def rescan(catalog: Catalog, source_id: str, reader: Reader = location_files, job: Cancellable | None = None) -> dict:
    """Brings a source up to date with its folder (root_path); gives a summary. A first scan imports all.

    scanned files; added, changed, removed and touched (a new time or size, the same content) ones; read: those imported;
    errors: (path, message) of unfit files, and n_errors. After an exception or a cancellation nothing counts.
    """
    spark = catalog.spark
    with catalog.transaction(job):
        source = catalog.source(source_id)
        if not source or not source["root_path"]:
            raise ValueError(f"{source_id} has no folder")
        generation = source["generation"] or catalog.prepare_import(source_id)
        files = saved(difference(catalog.listing(source_id), list_files(spark, source["root_path"])))
        todo = files.filter(F.col("change").isin("added", "changed"))
        known = saved(files.join(_hashes(spark, todo), "path", "left"))
        counts = {r["change"]: r["n"] for r in known.withColumn("change", F.when((F.col("change") == "changed") & (F.col("hash") == F.col("now")), "touched").otherwise(F.col("change"))).groupBy("change").agg(F.count("*").alias("n")).collect()}
        new = known.filter((F.col("change") == "added") | (F.col("change") == "changed") & ~F.col("hash").eqNullSafe(F.col("now")))
        old = known.filter((F.col("change") == "removed") | (F.col("change") == "changed") & ~F.col("hash").eqNullSafe(F.col("now")))
        out = {"scanned": sum(n for k, n in counts.items() if k != "removed"), **{k: counts.get(k, 0) for k in ("added", "changed", "removed", "touched")}, "read": 0, "n_errors": 0, "errors": []}
        if out["changed"] + out["removed"]:
            catalog.forget_files(source_id, old.select("path"))
        for part in _batches(new):
            if job:
                job.check()
            items, errors = reader(spark, part, source_id, source["label"], source["root_path"])
            place = F.col("location")
            items = items.withColumn("location", place.withField("root_path", F.lit(source["root_path"])).withField("absolute_path", _plain(F.try_url_decode(F.replace(place["absolute_path"], F.lit("+"), F.lit("%2B"))))))
            catalog.append(items, generation, None, source_id)
            out["read"] += len(part)
            if errors is not None:
                out["n_errors"] += errors.count()
                out["errors"] += [tuple(r) for r in errors.limit(max(0, ERRORS_SHOWN - len(out["errors"]))).collect()]
        if out["added"] + out["changed"] + out["removed"] + out["touched"]:
            catalog.put_listing(source_id, known.filter("change <> 'removed'").withColumn("hash", F.coalesce("now", "hash")))
    return out


def rescan_all(catalog: Catalog, reader_of: Callable[[str], Reader] = lambda source_id: location_files, job: Cancellable | None = None) -> dict:
    """Re-scans every active source that has a folder, in the order of their folders; one that fails is an error, and the rest go on.

    Gives the sums of the summaries, and cancelled; each source is a version of its own, so what was done before a cancellation stays.
    """
    out = {"scanned": 0, "added": 0, "changed": 0, "removed": 0, "touched": 0, "read": 0, "n_errors": 0, "errors": [], "cancelled": False}
    roots = catalog.sources().filter("active and root_path is not null").orderBy("root_path", "source_id").collect()
    for source in roots:
        try:
            own = rescan(catalog, source["source_id"], reader_of(source["source_id"]), job)
        except Exception as e:
            if isinstance(e, Cancelled) or job and job.cancelled:
                out["cancelled"] = True
                break
            own = {"n_errors": 1, "errors": [(source["root_path"], "the folder isn't there" if "PATH_NOT_FOUND" in str(e) else str(e))]}
        for k, v in own.items():
            out[k] = out[k] + v
    return out
