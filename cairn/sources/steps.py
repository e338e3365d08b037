"""Imports of large records files in steps, each of a number of locations: an import can be paused after any step and resumed.

How far each file was read is committed together with what was read, so a step that fails or is cancelled has no effect and
is done again, and none is done twice. A step reads the files again up to its end, as splits of Spark, but takes apart only
its own locations; so steps should be few and large.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.operators.cancel import Cancellable
from cairn.operators.catalog import Catalog
from cairn.operators.tables import saved
from cairn.sources.readers import record_items, record_texts


class Unfinished(ValueError):
    """Files end before their list of locations does, or have none."""


def import_step(catalog: Catalog, paths: str | list[str], source_id: str, entries: int = 10_000_000, job: Cancellable | None = None) -> bool:
    """Imports the next entries locations of each records file into the source's generation; True if there is more to import.

    When files are at their end and one's list of locations isn't closed, Unfinished is raised; what stood before is imported
    all the same. A file that has another size than at an earlier step raises ValueError.
    """
    spark = catalog.spark
    with catalog.transaction(job):
        source = catalog.source(source_id)
        generation = source["generation"] if source and source["generation"] else catalog.prepare_import(source_id)
        label, done = catalog.source(source_id)["label"], catalog.progress(source_id)
        texts, files = record_texts(spark, paths)
        found = {r["path"]: r for r in files.collect()}  # a row a file
        changed = [p for p, r in found.items() if p in done and done[p][1] != r["bytes"]]
        if changed:
            raise ValueError(f"changed since the last step: {', '.join(sorted(changed))}")
        ahead = {p: (done.get(p, [0])[0], r["n"]) for p, r in found.items() if done.get(p, [-1])[0] < r["n"]}
        if ahead:
            steps = spark.createDataFrame([(p, a, a + entries) for p, (a, _) in ahead.items()], "path string, after_ long, until_ long")
            own = texts.join(F.broadcast(steps), "path").filter((F.col("index") > F.col("after_")) & (F.col("index") <= F.col("until_")))
            catalog.append(record_items(saved(own.select("path", "index", "text")), source_id, label), generation, None, source_id)
        done |= {p: [min(a + entries, n), found[p]["bytes"]] for p, (a, n) in ahead.items()}
        done |= {p: [0, r["bytes"]] for p, r in found.items() if p not in done}
        catalog.put_progress(source_id, done)
        more = any(done[p][0] < r["n"] for p, r in found.items())
    if not more and (cut := sorted(p for p, r in found.items() if not r["closed"])):
        raise Unfinished(f"the list of locations isn't there or isn't closed: {', '.join(cut)}")
    return more


def import_in_steps(catalog: Catalog, paths: str | list[str], source_id: str, entries: int = 10_000_000, job: Cancellable | None = None) -> int:
    """All steps that are left; gives their number."""
    n = 1
    while import_step(catalog, paths, source_id, entries, job):
        n += 1
    return n
