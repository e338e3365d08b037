"""Tables that are computed once and kept in the shared folder, and joins with one row per key."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table with at most this many narrow key rows (tens of bytes each) is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_ROWS = 1_000_000
#: A key with more than this part of all rows is hot; so there are fewer hot keys than this number.
HOT_PARTS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or, where that is unset and Spark is local, a folder set here."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if known.isEmpty():
        if not conf and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = conf or os.path.join(tempfile.gettempdir(), f"cairn-{os.getpid()}")
        sc.setCheckpointDir(conf)
    return conf or known.get()


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later reads survive lost executors and don't recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As saved(), in Parquet: wide rows take less room, and later reads only take the columns that they need. Not for tables whose partitions count."""
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table or for files written by Spark."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of work_path()."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bounded(keys: DataFrame, limit: int | None = None) -> DataFrame:
    """keys with a broadcast hint if it was counted to hold at most limit rows; else as it is (a shuffle join follows).

    keys should be saved() or cheap: it is read once more to be counted, and at most limit + 1 rows are.
    """
    limit = MAX_BROADCAST_ROWS if limit is None else limit
    small = keys.limit(limit + 1).count() <= limit
    return F.broadcast(keys) if small else keys


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with groups: one row per key, with the number of its rows in the column n. how: inner or left.

    Few groups are broadcast. Of many, only those that hold more than a HOT_PARTS-th of all rows are: there are fewer than
    HOT_PARTS of them, and what is shuffled has no hot key left (for left: if keys without a group aren't hot). groups should
    be saved(); rows are read twice then. Null keys meet nothing.
    """
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    if count <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), keys, how)
    hot = F.col(n) > total / HOT_PARTS
    top = F.broadcast(groups.filter(hot))
    rest = rows.join(F.broadcast(groups.filter(hot).select(*keys)), keys, "left_anti").join(groups.filter(~hot), keys, how)
    return rows.join(top, keys).unionByName(rest)
