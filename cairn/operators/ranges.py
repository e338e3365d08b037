"""Tables kept as ranges of a unique string key: folders of Parquet files that are never changed, and a small list of them.

A range's rows are sorted by key, and its list entry has its smallest key, its number of rows and statistics. Small ranges
that a task wrote share its folder, so folders grow with tasks, not with ranges; a range is found in it by key and id. An update
rewrites only the ranges that hold a touched key; the others are carried over as they are, so a reader of the old list
goes on. Keys that a range doesn't hold yet belong to the last range whose smallest key is below them.
"""

from __future__ import annotations

import bisect
import functools
import json
import math
import operator
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.tables import bounded, stored

#: The key, and a row's place in the task that wrote its range.
KEY, POS = "key_", "pos_"
#: Rows of a range, about; ranges grow to twice as many before an update splits them.
ROWS = 500_000
#: Tasks that write ranges, at least, if there are so many; they have at most ROWS rows each, or a range.
TASKS = 64
#: Spans of keys, and ids of ranges, that a filter names.
MAX_SPANS, MAX_IDS = 64, 200


@dataclass
class Ranges:
    """A version of a table: its schema (key and place included) and its ranges in the order of their keys.

    A range: path, id, lo and hi (its keys), n, first (the place of its first row), of (rows in its folder), and statistics.
    """

    schema: str
    ranges: list[dict] = field(default_factory=list)

    def as_json(self) -> dict:
        return {"schema": self.schema, "ranges": self.ranges}

    @property
    def rows(self) -> int:
        return sum(r["n"] for r in self.ranges)

    def holding(self, keys: list[str]) -> list[dict]:
        """The ranges that may hold one of a few keys."""
        los = [r["lo"] for r in self.ranges]
        at = {max(0, bisect.bisect_right(los, k) - 1) for k in keys} if los else set()
        return [self.ranges[i] for i in sorted(at)]

    def touched(self, keys: DataFrame) -> list[dict]:
        """The ranges that hold a key of a table (key_), or where it would belong."""
        return [self.ranges[i] for i in sorted(self.belonging(keys))]

    def belonging(self, keys: DataFrame) -> dict[int, int]:
        """The number of rows of a table (key_) that belong to a range, by the range's number."""
        if not self.ranges:
            return {}
        place = _place([r["lo"] for r in self.ranges])
        return {r["o_"]: r["n"] for r in keys.select(place.alias("o_")).groupBy("o_").agg(F.count("*").alias("n")).collect()}  # a row a range

    def read(self, spark: SparkSession, ranges: list[dict] | None = None) -> DataFrame:
        """The rows of all or some ranges, with key_, pos_ and range_ (the range's id)."""
        ranges, schema = self.ranges if ranges is None else ranges, T.StructType.fromJson(json.loads(self.schema))
        if not ranges:
            return spark.createDataFrame([], schema)
        here: dict[str, int] = {}
        for r in ranges:
            here[r["path"]] = here.get(r["path"], 0) + r["n"]
        rows = spark.read.schema(schema).parquet(*here)
        if all(here[r["path"]] == r.get("of", r["n"]) for r in ranges):
            return rows
        # Others are in these folders, too, old ones among them. Spans of keys prune pages, ids tell the ranges.
        ids, spans, at = {r["id"] for r in ranges}, [], None
        for i, r in enumerate(self.ranges):
            if r["id"] in ids:
                spans = [*spans[:-1], (spans[-1][0], r["hi"])] if at == i - 1 else [*spans, (r["lo"], r["hi"])]
                at = i
        spans = spans if len(spans) <= MAX_SPANS else [(spans[0][0], spans[-1][1])]
        rows = rows.filter(functools.reduce(operator.or_, [F.col(KEY).between(lo, hi) for lo, hi in spans]))
        if len(ids) <= MAX_IDS:
            return rows.filter(F.col("range_").isin(*sorted(ids)))
        return rows.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(ids)], "range_ string")), "range_", "left_semi").select(schema.names)

    def numbered(self, spark: SparkSession, name: str, ranges: list[dict] | None = None) -> DataFrame:
        """read() with each row's 0-based place in the order of keys as the column name; no shuffle."""
        start, rows = 0, []
        for r in self.ranges:
            rows.append((r["id"], start - r["first"]))
            start += r["n"]
        starts = F.broadcast(spark.createDataFrame(rows, "range_ string, start_ long"))  # a row a range
        return self.read(spark, ranges).join(starts, "range_").withColumn(name, F.col("start_") + F.col(POS)).drop("start_", KEY, POS, "range_")


def _place(los: list[str]) -> Column:
    """The number of the range that a key belongs to."""
    if len(los) < 2:
        return F.lit(0)

    def at(keys: pd.Series) -> pd.Series:
        return pd.Series([max(0, bisect.bisect_right(los, k) - 1) for k in keys], dtype="int32")

    return F.pandas_udf(at, "int")(F.col(KEY))


def _write(spark: SparkSession, rows: DataFrame, path: str, per_range: int, stats: dict[str, str], limit: int | None = None, sizes: dict[int, int] | None = None) -> list[dict]:
    """Writes rows (with o_, the range they belong to) as ranges; gives their list. Of an o_ with more than limit rows
    (twice per_range) many ranges are made, by key; any other one stays whole, in one task. A task writes several ranges,
    if they are small. sizes: the rows of each o_, which else are counted. rows are read more than once."""
    limit = 2 * per_range if limit is None else limit
    if sizes is None:
        sizes = {r["o_"]: r["n"] for r in rows.groupBy("o_").agg(F.count("*").alias("n")).collect()}  # a row a range
    big = [o for o, n in sizes.items() if n > limit]
    small = sorted(o for o in sizes if sizes[o] <= limit)
    load = max(per_range, min(ROWS, sum(sizes.values()) // TASKS))  # rows of a task
    parts = []
    if small:
        of, n, task = [0] * (small[-1] + 1), 0, 0
        for o in small:  # neighbours share a task; none is dealt by a hash, as that gives some tasks several large ranges
            if n and n + sizes[o] > load:
                n, task = 0, task + 1
            n, of[o] = n + sizes[o], task
        number = F.get(F.split(F.lit(",".join(map(str, of))), ",").cast("array<int>"), F.col("o_"))
        parts.append((rows.filter(~F.col("o_").isin(big)) if big else rows).repartitionById(task + 1, number))
    if big:
        parts.append(rows.filter(F.col("o_").isin(big)).repartitionByRange(math.ceil(sum(sizes[o] for o in big) / load), "o_", KEY))
    out = []
    for dealt in parts:
        uid, task = uuid.uuid4().hex, F.spark_partition_id()
        # A task has one folder, r_; the order of its rows is that of its ranges.
        dealt = dealt.withColumn("r_", F.shiftleft(task.cast("long"), 32)).sortWithinPartitions("r_", "o_", KEY)
        dealt = dealt.withColumn(POS, F.monotonically_increasing_id() - F.shiftleft(task.cast("long"), 33))
        cut = F.floor(F.col(POS) / per_range) if big and load > per_range else F.lit(0)
        number = F.col("r_") + F.when(F.col("o_").isin(big), cut).otherwise(0)
        dealt = dealt.withColumn("range_", F.concat_ws("-", F.lit(uid), "o_", number)).drop("o_")
        # Pages hold about a range at most, so that a filter on keys skips the others.
        dealt.write.option("parquet.page.row.count.limit", max(100, min(20_000, per_range))).partitionBy("r_").parquet(f"{path}/{uid}")
        # The list is made of what was written, a row a range.
        found = spark.read.parquet(f"{path}/{uid}").groupBy("r_", "range_").agg(
            F.min(KEY).alias("lo"), F.max(KEY).alias("hi"), F.count("*").alias("n"), F.min(POS).alias("first"), *[F.expr(x).alias(c) for c, x in stats.items()]
        ).collect()
        of: dict[int, int] = {}
        for r in found:
            of[r["r_"]] = of.get(r["r_"], 0) + r["n"]
        out += [{"path": f"{path}/{uid}/r_={r['r_']}", "id": r["range_"], "of": of[r["r_"]], **{c: r[c] for c in ("lo", "hi", "n", "first", *stats)}} for r in found]
    return out


def _stored_schema(rows: DataFrame) -> str:
    fields = [*rows.drop("o_").schema.fields, T.StructField(POS, T.LongType()), T.StructField("range_", T.StringType())]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]).json()


def write_ranges(rows: DataFrame, path: str, per_range: int = ROWS, stats: dict[str, str] | None = None, kept: bool = False) -> Ranges:
    """A first version of rows, which have a unique, whole key_. kept: they are stored already, or cheap to compute again."""
    rows = rows if kept else stored(rows)
    found = _write(rows.sparkSession, rows.withColumn("o_", F.lit(0)), path, per_range, stats or {})
    return Ranges(_stored_schema(rows), sorted(found, key=lambda r: r["lo"]))


def held(old: Ranges, keys: DataFrame) -> DataFrame:
    """(key_, range_) of the keys (key_) that old has. Only old's keys are read."""
    return old.read(keys.sparkSession, old.touched(keys)).select(KEY, "range_").join(bounded(keys.select(KEY).distinct()), KEY, "left_semi")


def hits(found: DataFrame) -> dict[str, int]:
    """The number of rows of held() of each range, by its id."""
    return {r["range_"]: r["n"] for r in found.groupBy("range_").agg(F.count("*").alias("n")).collect()}  # a row a range


def read_held(old: Ranges, found: DataFrame, n: dict[str, int]) -> DataFrame:
    """old's rows with the keys of held(); n: their hits(). Ranges that are held as a whole are read without a join."""
    spark = found.sparkSession
    rows = old.read(spark, [r for r in old.ranges if n.get(r["id"]) == r["n"]])
    part = [r for r in old.ranges if 0 < n.get(r["id"], 0) < r["n"]]
    if part:
        some = found.join(F.broadcast(spark.createDataFrame([(r["id"],) for r in part], "range_ string")), "range_", "left_semi").select(KEY)
        rows = rows.unionByName(old.read(spark, part).join(bounded(some), KEY, "left_semi"))
    return rows


def update_ranges(old: Ranges, removed: DataFrame, added: DataFrame, path: str, per_range: int = ROWS, stats: dict[str, str] | None = None, gone: dict[str, int] | None = None) -> tuple[Ranges, list[dict]]:
    """(old without the keys (key_) of removed and with the rows of added, the old ranges that were rewritten).

    Keys of rows in added that old has already must be in removed. Both tables are read more than once: save them. gone: the
    number of removed keys that each range has, by its id, which else are looked up. Only ranges that lose some of their rows
    are joined with the removed keys; those that lose none or all aren't.
    """
    if not old.ranges:
        return write_ranges(added, path, per_range, stats, kept=True), []
    spark, los = added.sparkSession, [r["lo"] for r in old.ranges]
    gone = hits(held(old, removed)) if gone is None else gone
    more = old.belonging(added.select(KEY))
    sizes = {i: r["n"] - gone.get(r["id"], 0) + more.get(i, 0) for i, r in enumerate(old.ranges) if gone.get(r["id"]) or more.get(i)}
    stale = [old.ranges[i] for i in sizes]
    if not stale:
        return old, []
    whole, part = [r for r in stale if not gone.get(r["id"])], [r for r in stale if 0 < gone.get(r["id"], 0) < r["n"]]
    rows = added.withColumn("o_", _place(los))
    if whole or part:
        kept = old.read(spark, whole)
        if part:
            kept = kept.unionByName(old.read(spark, part).join(bounded(removed.select(KEY).distinct()), KEY, "left_anti"))
        of = spark.createDataFrame([(r["id"], i) for i, r in enumerate(old.ranges) if i in sizes], "range_ string, o_ int")  # a row a range
        rows = kept.join(F.broadcast(of), "range_").drop(POS, "range_").unionByName(rows)
    found = _write(spark, rows, path, per_range, stats or {}, sizes={i: n for i, n in sizes.items() if n})
    ids = {r["id"] for r in stale}
    same = [r for r in old.ranges if r["id"] not in ids]
    return Ranges(old.schema, sorted(same + found, key=lambda r: r["lo"])), stale


def merge_small(old: Ranges, spark: SparkSession, path: str, per_range: int = ROWS, stats: dict[str, str] | None = None) -> tuple[Ranges, list[dict]]:
    """(old with runs of neighbouring ranges packed into ranges of at most per_range rows, the ranges that went)."""
    bins, at, load = [], [], 0
    for r in old.ranges:
        if at and load + r["n"] > per_range:
            bins.append(at)
            at, load = [], 0
        at, load = [*at, r], load + r["n"]
    bins = [b for b in [*bins, at] if len(b) > 1]
    if not bins:
        return old, []
    los, gone = [b[0]["lo"] for b in bins], [r for b in bins for r in b]
    rows = old.read(spark, gone).drop(POS, "range_").withColumn("o_", _place(los))
    found = _write(spark, rows, path, per_range, stats or {}, limit=per_range)  # a bin has no more, so it stays whole
    ids = {r["id"] for r in gone}
    return Ranges(old.schema, sorted([r for r in old.ranges if r["id"] not in ids] + found, key=lambda r: r["lo"])), gone
