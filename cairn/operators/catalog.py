"""The catalog: occurrences from imports, their live generation, and assets merged from them by content hash."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.geo import to_e7
from cairn.functions.values import MEDIA_KINDS, basename, ms_to_sec
from cairn.operators.cancel import Cancellable
from cairn.operators.groups import group_points, group_summary
from cairn.operators.index import PLACE_STATS, TIME_STATS, Index, build_index, update_index
from cairn.operators.predicates import from_source, searchable
from cairn.operators.ranges import KEY, POS, ROWS, Ranges, held, hits, merge_small, read_held, update_ranges, write_ranges
from cairn.operators.tables import bounded, saved, stored
from cairn.plans.spec import SearchSpec

LOCATION = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("id", "source_id", "source_label", "root_path", "relative_path", "absolute_path")], T.StructField("point_index", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("source_dataset", "source_type", "group_id")], *[T.StructField(n, T.LongType()) for n in ("sequence", "timestamp_ms", "end_timestamp_ms")],
])

#: An item as readers give it: one place it was seen at is its location.
ITEM = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("media_id", "source_id", "relative_path", "display_name", "kind", "mime_type")],
    *[T.StructField(n, T.LongType()) for n in ("size_bytes", "duration_ms", "timestamp_ms", "end_timestamp_ms")],
    *[T.StructField(n, T.DoubleType()) for n in ("latitude", "longitude")], *[T.StructField(n, T.StringType()) for n in ("source_dataset", "source_type")],
    *[T.StructField(n, T.DoubleType()) for n in ("accuracy_m", "altitude_m", "vertical_accuracy_m", "velocity_mps", "heading_deg")],
    T.StructField("group_id", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("location", LOCATION),
])


def as_items(df: DataFrame) -> DataFrame:
    """df with ITEM's columns: those it lacks are null."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in ITEM}
    if list(have.items()) == list(want.items()):
        return df
    # As SQL: a column object takes several calls of the JVM, which a small batch would wait for.
    return df.selectExpr(*[f"CAST({f'`{c}`' if c in have else 'NULL'} AS {t}) AS `{c}`" for c, t in want.items()])


def live(occurrences: DataFrame, sources: DataFrame) -> DataFrame:
    """Occurrences of each active source's present generation; sources is one row per source."""
    now = sources.filter("active").select("source_id", "generation")
    return occurrences.join(now, ["source_id", "generation"], "left_semi")


def first_known(column: str, order: str = "ingest_seq") -> Column:
    """The value of the first row, by order, that has one. A minimum, so rows are combined before they are shuffled."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def merge_occurrences(occurrences: DataFrame, fields: list[str], order: str = "ingest_seq") -> DataFrame:
    """One row per media_id: each field's first known value, and the largest size."""
    aggs = [(F.max(c) if c == "size_bytes" else first_known(c, order)).alias(c) for c in fields]
    return occurrences.groupBy("media_id").agg(F.count("*").alias("n_occurrences"), *aggs)


def last_locations(occurrences: DataFrame, location_id: str, fields: list[str], order: str = "ingest_seq") -> DataFrame:
    """One row per media_id and location: the fields of its last occurrence."""
    last = F.max_by(F.struct(*fields), order)
    return occurrences.groupBy("media_id", location_id).agg(last.alias("l")).select("media_id", location_id, "l.*")


_FIELDS = [f.name for f in ITEM if f.name not in ("media_id", "source_id", "relative_path", "display_name", "metadata", "location")]


#: An id with more states is hot: its states are combined within tasks first.
HOT_STATES = 100_000


def as_states(occurrences: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Occurrences as states of one occurrence each: what merge_states() merges. order becomes order_, a sortable column."""
    there = F.col("location").isNotNull()
    return occurrences.select(
        "media_id", F.lit(1).cast("long").alias("n_occurrences"), *_FIELDS, F.col("display_name").alias("raw_name"), "metadata",
        F.when(there, F.array("location")).otherwise(F.array().cast(T.ArrayType(LOCATION))).alias("locations"), F.col(order).alias("order_"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per media_id: each field's first known value, the largest size, the sum of occurrences, metadata key by key
    (first come, first kept), and the last location of each id. A merged state may be merged again with later ones.

    Most ids have few states, which combining within tasks wouldn't make fewer, but wider: a value and its order for each field.
    So states are dealt by their ids as they are, once for fields, metadata and locations each; only states of ids that have
    more than HOT_STATES are combined before they are dealt.
    """
    hot = _hot_ids(states)
    if not hot:
        return _merged(states.repartition("media_id"))
    many = F.col("media_id").isin(hot)
    return _merged(states.filter(~many).repartition("media_id")).unionByName(_merged(states.filter(many)))


def _hot_ids(states: DataFrame) -> list[str]:
    """The ids of more than HOT_STATES states. Only those whose bucket has as many are counted one by one."""
    bucket = F.pmod(F.xxhash64("media_id"), F.lit(1 << 16))
    full = [r["b_"] for r in states.select(bucket.alias("b_")).groupBy("b_").count().filter(F.col("count") > HOT_STATES).collect()]  # 65 536 at most
    if not full:
        return []
    some = states.select("media_id").filter(bucket.isin(full)) if len(full) <= 1000 else states.select("media_id")
    return [r["media_id"] for r in some.groupBy("media_id").count().filter(F.col("count") > HOT_STATES).collect()]  # a HOT_STATES-th of the states at most


def _merged(states: DataFrame) -> DataFrame:
    aggs = [(F.max(c) if c == "size_bytes" else first_known(c, "order_")).alias(c) for c in [*_FIELDS, "raw_name"]]
    merged = states.groupBy("media_id").agg(F.sum("n_occurrences").alias("n_occurrences"), *aggs)
    meta = states.select("media_id", "order_", F.explode("metadata").alias("key", "value")).groupBy("media_id", "key").agg(F.min_by("value", "order_").alias("value"))
    meta = meta.groupBy("media_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    places = states.select("media_id", "order_", F.explode("locations").alias("location")).withColumn("location_id", F.col("location.id"))
    places = places.groupBy("media_id", "location_id").agg(F.max_by("location", "order_").alias("location"))
    key = F.struct(F.coalesce("location.relative_path", F.lit("")).alias("p"), F.col("location.id").alias("i"), F.col("location").alias("l"))
    places = places.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["l"]).alias("locations"))
    return merged.join(meta, "media_id", "left").join(places, "media_id", "left").withColumn("locations", F.coalesce("locations", F.array().cast(T.ArrayType(LOCATION))))


def normalise(states: DataFrame) -> DataFrame:
    """Assets of merged states: the first location by (path, id) is primary and names the asset. raw_name keeps the name it was given."""
    main = F.get("locations", F.lit(0))
    label = F.concat_ws(" #", F.coalesce(main["source_label"], main["source_id"]), main["point_index"].cast("string"))
    name = F.coalesce(F.when(F.col("kind").isin(*MEDIA_KINDS), basename(main["relative_path"])), label, "raw_name")
    return states.withColumns({"source_id": main["source_id"], "relative_path": main["relative_path"], "display_name": name})


def materialise(occurrences: DataFrame, sources: DataFrame) -> DataFrame:
    """Assets of ITEM occurrences (with generation, ingest_seq and perhaps ingest_batch, which comes before it): live, merged, with sorted locations and a dense asset_id."""
    rows = live(occurrences, sources)
    if "ingest_batch" in rows.columns:
        rows = rows.withColumn("ingest_seq", F.struct("ingest_batch", "ingest_seq"))
    return dense_ids(normalise(merge_states(as_states(rows))).drop("raw_name"), "media_id", "asset_id")


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with 0-based places in the order of a unique key: ranges of keys are numbered apart, then shifted by those before.

    The ranges are saved before they are counted, as another evaluation might cut them elsewhere.
    """
    ranged = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ranged = ranged.withColumn("range_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    ranged = saved(ranged)
    counts = ranged.groupBy("range_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))  # a row per partition
    return ranged.join(F.broadcast(start), "range_").withColumn(name, F.col("start_") + F.col("at_")).drop("range_", "at_", "start_")


def time_geo(assets: DataFrame, name: str = "asset_id") -> DataFrame:
    """The narrow time and place index of what is searchable; name: the column that names an asset."""
    geo = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return searchable(assets).select(
        F.coalesce(ms_to_sec("timestamp_ms"), F.lit(0)).alias("ts_sec"), F.when(geo, to_e7("latitude", 90)).alias("lat_e7"), F.when(geo, to_e7("longitude", 180)).alias("lon_e7"),
        name, "kind", geo.alias("has_geo"), "accuracy_m", "velocity_mps", "heading_deg", "group_id", "sequence",
    )


# --- the stored catalog

class Conflict(Exception):
    """Another writer committed first."""


class _Folder:
    """Small files and listings of a folder that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/") if "://" not in name and not name.startswith("/") else name)

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> bool:
        """Writes a new file as a whole; False if there is one."""
        draft, path = self._path(f"{name}.{uuid.uuid4().hex}"), self._path(name)
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if not self.fs.exists(path) and self.fs.rename(draft, path):
            return True
        self.fs.delete(draft, False)
        return False

    def size(self, name: str) -> int:
        path = self._path(name)
        return self.fs.getContentSummary(path).getLength() if self.fs.exists(path) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def delete_matching(self, pattern: str, rule: Callable[[str], bool]) -> None:
        """Deletes what a pattern of paths finds, if rule holds for its name."""
        for found in self.fs.globStatus(self._path(pattern)) or ():
            if rule(found.getPath().getName()):
                self.fs.delete(found.getPath(), True)


class Catalog:
    """Sources, occurrences and what materialise() derives, under a folder.

    Tables are folders of files that are never changed. A small JSON file a version, under log/, names those that count;
    a version is committed whole or not at all, and readers keep theirs until vacuum(). transaction() joins several changes
    into one version. There may be one writer at a time: of two, the second raises Conflict.
    """

    #: Given when read, as ids of digits would be taken for numbers.
    _OCCURRENCES = T.StructType([*ITEM.fields, *[T.StructField(n, T.LongType()) for n in ("generation", "append_no", "ingest_seq")]])
    _SOURCES = "source_id string, label string, root_path string, generation long, active boolean"
    _GONE = "source_id string, path string, no long"
    _LISTING = "path string, size long, mtime long, hash string"

    def __init__(self, spark: SparkSession, root: str, per_range: int = ROWS):
        self.spark, self.root, self.per_range = spark, root.rstrip("/"), per_range
        self.folder = _Folder(spark, root)
        self._open: dict | None = None
        #: Ranges that the last materialise() rewrote, of those there were, by table.
        self.rewritten: dict[str, tuple[int, int]] = {}

    # -- versions

    def commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("log") if n.endswith(".json"))

    def _load(self, commit: int | None = None) -> dict:
        if commit is None:
            commit = (self.commits() or [0])[-1]
        if not commit:
            return {"commit": 0, "version": 0, "index_version": 0, "next": 1, "sources": {}, "appends": [], "gone": [], "listings": {}, "index": None}
        return self.folder.read(f"log/{commit:012d}.json")

    @property
    def _now(self) -> dict:
        return self._open if self._open is not None else self._load()

    @contextmanager
    def transaction(self, job: Cancellable | None = None) -> Iterator[dict]:
        """Changes within the block are committed as one version at its end; after an exception, or if job was cancelled, none is."""
        if self._open is not None:
            yield self._open
            return
        base = self._load()
        self._open = json.loads(json.dumps(base))
        try:
            yield self._open
            if job:
                job.check()
            if self._open != base:
                self._open["commit"] += 1
                if not self.folder.write(f"log/{self._open['commit']:012d}.json", self._open):
                    raise Conflict(f"version {self._open['commit']} of {self.root} was committed by another writer")
        finally:
            self._open = None

    # -- sources

    def sources(self) -> DataFrame:
        """One row per source."""
        rows = [(k, v["label"], v["root_path"], v["generation"], v["active"]) for k, v in self._now["sources"].items()]
        return self.spark.createDataFrame(rows, self._SOURCES)

    def list_sources(self) -> DataFrame:
        return self.sources().filter("active").orderBy("label", "source_id")

    def source(self, source_id: str) -> dict | None:
        return self._now["sources"].get(source_id)

    def _put(self, source_id: str, **new) -> None:
        with self.transaction() as s:
            old = s["sources"].get(source_id, {"label": source_id, "root_path": None, "generation": 0, "active": True})
            s["sources"][source_id] = {**old, **new}
            s["version"] += 1

    def upsert_source(self, source_id: str, label: str, root_path: str | None = None) -> None:
        self._put(source_id, label=label, root_path=root_path, active=True)

    def remove_sources(self, ids: list[str]) -> None:
        with self.transaction():
            for i in ids:
                self._put(i, active=False)

    def prepare_import(self, source_id: str, duplicates: tuple[str, ...] = ()) -> int:
        """A new generation of a source: what was there before no longer counts, nor do its duplicates."""
        with self.transaction():
            generation = (self.source(source_id) or {"generation": 0})["generation"] + 1
            self._put(source_id, generation=generation, active=True)
            self.remove_sources([d for d in duplicates if d != source_id])
        return generation

    def rollback(self, source_id: str, commit: int) -> None:
        """The source as it was at a commit: later generations and appends of it no longer count."""
        then = self._load(commit)
        with self.transaction() as s:
            if source_id in then["sources"]:
                s["sources"][source_id] = then["sources"][source_id]
            else:
                s["sources"].pop(source_id, None)
            kept = {n for e in then["appends"] for n in e["nos"]}
            s["appends"] = [e for e in s["appends"] if source_id not in e["sources"] or set(e["nos"]) <= kept]
            s["gone"] = [g for g in s["gone"] if g["source"] != source_id or g in then["gone"]]
            if source_id in then["listings"]:
                s["listings"][source_id] = then["listings"][source_id]
            else:
                s["listings"].pop(source_id, None)
            s["version"] += 1

    # -- occurrences

    def append(self, items: DataFrame, generation: int, batch: int | None = None, source_id: str | None = None) -> bool:
        """Appends ITEM rows as occurrences, ordered by (append, row); items without a media id are left out.

        batch numbers the appends of a source's generation: another append of the same number replaces the first one, and
        keeps its place in the order, so a batch that is tried again counts once. If the first one was compacted, it stays, and
        the result is False. Without a number, an append is one of its own. source_id: that of all items, if it is known.
        """
        with self.transaction() as s:
            same = [e for e in s["appends"] if batch is not None and e["generation"] == generation and batch in e["batches"]]
            if same:
                own = {source_id} if source_id is not None else {r["source_id"] for r in items.select("source_id").distinct().collect()}
                same = [e for e in same if own & set(e["sources"])]
            if any(len(e["nos"]) > 1 for e in same):
                return False
            no = same[0]["no"] if same else s["next"]
            name = f"occurrences/{uuid.uuid4().hex}"
            # As rows of an array: numbers in the plan itself would have its code compiled anew for each append.
            numbers = F.inline(F.array(F.struct(F.lit(generation).cast("long").alias("generation"), F.lit(no).cast("long").alias("append_no"))))
            rows = as_items(items).filter("media_id is not null").select("*", numbers).withColumn("ingest_seq", F.monotonically_increasing_id())
            seen = Observation()  # told by the write, as a job of its own takes longer than a small batch
            rows.observe(seen, F.collect_set("source_id").alias("sources")).write.parquet(f"{self.root}/{name}")
            found = sorted(seen.get["sources"])
            s["appends"] = [e for e in s["appends"] if e not in same]
            if found:
                entry = {"no": no, "nos": [no], "dir": name, "generation": generation, "batches": [] if batch is None else [batch], "sources": found, "bytes": self.folder.size(name)}
                s["appends"] = sorted([*s["appends"], entry], key=lambda e: e["no"])
            s["next"] = max(s["next"], no + 1)
            s["version"] += 1
        return True

    def forget_files(self, source_id: str, paths: DataFrame) -> None:
        """What was imported from these files (path, as in the locations' absolute_path) no longer counts."""
        with self.transaction() as s:
            name, no = f"gone/{uuid.uuid4().hex}", s["next"]
            paths.select(F.lit(source_id).alias("source_id"), "path", F.lit(no).cast("long").alias("no")).write.parquet(f"{self.root}/{name}")
            s["gone"].append({"no": no, "dir": name, "source": source_id})
            s["next"] += 1
            s["version"] += 1

    def listing(self, source_id: str) -> DataFrame:
        """(path, size, mtime, hash) of the files of the source's last scan."""
        name = self._now["listings"].get(source_id)
        return self.spark.read.schema(self._LISTING).parquet(f"{self.root}/{name}") if name else self.spark.createDataFrame([], self._LISTING)

    def put_listing(self, source_id: str, files: DataFrame) -> None:
        with self.transaction() as s:
            name = f"listings/{uuid.uuid4().hex}"
            files.select("path", "size", "mtime", "hash").write.parquet(f"{self.root}/{name}")
            s["listings"][source_id] = name

    def progress(self, source_id: str) -> dict[str, list]:
        """What of each file of the source's generation was imported in steps: see sources.steps."""
        return dict(self._now.get("progress", {}).get(f"{source_id}/{(self.source(source_id) or {'generation': 0})['generation']}", {}))

    def put_progress(self, source_id: str, done: dict[str, list]) -> None:
        with self.transaction() as s:
            s.setdefault("progress", {})[f"{source_id}/{s['sources'][source_id]['generation']}"] = done

    def _files(self, names: list[str], schema: T.StructType | str | None = None) -> DataFrame:
        schema = schema or self._OCCURRENCES
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _alive(self, rows: DataFrame, gone: list[dict]) -> DataFrame:
        """rows without those of files that were forgotten after they were imported."""
        if not gone:
            return rows
        last = self._files([g["dir"] for g in gone], self._GONE).groupBy("source_id", "path").agg(F.max("no").alias("no"))
        late = last.select(F.col("source_id").alias("gone_source"), F.col("path").alias("gone_path"), F.col("no").alias("gone_no"))
        dead = (F.col("source_id") == F.col("gone_source")) & (F.col("location.absolute_path") == F.col("gone_path")) & (F.col("append_no") < F.col("gone_no"))
        return rows.join(bounded(stored(late)), dead, "left_anti")

    @staticmethod
    def _live(s: dict) -> list[list]:
        """[append numbers, folder, source] of what counts: by appends, and by the sources in each."""
        known = s["sources"]
        return [[e["nos"], e["dir"], i] for e in s["appends"] for i in e["sources"] if i in known and known[i]["active"] and known[i]["generation"] == e["generation"]]

    def _of(self, parts: list[list]) -> DataFrame:
        """The rows of [append numbers, folder, source]."""
        pairs = self.spark.createDataFrame([(n, i) for nos, _, i in parts for n in nos], "append_no long, source_id string").distinct()
        return self._files(sorted({d for _, d, _ in parts})).join(F.broadcast(pairs), ["append_no", "source_id"], "left_semi").select(self._OCCURRENCES.names)

    def occurrences(self) -> DataFrame:
        """All occurrences that count now."""
        s = self._now
        return self._alive(self._of(self._live(s)), s["gone"])

    # -- what is derived

    @staticmethod
    def _states(rows: DataFrame) -> DataFrame:
        return as_states(rows.withColumn("order_", F.struct("append_no", "ingest_seq")), "order_")

    def materialise(self, full: bool = False) -> DataFrame:
        """Brings assets, the index and the groups up to date, and gives the assets.

        Only media ids in appends, generations and forgotten files that changed since the last time are merged again: new
        occurrences into their assets, as they come later than all before; those that lost occurrences from what is left.
        Ranges without such ids are carried over. Groups are rebuilt if one of these assets is or was in a group. full: all
        is built anew.
        """
        with self.transaction() as s:
            path, now, old = f"{self.root}/tables", self._live(s), s["index"]
            if old is None or full:
                assets = stored(normalise(merge_states(self._states(self._alive(self._of(now), s["gone"])))).withColumn(KEY, F.col("media_id")))
                tables, index = write_ranges(assets, f"{path}/assets", self.per_range, kept=True), build_index(assets, path, self.per_range, kept=True)
                self.rewritten, groups = {"assets": (len(tables.ranges),) * 2}, True
            else:
                tables, index, groups = self._updated(s, now, old, path)
            s["index"] = {
                "live": now, "gone": [g["dir"] for g in s["gone"]], "assets": tables.as_json(), "time": index.time.as_json(), "place": index.place.as_json(),
                **({k: f"tables/{k}/{uuid.uuid4().hex}" for k in ("groups", "group_points")} if groups else {k: old[k] for k in ("groups", "group_points")}),
            }
            if groups:
                rows = tables.read(self.spark)
                members = rows.withColumn("group_ids", F.concat(F.array("group_id"), F.transform("locations", lambda x: x["group_id"])))
                group_summary(members).write.parquet(f"{self.root}/{s['index']['groups']}")
                points = group_points(rows, "media_id").repartitionByRange("group_id", "sequence").sortWithinPartitions("group_id", "sequence", "ts_sec")
                points.write.parquet(f"{self.root}/{s['index']['group_points']}")
            s["index_version"] = s["version"]
        return self.assets()

    def _updated(self, s: dict, now: list[list], old: dict, path: str) -> tuple[Ranges, Index, bool]:
        """(assets, index, whether groups are concerned) after what changed since old."""
        fresh, lost = [p for p in now if p not in old["live"]], [p for p in old["live"] if p not in now]
        late = [g for g in s["gone"] if g["dir"] not in old["gone"]]
        tables, index = (Ranges(**old["assets"]), Index(self.spark, Ranges(**old["time"]), Ranges(**old["place"])))
        self.rewritten = {"assets": (0, len(tables.ranges)), "time": (0, len(index.time.ranges)), "place": (0, len(index.place.ranges))}
        if not fresh and not lost and not late:
            return tables, index, False
        came = self._alive(self._of(fresh), s["gone"])
        new_ids = came.select(F.col("media_id").alias(KEY))
        some, less = False, None
        if lost or late:  # ids that lost occurrences are merged from all that is left
            less = self._of(lost).select("media_id")
            if late:
                stayed = self._of([p for p in old["live"] if p in now])
                less = less.unionByName(stayed.select("media_id", "source_id", "append_no", "location").exceptAll(self._alive(stayed, late).select("media_id", "source_id", "append_no", "location")).select("media_id"))
            less = stored(less.distinct())
            some = not less.isEmpty()
            new_ids = less.select(F.col("media_id").alias(KEY)).unionByName(new_ids)
        ids = stored(new_ids.distinct())
        known = stored(held(tables, ids))
        n = hits(known)
        before = stored(read_held(tables, known, n).drop(POS, "range_"))
        states = self._states(came)
        olds = before.withColumn("order_", F.struct(F.lit(-1).cast("long").alias("append_no"), F.lit(-1).cast("long").alias("ingest_seq")))
        if some:
            few = bounded(less)
            states = states.join(few, "media_id", "left_anti").unionByName(self._states(self._alive(self._of(now), s["gone"])).join(few, "media_id", "left_semi"))
            olds = olds.join(few, "media_id", "left_anti")
        new = stored(normalise(merge_states(states.unionByName(olds.select(states.columns)))).withColumn(KEY, F.col("media_id")))
        changed, stale = update_ranges(tables, ids, new, f"{path}/assets", self.per_range, gone=n)
        index, counts = update_index(index, before, new, path, self.per_range)
        self.rewritten = {"assets": (len(stale), self.rewritten["assets"][1]), **{k: (n, self.rewritten[k][1]) for k, n in counts.items()}}
        grouped = F.col("group_id").isNotNull() | F.exists("locations", lambda x: x["group_id"].isNotNull())
        return changed, index, not before.filter(grouped).isEmpty() or not new.filter(grouped).isEmpty()

    def merged_bytes(self) -> tuple[int, int]:
        """Bytes of the appends that materialise() has seen, and of those it hasn't."""
        s = self._now
        seen = {d for _, d, _ in (s["index"] or {"live": []})["live"]}
        return sum(e["bytes"] for e in s["appends"] if e["dir"] in seen), sum(e["bytes"] for e in s["appends"] if e["dir"] not in seen)

    def up_to_date(self) -> bool:
        s = self._now
        return s["index"] is not None and s["version"] == s["index_version"]

    def _indexed(self) -> dict:
        s = self._now
        if s["index"] is None or s["version"] != s["index_version"]:
            raise RuntimeError(f"the index is of version {s['index_version']}, the catalog of {s['version']}: materialise() first")
        return s["index"]

    def assets(self) -> DataFrame:
        """Assets with a dense asset_id, in the order of their media ids."""
        return Ranges(**self._indexed()["assets"]).numbered(self.spark, "asset_id").drop("raw_name")

    def index(self) -> Index:
        s = self._indexed()
        return Index(self.spark, Ranges(**s["time"]), Ranges(**s["place"]))

    def _with_ids(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.assets().select("media_id", "asset_id"), "media_id")

    def time_index(self) -> DataFrame:
        """The rows of the time index with their asset ids."""
        return self._with_ids(self.index().time.read(self.spark).drop(KEY, POS, "range_"))

    def search(self, spec: SearchSpec) -> DataFrame:
        """A page of whole assets, in order, with pos, as search.search: the index gives the page's ids, and only the ranges
        of assets that hold one are read."""
        index, tables = self.index(), Ranges(**self._indexed()["assets"])
        page = (index.knn_page(spec) if spec.order == "distance" else index.time_page(spec)).collect()  # MAX_PAGE rows
        rows = [(r["media_id"], i, r["ts_sec"], r["distance_m"] if spec.order == "distance" else None) for i, r in enumerate(page)]
        ids = self.spark.createDataFrame(rows, "media_id string, pos long, ts_sec long, distance_m double")
        found = tables.numbered(self.spark, "asset_id", tables.holding([r[0] for r in rows])).drop("raw_name")
        return from_source(found, spec.source_id).join(F.broadcast(ids), "media_id").orderBy("pos")

    def groups(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._indexed()['groups']}")

    def group_points(self) -> DataFrame:
        return self._with_ids(self.spark.read.parquet(f"{self.root}/{self._indexed()['group_points']}")).drop("media_id")

    def stats(self) -> dict[str, int]:
        s = self._now
        return {"version": s["version"], "index_version": s["index_version"], "assets": self.count_media() if s["index"] and s["version"] == s["index_version"] else 0}

    def count_media(self) -> int:
        """Known from the list of ranges; nothing is read."""
        return Ranges(**self._indexed()["assets"]).rows

    # -- upkeep

    def compact(self, file_bytes: int = 128 << 20) -> dict[str, int]:
        """Packs small appends of a source's generation into files of about file_bytes, and small neighbouring ranges into larger ones.

        Rows and their order stay the same; rows of forgotten files go. Appends that materialise() hasn't seen are left. The
        new folders count from one commit on, and readers of earlier versions keep theirs. Gives the numbers of appends and ranges
        before and after.
        """
        with self.transaction() as s:
            indexed = {d for _, d, _ in (s["index"] or {"live": []})["live"]}
            known = s["sources"]
            s["appends"] = [e for e in s["appends"] if e["dir"] in indexed or any(i in known and known[i]["generation"] <= e["generation"] for i in e["sources"])]
            live = self._live(s)
            ready = [e for e in s["appends"] if e["dir"] in indexed and all([e["nos"], e["dir"], i] in live for i in e["sources"]) and e["bytes"] < file_bytes // 2]
            alike: dict[tuple, list[dict]] = {}
            for e in ready:
                alike.setdefault((tuple(e["sources"]), e["generation"]), []).append(e)
            bins = []
            for entries in alike.values():
                own, load = [], 0
                for e in entries:
                    if own and load + e["bytes"] > file_bytes:
                        bins.append(own)
                        own, load = [], 0
                    own, load = [*own, e], load + e["bytes"]
                bins.append(own)
            bins = [b for b in bins if len(b) > 1]
            before, counts = len(s["appends"]), {}
            if bins:
                uid = f"occurrences/{uuid.uuid4().hex}"
                of = self.spark.createDataFrame([(n, k) for k, b in enumerate(bins) for e in b for n in e["nos"]], "append_no long, bin_ int")
                rows = self._alive(self._files([e["dir"] for b in bins for e in b]), s["gone"]).join(F.broadcast(of), "append_no")
                rows.repartition(len(bins), "bin_").sortWithinPartitions("bin_", "media_id", "append_no", "ingest_seq").write.partitionBy("bin_").parquet(f"{self.root}/{uid}")
                for k, b in enumerate(bins):
                    name = f"{uid}/bin_={k}"
                    there = self.folder.size(name) > 0
                    entry = {**b[0], "nos": sorted(n for e in b for n in e["nos"]), "dir": name, "batches": sorted(n for e in b for n in e["batches"]), "bytes": self.folder.size(name)}
                    s["appends"] = [e for e in s["appends"] if e not in b] + ([entry] if there else [])
                    dirs = {e["dir"] for e in b}
                    s["index"]["live"] = [p for p in s["index"]["live"] if p[1] not in dirs] + ([[entry["nos"], name, i] for i in entry["sources"]] if there else [])
                s["appends"].sort(key=lambda e: e["no"])
                order = {(e["dir"], i): k for k, e in enumerate(s["appends"]) for i in e["sources"]}
                s["index"]["live"].sort(key=lambda p: order.get((p[1], p[2]), len(order)))
            counts["appends"] = (before, len(s["appends"]))
            for name, stats in (("assets", {}), ("time", TIME_STATS), ("place", PLACE_STATS)) if s["index"] else ():
                had = Ranges(**s["index"][name])
                has, _ = merge_small(had, self.spark, f"{self.root}/tables/{name}", self.per_range, stats)
                s["index"][name], counts[name] = has.as_json(), (len(had.ranges), len(has.ranges))
        return counts

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what the last keep commits don't name; gives the number of folders deleted. Readers of older versions fail from then on."""
        commits = self.commits()
        used: set[str] = set()
        for c in commits[-keep:]:
            s = self._load(c)
            used |= {e["dir"] for e in s["appends"]} | {g["dir"] for g in s["gone"]} | set(s["listings"].values())
            if s["index"]:
                used |= {d for _, d, _ in s["index"]["live"]} | {s["index"][k] for k in ("groups", "group_points")} | set(s["index"]["gone"])
                used |= {r["path"].removeprefix(f"{self.root}/") for k in ("assets", "time", "place") for r in s["index"][k]["ranges"]}
        for c in commits[:-keep]:
            self.folder.delete(f"log/{c:012d}.json")
        return sum(self._swept(top, used) for top in ("occurrences", "gone", "listings", "tables"))

    def _swept(self, name: str, used: set[str]) -> int:
        if name in used:
            return 0
        if not any(u.startswith(f"{name}/") for u in used):
            there = bool(self.folder.names(name))
            self.folder.delete(name)
            return int(there)
        return sum(self._swept(f"{name}/{n}", used) for n in self.folder.names(name) if not n.startswith(("_", ".")))

    def clear(self) -> None:
        self.folder.delete("")
