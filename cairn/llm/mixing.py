"""Mixing sources to target weights by pivotal dependent rounding, along a reduction tree of bounded blocks.

Every document of a source gets the same expected number of copies (the source's target over its size). Its whole part
is given at once; the fractional parts are rounded by pivotal steps: two fractional units meet, and random mass goes from
one to the other until one is 0 or 1; the other is carried on. Units meet in blocks of about BLOCK units of like size,
and what a block carries out meets the carried units of other blocks on the next level, so that the number of copies in a
source stays within one of its expectation, and no array holds more than a few blocks' units: rows that repeat an id and a
size more than BLOCK times are told apart by a salt.

Null texts and sources: null counts as an empty text, and null is a source of its own, last in order. Documents without
words take nothing. Randomness is a hash of the seed and the units' ids and sizes, so reruns agree, wherever rows are (of
rows that repeat an id and size more than BLOCK times, wherever the table's files are the same). Repeated rows are rounded
separately; a text of any length is one unit; an empty table gives an empty result. Other columns may have any names.
There is one row per source in the windows that find targets: sources are taken to be few enough for one task (millions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.spark_io import fresh_name, text_or_empty
from cairn.operators.tables import bounded, join_groups, saved

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Units that meet in one block of the reduction tree, on average.
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """sizes (source, source_size) with target: all sizes shared by weight, stopped at cap times a source's size.

    The excess is shared again by weight: the level is found in one pass over the sources by cap per weight, ascending.
    There is one row per source here, aggregated before.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    arr = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(arr, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("top", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("top") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, every = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # The first source that isn't stopped has the level of all that follow.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    s = s.withColumn("target", F.when(F.col("source_size") <= 0, F.lit(0.0)).otherwise(F.least(F.col("top"), F.coalesce(level * F.col("w"), F.col("top")))))
    return s.select("source", "source_size", "target")


def _uniform(seed: int, level: int, *parts: Column) -> Column:
    """In (0, 1), from a hash of the seed, the level and the parts."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *parts), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def _pivot(seed: int, level: int, a: Column, b: Column) -> Column:
    """struct(carry, out) of two fractional units: one is decided (p is 0 or 1), the other keeps the rest of the mass."""
    pa, pb = a["p"], b["p"]
    u, both = _uniform(seed, level, a["id"], a["size"], a["salt"], b["id"], b["size"], b["salt"]), pa + pb

    def to(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["h"].alias("h"), x["id"].alias("id"), x["row"].alias("row"), x["salt"].alias("salt"), x["whole"].alias("whole"), p.alias("p"))

    def pair(carry: Column, out: Column) -> Column:
        return F.struct(carry.alias("carry"), out.alias("out"))

    zero, one = F.lit(0.0), F.lit(1.0)
    low = F.when(u * both < pa, pair(to(a, both), to(b, zero))).otherwise(pair(to(b, both), to(a, zero)))
    high = F.when(u * (2.0 - both) < 1.0 - pb, pair(to(b, both - 1.0), to(a, one))).otherwise(pair(to(a, both - 1.0), to(b, one)))
    return F.when(both < 1.0, low).otherwise(high)


def _meet(seed: int, level: int, units: Column) -> Column:
    """struct(carry, done) of an array of units: pivotal steps from the first to the last."""
    unit = "struct<size:bigint,h:bigint,id:bigint,row:bigint,salt:bigint,whole:bigint,p:double>"
    start = F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(f"array<{unit}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        carry, done = acc["carry"], acc["done"]
        settled = (carry["p"] <= EPS) | (carry["p"] >= 1.0 - EPS)
        two = F.when(settled, F.struct(x.alias("carry"), carry.alias("out"))).otherwise(_pivot(seed, level, carry, x))
        # transform over one element: the pair is computed once
        met = F.transform(F.array(two), lambda t: F.struct(t["carry"].alias("carry"), F.concat(done, F.array(t["out"])).alias("done")))
        return F.when(carry.isNull(), F.struct(x.alias("carry"), done.alias("done"))).otherwise(F.element_at(met, 1))

    return F.aggregate(units, start, step)


def pivotal_round(units: DataFrame, key: str, seed: int, block: int = BLOCK) -> DataFrame:
    """units (key, id, size, row, salt, whole, p) as (key, id, size, row, copies): whole plus p rounded to 0 or 1.

    Within each key the sum of p changes by less than one.
    """
    fractional = (F.col("p") > EPS) & (F.col("p") < 1.0 - EPS)
    out = [units.filter(~fractional).select(key, "id", "size", "row", (F.col("whole") + F.round("p").cast("long")).alias("copies"))]
    # Units of like size meet first: a class is an eighth of an octave. Then what the classes carry meets.
    left = units.filter(fractional).withColumn("cls", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int"))
    level = 0
    for within in (True, False):
        left = left if within else left.withColumn("cls", F.lit(0))
        while True:
            counts = saved(left.groupBy(key, "cls").agg(F.count("*").alias("n")))
            largest = counts.agg(F.max("n")).first()[0] or 0
            if largest <= 1:
                break
            counts = counts.withColumn("n_blocks", F.ceil(F.col("n") / block).cast("long")).drop("n")
            dealt = left.join(bounded(counts), [key, "cls"]).withColumn("blk", F.pmod(F.xxhash64(F.lit(seed + level), "id", "size", "salt"), F.col("n_blocks")))
            each = F.struct("size", F.xxhash64(F.lit(seed), "id", "salt").alias("h"), "id", "row", "salt", "whole", "p")
            met = dealt.groupBy(key, "cls", "blk").agg(F.array_sort(F.collect_list(each)).alias("units"))
            met = saved(met.select(key, "cls", _meet(seed, level, F.col("units")).alias("met")))
            done = met.select(key, F.explode("met.done").alias("u"))
            out.append(done.select(key, "u.id", "u.size", "u.row", (F.col("u.whole") + F.round("u.p").cast("long")).alias("copies")))
            left = met.select(key, F.col("met.carry.id").alias("id"), F.col("met.carry.size").alias("size"), F.col("met.carry.row").alias("row"), F.col("met.carry.salt").alias("salt"), F.col("met.carry.whole").alias("whole"), F.col("met.carry.p").alias("p"), "cls")
            level += 1
    lone = _uniform(seed, level, F.col("id"), F.col("size"), F.col("salt")) < F.col("p")
    out.append(left.select(key, "id", "size", "row", (F.col("whole") + lone.cast("long")).alias("copies")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def row_key(df: DataFrame, text_col: str, id_col: str, source_col: str) -> Column:
    """A hash that is equal for rows with equal id, source and text, and as good as never for others."""
    cols = [F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string")]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def mix_plan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_COPIES, seed: int = 7) -> DataFrame:
    """One row per row of df: id, source, size, source_size, target, copies, taken (size times copies) and row_key."""
    docs = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        row_key(df, text_col, id_col, source_col).alias("row"), F.monotonically_increasing_id().alias("tag"),
    )
    docs = saved(docs.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    # Rows that repeat an id and size so often that they wouldn't fit in a block get salts.
    twin = F.xxhash64("key", "id", "size")
    twins = saved(docs.groupBy(twin.alias("twin")).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK))
    units = join_groups(docs.withColumn("twin", twin), twins, ["twin"], how="left")
    units = units.withColumn("salt", F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("tag"), F.ceil(F.col("n") / BLOCK)))).drop("twin", "n", "tag")

    sources = saved(docs.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    targets = saved(source_targets(sources.select("source", "source_size"), weights, cap).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    rates = bounded(targets.select("key", rate.alias("rate")))
    units = units.select("key", "id", "size", "salt", "row").join(rates, "key")
    units = units.withColumns({"whole": F.floor(F.col("rate") + EPS).cast("long"), "p": F.greatest(F.col("rate") - F.floor(F.col("rate") + EPS), F.lit(0.0))})
    rounded = pivotal_round(units, "key", seed)
    out = rounded.join(bounded(targets), "key")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.col("row").alias("row_key"))


def apply_mix(df: DataFrame, plan: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """df's rows, each as often as mix_plan(df) says, with a last column copy_no from 1 (of another name if df has that one).

    Rows meet their plan by id and row_key. Equal rows are one: it comes as often as all of them are taken.
    """
    key, id_, none, copies, row = (fresh_name(df, x) for x in ("key", "id", "none", "copies", "row"))
    copy_no = "copy_no" if "copy_no" not in {c.lower() for c in df.columns} else fresh_name(df, "copy_no")
    times = plan.groupBy(F.col("row_key").alias(key), F.coalesce(id_col, F.lit(0)).alias(id_), F.col(id_col).isNull().alias(none)).agg(F.sum("copies").alias(copies), F.count("*").alias(row))
    times = times.filter(F.col(copies) > 0)
    own = F.col(id_col).cast("long")
    met = df.withColumns({key: row_key(df, text_col, id_col, source_col), id_: F.coalesce(own, F.lit(0)), none: own.isNull()}).join(times, [key, id_, none])
    one = met.filter(F.col(row) == 1).select(*df.columns, copies)
    whole = F.struct(*[F.col(c) for c in df.columns])
    equal = met.filter(F.col(row) > 1).groupBy(key, id_, none, copies).agg(F.first(whole).alias(row)).select(f"{row}.*", copies)
    return one.unionByName(equal).withColumn(copy_no, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copies)
