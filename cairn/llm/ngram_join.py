"""N-gram Jaccard self-join with vertical partitioning of the global n-gram order.

A document is the set of its n-grams, as 64-bit hashes, and the global order is that of the hashes. First the order is cut
into fragments of bounded size, in each of which the n-grams that a document has in common with any other one are counted.
The counts are summed per document; linked sets have at least p/q of their n-grams in common, so only documents with as many
are candidates. Of those, for documents of like size the order is cut into m fragments. Two sets with a Jaccard similarity of p/q or more differ in at most
D = (q-p)/(q+p) * (|x|+|y|) n-grams, so with m > D + s fragments they agree in more than s of them: a hash of each
fragment's n-grams finds candidates, none is missed, and common n-grams alone don't make one, as a fragment agrees as a
whole. Of its fragments, a set leaves out the most frequent ones, as many as linked sets have at least in common, less one: a
rarer one in common remains, and passages of many sets don't chain them. Each candidate's partial overlaps are counted in each
fragment of a coarser cut and summed per pair.

Documents with equal sets are one class. The candidates' graph (each class with the smallest of its fragment's) splits the
classes into clusters. Each class is first compared with the one class that it shares most
fragments with, in blocks of bounded size; in a group of near copies this links nearly all. What isn't of one component then
is compared within its cluster: bands of sizes are cut into blocks, and every pair of blocks that may hold links between
different components is one group. A group sums the partial overlaps of its pairs and returns a spanning forest of its
links, never the pairs. So links' components are exact, and a group of near copies of any size is spread over bounded tasks.

Null and empty texts have no n-grams and link with nothing; a text with fewer than n words is one n-gram. Texts may be of any
length. Null ids are allowed, repeated rows are one class. An empty table gives an empty result. Other columns of df may have
any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.spark_io import bit_table, fresh_name, marked
from cairn.llm.words import mix64, not_space, slices, words
from cairn.operators.components import connected_components
from cairn.operators.tables import join_groups, saved, stored

U64 = np.uint64
#: Fragments of the coarser cut in which overlaps are counted.
COARSE = 16
#: n-grams of a block's documents, and documents in a block, on average at most.
BLOCK_GRAMS, BLOCK_DOCS = 400_000, 384
#: n-grams of a fragment in which documents' common n-grams are counted, and n-grams that a task holds before it sends them.
FRAGMENT_GRAMS, HELD_GRAMS = 2_000_000, 1_000_000
#: Stands for several documents of a task.
SEVERAL = 0
#: Fragments that a task holds before it sends them.
HELD_SIGS = 500_000
#: Distinct sets that a task remembers, so as not to send their fragments twice.
SEEN = 500_000


class Rule:
    """The sizes, differences and fragments that follow from n and a similarity of num / den."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def differ(self, a: int, b: int) -> int:
        """The most n-grams by which linked sets of sizes a and b differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def top(self, cls: int) -> int:
        """The largest size in a class; class c holds sizes of top(c - 1) + 1 to top(c), and tops double."""
        return 1 << cls

    def cls(self, size: int) -> int:
        return max(0, (size - 1).bit_length())

    def cut(self, cls: int) -> tuple[int, int]:
        """(m, D) of a class. m has room for as many empty fragments as sets of such sizes are likely to have."""
        d = self.differ(self.top(cls), self.top(cls))
        m = d + 2
        for _ in range(8):
            empty = m * math.exp(-(self.top(cls) / 2) / m)
            m = d + 2 + math.ceil(empty + 5 * math.sqrt(empty))
        return m, d

    def classes(self, size: int) -> list[int]:
        """Its own class, and the next one if a larger set there may be linked."""
        c = self.cls(size)
        return [c, c + 1] if size * self.den >= self.num * (self.top(c) + 1) else [c]

    def linked(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return both * (self.den + self.num) >= self.num * (a + b)


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its n-grams of words."""
    for lo, hi in slices(texts):
        first, _, _, h = words(texts.slice(lo, hi - lo), not_space())
        g = np.zeros(len(h), U64)
        for k in range(n):
            m = max(len(h) - k, 0)
            g[:m] = g[:m] * U64(0x9E3779B97F4A7C15) + h[len(h) - m :]
        g = mix64(g)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            if z - a >= n:
                yield np.unique(g[a : z - n + 1])
            elif z > a:  # the whole sequence; its length keeps it apart from n-grams
                whole = U64(z - a)
                for x in h[a:z]:
                    whole = U64((int(whole) * 0x9E3779B97F4A7C15 + int(x)) & 0xFFFFFFFFFFFFFFFF)
                yield mix64(np.array([whole], U64))
            else:
                yield np.empty(0, U64)


def set_key(g: np.ndarray) -> int:
    """A 63-bit key of a set."""
    return int(mix64(np.array([np.add.reduce(mix64(g ^ U64(0x5851F42D4C957F2D))) + U64(len(g))], U64))[0] >> U64(1))


def fragments(g: np.ndarray, rule: Rule) -> list[tuple[int, int, np.ndarray]]:
    """Of a set, for each of its classes: the class, the number of its fragments that may be left out, and their signatures.

    A linked set has all of its fragments but those that one of the differing n-grams is in; left out may be one less than it
    has at least: the last ones of an order that holds for all sets, and one in common is still among the others of both.
    Empty fragments count only where sets may have no other ones in common, as a class of their own.
    """
    out = []
    for c in rule.classes(len(g)):
        m, _ = rule.cut(c)
        d = rule.differ(len(g), min(len(g) * rule.den // rule.num, rule.top(c)))
        if not d:  # only equal sets are linked
            continue
        part = ((g >> U64(32)) * U64(m)) >> U64(32)
        head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        content = np.add.reduceat(mix64(g), head)
        where = part[head] + U64(c << 40)
        out.append((c, max(0, len(head) - d - 1), mix64(content ^ mix64(where))))
        if len(head) <= d:  # such sets may agree in empty fragments only
            out.append((-1 - c, 0, mix64(np.setdiff1d(np.arange(m, dtype=U64), part[head]) + U64((c << 40) | (1 << 39)))))
    return out


def _sets(df: DataFrame, rule: Rule) -> DataFrame:
    """(id, k, n) of each row: its set's key (null if empty) and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [(set_key(g) if len(g) else None, len(g)) for g in gram_sets(b.column(1), rule.n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in sets], pa.int64()), pa.array([n for _, n in sets], pa.int64())], ["id", "k", "n"])

    return df.mapInArrow(run, "id long, k long, n long")


def _common(df: DataFrame, rule: Rule, parts: int, wide: bool) -> DataFrame:
    """(doc) of the sets that may have num/den of their n-grams in common with others: a key, or 32 bits of it unless wide.

    No such set is missing; there may be more where 32 bits of n-grams or keys collide. Rows between the steps are packed:
    a fragment's n-grams with the documents that hold them, then documents' counts, a row for a task and fragment.
    """
    doc_type = U64 if wide else np.uint32
    names, row_type = ["part", "kind", "a", "b"], "part long, kind int, a binary, b binary"
    grams_kind, count_kind, need_kind = 0, 1, 2

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names)

    def by_doc(kind: int, docs: np.ndarray, values: np.ndarray, sign: int) -> list[tuple]:
        bucket = (docs % doc_type(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        docs, values, cut = docs[order], values[order].astype(np.uint32), np.searchsorted(bucket[order], np.arange(parts + 1))
        return [(b if sign > 0 else -1 - b, kind, docs[cut[b] : cut[b + 1]].tobytes(), values[cut[b] : cut[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cut)).tolist()]

    def send(held: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        g, own, sizes = np.concatenate(held), np.array(keys, doc_type), np.array([len(x) for x in held])
        doc = np.repeat(own, sizes)
        order = np.argsort(g)
        g, doc = g[order], doc[order]
        new = np.r_[True, g[1:] != g[:-1]]
        run = np.diff(np.r_[np.flatnonzero(new), len(g)])
        many = np.repeat(run > 1, run)
        # n-grams of several sets here: counted, and sent once for the other tasks.
        known, count = np.unique(doc[many], return_counts=True)
        part = (((g[new] >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
        low, who = g[new].astype(np.uint32), np.where(many[new], doc_type(SEVERAL), doc[new])
        cut = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, grams_kind, low[cut[p] : cut[p + 1]].tobytes(), who[cut[p] : cut[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(cut)).tolist()]
        return packed(rows + by_doc(count_kind, known, count, -1) + by_doc(need_kind, own, -(-sizes * rule.num // rule.den), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, size, seen = [], [], 0, set()
        for b in batches:
            for g in gram_sets(b.column(0), rule.n):
                if not len(g) or (k := set_key(g)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(k)
                held.append(g)
                keys.append(k if wide else max(1, k & 0xFFFFFFFF))
                size += len(g)
                if size >= HELD_GRAMS:
                    yield send(held, keys)
                    held, keys, size = [], [], 0
        if held:
            yield send(held, keys)

    def count(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part < 0:  # counts and needs of a bucket of documents
            return table.set_column(0, "part", pa.array([-1 - part] * len(table), pa.int64()))
        grams = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["a"]])
        docs = np.concatenate([np.frombuffer(x.as_buffer(), doc_type) for x in table["b"]])
        order = np.argsort(grams, kind="stable")
        g = grams[order]
        run = np.diff(np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)])
        docs = docs[order][np.repeat(run > 1, run)]
        return pa.Table.from_batches([packed(by_doc(count_kind, *np.unique(docs[docs != SEVERAL], return_counts=True), 1))])

    def enough(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        docs = [np.frombuffer(x.as_buffer(), doc_type) for x in table["a"]]
        values = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in table["b"]]

        def joined(kind: int) -> tuple[np.ndarray, np.ndarray]:
            some = np.flatnonzero(kinds == kind).tolist()
            return np.concatenate([docs[i] for i in some] or [np.empty(0, doc_type)]), np.concatenate([values[i] for i in some] or [np.empty(0, np.int64)])

        (who, n), (own, need) = joined(count_kind), joined(need_kind)
        found, at = np.unique(own, return_inverse=True)
        least = np.full(len(found), 1 << 62)
        np.minimum.at(least, at, need)
        total = np.bincount(np.searchsorted(found, who), n, len(found)) if len(who) else np.zeros(len(found))
        return pa.table({"doc": pa.array(found[total >= least].astype(np.int64))})

    sent = df.mapInArrow(run, row_type)
    return sent.groupBy("part").applyInArrow(count, row_type).groupBy("part").applyInArrow(enough, "doc long")


def _stars(df: DataFrame, rule: Rule) -> DataFrame:
    """(k, c, w): each set's key, a smaller one with w equal fragments. Linked sets are connected by such rows.

    Fragments are ordered by the number of sets that have them. Those of one set tie nothing, and each set leaves out its most
    frequent ones, as many as it may: a passage that chains sets that aren't alike ties few of them.
    """
    names = ["sig", "k", "cls", "out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, rows = [], 0

        def batch() -> pa.RecordBatch:
            columns = [np.concatenate([x.view(np.int64) for _, _, _, x in held]), *[np.repeat(np.array([h[i] for h in held], t), [len(h[3]) for h in held]) for i, t in ((0, np.int64), (1, np.int32), (2, np.int32))]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

        for b in batches:
            for g in gram_sets(b.column(0), rule.n):
                if not len(g) or (k := set_key(g)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(k)
                for c, out, s in fragments(g, rule):
                    held.append((k, c, out, s))
                    rows += len(s)
                if rows > HELD_SIGS:
                    yield batch()
                    held, rows = [], 0
        if rows:
            yield batch()

    rows = stored(df.select("text").mapInArrow(run, "sig long, k long, cls int, out int"))
    common = saved(rows.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1"))
    place = F.row_number().over(Window.partitionBy("k", "cls").orderBy(F.desc("n"), F.desc("sig")))
    keys = saved(join_groups(rows, common, ["sig"]).withColumn("place", place).filter("place > out").select("sig", "k"))
    low = saved(keys.groupBy("sig").agg(F.min("k").alias("c"), F.count("*").alias("n")).filter("n > 1"))
    return join_groups(keys, low, ["sig"]).filter("k > c").groupBy("k", "c").agg(F.count("*").alias("w"))


def _grams(df: DataFrame, rule: Rule) -> DataFrame:
    """(k, grams) of each row: the set as the bytes of its sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, grams, size = [], [], 0
            for g in gram_sets(b.column(1), rule.n):
                if len(g):
                    keys.append(set_key(g))
                    grams.append(g.tobytes())
                    size += len(g)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.binary())], ["k", "grams"])
                    keys, grams, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.binary())], ["k", "grams"])

    return df.mapInArrow(run, "k long, grams binary")


def block_links(keys: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right sets (indices): partial overlaps per fragment, summed per pair."""
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    size = np.array([len(s) for s in sets], np.int64)
    counts = np.zeros((len(sets), COARSE), np.int32)
    cuts = (np.arange(1, COARSE, dtype=U64) << U64(60))
    bounds = np.array([np.r_[0, np.searchsorted(s, cuts), len(s)] for s in sets])
    counts = np.diff(bounds, axis=1)
    need = -(-rule.num * (size[a][:, None] + size[b][None, :]) // (rule.den + rule.num))
    # What is left to come: no pair shares more of a fragment than the smaller part has.
    most = np.zeros((len(a), len(b)), np.int32)
    for v in range(COARSE):
        most += np.minimum(counts[a, v][:, None], counts[b, v][None, :]).astype(np.int32)
    alive = (most >= need) & (a[:, None] != b[None, :])
    ra, rb = alive.any(1), alive.any(0)
    a, b = a[ra], b[rb]
    if not len(a) or not len(b):
        return []
    alive, need = alive[np.ix_(ra, rb)], need[np.ix_(ra, rb)]
    total = np.zeros(alive.shape, np.float32)
    for v in range(COARSE):
        ga = [sets[i][bounds[i, v] : bounds[i, v + 1]] for i in a]
        gb = [sets[i][bounds[i, v] : bounds[i, v + 1]] for i in b]
        fa, fb = np.concatenate(ga), np.concatenate(gb)
        shared = np.intersect1d(fa, fb)
        if not len(shared):
            continue
        ia, ib = np.repeat(np.arange(len(a)), [len(x) for x in ga]), np.repeat(np.arange(len(b)), [len(x) for x in gb])
        ca, cb = np.minimum(np.searchsorted(shared, fa), len(shared) - 1), np.minimum(np.searchsorted(shared, fb), len(shared) - 1)
        oa, ob = shared[ca] == fa, shared[cb] == fb
        for at in range(0, len(shared), 8192):  # so many columns at once
            wide = min(8192, len(shared) - at)
            ma, mb = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
            x, y = oa & (ca >= at) & (ca < at + wide), ob & (cb >= at) & (cb < at + wide)
            ma[ia[x], ca[x] - at] = 1
            mb[ib[y], cb[y] - at] = 1
            total += ma @ mb.T
    link = alive & (total >= need)
    # Labels spread over the links until nothing changes; each row and column then ties itself to a neighbour of its label.
    label_a, label_b, out = np.arange(len(a)), np.full(len(b), len(a)), []
    far = len(a)
    while True:
        new_b = np.minimum(label_b, np.where(link, label_a[:, None], far).min(0))
        new_a = np.minimum(label_a, np.where(link, new_b[None, :], far).min(1))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    for i, root in enumerate(label_a.tolist()):
        if root != i:
            out.append((int(keys[a[i]]), int(keys[a[root]])))
    for j, root in enumerate(label_b.tolist()):
        if root < far and keys[b[j]] != keys[a[root]]:
            out.append((int(keys[b[j]]), int(keys[a[root]])))
    return out


def _compare(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        keys = table["k"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table["grams"]]
        cluster, side, same = table["cluster"].to_numpy(), table["side"].to_numpy(), table["same"].to_numpy()
        pairs: list[tuple[int, int]] = []
        order = np.argsort(cluster, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            part = part[np.unique(keys[part] * 2 + side[part], return_index=True)[1]]  # equal sets come from repeated texts
            left, right = side[part] == 0, side[part] == 1
            pairs += block_links(keys[part], [sets[i] for i in part], left, left if same[part[0]] else right, rule)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return run


def _classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """docs (id, text) as rows (id, k, n), and the classes (k, component, component_id, n_rows) of non-empty ones."""
    rows = saved(_sets(docs, rule))
    classes = saved(rows.filter("k is not null").groupBy("k").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count("*").alias("n_rows")))

    # Documents with enough n-grams in common with others; keys take 32 bits as long as they are much fewer than that.
    n_docs, grams = rows.filter("k is not null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wide = n_docs > 100_000_000
    parts = -(-grams // FRAGMENT_GRAMS) or 1
    doc = F.col("k") if wide else F.greatest(F.col("k").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(1))
    near = classes.withColumn("doc", doc).join(_common(docs.select("text"), rule, parts, wide), "doc", "left_semi").select("k", "id", "n")
    near = saved(near)
    docs = _with_ids(docs, near)

    star = saved(_stars(docs, rule))
    cluster = saved(connected_components(star.select(F.col("k").alias("a"), F.col("c").alias("b"))))
    cluster = cluster.unionByName(cluster.select(F.col("component").alias("id"), "component").distinct())
    member = saved(cluster.select(F.col("id").alias("k"), F.col("component").alias("cluster")).join(near, "k"))

    found = saved(_components(docs, member, star, rule))
    # Classes without links stand alone under their own key.
    least = classes.join(found.withColumnRenamed("id", "k"), "k", "left").select("k", "id", "n_rows", F.coalesce("component", "k").alias("component"))
    least = saved(least)
    ends = saved(least.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n")))
    return rows, saved(join_groups(least, ends, ["component"]).select("k", "component", "component_id", "n_rows"))


def _with_ids(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Of docs (id, text) the rows whose id is among keys', and perhaps a few others; docs aren't shuffled."""
    return marked(docs, bit_table(keys.select("id")), "wanted", F.col("id")).filter("wanted").select("id", "text")


def ngram_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (the smallest id reachable by links of similarity num/den)."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, classes = _classes(docs, Rule(n, num, den))
    empty = rows.filter("k is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    full = join_groups(rows.filter("k is not null"), classes, ["k"], "n_rows").select("id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty).withColumnRenamed("id", id_col)


def _keyed(df: DataFrame, text_col: str, rule: Rule, name: str) -> DataFrame:
    """df with each row's set key (null if empty) in a new column."""
    at, schema = df.columns.index(text_col), T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [set_key(g) if len(g) else None for g in gram_sets(b.column(at).cast(pa.string()), rule.n)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], schema.fieldNames())

    return df.mapInArrow(run, schema)


def drop_near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """df's rows and columns, one row of each component: that with the smallest id (nulls last), then the smallest set key.

    Of rows that repeat that id and set, the one with the largest hash of its columns stays. Rows without words all stay.
    A row is dropped for its own text: other rows with its id aren't touched. Only rows whose id is in a component of several
    rows are read apart; others aren't shuffled.
    """
    rule = Rule(n, num, den)
    rows, classes = _classes(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), rule)
    pairs = saved(rows.filter("k is not null").groupBy("id", "k").agg(F.count("*").alias("n_rows")))
    sizes = pairs.groupBy("k").agg(F.count("*").alias("n")).join(classes.select("k", "component"), "k")
    of = saved(join_groups(pairs, saved(sizes), ["k"]).drop("n"))
    first = of.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("f"), F.count("*").alias("n"), F.sum("n_rows").alias("rows"))
    several = join_groups(of, saved(first.filter("rows > 1")), ["component"])
    several = saved(several.select("id", "k", (F.col("id").eqNullSafe(F.col("f.id")) & (F.col("k") == F.col("f.k"))).alias("stays")))
    touched = bit_table(several.select("id"))

    def keyed(of: DataFrame, id_: Column) -> DataFrame:
        return of.withColumns({key_id: F.coalesce(id_, F.lit(0)), no_id: id_.isNull()})

    mark, key, key_id, no_id, row, n_rows = (fresh_name(df, x) for x in ("touched", "key", "key_id", "no_id", "row", "n_rows"))
    id_ = F.col(id_col).cast("long")
    all_rows = marked(df, touched, mark, id_)
    apart = keyed(_keyed(all_rows.filter(F.col(mark)).select(*df.columns), text_col, rule, key), id_)
    # What becomes of the sets of all ids that may be touched.
    fate = keyed(marked(pairs, touched, "maybe", F.col("id")).filter("maybe"), F.col("id")).withColumnRenamed("k", key)
    gone = keyed(several.filter("not stays"), F.col("id")).select(key_id, no_id, F.col("k").alias(key))
    fate = saved(fate.join(gone, [key_id, no_id, key], "left_anti").select(key_id, no_id, key, F.col("n_rows").alias(n_rows)))
    stay = join_groups(apart.filter(F.col(key).isNotNull()), fate, [key_id, no_id, key], n_rows)
    whole = F.struct(*[F.col(c) for c in df.columns])
    others = [F.col(f.name) for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    one = stay.filter(F.col(n_rows) > 1).groupBy(key_id, no_id, key).agg(F.max_by(whole, F.xxhash64(F.lit(0), *others)).alias(row)).select(f"{row}.*")
    parts = (all_rows.filter(~F.col(mark)), apart.filter(F.col(key).isNull()), stay.filter(F.col(n_rows) == 1))
    for part in parts:
        one = one.unionByName(part.select(*df.columns))
    return one


def _linked(docs: DataFrame, places: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) between linked classes of places (k, unit, side, same): a spanning forest of each unit's links.

    Units are packed into groups: as many as there are blocks' n-grams in all, so a group holds about one block's.
    """
    total = places.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, int(total // BLOCK_GRAMS))
    placed = places.select("k", F.col("unit").alias("cluster"), "side", "same", F.pmod("unit", F.lit(groups)).alias("group"))
    return _grams(docs, rule).join(placed, "k").groupBy("group").applyInArrow(_compare(rule), "a long, b long")


def _blocks(docs: str = "docs", grams: str = "grams") -> Column:
    return F.ceil(F.greatest(F.col(docs) / BLOCK_DOCS, F.col(grams) / BLOCK_GRAMS)).cast("int")


def _components(docs: DataFrame, member: DataFrame, star: DataFrame, rule: Rule) -> DataFrame:
    """(id, component) of the classes that have links; member: (k, cluster, id, n) of all candidates, star: as _stars'."""
    size = (F.count("*").alias("docs"), F.sum("n").alias("grams"))
    whole = (F.lit(0).alias("side"), F.lit(True).alias("same"))
    # Each class with the one that it shares most fragments with.
    most = star.groupBy("k").agg(F.max_by("c", F.struct("w", -F.col("c"))).alias("c")).join(member.select("k", "n"), "k")
    most = saved(most)
    sizes = saved(most.groupBy("c").agg(*size).withColumn("blocks", _blocks()))
    near = join_groups(most, sizes, ["c"], "docs").withColumn("unit", F.xxhash64("c", F.pmod(F.xxhash64("k"), F.col("blocks"))))
    centres = near.select("c", "unit").distinct().select(F.col("c").alias("k"), "unit", F.lit(0).cast("long").alias("n"))
    places = saved(near.select("k", "unit", "n").unionByName(centres).select("*", *whole))
    links = saved(_linked(docs, places, rule))
    part = connected_components(links)

    # Clusters that aren't one component yet.
    m = saved(member.join(part.withColumnRenamed("id", "k"), "k", "left").withColumn("part", F.coalesce("component", "k")).drop("component"))
    open_ = m.groupBy("cluster").agg(*size, F.min("part").alias("p1"), F.max("part").alias("p2")).filter("p1 <> p2").drop("p1", "p2")
    m = saved(join_groups(m, saved(open_), ["cluster"], "docs"))
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("grams") <= BLOCK_GRAMS)
    places = m.filter(small).select("k", F.col("cluster").alias("unit"), "n", *whole)

    # Large ones: a component that fills a block has cells of its own, and these don't meet one another; others share cells.
    large = m.filter(~small).drop("docs", "grams")
    if not large.isEmpty():
        # Bands of sizes: linked sets are in one band or in neighbouring ones, as tops grow by den / num.
        step = math.log(rule.den / rule.num)
        large = large.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int"))
        parts = saved(large.groupBy("cluster", "part").agg(F.count("*").alias("in_part")))
        large = saved(join_groups(large, parts, ["cluster", "part"], "in_part").withColumn("own", F.when(F.col("in_part") >= BLOCK_DOCS, F.col("part")).otherwise(F.lit(-1))))
        cells = saved(large.groupBy("cluster", "band", "own").agg(*size).withColumn("blocks", _blocks()))
        large = saved(join_groups(large, cells, ["cluster", "band", "own"], "docs").withColumn("blk", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")))
        cell = ["cluster", "band", "own", "blk"]
        one = cells.select("cluster", "band", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
        # Cells meet those of the same and the next bands; ones that float rounding puts a band away, too.
        two = one.select("cluster", *[F.col(c).alias(f"{c}2") for c in cell[1:]])
        met = one.withColumn("band2", F.explode(F.sequence(F.col("band"), F.col("band") + 2))).join(two, ["cluster", "band2"])
        met = met.filter("(band2 > band or own2 > own or (own2 = own and blk2 >= blk)) and (own <> own2 or own = -1)")
        met = saved(met.withColumn("unit", F.xxhash64(*cell, "band2", "own2", "blk2")).withColumn("same", F.expr("band = band2 and own = own2 and blk = blk2")))
        left = large.join(met.select(*cell, "unit", "same"), cell).select("k", "unit", "n", F.lit(0).alias("side"), "same")
        other = met.filter("not same").select("cluster", *[F.col(f"{c}2").alias(c) for c in cell[1:]], "unit", "same")
        right = large.join(other, cell).select("k", "unit", "n", F.lit(1).alias("side"), "same")
        places = places.unionByName(left).unionByName(right)
    places = saved(places)
    if places.isEmpty():
        return part
    return connected_components(links.unionByName(_linked(_with_ids(docs, m), places, rule)))
