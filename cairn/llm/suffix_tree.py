"""Language-model scoring with a probabilistic suffix tree, and add-half unigrams as a base.

The model reads the bytes of lower-cased words with single spaces between them and an end mark, as symbols of a fixed
alphabet of 64 (rare bytes share a symbol and are equally likely within it). The tree holds contexts of 0 to DEPTH symbols.
A context is kept if the next symbol's distribution after it diverges from that after its suffix by enough: its count times
the divergence must reach GAIN. All such contexts, with their suffixes, make the tree. A kept context's distribution is its
counts' smoothed with its suffix's, which weighs WEIGHT times the number of different symbols that follow the context
(Witten-Bell for 1). A symbol is scored by the longest kept suffix before it.

All learned rows are counted: symbol grams and words are counted in the tasks, then summed by key. The tree is a table; its
MAX_STATES most frequent contexts (a tree as well: a suffix is no rarer) and the most frequent words go to every task. Other
words of a text, and its symbols after contexts that the head may lack (a bit map of fixed size tells), meet their counts in
joins.

Null and empty texts are an end mark alone; texts may be of any length. Repeated rows get equal scores. With nothing learned,
symbols are equally likely. An empty table gives an empty result. Other columns aren't read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import U64, buffers, lower_ascii, mix64, not_space, slices, words
from cairn.operators.tables import bounded, join_groups, saved

DEPTH, MAX_STATES, GAIN, WEIGHT = 5, 1 << 17, 12.0, 2.0
#: Bytes of text that are turned into symbols at once; temporary arrays take some 60 times as much.
SLICE = 1 << 20
#: Words whose counts go to every task.
HEAD_WORDS = 1 << 17
#: Distinct keys that a task counts before it sends them on.
HELD = 1_500_000
#: Bits of the map of the contexts that aren't in the head: ctx + (d << 30), times _TIMES, modulo a prime.
MAP_BITS, _TIMES = 67_108_859, 402_653_189

# The symbols that stand for one byte or for a class of equally likely ones.
_SINGLE = "abcdefghijklmnopqrstuvwxyz .,;:!?'\"-()/#$%&*=".encode() + bytes([0xC2, 0xC3, 0xE2, 0x9F, 0xA0, 0xA1, 0xA4, 0xA7, 0xA8, 0xA9, 0xAA, 0xAD, 0xB1, 0xB3, 0xB6])
_DIGITS = b"0123456789"
END, DIGIT, OTHER = 0, 62, 63
#: Bits of a gram, and the most occurrences that stand beside it in one number.
_GRAM, _MOST = 6 * (DEPTH + 1), 1 << 26


def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: its symbol, and the log10 of its share within that symbol."""
    sym, share = np.full(256, OTHER, np.uint8), np.zeros(256, np.float32)
    for k, b in enumerate(_SINGLE):
        sym[b] = k + 1
    sym[np.frombuffer(_DIGITS, np.uint8)] = DIGIT
    sym[65:91] = sym[97:123]
    share[sym == DIGIT] = -1.0
    others = (sym == OTHER) & (np.arange(256) != 0)
    share[sym == OTHER] = -np.log10(max(others.sum(), 1))
    return sym, share


SYMBOL, SHARE = _alphabet()


@dataclass
class Symbols:
    """Texts as symbols: DEPTH end marks before each; head[i] is where text i's own symbols start."""

    symbols: np.ndarray
    share: np.ndarray
    head: np.ndarray
    size: np.ndarray


def to_symbols(data: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray) -> Symbols:
    n_words, length = np.diff(first), end - start
    by_text = np.r_[0, np.cumsum(length + 1)]
    size = by_text[first[1:]] - by_text[first[:-1]]
    size = np.where(n_words, size, 1)  # each word and a space or, after the last, the end mark
    head = np.r_[0, np.cumsum(size + DEPTH)][:-1] + DEPTH
    out, share = np.zeros(int((size + DEPTH).sum()), np.uint8), np.zeros(int((size + DEPTH).sum()), np.float32)
    if len(start):
        text = np.repeat(np.arange(len(n_words)), n_words)
        at = head[text] + by_text[:-1] - by_text[first[:-1]][text]
        space = np.ones(len(start), bool)
        space[first[1:][n_words > 0] - 1] = False
        out[(at + length)[space]] = SYMBOL[32]
        shift = np.repeat(at - start, length)
        src = np.arange(int(length.sum())) + np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length)
        out[src + shift], share[src + shift] = SYMBOL[data[src]], SHARE[data[src]]
    return Symbols(out, share, head, size)


def _all_codes(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol but the first DEPTH: the DEPTH before it and itself as one number, and whether it is a text's own."""
    x = s.symbols.astype(np.int64)
    code = np.zeros(max(len(x) - DEPTH, 0), np.int64)
    for j in range(DEPTH + 1):
        code = (code << 6) | x[j : len(x) - DEPTH + j]
    own = np.ones(len(x), bool)
    pads = (s.head[:, None] - 1 - np.arange(DEPTH)).ravel()
    own[pads] = False
    return code, own[DEPTH:]


def gram_codes(s: Symbols) -> np.ndarray:
    """Of each symbol of a text, the DEPTH before it and itself as one number."""
    code, own = _all_codes(s)
    return code[own]


@dataclass
class Tree:
    """Node 0 is the empty context; child[64 n + s] adds the older symbol s to node n's context, -1 if that isn't kept."""

    child: np.ndarray
    logp: np.ndarray  # 64 n + s: log10 of s after n
    depth: np.ndarray
    near: np.ndarray  # of the last three symbols: the node they lead to

    def nodes(self, s: Symbols) -> np.ndarray:
        """Of each symbol but the first DEPTH, the node of the longest context before it."""
        x = s.symbols
        n = len(x) - DEPTH
        at = [x[DEPTH - d : DEPTH - d + n].astype(np.int32) for d in range(DEPTH + 1)]
        node = self.near[(at[1] << 12) | (at[2] << 6) | at[3]]
        deep = np.flatnonzero(self.depth[node] == 3)
        for d in range(4, DEPTH + 1):
            more = self.child[(node[deep] << 6) | at[d][deep]]
            ok = more >= 0
            deep = deep[ok]
            node[deep] = more[ok]
        return node

    def beyond(self, s: Symbols, node: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, gram) of the texts' symbols that may have a longer context in the table than in this tree."""
        code, own = _all_codes(s)
        at = np.flatnonzero(own & (self.depth[node] < DEPTH))
        d = self.depth[node[at]].astype(np.int64) + 1
        bit = (((code[at] >> 6) & ((1 << (6 * d)) - 1)) + (d << 30)) * _TIMES % MAP_BITS
        at = at[(bits[bit >> 6] >> (bit & 63).astype(U64)) & U64(1) == 1]
        return at, code[at]

    def score(self, s: Symbols, node: np.ndarray | None = None, left: np.ndarray | None = None) -> np.ndarray:
        """Of each text, the log10 probability of its symbols, those at left counted as certain within the alphabet."""
        node = self.nodes(s) if node is None else node
        p = self.logp[(node << 6) | s.symbols[DEPTH:]].astype(np.float64)
        if left is not None:
            p[left] = 0.0
        total = np.r_[0.0, np.cumsum(p + s.share[DEPTH:])]
        a = s.head - DEPTH
        return total[a + s.size] - total[a]


def build_tree(contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], root: np.ndarray) -> Tree:
    """contexts[d - 1]: (context, symbol, count) of the kept contexts of d symbols, sorted; root: counts without context."""
    p = ((root + 0.5) / (root.sum() + 32.0))[None, :]
    logs, depth, known = [np.log10(p).astype(np.float32)], [np.zeros(1, np.int8)], np.zeros(1, np.int64)
    child, first = [np.full((1, 64), -1, np.int32)], 0
    for d, (ctx, sym, n) in enumerate(contexts, 1):
        own, of = np.unique(ctx, return_inverse=True)
        if not len(own):
            break
        parent = np.searchsorted(known, own & ((1 << (6 * (d - 1))) - 1))
        total = np.bincount(of, n, len(own))
        smooth = WEIGHT * np.bincount(of, minlength=len(own))  # a row for a context and symbol
        p = p[parent] * smooth[:, None]
        p[of, sym] += n
        p /= (total + smooth)[:, None]
        child[-1][parent, own >> (6 * (d - 1))] = first + len(known) + np.arange(len(own))
        first += len(known)
        logs.append(np.log10(p).astype(np.float32))
        depth.append(np.full(len(own), d, np.int8))
        child.append(np.full((len(own), 64), -1, np.int32))
        known = own
    child_all, depth_all = np.concatenate(child).ravel(), np.concatenate(depth)
    codes = np.arange(1 << 18, dtype=np.int32)
    near, alive = np.zeros(1 << 18, np.int32), np.ones(1 << 18, bool)
    for s in (codes >> 12, (codes >> 6) & 63, codes & 63):
        more = child_all[(near << 6) | s]
        alive &= more >= 0
        near = np.where(alive, more, near).astype(np.int32)
    return Tree(child_all, np.concatenate(logs).ravel(), depth_all, near)


def _count(df: DataFrame) -> DataFrame:
    """(kind, key, n): counts of symbol grams (kind 0) and of words' hashes (kind 1), several rows for a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate([x[k] for x in held[kind]]) for k in (0, 1))
            u, at = np.unique(keys, return_inverse=True)
            return u, np.bincount(at, n, len(u)).astype(np.int64)

        def add(kind: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            held[kind].append(np.unique(keys, return_counts=True))
            if sum(len(x[0]) for x in held[kind]) > 2 * HELD:
                held[kind] = [merged(kind)]
                if len(held[kind][0][0]) > HELD:
                    yield from send(kind)

        def send(kind: int) -> Iterator[pa.RecordBatch]:
            u, n = merged(kind)
            held[kind] = []
            for a in range(0, len(u), 100_000):
                part = u[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[a : a + 100_000])], ["kind", "key", "n"])

        for b in batches:
            for lo, hi in slices(b.column(0), SLICE):
                part = b.column(0).slice(lo, hi - lo)
                data, _ = buffers(part)
                first, start, end, h = words(part, not_space())
                yield from add(0, gram_codes(to_symbols(data, first, start, end)))
                yield from add(1, h.view(np.int64))
        for kind in held:
            if held[kind]:
                yield from send(kind)

    return df.mapInArrow(run, "kind int, key long, n long")


def _low(ctx: Column, d: Column) -> Column:
    """The last d symbols of ctx."""
    return ctx.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (d * 6).cast("int")) - 1)


def _kept(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, kept) of grams (key, n), each key once. root: sym, n of all symbols. kept: the contexts that pass the
    divergence test, and their suffixes, as d, ctx, total and nexts, an array of (sym, n) of at most 64 symbols."""
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("key", 6).bitwiseAND(F.lit((1 << (6 * d)) - 1)).alias("ctx")) for d in range(DEPTH + 1)]))
    rows = grams.select(F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("sym"), "n", levels.alias("c")).groupBy("c.d", "c.ctx", "sym").agg(F.sum("n").alias("n"))
    rows = saved(rows)
    totals = saved(rows.groupBy("d", "ctx").agg(F.sum("n").alias("total")))
    suffix = _low(F.col("ctx"), F.col("d") - 1)
    # A context's gain is the sum of n * log((n / total) / (n of the suffix / total of the suffix)); a suffix meets at most 64 contexts.
    up = rows.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("suffix"), "sym", F.col("n").alias("m"))
    gain = rows.filter("d > 0").withColumn("suffix", suffix).join(up, ["d", "suffix", "sym"]).groupBy("d", "ctx", "suffix").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log(F.col("n") / F.col("m"))).alias("gain"))
    up = totals.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("suffix"), F.col("total").alias("total_up"))
    best = gain.join(up, ["d", "suffix"]).filter(F.col("gain") + F.col("total") * F.log(F.col("total_up") / F.col("total")) >= GAIN)
    own = best.select("ctx", F.explode(F.sequence(F.lit(1), "d")).alias("d")).select("d", _low(F.col("ctx"), F.col("d")).alias("ctx")).distinct()
    kept = rows.join(own, ["d", "ctx"]).groupBy("d", "ctx").agg(F.sum("n").alias("total"), F.collect_list(F.struct("sym", "n")).alias("nexts"))
    return rows.filter("d = 0").select("sym", "n"), saved(kept)


def _map(states: DataFrame) -> np.ndarray:
    """The bit map of states."""
    bit = (F.col("ctx") + F.shiftleft(F.col("d").cast("long"), 30)) * _TIMES % MAP_BITS
    rows = states.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64 + 1, U64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(U64)
    return bits


def _gram_logs(grams: DataFrame, kept: DataFrame, root: np.ndarray) -> DataFrame:
    """(g, logp) of grams (g): log10 of the last symbol after the longest kept context, as build_tree smooths it."""
    base = F.array(*[F.lit(float(x)) for x in (root + 0.5) / (root.sum() + 32.0)])
    out = grams.withColumn("sym", F.col("g").bitwiseAND(F.lit(63)).cast("int")).withColumn("p", F.get(base, F.col("sym")))
    for d in range(1, DEPTH + 1):
        own = kept.filter(F.col("d") == d).select("ctx", "total", (WEIGHT * F.size("nexts")).alias("smooth"), F.map_from_entries("nexts").alias("nexts"))
        # There are at most 4096 contexts of two symbols, so they are broadcast; longer ones meet 64 ** 3 grams each at most.
        out = out.withColumn("ctx", F.shiftright("g", 6).bitwiseAND(F.lit((1 << (6 * d)) - 1))).join(F.broadcast(own) if d < 3 else own, "ctx", "left")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce(F.col("nexts")[F.col("sym")], F.lit(0)) + F.col("smooth") * F.col("p")) / (F.col("total") + F.col("smooth")))
        out = out.select("g", "sym", p.alias("p"))
    return out.select("g", F.log10("p").alias("logp"))


def score_texts(df: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: id, n_tokens, n_known, train_tokens, base_score and score; learn picks the rows learned from."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    learned = docs.filter("learn").select("text")
    counts = saved(_count(learned).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    first, kept = _kept(counts.filter("kind = 0").select("key", "n"))
    states, bits = kept, None
    if kept.count() > MAX_STATES:
        states = saved(kept.orderBy(F.desc("total"), "d", "ctx").limit(MAX_STATES))
        bits = _map(kept.select("d", "ctx").join(states.select("d", "ctx"), ["d", "ctx"], "left_anti"))
    heads = states.select("d", "ctx", F.inline("nexts")).toArrow()
    depth, *head = (heads[c].to_numpy() for c in ("d", "ctx", "sym", "n"))
    parts = [tuple(x[depth == d] for x in head) for d in range(1, DEPTH + 1)]
    root, seen = np.zeros(64), first.toArrow()
    np.add.at(root, seen["sym"].to_numpy(), seen["n"].to_numpy())
    tree = build_tree(parts, root)

    vocabulary = counts.filter("kind = 1").select(F.col("key").alias("word"), "n")
    n_docs = learned.count()
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, v = total + n_docs, distinct + (n_docs > 0)
    norm = float(np.log10(n_all + 0.5 * (v + 1)))
    head = vocabulary.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).toArrow()
    words_, n = head["word"].to_numpy(), head["n"].to_numpy()
    order = np.argsort(words_.view(U64) if len(words_) else words_)
    model = spark.sparkContext.broadcast((tree, words_[order].view(U64), np.log10(n[order] + 0.5), bits))
    end_score = float(np.log10(n_docs + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known, logn, bits = model.value
        for b in batches:
            for lo, hi in slices(b.column(2), SLICE):
                part = b.column(2).slice(lo, hi - lo)
                data, _ = buffers(part)
                first, start, end, h = words(part, not_space())
                n_words = np.diff(first)
                text = np.repeat(np.arange(len(n_words)), n_words)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                base = np.bincount(text[hit], logn[at[hit]], len(n_words))
                place = np.arange(len(h)) - first[:-1][text]
                key = np.zeros(len(n_words), U64)
                np.add.at(key, text, mix64(h + mix64(place.astype(U64))))
                key = (mix64(key + n_words.astype(U64)) >> U64(1)).astype(np.int64)
                rest = ~hit
                tail, cut = h[rest].view(np.int64), np.r_[0, np.cumsum(np.bincount(text[rest], minlength=len(n_words)))].astype(np.int32)
                symbols = to_symbols(data, first, start, end)
                node = tree.nodes(symbols)
                left, gram = tree.beyond(symbols, node, bits) if bits is not None else (np.empty(0, np.int64),) * 2
                score = tree.score(symbols, node, left)
                of = np.searchsorted(symbols.head - DEPTH, left, "right") - 1
                own, times = np.unique((of << _GRAM) | gram, return_counts=True)
                parts = -(-times // _MOST)  # so that a gram and its count are one number
                own, times = np.repeat(own, parts), np.repeat(times, parts)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
                packed = (np.minimum(times - nth * _MOST, _MOST) << _GRAM) | (own & ((1 << _GRAM) - 1))
                cut_grams = np.r_[0, np.cumsum(np.bincount(own >> _GRAM, minlength=len(n_words)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in b.columns[:2]), pa.array(key), pa.array(n_words + 1), pa.array(np.bincount(text[hit], minlength=len(n_words))), pa.array(base.astype(float)), pa.array(score), pa.ListArray.from_arrays(pa.array(cut), pa.array(tail)), pa.ListArray.from_arrays(pa.array(cut_grams), pa.array(packed))],
                    ["id", "learn", "key", "n_tokens", "head_known", "head_base", "score", "tail", "grams"],
                )

    schema = "id long, learn boolean, key long, n_tokens long, head_known long, head_base double, score double, tail array<long>, grams array<long>"
    rows = saved(docs.select("id", "learn", "text").mapInArrow(run, schema))
    # Each text's other words, one row for a word, meet the counts; equal texts are taken once for each partition.
    texts = rows.filter(F.size("tail") > 0).select("key", "tail", F.spark_partition_id().alias("p")).dropDuplicates(["key", "p"])
    tail = texts.select("key", "p", F.explode("tail").alias("word")).groupBy("key", "p", "word").agg(F.count("*").alias("times"))
    met = tail.join(vocabulary, "word", "left")
    sums = met.groupBy("key", "p").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    sums = sums.groupBy("key").agg(F.max("tail_base").alias("tail_base"), F.max("tail_known").alias("tail_known"))
    score = F.col("score")
    if bits is not None:  # each text's grams meet their probabilities; equal texts get one sum
        met = rows.withColumn("row", F.monotonically_increasing_id()).select("key", "row", F.explode("grams").alias("x"))
        met = met.select("key", "row", F.col("x").bitwiseAND(F.lit((1 << _GRAM) - 1)).alias("g"), F.shiftright("x", _GRAM).alias("times"))
        logs = bounded(saved(_gram_logs(met.select("g").distinct(), kept, root)))
        beyond = met.join(logs, "g").groupBy("key", "row").agg(F.sum(F.col("times") * F.col("logp")).alias("beyond")).groupBy("key").agg(F.max("beyond").alias("beyond"))
        sums, score = sums.join(beyond, "key", "full"), score + F.coalesce("beyond", F.lit(0.0))
    # One row for a distinct text, whatever the number of its copies.
    per_text = rows.groupBy("key").agg(F.count("*").alias("copies")).join(sums, "key", "left")
    out = join_groups(rows.drop("tail", "grams"), saved(per_text), ["key"], "copies")
    base = F.col("head_base") + F.coalesce("tail_base", F.lit(0.0)) + F.lit(end_score) - F.col("n_tokens") * F.lit(norm)
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(n_docs > 0))
    return out.select(F.col("id").alias(id_col), "n_tokens", known.alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
