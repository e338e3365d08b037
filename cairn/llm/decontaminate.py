"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are [a-z0-9 and non-ASCII]+ of the lower-cased text. Seeds are an item's n-grams of SEED words; an item of fewer words
has one seed, the whole of it. Around a document's seed hits the item is aligned to the document's words (match 1, mismatch
and gap -1), in a window that holds every alignment through the seed that can reach least; the score is the alignment's over
the item's length, and copies score LEAST or more. Seeds that are rare among the texts at hand come first; common ones follow
where they can still raise a score, as rare ones alone would lose copies whose edits broke them. Windows that share too few
words with the item to reach least aren't aligned. So a copy that keeps any SEED words in a row is always found; of copies
with 5 to 30 % of their words edited that reach LEAST in a full alignment, the tests find over 0.9.

The benchmark is a stated query set: it is taken in blocks of at most BLOCK_WORDS words, each of which is sent to all tasks;
documents are read once, pass through all blocks, and aren't shuffled. Null and empty texts and items have no words and aren't
found. An empty benchmark or table gives no rows. Texts may be of any length. Repeated rows and items give repeated results.
Other columns aren't read for contaminated(), and drop_contaminated() keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import U64, letters_digits, mix64, slices, words

SEED, LEAST = 5, 0.6
BLOCK_WORDS = 2_000_000
#: A seed with more hits than this among the texts at hand is common.
RARE_HITS = 32
_BITS = 22


@dataclass
class Items:
    """A block of the benchmark: ids, word hashes, and seeds with the item and place each stands at, sorted by seed; lengths of seeds."""

    ids: list[int | None]
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    lengths: list[int]

    def table(self) -> np.ndarray:
        t = np.zeros(1 << _BITS, bool)
        t[(self.seed >> U64(64 - _BITS)).astype(np.int64)] = True
        return t


def _seeds(h: np.ndarray, size: int = SEED) -> np.ndarray:
    """The hash of the n-gram of size words that starts at each word but the last ones."""
    n = max(0, len(h) - size + 1)
    g = np.full(n, size, U64)
    for k in range(size):
        g = g * U64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix64(g)


def _items(ids: list, hashes: list[np.ndarray]) -> Items:
    lengths = [min(SEED, len(h)) for h in hashes]
    seeds = [_seeds(h, n) for h, n in zip(hashes, lengths)]
    seed = np.concatenate(seeds) if seeds else np.empty(0, U64)
    item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
    place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, np.int64)
    order = np.argsort(seed, kind="stable")
    return Items(ids, hashes, seed[order], item[order], place[order], sorted(set(lengths)))


def _hits(h: np.ndarray, first: np.ndarray, items: Items, table: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, index into seed) of every seed of size words that stands whole within one text."""
    g = _seeds(h, size)
    maybe = np.flatnonzero(table[(g >> U64(64 - _BITS)).astype(np.int64)])
    if not len(maybe):
        return maybe, maybe
    doc = np.searchsorted(first, maybe, "right")
    maybe = maybe[maybe + size <= first[np.minimum(doc, len(first) - 1)]]
    lo, hi = np.searchsorted(items.seed, g[maybe], "left"), np.searchsorted(items.seed, g[maybe], "right")
    n = hi - lo
    start = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else lo
    return np.repeat(maybe, n), start + np.arange(int(n.sum()))


def align(item: np.ndarray, words_: np.ndarray) -> tuple[int, int]:
    """(best local score, end of the best alignment in words_) by Smith-Waterman with linear gaps."""
    n = len(words_)
    step, row, best, end = np.arange(n + 1), np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(words_ == w, 1, -1), row[1:] - 1)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step  # gaps along the text
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def find_copies(texts: pa.Array, items: Items, table: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end word) of the best alignment of every text and item that reaches least."""
    out = []
    for lo, hi in slices(texts):
        first, _, _, h = words(texts.slice(lo, hi - lo), letters_digits())
        word, at = (np.concatenate(x) for x in zip(*(_hits(h, first, items, table, n) for n in items.lengths)))
        if not len(word):
            continue
        doc, item = np.searchsorted(first, word, "right") - 1, items.item[at]
        start = word - items.place[at]
        order = np.lexsort((start, item, doc))
        by = np.stack([doc, item, start])[:, order]
        new = np.r_[True, (by[:, 1:] != by[:, :-1]).any(0)]  # seeds in a row share their start
        # How often the seed of a hit is hit: equal seeds of several items are hit together.
        _, same, hits = np.unique(items.seed[at], return_inverse=True, return_counts=True)
        rarest = np.minimum.reduceat(hits[same][order], np.flatnonzero(new))
        order = order[new]
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        group, until = None, 0
        order = np.concatenate([order[rarest <= RARE_HITS], order[rarest > RARE_HITS]])
        for d, i, s in zip(doc[order].tolist(), item[order].tolist(), start[order].tolist()):
            size = len(items.words[i])
            pad = max(size // 4 + 4, math.ceil((1 - least) * size))
            if group == (d, i) and s <= until and s >= until - pad:
                continue
            group, until = (d, i), s + pad
            a, z = max(int(first[d]), s - pad), min(int(first[d + 1]), s + size + 2 * pad)
            if best.get(group, (0,))[0] >= 1.0:
                continue
            if np.isin(items.words[i], h[a:z]).sum() < size * max(least, best.get(group, (0.0,))[0]):
                continue
            score, end = align(items.words[i], h[a:z])
            if score / size >= max(least, best.get(group, (0.0,))[0]):
                _, back = align(items.words[i][::-1], h[a : a + end][::-1])
                best[group] = score / size, a + end - back - int(first[d]), a + end - int(first[d])
        out += [(lo + d, i, *b) for (d, i), b in best.items()]
    return out


def _blocks(benchmark: DataFrame, text_col: str, id_col: str, limit: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The benchmark's (ids, word hashes), limit words at a time; rows are streamed to the driver partition by partition."""
    ids, hashes, n = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        _, _, _, h = words(pa.array([row[1]], pa.string()), letters_digits())
        if not len(h):
            continue
        if n and n + len(h) > limit:
            yield ids, hashes
            ids, hashes, n = [], [], 0
        ids.append(row[0])
        hashes.append(h)
        n += len(h)
    if ids:
        yield ids, hashes


def contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_id_col: str = "item_id", least: float = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item it holds a copy of: id, item id, score, start_word and end_word in the document."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = [_items(*block) for block in _blocks(benchmark, text_col, item_id_col, block_words)]
    for k, items in enumerate(blocks):
        rows = rows.mapInArrow(_copies_of(items, least, k == len(blocks) - 1), "id long, found array<struct<item:long,score:double,start_word:long,end_word:long>>" + ", text string" * (k < len(blocks) - 1))
    if not blocks:
        return df.sparkSession.createDataFrame([], f"`{id_col}` long, `{item_id_col}` long, score double, start_word long, end_word long")
    hit = rows.select("id", F.explode("found").alias("h"))
    return hit.select(F.col("id").alias(id_col), F.col("h.item").alias(item_id_col), "h.score", "h.start_word", "h.end_word")


_FOUND = pa.list_(pa.struct([("item", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))


def _copies_of(items: Items, least: float, last: bool):
    """Adds a block's copies to found; the last block leaves texts, and rows without copies, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = items.table()
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            before = b.column(b.schema.get_field_index("found")).to_pylist() if "found" in b.schema.names else [[] for _ in range(len(b))]
            for d, i, score, start, end in find_copies(text, items, table, least):
                before[d].append({"item": items.ids[i], "score": score, "start_word": start, "end_word": end})
            out = [b.column(0), pa.array(before, _FOUND), text]
            batch = pa.RecordBatch.from_arrays(out[: 2 if last else 3], ["id", "found", "text"][: 2 if last else 3])
            yield batch.filter(pa.array([bool(f) for f in before], pa.bool_())) if last else batch

    return run


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = LEAST, item_id_col: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """df's rows and columns without documents that hold a copy of an item; nothing is shuffled."""
    at, clean = df.columns.index(text_col), df
    for ids, hashes in _blocks(benchmark, text_col, item_id_col, block_words):
        items = _items(ids, hashes)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            table = items.table()
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in find_copies(b.column(at), items, table, least)]] = False
                yield b.filter(pa.array(keep))

        clean = clean.mapInArrow(run, df.schema)
    return clean
