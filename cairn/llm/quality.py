"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over the whole text's bytes and words, in numpy on the executors. The trees are fitted on a bounded
sample of labelled rows (MAX_ROWS feature vectors reach the driver) and flattened into complete binary arrays, which all
rows descend at once. Null texts count as empty and get a score, too. Rows with a null label aren't learned from; if all
learned labels are equal or there are none, the score is their share (0.5 without any). Repeated rows get equal scores.
Null ids are scored, and never learned from. Texts may be of any length; they are counted in slices. An empty table gives no
scores. Other columns aren't read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import U64, buffers, mix64, not_space, slices, words

#: Labelled rows that are learned from, those with the smallest hashes of their ids.
MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 80, 4, 64, 0.15, 1.0

# Classes of bytes that are counted.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:'\"-", "!?", "#$%&*@^~|_=+", "<>{}[]()/\\`")
NAMES = ["log_bytes", "log_words", "lower", "upper", "digit", "blank", "line", "point", "mark", "symbol", "bracket", "high", "other", "word_len", "word_len_sd", "word_max", "distinct", "top_word", "pairs", "line_repeat", "line_len", "symbol_words", "upper_words"]


def _class_table() -> np.ndarray:
    t = np.full(256, len(CLASSES) + 1, np.int64)
    t[128:] = len(CLASSES)
    for k, chars in enumerate(CLASSES):
        t[np.frombuffer(chars.encode(), np.uint8)] = k
    return t


def _repeats(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of keys: the share of distinct ones and of the most frequent one (1 and 0 if it is empty)."""
    n = np.diff(first)
    at = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((keys, at))
    k, d = keys[order], at[order]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.empty(0, np.int64)
    runs = np.diff(np.r_[new, len(k)])
    distinct, top = np.bincount(d[new], minlength=len(n)), np.zeros(len(n))
    np.maximum.at(top, d[new], runs)
    return np.where(n, distinct / np.maximum(n, 1), 1.0), top / np.maximum(n, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """NAMES' statistics of each text, as float32."""
    out, table = [], _class_table()
    for lo, hi in slices(texts):
        part = texts.slice(lo, hi - lo)
        data, off = buffers(part)
        n, k = np.diff(off), len(CLASSES) + 2
        doc = np.repeat(np.arange(len(n)), n)
        cls = table[data]
        count = np.bincount(doc * k + cls, minlength=len(n) * k).reshape(len(n), k)
        share = count / np.maximum(n, 1)[:, None]
        first, start, end, h = words(part, not_space())
        nw, size = np.diff(first), (end - start).astype(float)
        wd = np.repeat(np.arange(len(nw)), nw)
        mean = np.bincount(wd, size, len(nw)) / np.maximum(nw, 1)
        sd = np.sqrt(np.maximum(np.bincount(wd, size * size, len(nw)) / np.maximum(nw, 1) - mean**2, 0))
        top_len = np.zeros(len(nw))
        np.maximum.at(top_len, wd, size)
        distinct, top = _repeats(first, h)
        pair = mix64(h[:-1] * U64(3) + h[1:]) if len(h) else h
        pf = np.r_[0, np.cumsum(np.maximum(nw - 1, 0))]
        inside = wd[:-1] == wd[1:] if len(wd) else np.empty(0, bool)
        pairs, _ = _repeats(pf, pair[inside])
        lines = np.ones(256, bool)
        lines[10] = False
        lf, ls, le, lh = words(part, lines)
        line_distinct, _ = _repeats(lf, lh)
        nl = np.diff(lf)
        line_len = np.bincount(np.repeat(np.arange(len(nl)), nl), le - ls, len(nl)) / np.maximum(nl, 1)
        last = cls[end - 1] if len(end) else np.empty(0, np.int64)
        begin = cls[start] if len(start) else np.empty(0, np.int64)
        sym = np.bincount(wd, (last == 7) | (last == 6), len(nw)) / np.maximum(nw, 1)
        second = cls[np.minimum(start + 1, len(cls) - 1)] if len(start) else begin
        shout = np.bincount(wd, (begin == 1) & (second == 1), len(nw)) / np.maximum(nw, 1)
        cols = [np.log1p(n), np.log1p(nw), *share.T, mean, sd, top_len, distinct, top, pairs, 1 - line_distinct, np.log1p(line_len), sym, shout]
        out.append(np.column_stack(cols).astype(np.float32))
    return np.concatenate(out) if out else np.empty((0, len(NAMES)), np.float32)


@dataclass
class Trees:
    """Complete binary trees as arrays: node i has the children 2 i + 1 and 2 i + 2; leaves are the last level."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the labels y (0 or 1) of the statistics x, on histograms of BINS quantile bins."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(np.unique(y)) < 2:
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    total, trees = np.full(len(y), base), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node, feature, threshold = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            at = node - first
            split = np.full(width, -1)
            for j, c in enumerate(cuts):
                key = at * BINS + binned[:, j]
                hg, hh = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h))
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + SMOOTH) + (tg - hg) ** 2 / (th - hh + SMOOTH) - tg**2 / (th + SMOOTH)
                gain[:, len(c) :] = 0
                gain[(hh < 1) | (th - hh < 1)] = 0
                k = gain.argmax(1)
                value = gain[np.arange(width), k]
                better = value > best
                best = np.where(better, value, best)
                feature[first : first + width] = np.where(better, j, feature[first : first + width])
                split = np.where(better, k, split)
                threshold[first : first + width] = np.where(better, c[np.minimum(k, max(len(c) - 1, 0))] if len(c) else np.inf, threshold[first : first + width])
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        value = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + SMOOTH)
        total += value[at]
        for a, v in zip(trees, (feature, threshold, value)):
            a.append(v)
    return Trees(*(np.array(t) for t in trees), base)


def _map_statistics(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.FixedSizeListArray.from_arrays(x.ravel(), len(NAMES)).cast(pa.list_(pa.float32()))], [*keep, "x"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", x array<float>"
    return df.select(*keep, text).mapInArrow(run, schema)


def train_quality(df: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Trees fitted on labelled rows of df (joined by id) for which learn, an expression over the id, is true."""
    sample = labels.filter(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sample = sample.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)  # bounded, so it may be broadcast
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = _map_statistics(docs.join(F.broadcast(sample), "id"), ["id", "label"], "text").toPandas()
    rows = rows.sort_values(["id", "label"]).reset_index(drop=True)
    x = np.stack(rows["x"].to_list()).astype(np.float32) if len(rows) else np.empty((0, len(NAMES)), np.float32)
    return fit(x, rows["label"].to_numpy(float))


def score_quality(df: DataFrame, trees: Trees, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score) of each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(statistics(b.column(1))))], ["id", "score"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
