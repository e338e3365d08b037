"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word [a-z0-9 and non-ASCII]+ of the lower-cased text is the mean of the vectors of its character n-grams (of UTF-8 bytes,
with marks for its ends) and of the whole word, in hashed buckets; a text is the mean of its words. A linear softmax over
two classes reads that mean. As an unseen misspelling shares n-grams with what was learned, it scores alike. The model is
fitted on a bounded sample of labelled rows (MAX_ROWS); the driver gets word counts of these only.

Null texts count as empty: their score is that of no words, the share of label 1 among what may be learned. Rows with a null label aren't learned from; if learned labels
are all equal or missing, the score is their share (0 without any). Repeated rows get equal scores. Null ids are scored, and
never learned from. Texts may be of any length. An empty table gives no scores. Scores read no other columns, and
drop_toxic() keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import U64, buffers, letters_digits, lower_ascii, mix64, slices, words

#: Labelled rows that are learned from: those of either class with the smallest hashes of their ids.
MAX_ROWS = 4_000
BUCKETS, DIM, STEPS, RATE = 1 << 17, 8, 300, 0.3
#: Loss at which fitting ends: what few rows can teach is learned soon.
ENOUGH = 0.02
GRAMS = (3, 4, 5)
#: Words whose score a task remembers.
CACHE = 400_000


def word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, bucket) of words of lower-cased bytes: first[i]:first[i + 1] are word i's n-grams and itself."""
    n = end - start
    total = int((n + 2).sum())
    head = np.r_[0, np.cumsum(n + 2)]
    at = np.arange(total) - np.repeat(head[:-1], n + 2)  # place in its word, with marks at both ends
    size = np.repeat(n + 2, n + 2)
    src = np.clip(np.repeat(start, n + 2) + at - 1, 0, max(len(data) - 1, 0))
    b = np.where(at == 0, 1, np.where(at == size - 1, 2, data[src])).astype(U64)
    v = mix64(b + U64(17))
    word = np.repeat(np.arange(len(n)), n + 2)
    owner, bucket = [], []
    for k in GRAMS:
        if total < k:
            continue
        h = np.zeros(total - k + 1, U64)
        for j in range(k):
            h = h * U64(0x9E3779B97F4A7C15) + v[j : total - k + 1 + j]
        ok = at[: total - k + 1] + k <= size[: total - k + 1]
        owner.append(word[: total - k + 1][ok])
        bucket.append((mix64(h[ok] + U64(k)) % U64(BUCKETS)).astype(np.int64))
    whole = np.zeros(len(n), U64)
    weight = v * mix64(at.astype(U64) + U64(99))
    np.add.at(whole, word, weight)
    owner.append(np.arange(len(n)))
    bucket.append((mix64(whole) % U64(BUCKETS)).astype(np.int64))
    owner_all, bucket_all = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner_all, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(owner_all, minlength=len(n)))], bucket_all[order]


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, which, data, start, end): text i's words are which[first[i]:first[i + 1]], indices of distinct words."""
    data, _ = buffers(texts)
    first, start, end, h = words(texts, letters_digits())
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    return first, which, lower_ascii()[data], start[one], end[one]


@dataclass
class SubwordModel:
    gram_score: np.ndarray  # difference of the two classes' scores of each bucket's vector
    bias: float

    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        first, bucket = word_grams(data, start, end)
        if not len(start):
            return np.empty(0)
        return np.add.reduceat(self.gram_score[bucket], first[:-1]) / np.diff(first)

    def score(self, texts: pa.Array, known: dict | None = None) -> np.ndarray:
        """Of each text; known: arrays of hashes and scores of words met before, kept by the caller."""
        out = []
        for lo, hi in slices(texts):
            part = texts.slice(lo, hi - lo)
            data, _ = buffers(part)
            first, start, end, h = words(part, letters_digits())
            u, one, which = np.unique(h, return_index=True, return_inverse=True)
            value = np.empty(len(u))
            old_h, old_s = (known or {}).get("words", (np.empty(0, U64), np.empty(0)))
            at = np.minimum(np.searchsorted(old_h, u), max(len(old_h) - 1, 0))
            hit = old_h[at] == u if len(old_h) else np.zeros(len(u), bool)
            value[hit] = old_s[at[hit]] if hit.any() else 0
            new = np.flatnonzero(~hit)
            for a in range(0, len(new), 50_000):
                some = new[a : a + 50_000]
                value[some] = self.word_scores(lower_ascii()[data], start[one[some]], end[one[some]])
            if known is not None and len(new) and len(old_h) < CACHE:
                keys, vals = np.r_[old_h, u[new]], np.r_[old_s, value[new]]
                order = np.argsort(keys)
                known["words"] = keys[order], vals[order]
            n = np.diff(first)
            logit = np.bincount(np.repeat(np.arange(len(n)), n), value[which], len(n)) / np.maximum(n, 1) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        return np.concatenate(out) if out else np.empty(0)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], word_first: np.ndarray, word_bucket: np.ndarray, y: np.ndarray, share: float) -> SubwordModel:
    """Embeddings and softmax by gradient steps of fixed length with momentum, over all rows at once.

    docs: (word indices, counts) of each row; word_*: the words' n-grams; share: of label 1 among all that may be learned.
    """
    share = float(np.clip(share, 1e-4, 1 - 1e-4))
    prior = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return SubwordModel(np.zeros(BUCKETS), prior)
    # Only buckets that occur are trained.
    used, gram = np.unique(word_bucket, return_inverse=True)
    gram, n_words, n_docs = gram.astype(np.int32), len(word_first) - 1, len(docs)
    gram_word = np.repeat(np.arange(n_words, dtype=np.int32), np.diff(word_first))
    gram_weight = (1 / np.diff(word_first)).astype(np.float32)
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), [len(w) for w, _ in docs])
    word = np.concatenate([w for w, _ in docs]).astype(np.int32)
    count = np.concatenate([c for _, c in docs]).astype(np.float32)
    weight = count / np.maximum(np.bincount(doc, count, n_docs), 1)[doc].astype(np.float32)
    rng = np.random.default_rng(5)
    e, w = rng.normal(0, 0.05, (len(used), DIM)), rng.normal(0, 1.0, (2, DIM))
    move_e, move_w = np.zeros_like(e), np.zeros_like(w)
    # The classes weigh alike and the prior comes last; without a bias, words that nothing is known of score the prior.
    row = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(STEPS):
        side = w[1] - w[0]
        word_score = np.bincount(gram_word, (e @ side)[gram], n_words) * gram_weight
        logit = np.bincount(doc, word_score[word] * weight, n_docs)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if -(row * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum() < ENOUGH:
            break
        d = (p - y) * row
        d_word = np.bincount(word, d[doc] * weight, n_words) * gram_weight
        d_gram = np.bincount(gram, d_word[gram_word], len(used))
        d_gram /= np.linalg.norm(d_gram) + 1e-12
        side_step = d_gram @ e
        move_e = 0.9 * move_e - RATE * np.outer(d_gram, side)
        move_w = 0.9 * move_w - 1e-4 * np.stack([-side_step, side_step])
        e, w = e + move_e, w + move_w
    score = np.zeros(BUCKETS)
    score[used] = e @ (w[1] - w[0])
    return SubwordModel(score, prior)


def train_toxicity(df: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> SubwordModel:
    """A model fitted on labelled rows of df (joined by id) for which learn, an expression over the id, is true."""
    good = labels.filter(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in good.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    one, two = (good.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2) for k in (0, 1))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                first, which, data, start, end = distinct_words(b.column(2).slice(i, 1))
                count = np.bincount(which, minlength=len(start))
                raw = data.tobytes()
                found = [raw[s:e] for s, e in zip(start, end)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([found], pa.list_(pa.binary())), pa.array([count], pa.list_(pa.int64()))], ["id", "label", "words", "counts"])

    rows = docs.join(F.broadcast(one.unionByName(two)), "id").select("id", "label", "text").mapInArrow(run, "id long, label int, words array<binary>, counts array<long>").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("label", "ascending")])
    y = rows["label"].to_numpy().astype(float) if len(rows) else np.empty(0)
    lists = rows["words"].combine_chunks()
    flat = lists.flatten() if len(rows) else pa.array([], pa.binary())
    codes = flat.dictionary_encode() if len(flat) else None
    if codes is None:
        return fit([], np.zeros(1, np.int64), np.empty(0, np.int64), y, share)
    # Words of one learned row only tell nothing of others.
    index, counts = codes.indices.to_numpy(), rows["counts"].combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    seen = np.bincount(index, minlength=len(codes.dictionary))
    place = np.cumsum(seen > 1) - 1
    vocab = [w for w, n in zip(codes.dictionary.to_pylist(), seen) if n > 1]
    index, counts, owner = place[index][seen[index] > 1], counts[seen[index] > 1], owner[seen[index] > 1]
    end = np.cumsum([len(v) for v in vocab])
    start = end - np.array([len(v) for v in vocab])
    data = np.frombuffer(b"".join(vocab), np.uint8)
    first, bucket = word_grams(data, start, end)
    cut = np.cumsum(np.bincount(owner, minlength=len(rows)))[:-1]
    return fit(list(zip(np.split(index, cut), np.split(counts, cut))), first, bucket, y, share)


def score_toxicity(df: DataFrame, model: SubwordModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score) of each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1), known))], ["id", "score"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def drop_toxic(df: DataFrame, model: SubwordModel, limit: float = 0.3, text_col: str = "text") -> DataFrame:
    """df's rows whose score is below limit, with df's columns; nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            yield b.filter(pa.array(model.score(b.column(at), known) < limit))

    return df.mapInArrow(run, df.schema)
