"""Near-duplicates by SimHash fingerprints, found through codewords of the binary Golay code.

A fingerprint has a bit for each of the 64 bits of the hashes of a text's shingles (3 words, repeats included): 1 if it is
set in over half of them. Two fingerprints link if they differ in at most 2 bits.

Fingerprints are cut into three segments, so that linked ones agree in one segment at least; in the next one they differ in
at most 2 bits, so there is a word that differs in at most 1 bit from either. The perfect Golay code decodes that word to
one codeword for both: a segment's keys are the codewords of the words around it (one key or six, mostly). Keys (segment,
its bits, a codeword of the next one) bring candidates together, and links are verified by counting bits. Equal fingerprints
are one candidate. Up to CROWD fingerprints of a key are compared pair by pair; those of a larger crowd get an exact way
that grows with their number only: all fingerprints within 1 bit of the same word are linked to each other, so each is
tied to the smallest one around each of the 65 words about it.

Null texts, and texts without words, have the fingerprint zero, which links like any other. Fewer words than a shingle are
one shingle. Texts may be of any length. Rows that repeat an id or a text are rows like others; null ids are no smallest
id, unless a component has no other. An empty table gives no rows. Other columns aren't read, so their names may clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.spark_io import text_or_empty
from cairn.operators.components import connected_components
from cairn.operators.tables import join_groups, saved

#: (first bit, bits) of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The most bits that linked fingerprints differ in. The keys find these, not more.
DIFFER = 2
#: Fingerprints of one key that are compared pair by pair.
CROWD = 64
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code of length 23.
GENERATOR = 0b110001110101


def _word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, of about PIECE bytes at a time."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].lower().split()  # of bytes: at 0x20 and 0x09 to 0x0D, as words are defined
        at = end


def shingle_hashes(raw: bytes, n: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles of a UTF-8 text, in blocks."""
    digest, words, none = xxhash.xxh64_intdigest, [], True
    for block in _word_blocks(raw):
        words += block
        if len(words) < n:
            continue
        joined, none = b" ".join(words), False
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - n] + 1).tolist()]
        yield np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[n - 1 :].tolist())], np.uint64)
        words = words[len(words) - n + 1 :]
    if none and words:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)


def fingerprint(raw: bytes, n: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned."""
    counts, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(raw, n, seed):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3) -> DataFrame:
    """(id, fp: the fingerprint as a signed long) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes(), n) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("raw")).mapInArrow(task, "id long, fp long")


# --- the Golay code: 12 bits of information, then 11 check bits

@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(check bits of each information, the error of at most 3 bits of each syndrome)."""
    check = np.zeros(1 << 12, np.int64)
    for info in range(1 << 12):
        rest = info << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        check[info] = rest
    error = np.full(1 << 11, -1, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            error[check[word >> 11] ^ (word & 0x7FF)] = word
    return check, error


def decode(words: np.ndarray) -> np.ndarray:
    """The information (12 bits) of the codeword nearest to each word of 23 bits."""
    check, error = golay_tables()
    return (words ^ error[check[words >> 11] ^ (words & 0x7FF)]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, key) of the keys of unsigned fingerprints, each once."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    index, keys = [], []
    for s, (same, (_, bits)) in enumerate(zip(parts, SEGMENTS[1:] + SEGMENTS[:1])):
        near = parts[(s + 1) % 3]
        around = near[:, None] ^ np.concatenate([[0], 1 << np.arange(bits)])
        found = np.sort(decode(around), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        row, at = np.nonzero(new)
        index.append(row)
        keys.append((s << 34) | (same[row] << 12) | found[row, at])
    return np.concatenate(index), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp) of every fingerprint."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            index, keys = golay_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[index])], ["key", "fp"])

    return fps.select("fp").mapInArrow(task, "key long, fp long")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DIFFER


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that connect all that link: every linked pair of a key's crowd, ties of larger ones."""
    keyed = saved(_keyed(fps))
    crowds = saved(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"))
    two = crowds.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).filter(_near(F.col("a"), F.col("b")))

    few = join_groups(keyed, saved(crowds.filter(F.col("n").between(3, CROWD)).select("key", "n")), ["key"])
    few = few.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))  # CROWD at most
    pairs = F.flatten(F.transform("fps", lambda x, i: F.transform(F.filter(F.slice("fps", i + 2, CROWD), lambda y: _near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = few.select(F.inline(pairs))

    many = join_groups(keyed, saved(crowds.filter(F.col("n") > CROWD).select("key", "n")), ["key"]).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), k)) for k in range(64)])
    balls = saved(many.select("fp", F.explode(around).alias("word")))
    least = saved(balls.groupBy("word").agg(F.count("*").alias("n"), F.min("fp").alias("a")).filter("n > 1"))
    ties = join_groups(balls, least, ["word"]).select("a", F.col("fp").alias("b")).filter("a <> b")
    return two.unionByName(few).unionByName(ties).distinct()


def simhash_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 3) -> DataFrame:
    """(id_col, fingerprint: 16 hexadecimal digits, component_id: the smallest id that links lead to) of every row."""
    rows = saved(fingerprints(df, text_col, id_col, n))
    groups = saved(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    part = connected_components(links(groups))
    member = groups.join(part.withColumnRenamed("id", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp")).drop("component")
    member = saved(member)
    least = saved(member.groupBy("part").agg(F.count("*").alias("in_part"), F.min("least").alias("component_id")))
    known = saved(join_groups(member, least, ["part"], "in_part").select("fp", "n", "component_id"))
    return join_groups(rows, known, ["fp"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
