import random
import re

import pyarrow as pa

from cairn.llm import words as w


def test_words_match_the_pattern_at_any_chunk_size():
    rng, pattern, old = random.Random(1), re.compile(rb"[^\x20\x09-\x0D]+"), w.CHUNK_BYTES
    try:
        for w.CHUNK_BYTES in (7, 64, 1 << 20):
            for _ in range(20):
                texts = [None if rng.random() < 0.1 else "".join(rng.choice("abAB é\n\t  ß") for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(rng.randint(0, 12))]
                a = pa.array(texts, pa.string())
                first, start, end, h = w.words(a, w.not_space())
                data, seen = bytes(w.buffers(a)[0]), {}
                for i, t in enumerate(texts):
                    got = [data[start[j] : end[j]] for j in range(first[i], first[i + 1])]
                    assert got == pattern.findall((t or "").encode())
                    for j, x in zip(range(first[i], first[i + 1]), got):
                        assert seen.setdefault(x.lower(), h[j]) == h[j]
                assert len(set(seen.values())) == len(seen)
    finally:
        w.CHUNK_BYTES = old


def test_sliced_arrays():
    a = pa.array(["x y", "z", None, "q r s"])[1:]
    first, *_ = w.words(a, w.not_space())
    assert first.tolist() == [0, 1, 1, 4]
    assert list(w.slices(a, 2)) == [(0, 2), (2, 3)]


def test_bit_tables_miss_no_key(spark):
    from pyspark.sql import functions as F

    from cairn.llm import spark_io

    keys = spark.range(0, 5000, 7).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), (F.col("id") % 3).cast("string").alias("s"))
    bits = spark_io.bit_table(keys)
    df = spark.range(20000).select(F.when(F.col("id") > 0, F.col("id")).alias("bits"), (F.col("id") % 3).cast("string").alias("row"))
    got = spark_io.marked(df, bits, "in_", F.col("bits"), F.col("row"))
    assert got.columns == ["bits", "row", "in_"] and bits.size == 1 << 15
    rows = got.collect()
    assert all(r.in_ for r in rows if (r.bits or 0) % 7 == 0 and (r.bits or 0) < 5000)
    assert sum(r.in_ for r in rows if (r.bits or 0) % 7 or (r.bits or 0) >= 5000) < 0.1 * len(rows)
    assert not any(r.in_ for r in spark_io.marked(df, spark_io.bit_table(keys.limit(0)), "in_", F.col("bits"), F.col("row")).collect())


def test_splitting_texts_takes_little_memory():
    import tracemalloc

    w._POWER.clear()
    texts = pa.array(["some words of a text " * 200] * 1000)  # 4 MB
    tracemalloc.start()
    w.words(texts, w.not_space())
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 16 << 20 and peak < 80 << 20
