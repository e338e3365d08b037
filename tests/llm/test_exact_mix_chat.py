import collections
import random

from pyspark.sql import functions as F

from cairn.llm import chat, exact_dedup, mixing


def test_exact_groups_keep_largest_id(docs_of):
    long = "x" * 300
    df = docs_of((1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, long + "1"), (7, long + "2"), (8, long + "1"), (None, "a"), (2, "a"))
    got = exact_dedup.mark_exact_duplicates(df).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert sorted(by[2]) == [(2, 4, False), (2, 4, True)]  # of repeated rows one stays
    assert by[1] == [(2, 4, False)] and by[None] == [(2, 4, False)]
    assert by[3] == [(3, 1, True)] and by[4] == [(5, 2, False)] and by[5] == [(5, 2, True)]
    assert by[6] == [(8, 2, False)] and by[7] == [(7, 1, True)]


def test_exact_drop_and_clashing_columns(docs_of):
    df = docs_of((1, "a"), (2, "a"), (3, None), (4, "b")).withColumn("__size", F.lit(1)).withColumn("__key", F.lit("k"))
    got = exact_dedup.drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 4]
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0
    assert exact_dedup.mark_exact_duplicates(df.limit(0)).count() == 0


def level(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in stopped)
        free = [s for s in order if s not in stopped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return {s: t.get(s, cap * sizes[s]) for s in order}
        stopped |= set(over)


def test_mix_targets_and_rounding(docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(1500)]
    rows += [(2000, None, "a"), (2001, "", "z"), (2002, "one\x0btwo three", "tiny")]
    df = docs_of(*rows)
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
    want = level(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.size * r.copies
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(60, 0.05 * t)
    assert {r.doc_id: r.size for r in got}[2002] == 2
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_mix_keeps_expected_copies(spark):
    units = spark.range(1000).select(F.lit("k").alias("key"), "id", (F.col("id") % 37).alias("size"), F.col("id").alias("row"), F.lit(0).cast("long").alias("salt"), F.lit(1).cast("long").alias("whole"), F.lit(0.3).alias("p"))
    got = mixing.pivotal_round(units, "key", 1, block=16).collect()
    assert len(got) == 1000 and abs(sum(r.copies for r in got) - 1300) <= 1
    assert {r.copies for r in got} == {1, 2}


def test_mix_of_rows_that_repeat_an_id(docs_of):
    """A third of all rows has no id and one size: their blocks are bounded by salts, the totals are right, reruns agree."""
    rows = [(i, "a b c", "s") for i in range(600)] + [(None, "x y z", "s")] * 300 + [(700, "q", "t")]
    got = mixing.mix_plan(docs_of(*rows)).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got if r.source == "s") <= 2701
    want = level({"s": 2700, "t": 1})
    assert abs(sum(r.taken for r in got if r.source == "s") - want["s"]) <= 3
    again = mixing.mix_plan(docs_of(*rows)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_plan(docs_of(*rows).limit(0)).count() == 0


def test_apply_mix_repeats_rows(docs_of):
    df = docs_of((1, "a"), (2, "b"), (3, "c"), (3, "c"), (3, "other"), (None, "d"), (None, "e"), (4, None), (4, ""))
    for c in ("plan_copies", "copy_no", "plan_id", "key", "row", "__key"):
        df = df.withColumn(c, F.col("n_chars"))
    copies = {"a": 0, "b": 3, "c": 1, "other": 2, "d": 2, "e": 0, None: 1, "": 3}
    key = F.create_map(*[F.lit(x) for t, n in copies.items() if t is not None for x in (t, n)])
    plan = df.select("doc_id", mixing.row_key(df, "text", "doc_id", "source").alias("row_key"), F.coalesce(key[F.col("text")], F.lit(1)).alias("copies"))
    got = mixing.apply_mix(df, plan)
    assert got.columns == [*df.columns, "__copy_no"]
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == {(2, "b"): 3, (3, "c"): 2, (3, "other"): 2, (None, "d"): 2, (4, None): 1, (4, ""): 3}
    assert sorted(r["__copy_no"] for r in got.collect() if r.text == "b") == [1, 2, 3]
    assert mixing.apply_mix(df.limit(0), plan.limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def brute_maximal(rows):
    convs = collections.defaultdict(set)
    for c, t, r, x in rows:
        convs[c].add((t if t is not None else -1 << 60, r or "", x or ""))
    seqs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    out = set()
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        equal = [k for k, o in seqs.items() if o == s and k is not None]
        if not longer and (c == min(equal) if equal else True):
            out.add(c)
    return out, seqs


def test_chat_snapshots_collapse(spark):
    rng = random.Random(5)
    base = [(rng.choice(["user", "assistant"]), f"t{rng.randint(0, 2)}") for _ in range(9)]
    rows = []
    for c in range(40):
        s = list(base) if c % 2 else [(rng.choice(["user", "assistant"]), f"t{rng.randint(0, 2)}") for _ in range(3)]
        s = s[: rng.randint(1, len(s))]
        rows += [(c, i * 3, r, x) for i, (r, x) in enumerate(s)]
    rows += [(99, None, "user", None), (99, None, "user", None), (None, 1, None, "z")]
    want, seqs = brute_maximal(rows)
    df = spark.createDataFrame(rows + rows[:5], TURNS)
    got = chat.render_chat(chat.maximal_conversations(df, block=7)).collect()
    text = collections.defaultdict(list)
    for r in got:
        text[r.conv].append((r.part, r.text))
        assert r.n_turns == len(seqs[r.conv])
    assert set(text) == want
    for c, parts in text.items():
        assert "".join(t for _, t in sorted(parts)) == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in seqs[c])
    assert chat.render_chat(chat.maximal_conversations(df.limit(0))).count() == 0


def test_chat_with_few_broadcast_rows_long_texts_and_clashing_names(spark, monkeypatch):
    from cairn.operators import tables

    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", 1)
    long = "x" * 3_000_000
    rows = [(None, t, "user", f"n{t}") for t in range(200)] + [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "user", "y"), (3, 0, "user", "n0")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("pos", "blk", "none", "c0", "n_turns", "conv")})
    got = chat.render_chat(chat.maximal_conversations(df)).collect()
    assert sorted((r.conv or 0, r.part, r.n_parts) for r in got) == [(0, 0, 4), (0, 1, 4), (0, 2, 4), (0, 3, 4), (2, 0, 1)]  # 3 starts as the null one does
