"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import centroids, chat, decontaminate, exact_dedup, licenses, mixing, ngram_join, quality, simhash, suffix_tree, toxicity, warc, whitening
from cairn.llm.spark_io import table, text_or_empty
from cairn.operators.tables import work_path


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sha = F.sha2(text_or_empty().cast("binary"), 256)
    return exact_dedup.mark_exact_duplicates(docs, carry={"text_sha256": sha}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def fold(column: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo parts."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def _held_out(scores: DataFrame, parts: int, rest: int, least: float) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), parts) == rest, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    trees = quality.train_quality(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return _held_out(quality.score_quality(docs, trees), 3, 1, 0.5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return _held_out(toxicity.score_toxicity(docs, model), 4, 2, 0.3)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path)
    return records.select(F.col("page").alias("page_id"), F.col("payload").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


#: Base32 of a SHA-1: of every 40 bits (10 hex digits) 8 digits of 5 bits.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (k // 8) AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = suffix_tree.score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    nearest = F.array_min(F.transform("spans", lambda s: s["edits"] / F.length(s["notice"])))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(1 - nearest, F.lit(0.0)).alias("score"),
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contaminated(docs, benchmark)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.maximal_conversations(table(spark, sf_dir, "conversations"))
    return chat.render_chat(turns).select(F.col("conv").alias("conv_id"), "part", "n_parts", "n_turns", "text")


OP10_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
heads AS (SELECT min(conv_id) AS conv_id, n, prefix FROM p WHERE pos = n GROUP BY n, prefix),
kept AS (SELECT conv_id, n FROM heads h WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = h.n AND p.pos < p.n AND p.prefix = h.prefix)),
parts AS (SELECT p.conv_id, coalesce(floor(p.turn / 64), -1e18) AS blk, p.n AS n_turns,
            string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
          FROM p JOIN kept ON p.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY blk) - 1 AS part,
  count(*) OVER (PARTITION BY conv_id) AS n_parts, n_turns, text
FROM parts
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


#: Of op12, fixed by its contract.
CENTROIDS, ROUNDS, DIMS = 40, 5, 64


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS, dims=DIMS, scale=256, seed="2")


def _lloyd_sql() -> str:
    """Rounds of assignments a0, a1, ... to centroids c0, c1, ..., a row for each component."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT v, k, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM e JOIN c{r} c USING (i) GROUP BY v, k),
a{r} AS MATERIALIZED (SELECT v, min_by(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY v)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{r} USING (v) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN m{r} USING (k, i))""")
    return ",\n".join(steps)


OP12_SQL = f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT v, unnest(range({DIMS})) AS i, unnest(list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM p),
h AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM p QUALIFY k < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT k, i, x FROM e JOIN h USING (v)),
{_lloyd_sql()},
s AS (SELECT k, sha256(string_agg(x, ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{ROUNDS} JOIN p USING (v) JOIN s USING (k)
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_ngram_jaccard": op2_ngram_jaccard, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_warc": op5_warc, "op6_suffix_tree": op6_suffix_tree, "op7_licenses": op7_licenses, "op8_source_mix": op8_source_mix, "op9_decontaminate": op9_decontaminate, "op10_chat_format": op10_chat_format, "op11_whitening": op11_whitening, "op12_centroids": op12_centroids, "op13_simhash": op13_simhash}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op5_warc": OP5_SQL, "op10_chat_format": OP10_SQL, "op12_centroids": OP12_SQL}
