"""WARC archives: records written by Spark's text writer, and read back by boundary-chain verification.

Writing: a row becomes a record; of equal payloads of at least least_bytes the smallest id is a response and the others
are revisits without a payload, whose header has the payload's size (rows that repeat that id are responses, too). Null
payloads are empty, null ids sort last, null and unfit URLs are left out or escaped, and payloads may be of any length. Other
columns aren't read, so their names may clash; an empty table gives no records. Files are committed by Spark, so lost executors leave no partial archive.

Reading: Spark splits the archives at the magic line, wherever it stands, within payloads as well. Tasks parse what follows
each magic into a candidate (offset, successor's offset). Within a block of a file, which a task holds whole, candidates are
led to where their chain leaves the block; pointer jumping from each file's start over blocks, with offsets joined to offsets
and jumps doubling each round, finds where blocks are entered, and only records on the chain from there are kept. Magic
inside a payload isn't reached.
Payloads that hold the magic are put together from their pieces: within a block, each piece belongs to the last record
before it, or to the last one of the blocks before. A second scan fetches the bytes of these pieces by their content (128
bits of hash and the length, per file), not by their place in a split, so the two scans may be split differently. A record
whose pieces don't make up its length raises an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.tables import bounded, saved

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
URN = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column, by built-in functions: 40 bits are 8 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Writes a record per row of df to archives under path."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    groups = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1 and first is not null")
    first = saved(groups.select("digest", "first"))
    rows = rows.join(bounded(first), "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def urn(x: Column) -> Column:
        return F.concat(F.lit(f"<{URN}"), x.cast("string"), F.lit(">"))

    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Refers-To", F.when(F.col("revisit"), urn(F.col("first")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Length", F.when(F.col("revisit"), F.col("size").cast("string"))),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _header(raw: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """(bytes before the content, fields) of what follows a magic; None if it isn't a record's header."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for row in raw[:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return (end + 4, fields) if fields.get(b"content-length", b"").isdigit() and b"warc-type" in fields else None


def _page(value: bytes | None) -> int | None:
    tail = (value or b"").strip(b"<>").removeprefix(URN.encode())
    return int(tail) if tail.lstrip(b"-").isdigit() else None


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_PIECE = "file string, block long, h1 long, h2 long, at long, bytes long, page long, kind string, refers long, digest string, length long, payload long, next long, whole boolean"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece between two magics: its place in its block, and the candidate it may be. at is from the block's first piece on."""
    sizes: dict[tuple[str, int], int] = {}
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _PIECE.split(", "))])
    for b in batches:
        rows = []
        for raw, *place in zip(b.column(0), *(b.column(k).to_pylist() for k in range(1, 5))):
            raw = raw.as_buffer().to_pybytes()
            at = sizes.setdefault((place[0], place[1]), 0)
            head = _header(raw)
            row = [*place, at, len(raw)]
            if head:
                start, f = head
                length = int(f[b"content-length"])
                whole = len(raw) >= start + length
                digest = _digest(raw[start : start + length]) if whole and f[b"warc-type"] != b"revisit" else f.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
                row += [_page(f.get(b"warc-record-id")), f[b"warc-type"].decode("utf-8", "replace"), _page(f.get(b"warc-refers-to")), digest, length, int(full) if (full := f.get(b"x-payload-length", b"")).isdigit() else length, at + start + length + len(END) + len(MAGIC), whole]
            else:
                row += [None] * 8
            rows.append(row)
            sizes[place[0], place[1]] = at + len(raw) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file, block, h1, h2): what is between two magics, with 128 bits of its hash."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    rows = text.select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumns({"h1": F.xxhash64("raw"), "h2": F.xxhash64(F.lit(MAGIC), "raw")})


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, at, next) that the chain from at = 0 reaches, by pointer jumping."""
    ends = links.select(F.col("file").alias("f"), F.col("at").alias("a"))
    jump = saved(links.join(ends, (F.col("file") == F.col("f")) & (F.col("next") == F.col("a"))).select("file", "at", "next"))
    found = saved(links.filter("at = 0").select("file", "at"))
    n = found.count()
    while n:
        more = found.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        found = saved(found.unionByName(more).distinct())
        if (now := found.count()) == n:
            break
        n = now
        second = jump.select(F.col("file").alias("f"), F.col("at").alias("a"), F.col("next").alias("n2"))
        jump = saved(jump.join(second, (F.col("file") == F.col("f")) & (F.col("next") == F.col("a"))).select("file", "at", F.col("n2").alias("next")))
    return found


def _jumped(at: np.ndarray, next_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each sorted candidate's successor or -1, where its chain leaves the block), by pointer jumping."""
    to = np.minimum(np.searchsorted(at, next_), len(at) - 1)
    to = np.where(at[to] == next_, to, -1)
    last = np.arange(len(at))
    jump = to.copy()
    while (jump >= 0).any():
        last = np.where(jump >= 0, last[jump], last)
        jump = np.where(jump >= 0, jump[jump], -1)
    return to, next_[last]


def _exits(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    _, out = _jumped(table["at"].to_numpy(), table["next"].to_numpy())
    return table.set_column(table.column_names.index("next"), "next", pa.array(out))


def _on_chain(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    to, _ = _jumped(table["at"].to_numpy(), table["next"].to_numpy())
    kept = table["entered"].to_numpy(zero_copy_only=False).copy()
    for i in range(len(to)):  # successors follow in the file
        if kept[i] and to[i] >= 0:
            kept[to[i]] = True
    return table.filter(pa.array(kept)).select(["file", "block", "at"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, page, kind, refers, digest, length, payload) of each record: length bytes follow its header; digest and payload
    (bytes) are those of what was read, or of a revisit's header.
    """
    pieces = saved(_raw(spark, path).mapInArrow(_pieces, _PIECE))
    # Blocks follow one another in a file; the text before a file's first magic is its first piece.
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("size").over(before), F.lit(0)) - len(MAGIC)).alias("base"))
    placed = pieces.join(bounded(saved(blocks)), ["file", "block"]).withColumn("at", F.col("at") + F.col("base")).withColumn("next", F.col("next") + F.col("base")).drop("base")
    records = placed.filter("next is not null")
    candidates = records.select("file", "block", "at", "next")
    ways = candidates.groupBy("file", "block").applyInArrow(_exits, "file string, block long, at long, next long")
    entered = reachable(saved(ways.select("file", "at", "next"))).withColumn("entered", F.lit(True))
    marked = candidates.join(entered, ["file", "at"], "left").withColumn("entered", F.coalesce("entered", F.lit(False))).select("file", "block", "at", "next", "entered")
    found = marked.groupBy("file", "block").applyInArrow(_on_chain, "file string, block long, at long")
    chain = records.join(saved(found), ["file", "block", "at"])
    broken = saved(chain.filter("not whole").select("file", "at", "next", "length"))
    good = chain.filter("whole").select("file", "at", "page", "kind", "refers", "digest", "length", "payload")
    if broken.isEmpty():
        return good
    # Payloads with a magic in them: their pieces are read again and put together.
    files = bounded(broken.select("file").distinct())
    record = chain.join(files, "file").select("file", "block", F.col("at").alias("piece"), F.lit(True).alias("starts"))
    own = placed.join(files, "file").select("file", "block", "h1", "h2", "bytes", F.col("at").alias("piece")).join(record, ["file", "block", "piece"], "left")
    within = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("starts"), F.col("piece"))
    last = record.groupBy("file", "block").agg(F.max("piece").alias("last"))
    carried = blocks.join(last, ["file", "block"], "left").select("file", "block", F.max("last").over(before).alias("carried"))
    own = own.withColumn("record", F.last(start, ignorenulls=True).over(within)).join(bounded(saved(carried)), ["file", "block"]).withColumn("record", F.coalesce("record", "carried"))
    span = broken.select("file", F.col("at").alias("record"), F.col("next").alias("until"), "length")
    parts = own.join(bounded(span), ["file", "record"]).filter("piece < until")
    parts = saved(parts.select("file", "h1", "h2", "bytes", "piece", "record", "length"))

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        raw = MAGIC.encode().join(x.as_buffer().to_pybytes() for x in table["raw"])
        start, _ = _header(raw)
        payload = raw[start : start + table["length"][0].as_py()]
        if len(payload) < table["length"][0].as_py():
            raise ValueError(f"a record of {table['file'][0]} at {table['record'][0]} isn't complete")
        return pa.table({"file": table["file"][:1], "at": table["record"][:1], "found": [_digest(payload)]})

    # A content is fetched once a file, however many of the file's records hold it.
    content = ["file", "h1", "h2", "bytes"]
    raw = _raw(spark, path).withColumn("bytes", F.octet_length("raw").cast("long")).join(bounded(parts.select(*content).distinct()), content, "left_semi")
    raw = raw.groupBy(*content).agg(F.any_value("raw").alias("raw"))
    digests = parts.join(raw, content, "left").groupBy("file", "record").applyInArrow(joined, "file string, at long, found string")
    lost = F.raise_error(F.concat(F.lit("no pieces of the record at "), F.col("at").cast("string"), F.lit(" of "), F.col("file")))
    digest = F.when(F.col("kind") == "revisit", F.col("digest")).when(F.col("found").isNull(), lost.cast("string")).otherwise(F.col("found"))
    rest = chain.filter("not whole").join(digests, ["file", "at"], "left").withColumn("digest", digest)
    return good.unionByName(rest.select(*good.columns))
