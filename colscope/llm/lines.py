"""Line dedup by content-defined chunks of lines. DataFrame operations only.

A rolling hash over the hashes of the last lines decides where a chunk ends, so an inserted line shifts boundaries only near
itself, and every chunk has two lines or more. Chunks that stand elsewhere too are found by hash and then compared by their
bytes; the first copy stays. With ``blocks``, so are neighbouring lines two by two: what a chunk shares with a repeated passage
only in part goes too, however the passage is glued to its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read

_NULL_FIRST = -(2**63)
BROADCAST_DOCS = 500_000  # up to so many 16-byte keys of documents are broadcast
BROADCAST_HASHES = 1_000_000  # up to so many 8-byte hashes of repeated chunks are broadcast; more are joined by shuffle


def _cut(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 2, every: int = 4, longest: int = 64, blocks: bool = False) -> DataFrame:
    """(_cs_id, _cs_key, l: lines, h: their hashes, p: start and len of every chunk of two lines or more); lines count from 0.

    A chunk ends after line i if the hash of the hashes of lines i-window+1 .. i is 0 modulo ``every`` and that of the line before
    is not, unless a single line would be left at either end of the text; after ``longest`` lines; and at the end of the text.
    With ``blocks``, each line that is not blank and the next such line, with the blank ones between, are a chunk as well.
    It is all done inside the row: no shuffle, no explosion into lines.
    """
    d = docs.where(F.col(text).contains("\n")).select(F.col(id_col).alias("_cs_id"), F.xxhash64(text).alias("_cs_key"), F.split(text, "\n", -1).alias("l"))
    d = d.withColumn("h", F.transform("l", lambda x: F.xxhash64(x)))
    last = F.size("l") - 1
    at = lambda i, k: F.coalesce(F.get("h", i - k), F.lit(0).cast("long"))
    ends = lambda i: F.pmod(F.xxhash64(*(at(i, k) for k in range(window))), F.lit(every)) == 0
    cut = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((i > 0) & (i < last - 1) & ends(i) & ~ends(i - 1)))
    d = d.withColumn("cut", cut)
    runs = F.transform("cut", lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get("cut", k - 1) + 1).alias("s"), e.alias("e")))
    # a single line left over takes one from the piece before it
    begin = lambda s, r: F.when((s == r["e"]) & (s > r["s"]), s - 1).otherwise(s)
    end = lambda s, r: F.when(s + longest == r["e"], s + longest - 2).otherwise(F.least(s + longest - 1, r["e"]))
    parts = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(r["s"], r["e"], F.lit(longest)), lambda s: F.struct(begin(s, r).alias("start"), (end(s, r) - begin(s, r) + 1).alias("len")))))
    d = d.withColumn("p", F.filter(parts, lambda p: p["len"] >= 2))
    if blocks:
        d = d.withColumn("full", F.filter(F.sequence(F.lit(0), last), lambda i: F.trim(F.translate(F.get("l", i), "\t\r", "")) != ""))
        two = F.transform("full", lambda s, k: F.struct(s.alias("start"), (F.get("full", k + 1) - s + 1).alias("len")))
        d = d.withColumn("p", F.array_union("p", F.filter(two, lambda p: p["len"].isNotNull())))
    return d.select("_cs_id", "_cs_key", "l", "h", "p")


def _texts(d: DataFrame, spans: str, *more: str) -> DataFrame:
    """A row for each of the ``spans`` (start, len and the fields ``more``) of a row, with the text of its lines."""
    chunk = lambda p: F.array_join(F.slice("l", p["start"] + 1, p["len"]), "\n").alias("chunk")
    each = F.transform(spans, lambda p: F.struct(*(p[c].alias(c) for c in ("start", "len", *more)), chunk(p)))
    return d.select("_cs_id", "_cs_key", F.explode(each).alias("c")).select("_cs_id", "_cs_key", "c.*")


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(_cs_id, _cs_key, start, len, chunk) of every chunk, see _cut."""
    return _texts(_cut(docs, id_col, text, **how), "p")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(_cs_id, _cs_key, start, len) of all chunks but the first copy of each, in the order of id (null first), hash of the text, line."""
    hashes = F.transform("p", lambda p: F.struct(p["start"].alias("start"), p["len"].alias("len"), F.xxhash64(F.slice("h", p["start"] + 1, p["len"])).alias("h")))
    hashed = _cut(docs, id_col, text, **how).select("_cs_id", "_cs_key", F.explode(hashes).alias("c")).select("_cs_id", "_cs_key", "c.*")
    often = checkpoint(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    often = F.broadcast(often) if often.count() <= BROADCAST_HASHES else often
    # up to here only hashes of hashes of lines; the text is made of those chunks only whose hash occurs twice
    hits = hashed.join(often, "h", "left_semi").groupBy("_cs_id", "_cs_key").agg(F.collect_set(F.struct("start", "len", "h")).alias("hits")).withColumnRenamed("_cs_id", "hit_id").withColumnRenamed("_cs_key", "hit_key")
    rows = docs.where(F.col(text).contains("\n")).select(F.col(id_col).alias("_cs_id"), F.xxhash64(text).alias("_cs_key"), F.col(text).alias("t"))
    hits = checkpoint(hits)
    keys = hits.select("hit_id", "hit_key")
    found = F.col("_cs_id").eqNullSafe(F.col("hit_id")) & (F.col("_cs_key") == F.col("hit_key"))
    if keys.count() <= BROADCAST_DOCS:  # then only texts with such chunks are shuffled
        rows = rows.join(F.broadcast(keys), found, "left_semi")
    rows = rows.join(hits, found).select("_cs_id", "_cs_key", F.split("t", "\n", -1).alias("l"), "hits")
    some = _texts(rows, "hits", "h").where(F.trim(F.translate("chunk", "\n\t\r", "")) != "")
    # grouping by the text itself is the comparison of bytes
    some = some.withColumn("at", F.struct(F.coalesce(F.col("_cs_id").cast("long"), F.lit(_NULL_FIRST)).alias("o"), F.col("_cs_key").alias("k"), F.col("start").alias("s")))
    first = some.groupBy("h", "chunk").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("fh"), F.col("chunk").alias("fc"), "first")
    return some.join(first, (F.col("h") == F.col("fh")) & (F.col("chunk") == F.col("fc")) & (F.col("at") != F.col("first"))).select("_cs_id", "_cs_key", "start", "len")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", drop_emptied: bool = True, **how) -> DataFrame:
    """``docs`` without repeated chunks of lines, same columns; ids must be integers.

    Rows that lose nothing are returned as they are, null and empty texts and single lines among them. A row of which nothing
    but white space is left is dropped, or kept with what is left. Rows equal in id and text are one document: they lose and keep
    the same lines. ``n_chars``, where there is such a column, is set to the new length.
    """
    lost = repeated_chunks(docs, id_col, text, **how).groupBy("_cs_id", "_cs_key").agg(F.collect_set(F.struct("start", "len")).alias("_cs_lost"))
    lost = lost.withColumnRenamed("_cs_id", "_cs_lid").withColumnRenamed("_cs_key", "_cs_lkey")
    d = docs.withColumn("_cs_k", F.xxhash64(text)).join(lost, F.col(id_col).eqNullSafe(F.col("_cs_lid")) & (F.col("_cs_k") == F.col("_cs_lkey")), "left")
    gone = F.flatten(F.transform("_cs_lost", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1)))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n", -1)) - 1), F.col("_cs_gone")), lambda i: F.get(F.col("_cs_lines"), i)), "\n")
    hit = F.col("_cs_lost").isNotNull()
    d = d.withColumn("_cs_gone", F.when(hit, gone)).withColumn("_cs_lines", F.when(hit, F.split(text, "\n", -1)))
    d = d.withColumn("_cs_new", F.when(hit, left).otherwise(F.col(text)))
    if drop_emptied:
        d = d.where(~hit | (F.trim(F.translate("_cs_new", "\n\t\r", "")) != ""))
    changed = {text: F.col("_cs_new")}
    if "n_chars" in docs.columns and text != "n_chars":
        changed["n_chars"] = F.when(hit, F.char_length("_cs_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines and bytes before and after, and the digest of what is left."""
    n = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), 0).otherwise(F.size(F.split(c, "\n", -1))).cast("long")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", n("text").alias("n_lines"))
    out = dedup_lines(docs, drop_emptied=False, blocks=True)
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - n("text")).alias("n_removed"), F.octet_length(left).cast("long").alias("kept_bytes"), F.sha2(left.cast("binary"), 256).alias("kept_sha256"))
