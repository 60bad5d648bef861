"""Benchmark decontamination with a distributed positional inverted index. DataFrame operations only.

1. Test items become windows of words. All training tokens are counted for the words of those windows.
2. Each distinct window is anchored at its rarest words; the index keeps the postings (term, document, position) of anchors,
   each with a hash of the word that follows it, so that only places where this word fits too are sent on.
3. Offset-adjusted postings of a window's anchors are intersected; what is left is compared word by word with the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, read

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words
_END = " end"  # no word holds a space: the posting whose position is the document's number of words
BROADCAST_ROWS = 200_000  # tables of terms up to this many rows are broadcast (about 20 MB); larger ones are joined by shuffle


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")  # several times faster than regexp_extract_all


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, terms): all runs of ``size`` words; an item of fewer words, but not none, is one window."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    return w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))), lambda i: F.slice("w", i, size))).alias("terms")).distinct()


@dataclass
class PositionalIndex:
    """postings: term, id, key (hash of the text), pos, next (hash of the following word); and one posting of the term ``_END`` for each document."""

    postings: DataFrame
    id_col: str

    def phrase(self, terms: list[str]) -> DataFrame:
        """(id, key, start) of each place where the indexed ``terms`` stand in a row: intersects their shifted postings."""
        rows = [(t, i) for i, t in enumerate(terms)]
        q = self.postings.sparkSession.createDataFrame(rows, "term string, off int")
        hits = self.postings.join(F.broadcast(q), "term").select("id", "key", (F.col("pos") - F.col("off")).alias("start"), "off").distinct()
        return hits.groupBy("id", "key", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(rows)).drop("n")

    def proximity(self, terms: list[str], within: int) -> DataFrame:
        """(id, key, start, end) of the shortest stretches of at most ``within`` words that hold all indexed ``terms``, in any order.

        For each posting, the latest earlier posting of every term is carried along the document by window functions.
        """
        terms = sorted(set(terms))
        w = Window.partitionBy("id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        p = self.postings.where(F.col("term").isin(terms))
        last = [F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(w) for t in terms]
        p = p.select("id", "key", F.col("pos").alias("end"), F.array(*last).alias("last"))
        p = p.where(~F.exists("last", lambda x: x.isNull())).select("id", "key", F.array_min("last").alias("start"), "end")
        return p.where(F.col("end") - F.col("start") < within).groupBy("id", "key", "start").agg(F.min("end").alias("end"))


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str = "doc_id", text: str = "text") -> PositionalIndex:
    """Postings of all words of ``docs`` that stand in ``terms`` (column term), stored in the shared folder."""
    w = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.array_append(words(F.col(text)), F.lit(_END)).alias("w"))
    # outer: no filter on the size of the array is inferred, which would make the words twice
    w = w.select("id", "key", "w", F.posexplode_outer("w").alias("pos", "term")).select("id", "key", "pos", "term", F.hash(F.get("w", F.col("pos") + 1)).alias("next"))
    wanted = terms.select("term").unionByName(terms.sparkSession.createDataFrame([(_END,)], "term string"))
    # rows that are equal in id and text are one document
    return PositionalIndex(checkpoint(w.join(_small(wanted, n_terms), "term", "left_semi")), id_col)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, anchors: int = 3, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per distinct (id, text): id, _cs_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of an item's window is hit; an item counts if one of its windows occurs. Null and
    empty texts have no words; with no items nothing is hit. Equal rows are one document and appear once here.
    """
    spark = docs.sparkSession
    by_item = checkpoint(item_windows(items, size, item_id, item_text))
    windows = by_item.select("terms").distinct().withColumn("win", F.xxhash64("terms"))
    vocab = windows.select(F.explode("terms").alias("term")).distinct()
    n_vocab = vocab.count()
    tokens = docs.select(F.explode(words(F.col(text))).alias("term"))
    freq = tokens.join(_small(vocab, n_vocab), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    each = windows.select("win", "terms", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
    each = each.withColumn("next", F.when(F.col("off") < F.col("len") - 1, F.hash(F.get("terms", F.col("off") + 1)))).drop("terms")
    # a word that the corpus lacks drops its whole window at the inner join
    counted = checkpoint(each.join(freq, "term"))
    rare = Window.partitionBy("win").orderBy(F.col("next").isNull(), "df", "off")  # the last word has no follower: only a window of one word is anchored there
    anchor = counted.select("win", "len", "term", "next", "off", F.row_number().over(rare).alias("rank"), F.count("*").over(Window.partitionBy("win")).alias("found"))
    need = F.least(F.greatest(F.col("len") - 1, F.lit(1)), F.lit(anchors))
    anchor = anchor.where(F.col("found") == F.col("len")).withColumn("need", need).where("rank <= need")
    anchor = checkpoint(anchor.select("win", "term", "next", "off", F.expr("shiftleft(1L, rank - 1)").alias("bit"), F.expr("shiftleft(1L, need) - 1").alias("all")))
    n_anchor, n_pairs = anchor.agg(F.count("*"), F.count("next")).first()
    index = build_index(docs, anchor.select("term").distinct(), n_anchor, id_col, text)
    lengths = index.postings.where(F.col("term") == _END).select("id", "key", F.col("pos").alias("n_words")).distinct()
    starts = index.postings.join(_small(anchor, n_anchor), ["term", "next"])
    if n_pairs < n_anchor:  # windows of one word
        single = anchor.where("next is null").drop("next")
        starts = starts.unionByName(index.postings.join(_small(single, n_anchor), "term"))
    starts = starts.select("id", "key", "win", (F.col("pos") - F.col("off")).alias("start"), "bit", "all").where("start >= 0")
    # each anchor sets its bit, however often rows repeat
    met = starts.groupBy("id", "key", "win", "start").agg(F.bit_or("bit").alias("bits"), F.first("all").alias("all")).where("bits = all")
    n_windows = windows.count()
    cand = met.join(_small(windows, n_windows), "win").groupBy("id", "key").agg(F.collect_list(F.struct("start", "terms")).alias("cand"))
    # the exact comparison reads only the texts of documents with candidates
    full = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text).alias("d_key"), F.col(text).alias("d_text"))
    full = full.join(cand, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_key") == F.col("key"))).select("id", "key", "d_text", "cand")
    # generated, so that words are made once a text, not once a candidate nor again for the filter
    hits = F.transform(F.array(words(F.col("d_text"))), lambda w: F.filter("cand", lambda c: F.slice(w, c["start"] + 1, F.size(c["terms"])) == c["terms"]))
    true = checkpoint(full.select("id", "key", F.explode_outer(hits).alias("hits")).where(F.size("hits") > 0))
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("s"), (h["start"] + F.size(h["terms"])).alias("e"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(spans, zero, lambda a, s: F.struct(F.greatest(a["end"], s["e"]).alias("end"), (a["n"] + F.greatest(s["e"] - F.greatest(a["end"], s["s"]), F.lit(0))).alias("n")))["n"]
    n_hit = true.select("id", "key", covered.alias("n_hit")).dropDuplicates(["id", "key"])
    found = true.select("id", "key", F.explode("hits.terms").alias("terms")).distinct().join(by_item, "terms").select("id", "key", F.col("item").cast("string").alias("item")).distinct()
    found = found.groupBy("id", "key").agg(F.sort_array(F.collect_list("item")).alias("found"))
    hit = n_hit.join(found, n_hit["id"].eqNullSafe(found["id"]) & (n_hit["key"] == found["key"])).select(n_hit["id"].alias("h_id"), n_hit["key"].alias("h_key"), "n_hit", "found")
    out = lengths.join(hit, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("key").alias("_cs_key"), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("found", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        (F.coalesce(F.col("n_hit"), F.lit(0)) > 0).alias("contaminated"),
    )


def per_row(docs: DataFrame, found: DataFrame, id_col: str, text: str, how: str = "inner", columns: list[str] | None = None) -> DataFrame:
    """Joins results per distinct (id, text) back to every row of ``docs``."""
    f = found.withColumnRenamed(id_col, "_cs_id")
    d = docs.select(F.col(id_col), F.xxhash64(text).alias("_cs_doc"))
    return d.join(f, F.col(id_col).eqNullSafe(F.col("_cs_id")) & (F.col("_cs_doc") == F.col("_cs_key")), how).drop("_cs_id", "_cs_doc", "_cs_key")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 10) -> DataFrame:
    """The rows of ``docs`` without any occurrence of an item's window, all columns as they were."""
    bad = decontaminate(docs, items, size, id_col=id_col, text=text).where("contaminated").select(F.col(id_col).alias("_cs_id"), "_cs_key")
    return docs.join(bad, F.col("_cs_id").eqNullSafe(docs[id_col]) & (F.col("_cs_key") == F.xxhash64(docs[text])), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return per_row(docs, decontaminate(docs, read(spark, sf_dir, "benchmark")), "doc_id", "text")
