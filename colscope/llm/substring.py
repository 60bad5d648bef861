"""Substring dedup by relative Lempel-Ziv parsing over words.

Reference blocks are the anchors' hash ranges (see repeats): a block holds the earliest copy of every region that is routed
to it, indexed by windows of words. Each region, in corpus order, is factored against the reference that came before it:
at each place the earliest match is taken and followed in the reference as far as it goes; the parse goes on with the window
that straddles the factor's end, so no duplicate hides between two factors. Factors of a window or more become spans. Factoring
every document against every block would take time in the square of the corpus; the anchors give the blocks in which a factor of
a full window can lie at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, texts_of
from .decontam import per_row
from .repeats import Kind, Region, Runs, covered, finish, prepared, repeated_spans


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    out: list[int] = []
    n = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        n[i] = len(w)
        out += map(xxhash.xxh3_64_intdigest, w)
    return np.array(out, np.uint64), n


class Reference:
    """A block's reference text: regions of words, and where each of their windows first stands (region, place)."""

    def __init__(self, window: int):
        self.window, self.texts, self.places = window, [], {}

    def add(self, words: list[bytes]) -> None:
        for i in range(len(words) - self.window + 1):
            self.places.setdefault(tuple(words[i : i + self.window]), (len(self.texts), i))
        self.texts.append(words)

    def factors(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """The greedy parse of ``words`` relative to the reference: (start, length, region, place) of its factors of a window or more.

        At each place the reference is looked up and the match followed in it as far as it goes. A factor's last window may go on
        otherwise elsewhere in the reference, so the parse goes on with the window after it, which straddles the boundary.
        """
        at, last = 0, len(words) - self.window
        while at <= last:
            if (found := self.places.get(tuple(words[at : at + self.window]))) is None:
                at += 1
                continue
            text, place = self.texts[found[0]], found[1]
            n, most = self.window, min(len(words) - at, len(text) - place)
            while n < most and words[at + n] == text[place + n]:
                n += 1
            yield at, n, *found
            at += n - self.window + 1


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text: str = "text", shard_bytes: int = 16 << 20, with_text: bool = False) -> DataFrame:
    """Per distinct (id, text): id, _cs_key, n_words, n_removed, kept_sha256 (and kept_text on request).

    A word is removed if a run of ``window`` words that covers it also starts earlier: in a smaller id (null first; then by hash of
    the text), or before in the same text. Runs are judged on the input. Ids must be integers; an empty table gives no rows; texts are taken whole. Null, empty and short texts lose nothing.
    """
    kind = Kind(window, max(1, window * 2 // 5), word_tokens)

    def region(texts: list[bytes], runs: Runs) -> list[bytes]:
        words, of, out = [], -1, []
        for d, s, c in zip(runs.doc.tolist(), runs.start.tolist(), runs.count.tolist(), strict=True):
            if d != of:
                words, of = texts[d].split(), d
            out.append(b" ".join(words[s : s + c + window - 1]))
        return out

    def solve(groups: list[list[Region]]) -> Iterator[tuple[tuple[int, int, int], int, int]]:
        for regions in groups:
            reference = Reference(window)
            for r in regions:  # in the order of their first places
                if len(regions) > 1:
                    words = r.text.split(b" ")
                    for start, n, *_ in reference.factors(words):
                        yield r.places[0], start, start + n - window
                    reference.add(words)
                for p in r.places[1:]:
                    yield p, 0, r.count - 1

    d = prepared(docs, id_col, text)
    out = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def result(words: list[bytes], n: int) -> tuple:
        kept = b" ".join(words)
        return (n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] * with_text))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows = [result(w, len(w)) for w in map(bytes.split, texts_of(batch, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, zip(*rows, strict=True))], ["_cs_id", "_cs_key", *(c.split()[0] for c in out.split(", "))])

    def rewrite(raw: bytes, spans: bytes) -> tuple:
        words = raw.split()
        gone = covered(spans, len(words), window)
        return result([w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words))

    some, spans = repeated_spans(d, kind, region, solve, True, shard_bytes)
    base = d.select("_cs_id", "_cs_key", "_cs_text").mapInArrow(whole, f"_cs_id long, _cs_key long, {out}").dropDuplicates(["_cs_id", "_cs_key"])
    return finish(docs, some, spans, base, rewrite, out, id_col)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return per_row(docs, dedup_substrings(docs), "doc_id", "text")
