"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped for scoring.

Counting: workers count bigrams per slice of text and send, for each range of the hash space, one blob of distinct bigrams
with counts. A reducer merges its range, writes it as a sorted array of hashes with counts, and passes on what the
unigram level needs: how many distinct words precede each word, and how a context's counts are spread. Nothing of
the corpus reaches the driver but a few totals per range. A bigram's hash starts with bits of its context's hash, so all
followers of a context are in one range; a context's entries number its distinct followers, not its occurrences.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LocalCopies, exchange, filesystem, mix, new_folder, read, shard_of, shards_for, slices, text_bytes, texts_of, write_file

END, START = np.uint64(xxhash.xxh3_64_intdigest(b"end of text ")), np.uint64(xxhash.xxh3_64_intdigest(b"start of text "))
_K = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(2**40 - 1)
_FLUSH = 3_000_000


def bigram_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """24 bits of the context, 40 of both: ranges of it hold whole contexts."""
    return (mix(before) & ~_LOW) | (mix(before * _K + word) & _LOW)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (lower-cased words, then one end per text), and how many tokens each text has."""
    out: list[int] = []
    n = np.empty(len(texts), np.int64)
    end, digest = int(END), xxhash.xxh3_64_intdigest
    for i, t in enumerate(texts):
        w = t.lower().split()  # bytes: A-Z only, and the six ASCII blanks only
        n[i] = len(w) + 1
        out += map(digest, w)
        out.append(end)
    return np.array(out, np.uint64), n


def contexts_of(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    if len(tokens):
        before[1:] = tokens[:-1]
        before[np.cumsum(n) - n] = START
    return before


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys, and where each distinct key starts in it."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<q", a.nbytes) + a.tobytes() for a in arrays)


def _unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        (n,) = struct.unpack_from("<q", blob, at)
        out.append(np.frombuffer(blob, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def _small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes; those of 255 and more aside, with their places."""
    big = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), big.astype(np.int32), counts[big].astype(np.int64)


def _large(small: np.ndarray, at: np.ndarray, big: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[at] = big
    return out


@dataclass(frozen=True)
class KneserNey:
    """folder: URI of the arrays. d2, d1: discounts for counts of 1, 2, 3 and more of bigrams and of the words' contexts."""

    folder: str
    shards: int
    n_tokens: int
    n_types: int
    n_bigrams: int
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    left: float  # mass that the word level leaves for the uniform one

    @property
    def unknown(self) -> float:
        return self.left / (self.n_types + 1)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's estimates from how many n-grams occur 1, 2, 3, 4 times; halves where the corpus is too small for them."""
    if min(n[:4]) == 0:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(min(max(x, 0.01), k + 0.99) for k, x in enumerate(d))  # type: ignore[return-value]


def train(docs: DataFrame, text: str = "text", shard_bytes: int = 4 << 20) -> KneserNey:
    """Counts all texts of ``docs``. An empty table gives a model that knows no word: each has the uniform probability."""
    spark = docs.sparkSession
    shards = shards_for(text_bytes(docs, text), shard_bytes)
    folder = new_folder(spark, "kneser-ney")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            word, before = (np.concatenate(x) for x in zip(*held, strict=True))
            key = bigram_hash(before, word)
            order, at = _group(key)
            n = np.diff(np.append(at, len(order)))
            first = order[at]
            word, before, shard = word[first], before[first], shard_of(key[first], shards)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            ids, blobs = [], []
            for s in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[s], cuts[s + 1]
                own = before[a:b]
                head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                ids.append(int(s))
                blobs.append(_pack(own[head], np.diff(np.append(head, b - a)).astype(np.int32), word[a:b], *_small(n[a:b])))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for batch in slices(batches, 0):
            tokens, n = tokens_of(texts_of(batch, 0))
            held.append((tokens, contexts_of(tokens, n)))
            size += len(tokens)
            if size >= _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def merge(shard: int, blobs: list[bytes]) -> pa.Table:
        parts = []
        for b in blobs:
            heads, runs, word, small, at, big = _unpack(b, np.uint64, np.int32, np.uint64, np.uint8, np.int32, np.int64)
            parts.append((np.repeat(heads, runs), word, _large(small, at, big)))
        before, word, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = bigram_hash(before, word)
        order, at = _group(key)
        n = np.add.reduceat(n[order], at)
        first = order[at]
        key, before, word = key[first], before[first], word[first]
        write_file(f"{folder}/bigram-{shard}", _pack(key, np.minimum(n, 2**32 - 1).astype(np.uint32)))
        # for the word level: each word's occurrences and distinct predecessors; each context's followers by their count
        w_order, w_at = _group(word)
        w = word[w_order[w_at]]
        w_n, w_types = np.add.reduceat(n[w_order], w_at), np.diff(np.append(w_at, len(w_order)))
        c_order, c_at = _group(before)
        c = before[c_order[c_at]]
        by = [np.add.reduceat((x[c_order]).astype(np.int64), c_at) for x in (n, n == 1, n == 2, n >= 3)]
        ids, out = [], []
        w_shard, c_shard = shard_of(w, shards), shard_of(c, shards)
        for s in np.union1d(w_shard, c_shard):
            a, b = np.searchsorted(w_shard, [s, s + 1])
            d, e = np.searchsorted(c_shard, [s, s + 1])
            ids.append(int(s))
            out.append(_pack(w[a:b], *_small(w_n[a:b]), *_small(w_types[a:b]), c[d:e], *(y for x in by for y in _small(x[d:e]))))
        totals = [len(key), *(int((n == k).sum()) for k in (1, 2, 3, 4))]
        return pa.table({"shard": pa.array([*ids, -1], pa.int32()), "blob": pa.array([*out, struct.pack("<5q", *totals)], pa.binary())})

    def words(shard: int, blobs: list[bytes]) -> pa.Table:
        if shard < 0:
            total = np.sum([struct.unpack("<5q", b) for b in blobs], axis=0)
            return pa.table({"level": pa.array([2], pa.int32()), "totals": pa.array([total.tolist()], pa.list_(pa.int64()))})
        kinds = [np.uint64, *(np.uint8, np.int32, np.int64) * 2, np.uint64, *(np.uint8, np.int32, np.int64) * 4]
        ws, cs = [], []
        for b in blobs:
            x = _unpack(b, *kinds)
            ws.append((x[0], _large(*x[1:4]), _large(*x[4:7])))
            cs.append((x[7], *(_large(*x[i : i + 3]) for i in (8, 11, 14, 17))))
        w, w_n, w_types = (np.concatenate(x) for x in zip(*ws, strict=True))
        c, *c_by = (np.concatenate(x) for x in zip(*cs, strict=True))
        keys = np.unique(np.concatenate((w, c)))
        table = np.zeros((6, len(keys)), np.int64)
        for row, (k, v) in enumerate([(w, w_n), (w, w_types), *((c, v) for v in c_by)]):
            np.add.at(table[row], np.searchsorted(keys, k), v)
        write_file(f"{folder}/word-{shard}", _pack(keys, *table.astype(np.uint64)))
        types = table[1]
        totals = [int(table[0].sum()), int((table[0] > 0).sum()), int(types.sum()), *(int((types == k).sum()) for k in (1, 2, 3, 4)), int((types >= 3).sum())]
        return pa.table({"level": pa.array([1], pa.int32()), "totals": pa.array([totals], pa.list_(pa.int64()))})

    counted = exchange(docs.select(text), count, merge, "shard int, blob binary")
    out = counted.groupBy("shard").applyInArrow(lambda t: words(t.column("shard")[0].as_py(), t.column("blob").to_pylist()), "level int, totals array<long>")
    sums = {r.level: [r[f"t{i}"] or 0 for i in range(8)] for r in out.groupBy("level").agg(*(F.sum(F.get("totals", F.lit(i))).alias(f"t{i}") for i in range(8))).collect()}
    two, one = sums.get(2, [0] * 8), sums.get(1, [0] * 8)
    d2, d1 = discounts(two[1:5]), discounts(one[3:7])
    pairs = one[2]
    left = (d1[0] * one[3] + d1[1] * one[4] + d1[2] * one[7]) / pairs if pairs else 1.0
    return KneserNey(folder, shards, one[0], one[1], two[0], d2, d1, left)


class Scorer:
    """Maps a model's arrays into memory and looks up many hashes at once, in sorted order."""

    def __init__(self, model: KneserNey):
        self.m, self.copies, self.maps = model, LocalCopies(), {}
        fs, path = filesystem(model.folder)
        self.files = {f.base_name for f in fs.get_file_info(_selector(path))}

    def _arrays(self, name: str, kinds: tuple) -> list[np.ndarray] | None:
        if name not in self.maps:
            if name not in self.files:
                self.maps[name] = None
            else:
                raw = np.memmap(self.copies.path(f"{self.m.folder}/{name}"), np.uint8, "r")
                out, at = [], 0
                for t in kinds:
                    n = int(raw[at : at + 8].view("<i8")[0])
                    out.append(raw[at + 8 : at + 8 + n].view(t))
                    at += 8 + n
                self.maps[name] = out
        return self.maps[name]

    def _look(self, kind: str, keys: np.ndarray, types: tuple) -> list[np.ndarray]:
        """Values of sorted distinct keys, 0 where there is none."""
        out = [np.zeros(len(keys), t) for t in types]
        cuts = np.searchsorted(shard_of(keys, self.m.shards), np.arange(self.m.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if (got := self._arrays(f"{kind}-{s}", (np.uint64, *types))) is None or not len(got[0]):
                continue
            k = keys[cuts[s] : cuts[s + 1]]
            at = np.minimum(np.searchsorted(got[0], k), len(got[0]) - 1)
            hit = got[0][at] == k
            for o, v in zip(out, got[1:], strict=True):
                o[cuts[s] : cuts[s + 1]] = np.where(hit, v[at], 0)
        return out

    def probabilities(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(word | before) and the word's count in training, for arrays of token hashes."""
        m = self.m
        if not m.n_bigrams:
            return np.full(len(word), 1.0), np.zeros(len(word), np.int64)
        d1, d2 = np.array([0, *m.d1]), np.array([0, *m.d2])
        words, back = np.unique(np.concatenate((word, before)), return_inverse=True)
        n, types, total, c1, c2, c3 = (x.astype(np.int64) for x in self._look("word", words, (np.uint64,) * 6))
        low = (types - d1[np.minimum(types, 3)]) / m.n_bigrams + m.unknown
        gamma = np.where(total > 0, (m.d2[0] * c1 + m.d2[1] * c2 + m.d2[2] * c3) / np.maximum(total, 1), 1.0)
        w, b = back[: len(word)], back[len(word) :]
        pairs, of = np.unique(bigram_hash(before, word), return_inverse=True)
        (c,) = self._look("bigram", pairs, (np.uint32,))
        c = c.astype(np.int64)[of]
        high = (c - d2[np.minimum(c, 3)]) / np.maximum(total[b], 1)
        return high + gamma[b] * low[w], n[w]


def _selector(path: str):
    from pyarrow.fs import FileSelector

    return FileSelector(path)


def held_out(id_col: Column, of: int = 7, is_: int = 2) -> Column:
    """crc32 of the id as text modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % of == is_


def score(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) and perplexity.

    No shuffle. Null and empty texts are one end token. base_score is that of add-one smoothed word counts.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        try:
            for batch in slices(batches):
                tokens, n = tokens_of(texts_of(batch))
                p, c = scorer.probabilities(contexts_of(tokens, n), tokens)
                starts = np.cumsum(n) - n
                add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                base = np.log10((c + 1) / (model.n_tokens + model.n_types + 1))
                s = add(np.log10(p))
                cols = [batch.column(0), pa.array(n), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(n), model.n_tokens)), pa.array(add(base)), pa.array(s), pa.array(10 ** (-s / n))]
                yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            scorer.copies.close()

    names = [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    return docs.select(id_col, text).mapInArrow(work, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
