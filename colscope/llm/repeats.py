"""Finding repeated windows of tokens over a whole corpus, exactly and without comparing all pairs.

Any window of W tokens holds W-k+1 k-grams; the one with the smallest hash is its anchor. Equal windows have equal anchors, so

1. anchors that occur more than once in the corpus are found by hash ranges (about 2/(W-k+2) entries per token);
2. only windows under repeated anchors travel, as short regions of text, to the block of their anchor;
3. a block compares its regions exactly by the operator's own method and returns spans of window starts.

Equal regions are merged before they travel and again in the block, so a passage that a third of all documents share costs one
region per task. Hashes only route: what is removed is decided by comparing text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, checkpoint, exchange, long_id, mix, shard_of, shards_for, slices, text_bytes, texts_of

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_B_INV = np.uint64(pow(int(_B), -1, 2**64))
_POS = 24  # bits for a position in a section
_SECTION = 1 << 18  # tokens hashed at a time: a bound on memory, the result does not depend on it
_FLUSH = 400_000
BROADCAST_DOCS = 500_000  # up to so many document keys, of 8 or 16 bytes each, are broadcast; more are joined by shuffle


@dataclass(frozen=True)
class Kind:
    """tokens: texts to (one 64-bit value per token, tokens per text). cut: (text, token starts and ends) handled by the operator."""

    window: int
    gram: int
    tokens: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


@dataclass
class Runs:
    """Runs of consecutive window starts with one anchor: text index, first start, how many, anchor minus first start, anchor hash."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    off: np.ndarray
    hash: np.ndarray

    def places(self) -> np.ndarray:
        """Where the anchors lie in their texts. A seam of sections can split a run but does not move its anchor."""
        return self.start + self.off


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs_of(x: np.ndarray, n: np.ndarray, kind: Kind) -> Runs:
    """Anchors of all windows that lie inside one text."""
    w, k = kind.window, kind.gram
    span = w - k + 1
    ends = np.cumsum(n)
    out = []
    for a in range(0, max(len(x) - w + 1, 0), _SECTION):
        part = x[a : a + _SECTION + w - 1]
        m = len(part) - w + 1
        up, down = _powers(_B, len(part)), _powers(_B_INV, len(part) - k + 1)
        h = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * up, dtype=np.uint64)))
        h = mix((h[k:] - h[:-k]) * down)
        v = (h & ~np.uint64(2**_POS - 1)) | np.arange(len(h), dtype=np.uint64)
        got = 1
        while got * 2 <= span:
            v = np.minimum(v[:-got], v[got:])
            got *= 2
        v = np.minimum(v[:m], v[span - got : span - got + m])
        at = (v & np.uint64(2**_POS - 1)).astype(np.int64)
        s = np.arange(m)
        doc = np.searchsorted(ends, s + a, side="right")
        ok = s + a + w <= ends[doc]
        new = ok.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new)
        last = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
        out.append((doc[first], first + a - (ends - n)[doc[first]], last - first + 1, at[first] - first, h[at[first]]))
    return Runs(*(np.concatenate(c) if out else np.zeros(0, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (np.int64,) * 4 + (np.uint64,), strict=True)))


def _rows_by(key: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    for a, b in zip(at, np.append(at, len(k))[1:], strict=True):
        yield (k[a], *(v[order[a:b]] for v in values))


def _by_document(found: DataFrame, rows: Callable[[list[bytes]], pa.Table], schema: str) -> DataFrame:
    """What all shards have found, once more dealt out: (shard int, blob binary) by shards of the documents, so that a document gets one row."""
    return found.groupBy("shard").applyInArrow(lambda t: rows(t.column("blob").to_pylist()), schema)


def prepared(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_cs_id (null as the smallest number), _cs_key (hash of the text), _cs_ref (both in 64 bits), text."""
    d = docs.select(long_id(docs, id_col).alias("_cs_id"), F.xxhash64(text).alias("_cs_key"), F.col(text).alias("_cs_text"))
    return d.select("_cs_id", "_cs_key", F.xxhash64("_cs_id", "_cs_key").alias("_cs_ref"), "_cs_text")


def repeated_anchors(docs: DataFrame, kind: Kind, shards: int) -> DataFrame:
    """(_cs_ref, ords): which anchors of a document (by their place in it) occur elsewhere too. docs: as prepared()."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, ref, o = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, ref, o = h[order], ref[order], o[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            twice = np.add.reduceat(_differs(at, ref, o), at) > 0
            ids, blobs = [], []
            # known here to be repeated: all its places are answered at once, and one entry stands for them in its shard
            local = np.repeat(twice, np.diff(np.append(at, len(h))))
            if local.any():
                own = ref[local].view(np.uint64)
                for s, r, q in _rows_by((own % np.uint64(shards)).astype(np.int64), ref[local], o[local]):
                    ids.append(-1 - int(s))
                    blobs.append(r.tobytes() + q.tobytes())
            shard = shard_of(h[at], shards)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                i = at[cuts[s] : cuts[s + 1]]
                ids.append(int(s))
                blobs.append(h[i].tobytes() + ref[i].tobytes() + o[i].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for batch in slices(batches):
            x, n = kind.tokens(texts_of(batch))
            runs = runs_of(x, n, kind)
            ref = np.asarray(batch.column(0), dtype=np.int64)
            # an anchor is the smallest of many hashes: mixed again, they spread over all shards
            held.append((mix(runs.hash), ref[runs.doc], runs.places().astype(np.int32)))
            size += len(runs.doc)
            if size >= _FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def meet(shard: int, blobs: list[bytes]) -> pa.Table:
        if shard < 0:
            n = [len(b) // 12 for b in blobs]
            ref = np.concatenate([np.frombuffer(b, np.int64, k) for b, k in zip(blobs, n, strict=True)])
            o = np.concatenate([np.frombuffer(b, np.int32, k, 8 * k) for b, k in zip(blobs, n, strict=True)])
        else:
            n = [len(b) // 20 for b in blobs]
            h = np.concatenate([np.frombuffer(b, np.uint64, k) for b, k in zip(blobs, n, strict=True)])
            ref = np.concatenate([np.frombuffer(b, np.int64, k, 8 * k) for b, k in zip(blobs, n, strict=True)])
            o = np.concatenate([np.frombuffer(b, np.int32, k, 16 * k) for b, k in zip(blobs, n, strict=True)])
            order = np.argsort(h)
            h, ref, o = h[order], ref[order], o[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            twice = np.add.reduceat(_differs(at, ref, o), at) > 0
            some = np.repeat(twice, np.diff(np.append(at, len(h))))
            ref, o = ref[some], o[some]
        out = [(int(s), r.tobytes() + q.tobytes()) for s, r, q in _rows_by((ref.view(np.uint64) % np.uint64(shards)).astype(np.int64), ref, o)]
        return pa.table({"shard": pa.array([s for s, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    def merge(blobs: list[bytes]) -> pa.Table:
        n = [len(b) // 12 for b in blobs]
        ref = np.concatenate([np.frombuffer(b, np.int64, k) for b, k in zip(blobs, n, strict=True)])
        o = np.concatenate([np.frombuffer(b, np.int32, k, 8 * k) for b, k in zip(blobs, n, strict=True)])
        out = [(int(r), np.unique(q).tobytes()) for r, q in _rows_by(ref, o)]
        return pa.table({"_cs_ref": pa.array([r for r, _ in out], pa.int64()), "ords": pa.array([q for _, q in out], pa.binary())})

    met = exchange(docs.select("_cs_ref", "_cs_text"), find, meet, "shard int, blob binary")
    return _by_document(met, merge, "_cs_ref long, ords binary")


def _differs(at: np.ndarray, ref: np.ndarray, o: np.ndarray) -> np.ndarray:
    """1 where an entry is another place than the first of its group: a repeated row is no second place."""
    out = np.ones(len(ref), np.int64)
    out[1:] = (ref[1:] != ref[:-1]) | (o[1:] != o[:-1])
    out[at] = 0
    return out


@dataclass
class Region:
    """A run's text with all its places (id, key, first start). off, count: as in Runs."""

    hash: int
    off: int
    count: int
    text: bytes
    places: list[tuple[int, int, int]]
    more: bool = False  # some task has seen it at two places and answered for all of them but the first


#: From all regions of a block, those of one anchor side by side, to (place, first window, last window) spans.
Solve = Callable[[list[list[Region]]], Iterator[tuple[tuple[int, int, int], int, int]]]


def repeated_spans(docs: DataFrame, kind: Kind, region: Callable[[list[bytes], Runs], list[bytes]], solve: Solve, keep_first: bool, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, spans): prepared rows that may lose something; and (_cs_id, _cs_key, spans: int32 pairs of window starts)."""
    shards = shards_for(text_bytes(docs, "_cs_text"), shard_bytes)
    marks = checkpoint(repeated_anchors(docs, kind, shards))
    refs = marks.select("_cs_ref")
    few = refs.count() <= BROADCAST_DOCS
    some = docs.join(F.broadcast(refs) if few else refs, "_cs_ref", "left_semi")
    work = some.join(marks, "_cs_ref").select("_cs_id", "_cs_text", "_cs_key", "ords")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            x, n = kind.tokens(texts)
            runs = runs_of(x, n, kind)
            o = runs.places()
            starts = np.searchsorted(runs.doc, np.arange(len(texts) + 1))
            want = np.zeros(len(o), bool)
            for d, ords in enumerate(batch.column(3).to_pylist()):
                i = np.frombuffer(ords, np.int32)
                own = o[starts[d] : starts[d + 1]]  # ascending
                a, z = np.searchsorted(own, i), np.searchsorted(own, i, side="right")
                if (a == z).any():
                    raise ValueError("a repeated anchor is not in its text")
                want[starts[d] + a] = True
                for j in np.flatnonzero(z - a > 1):  # split by a seam
                    want[starts[d] + a[j] : starts[d] + z[j]] = True
            runs = Runs(*(getattr(runs, f)[want] for f in ("doc", "start", "count", "off", "hash")))
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            seen: dict[tuple, list] = {}
            for d, s, c, f, h, t in zip(runs.doc.tolist(), runs.start.tolist(), runs.count.tolist(), runs.off.tolist(), runs.hash.tolist(), region(texts, runs), strict=True):
                seen.setdefault((h, f, t), [c]).append((ids[d], keys[d], s))
            mine, sends = [], {}
            place = dict(zip(runs.hash.tolist(), shard_of(mix(runs.hash), shards).tolist(), strict=True))
            for (h, f, t), (c, *places) in seen.items():
                if len(places) > 1:
                    places = sorted(set(places))
                    for p in places[1:] if keep_first else places if len(places) > 1 else ():
                        mine.append((*p, p[2] + c - 1))
                sends.setdefault(place[h], []).append((h, f, c, t, places[0], len(places) > 1))
            out_ids, blobs = [], []
            for s, entries in sends.items():
                head = np.array([(e[0] - 2**64 if e[0] >= 2**63 else e[0], e[1], e[2], *e[4], len(e[3]), e[5]) for e in entries], np.int64)
                out_ids.append(s)
                blobs.append(len(entries).to_bytes(8, "little") + head.tobytes() + b"".join(e[3] for e in entries))
            if mine:
                own = np.array(mine, np.int64)
                for s, rows in _rows_by(own[:, 1] % shards, own):
                    out_ids.append(-1 - int(s))
                    blobs.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def block(shard: int, blobs: list[bytes]) -> pa.Table:
        if shard < 0:
            found = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 4) for b in blobs])
        else:
            groups: dict[int, dict[tuple, Region]] = {}
            for b in blobs:
                n = int.from_bytes(b[:8], "little")
                head = np.frombuffer(b, np.int64, n * 8, 8).reshape(n, 8)
                at = 8 + n * 64
                for h, f, c, i, k, s, size, more in head.tolist():
                    t = b[at : at + size]
                    at += size
                    r = groups.setdefault(h, {}).setdefault((f, t), Region(h, f, c, t, []))
                    r.places.append((i, k, s))
                    r.more |= bool(more)
            for g in groups.values():
                for r in g.values():
                    if len(r.places) > 1:
                        r.places = sorted(set(r.places))
            spans = [(*p, p[2] + a, p[2] + z) for p, a, z in solve([sorted(g.values(), key=lambda r: r.places[0]) for g in groups.values()])]
            found = np.array(spans, np.int64).reshape(-1, 5)[:, [0, 1, 3, 4]]
        out = [(int(s), r.tobytes()) for s, r in _rows_by(found[:, 1] % shards, found)]
        return pa.table({"shard": pa.array([s for s, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    def merge(blobs: list[bytes]) -> pa.Table:
        found = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 4) for b in blobs])
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        edge = np.flatnonzero(np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))) if len(found) else np.zeros(0, np.int64)
        cuts = list(zip(edge.tolist(), np.append(edge, len(found))[1:].tolist(), strict=True))
        return pa.table({"_cs_id": pa.array(found[edge, 0]), "_cs_key": pa.array(found[edge, 1]), "spans": pa.array([found[a:b, 2:].astype(np.int32).tobytes() for a, b in cuts], pa.binary())})

    spans = _by_document(exchange(work, cut, block, "shard int, blob binary"), merge, "_cs_id long, _cs_key long, spans binary")
    return some.select("_cs_id", "_cs_key", "_cs_text"), spans


def covered(spans: bytes, length: int, window: int) -> np.ndarray:
    """Which of ``length`` tokens lie in a window that starts in one of the spans."""
    edge = np.zeros(length + 1, np.int32)
    s = np.frombuffer(spans, np.int32).reshape(-1, 2)
    np.add.at(edge, s[:, 0], 1)
    np.add.at(edge, s[:, 1] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def finish(docs: DataFrame, candidates: DataFrame, spans: DataFrame, base: DataFrame, rewrite: Callable[[bytes, bytes], tuple], out: str, id_col: str) -> DataFrame:
    """base: (_cs_id, _cs_key, columns of ``out``) of every row as if it lost nothing; rows with spans get rewrite()'s."""
    names = [c.split()[0] for c in out.split(", ")]
    lost = checkpoint(spans)
    few = lost.count() <= BROADCAST_DOCS
    keys = lost.select("_cs_id", "_cs_key")
    hit = candidates.join(F.broadcast(keys) if few else keys, ["_cs_id", "_cs_key"], "left_semi").join(lost, ["_cs_id", "_cs_key"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows = [rewrite(t, own) for t, own in zip(texts_of(batch, 2), batch.column(3).to_pylist(), strict=True)]
            cols = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["_cs_id", "_cs_key", *(f"_cs_{n}" for n in names)])

    kinds = ", ".join(f"_cs_{c}" for c in out.split(", "))
    new = hit.mapInArrow(work, f"_cs_id long, _cs_key long, {kinds}").dropDuplicates(["_cs_id", "_cs_key"])
    j = base.join(new, ["_cs_id", "_cs_key"], "left")
    ident = F.when(F.col("_cs_id") != NULL_ID, F.col("_cs_id")).alias(id_col)
    return j.select(ident, "_cs_key", *(F.coalesce(F.col(f"_cs_{n}"), F.col(n)).alias(n) for n in names))
