"""Suffix-array dedup over bytes with longest-previous-factor arrays.

Blocks of the anchors' hash ranges (see repeats) hold every region in which a repeated string of the wanted length can lie. Each
block is sorted into suffix order by prefix doubling; in that order the previous and the next smaller position of a suffix give
its longest match with an earlier one (LPF), and the previous and next larger position its longest match with a later one. That a
match has the wanted length shows in the ranks of the doubling. To keep the first copies, only earlier matches count.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .decontam import per_row
from .repeats import Kind, Region, Runs, covered, finish, prepared, repeated_spans

_BITS = 21  # a block's positions and ranks fit in 21 bits each, so that one 64-bit number holds a pair of ranks and a position
BLOCK, LARGE = 1 << 20, 1 << _BITS
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)  # a fixed random number per byte value


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Positions in the order of their first ``depth`` bytes, and how many bytes h the doubling came to, with the ranks by those.

    Past the end stands nothing, which is smaller than any byte. Equal ranks: equal prefixes (ties by position).
    """
    n = len(data)
    if n >= 1 << _BITS:
        raise ValueError("a block is too long")
    at = np.arange(n, dtype=np.uint64)
    bits, mask = np.uint64(_BITS), np.uint64((1 << _BITS) - 1)
    h = min(4, depth)
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = key << np.uint64(9)
        key[: max(n - i, 0)] |= data[i:].astype(np.uint64) + np.uint64(1)
    key = key << bits | at

    def ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.sort(key)
        order = (key & mask).astype(np.int64)
        k = key >> bits
        new = np.ones(n, np.uint64)
        new[1:] = k[1:] != k[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        return order, rank

    order, rank = ranks(key)
    while h < depth and rank[order[-1]] < n if n else False:
        step = min(h, depth - h)
        far = np.zeros(n, np.uint64)
        far[: max(n - step, 0)] = rank[step:]
        order, rank = ranks(rank << np.uint64(2 * _BITS) | far << bits | at)
        h += step
    return order, h, rank


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order, the nearest smaller position before and after it; -1 where there is none."""
    before = _previous_smaller(order)
    after = _previous_smaller(order[::-1])[::-1]
    return before, after


def _previous_smaller(order: np.ndarray) -> np.ndarray:
    """All between a place and the one it points to are larger than it; what points to a larger one jumps on to where that one points."""
    value = np.concatenate((np.full(1, -1, np.int64), order))  # place 0 ends every search
    to = np.maximum(np.arange(len(value)) - 1, 0)
    live = np.flatnonzero(value[to] > value)
    while len(live):
        to[live] = to[to[live]]
        live = live[value[to[live]] > value[live]]
    return value[to[1:]]


def longest_previous_factor(data: bytes, depth: int | None = None) -> np.ndarray:
    """LPF[i]: the longest prefix (up to ``depth``) of the suffix at i that also starts before i."""
    x = np.frombuffer(data, np.uint8)
    depth = depth or max(len(x), 1)
    out = np.zeros(len(x), np.int64)
    if len(x):
        order, *_ = suffix_order(x, depth)
        prev, nxt = smaller_neighbours(order)
        m = [_lce(x, order, other, depth) for other in (prev, nxt)]
        out[order] = np.maximum(*m)
    return out


def _lce(x: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    n, got = len(x), np.zeros(len(a), np.int64)
    live = np.flatnonzero(b >= 0)
    while len(live):
        i, j = a[live] + got[live], b[live] + got[live]
        go = (i < n) & (j < n) & (got[live] < depth)
        go[go] = x[i[go]] == x[j[go]]
        live = live[go]
        got[live] += 1
    return got


def repeated_starts(data: np.ndarray, length: int, first_too: bool, starts: np.ndarray | None = None) -> np.ndarray:
    """Positions whose next ``length`` bytes also start elsewhere in ``data`` (first_too) or before (LPF >= length).

    starts: a mask of the positions that count; others are neither answered nor matched.
    """
    n = len(data)
    out = np.zeros(n, bool)
    if n < length:
        return out
    order, h, ranks = suffix_order(data, length)
    if h < length:  # all ranks differ already: no string of that length repeats
        return out
    order = order[order + length <= n]
    if starts is not None:
        order = order[starts[order]]
    # suffixes whose first ``length`` bytes are equal have one rank: LPF >= length if the previous or the next smaller position has it
    others = [*smaller_neighbours(order)]
    if first_too:  # the same for matches with later positions
        others += [n - 1 - x for x in smaller_neighbours(n - 1 - order)]
    for other in others:
        known = (other >= 0) & (other < n)
        out[order[known]] |= ranks[order[known]] == ranks[other[known]]
    return out


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _TABLE[np.frombuffer(b"".join(texts), np.uint8)], np.fromiter(map(len, texts), np.int64, len(texts))


def dedup_suffixes(docs: DataFrame, length: int = 200, keep_first: bool = False, id_col: str = "doc_id", text: str = "text", shard_bytes: int = 16 << 20, with_bytes: bool = False) -> DataFrame:
    """Per distinct (id, text): id, _cs_key, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes on request).

    A byte is removed if a string of ``length`` UTF-8 bytes that covers it also starts elsewhere, in the same text too; with
    ``keep_first`` only if it also starts earlier: in a smaller id (null first; then by hash of the text) or before in the
    same text. Strings never cross texts and are judged on the input. Ids must be integers; an empty table gives no rows. Null, empty and short texts lose nothing.
    """
    kind = Kind(length, max(1, length // 2), byte_tokens)

    def region(texts: list[bytes], runs: Runs) -> list[bytes]:
        return [texts[d][s : s + c + length - 1] for d, s, c in zip(runs.doc.tolist(), runs.start.tolist(), runs.count.tolist(), strict=True)]

    def solve(groups: list[list[Region]]) -> Iterator[tuple[tuple[int, int, int], int, int]]:
        held: list[Region] = []
        size = 0
        for g in groups:
            for r in g:
                many = len(r.places) > 1
                for p in (r.places[1:] if keep_first else r.places) if many else ():
                    yield p, 0, r.count - 1
            if len(g) < 2:
                continue
            own = sum(len(r.text) for r in g)
            if size and size + own > BLOCK:
                yield from block(held)
                held, size = [], 0
            if own >= LARGE:
                for part in parts(g, own):
                    yield from block(part)
                continue
            held += g
            size += own
        if held:
            yield from block(held)

    def answer(r: Region, hit: np.ndarray) -> Iterator[tuple[tuple[int, int, int], int, int]]:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        for a, z in edge.reshape(-1, 2).tolist():
            yield r.places[0], a, z - 1

    def block(regions: list[Region]) -> Iterator[tuple[tuple[int, int, int], int, int]]:
        data = np.frombuffer(b"".join(r.text for r in regions), np.uint8)
        sizes = np.array([len(r.text) for r in regions])
        inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat([r.count for r in regions], sizes)
        hit = repeated_starts(data, length, not keep_first, inside)
        at = 0
        for r in regions:
            if keep_first or (len(r.places) == 1 and not r.more):
                yield from answer(r, hit[at : at + r.count])
            at += len(r.text)

    def parts(regions: list[Region], size: int) -> Iterator[list[Region]]:
        """A group that no block holds, in pieces: equal strings have their anchor at one distance, and one checksum."""
        for far in range(min(r.off - r.count + 1 for r in regions), max(r.off for r in regions) + 1):
            own = [(r, r.off - far) for r in regions if 0 <= r.off - far < r.count]
            n = -(-len(own) * length // BLOCK)
            pieces: list[list[Region]] = [[] for _ in range(n)]
            for r, i in own:
                w = r.text[i : i + length]
                pieces[zlib.crc32(w) % n].append(Region(r.hash, r.off - i, 1, w, [(p[0], p[1], p[2] + i) for p in r.places], r.more))
            yield from filter(None, pieces)

    d = prepared(docs, id_col, text)
    out = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes

    def rewrite(raw: bytes, spans_: bytes) -> tuple:
        gone = covered(spans_, len(raw), length)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
        return (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_bytes))

    some, spans = repeated_spans(d, kind, region, solve, keep_first, shard_bytes)
    raw = F.coalesce(F.col("_cs_text"), F.lit("")).cast("binary")
    base = d.select("_cs_id", "_cs_key", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept_bytes")] * with_bytes))
    return finish(docs, some, spans, base.dropDuplicates(["_cs_id", "_cs_key"]), rewrite, out, id_col)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return per_row(docs, dedup_suffixes(docs), "doc_id", "text")
