"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut by the public splitting pattern; every distinct piece is encoded once per worker. Pieces of like length share
a matrix, one row each. In a round every row merges its leftmost pair of minimum rank; the pair's rank comes from a hash
table probed for the whole matrix at once; rows are compacted and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read, slices

_NONE = np.int32(2**31 - 1)
_WIDE = 512  # longer pieces go through a heap: the same merges in the same order, in n log n rather than n * n
_CACHE_BYTES = 64 << 20  # of cached chunks in a worker, as estimated; a full cache is emptied
_CACHED = 64  # longer chunks (texts without spaces, say) are not cached
_SLICE = 1 << 20  # bytes of text that are encoded at a time, one text at least
_PART = 1 << 16  # ids that are made text of at a time


class PairTable:
    """(left id, right id) -> merged id, open addressing, looked up for whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        bits = max(4, (2 * len(pairs)).bit_length())
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.vals = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, _NONE, np.int32)
        keys = np.array(list(pairs), np.uint64)
        vals = np.array(list(pairs.values()), np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            free = left[self.keys[at[left]] == np.uint64(2**64 - 1)]
            self.keys[at[free]], self.vals[at[free]] = keys[free], vals[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + np.uint64(1)) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of two flat arrays, _NONE where there is no such pair."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.vals[at], _NONE)
        left_over = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        keys, at = keys[left_over], at[left_over]
        while len(left_over):
            at = (at + np.uint64(1)) & self.mask
            found = self.keys[at]
            hit = found == keys
            out[left_over[hit]] = self.vals[at[hit]]
            go = ~hit & (found != np.uint64(2**64 - 1))
            left_over, keys, at = left_over[go], keys[go], at[go]
        return out


def _short_blank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """White space of two bytes."""
    return (a == 0xC2) & ((b == 0x85) | (b == 0xA0))


def _wide_blank(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """White space of three bytes."""
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)


def _valid(col: pa.Array) -> pa.Array:
    """Texts as UTF-8 bytes, null as empty; what is no UTF-8 is replaced as decoding does."""
    col = pc.fill_null(col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()), b"")
    try:
        pc.cast(col, pa.large_string() if col.type == pa.large_binary() else pa.string())
        return col
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace").encode() for t in col.to_pylist()], pa.binary())


def _public_pattern() -> str | None:
    try:
        import public_tokenizers
    except ModuleNotFoundError:  # any pattern is then treated as unknown
        return None
    return public_tokenizers.PATTERN


class ByteBPE:
    """ranks: token bytes -> id; the id is also the merge rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.known = pattern == _public_pattern()
        self.ranks = ranks
        self.byte = np.full(256, -1, np.int32)
        for i in range(256):
            self.byte[i] = ranks.get(bytes([i]), -1)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        # every way to cut a token in two tokens is a pair that merges to it
        pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs, self.table = pairs, PairTable(pairs)
        size = max(ranks.values()) + 1
        self.names = [str(i) for i in range(size)]
        self.lens = np.zeros(size, np.int64)
        for t, r in ranks.items():
            self.lens[r] = len(t)
        self.starts = np.concatenate(([0], np.cumsum(self.lens)[:-1]))
        by_id = sorted(ranks, key=ranks.get)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.cache: dict[bytes, bytes] = {}  # neither is tracked by the garbage collector
        self.held = 0

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _heap(self, piece: bytes) -> list[int]:
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < len(ids) and (m := self.pairs.get(ids[k] << 32 | ids[nxt[k]])) is not None:
                    heapq.heappush(heap, (m, k, ids[k], ids[nxt[k]]))
        return [x for x in ids if x >= 0]

    def _matrix(self, pieces: list[bytes]) -> list[bytes]:
        """All pieces of one length bucket; the ids as int32 bytes, which the garbage collector need not track."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lens.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        fill = np.arange(width) < lens[:, None]
        ids[fill] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[bytes] = [b""] * len(pieces)
        rows = np.arange(len(pieces))
        rank = np.full((len(pieces), max(width - 1, 1)), _NONE, np.int32)  # of the pair that starts in each cell
        if width > 1:
            pair = fill[:, 1:]
            rank[pair] = self.table.get(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(rows):
            each = np.arange(len(rows))
            at = rank.argmin(axis=1)  # the leftmost of the minimum
            best = rank[each, at]
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k, : lens[k]].tobytes()
                go = ~done
                rows, ids, lens, at, best, rank = rows[go], ids[go], lens[go], at[go], best[go], rank[go]
                if not len(rows):
                    break
                width = int(lens.max())
                ids, rank, each = ids[:, :width], rank[:, : width - 1], np.arange(len(rows))
            lens = lens - 1
            ids[each, at] = best
            # compaction: what stands right of the merged pair moves one cell to the left
            ids = np.where(np.arange(width - 1) > at[:, None], ids[:, 1:], ids[:, :-1])
            rank = np.where(np.arange(width - 2) > at[:, None], rank[:, 1:], rank[:, :-1]) if width > 2 else np.full((len(rows), 1), _NONE, np.int32)
            width -= 1
            if width > 1:  # only the pairs that touch the merged cell are new
                for cell in (at - 1, at):
                    some = np.flatnonzero((cell >= 0) & (cell < lens - 1))
                    rank[some, cell[some]] = self.table.get(ids[some, cell[some]], ids[some, cell[some] + 1])
                last = np.flatnonzero(at >= lens - 1)
                rank[last[at[last] < width - 1], at[last[at[last] < width - 1]]] = _NONE
        return out

    def encode_pieces(self, raw: list[bytes]) -> list[bytes]:
        out = [b""] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if (one := self.ranks.get(b)) is not None:  # a whole token, as the library does
                out[i] = one.to_bytes(4, sys.byteorder)
            elif len(b) > _WIDE:
                out[i] = np.array(self._heap(b), np.int32).tobytes()
            else:
                buckets.setdefault((len(b) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, (1 << 20) >> width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._matrix([raw[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def _cuts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where chunks start: at each text, and at single spaces between two characters that are no white space.

        The public pattern's pieces take a space at their start at most, so each chunk is cut into pieces on its own. With any
        other pattern a text is one chunk.
        """
        own = starts[ends > starts]
        if not self.known:
            return own
        at = np.flatnonzero(data == 32)
        inside = np.ones(len(data) + 1, bool)
        inside[own], inside[ends[ends > 0] - 1] = False, False
        at = at[inside[at]]
        at = at[(data[at - 1] > 32) & (data[at + 1] > 32)]
        odd = (data[at - 1] > 127) | (data[at + 1] > 127)
        if odd.any():  # the wide white space characters
            padded = np.concatenate((np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)))
            some = at[odd] + 3
            blank = _wide_blank(*(padded[some - k] for k in (3, 2, 1))) | _wide_blank(*(padded[some + k] for k in (1, 2, 3)))
            blank |= _short_blank(padded[some - 2], padded[some - 1]) | _short_blank(padded[some + 1], padded[some + 2])
            at = np.delete(at, np.flatnonzero(odd)[blank])
        return np.sort(np.concatenate((own, at)))

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks, as int32 bytes."""
        if self.held > _CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        out = list(map(self.cache.get, chunks))
        new = [i for i, ids in enumerate(out) if ids is None]
        # ASCII letters after one space at most are one piece of the public pattern; all else is cut by it
        plain = [self.known and (c[1:] if c[:1] == b" " else c).isalpha() for c in (chunks[i] for i in new)]
        cut = {i: [p.encode() for p in self.pattern.findall(chunks[i].decode())] for i, one in zip(new, plain, strict=True) if not one}
        pieces = list({chunks[i] for i, one in zip(new, plain, strict=True) if one}.union(*cut.values()))
        ids_of = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        for i in new:
            c = chunks[i]
            out[i] = ids = b"".join([ids_of[p] for p in cut[i]]) if i in cut else ids_of[c]
            if len(c) <= _CACHED:
                self.cache[c] = ids
                self.held += 200 + len(c) + len(ids)
        return out

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (binary, valid UTF-8, without nulls) one after another, and where each text's ids end."""
        bounds = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)))
        data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        cuts = self._cuts(data, bounds[:-1], bounds[1:])
        if not len(cuts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        offsets = np.append(cuts, len(data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self._ids_of(chunks.dictionary.to_pylist())
        at = chunks.indices.to_numpy()
        n = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat, starts = np.frombuffer(b"".join(found), np.int32), np.cumsum(n) - n
        ends = np.cumsum(n[at])
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends + n[at], n[at])]
        last = np.searchsorted(cuts, bounds[1:])  # chunks up to the end of each text
        return ids, np.concatenate(([0], ends))[last]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text.encode("utf-8", "replace")], pa.binary()))[0].tolist()

    def text_of(self, ids: np.ndarray) -> Iterator[bytes]:
        """Decimal ids joined by commas, in parts."""
        for k in range(0, len(ids), _PART):
            part = ",".join(map(self.names.__getitem__, ids[k : k + _PART].tolist()))
            yield (("," if k else "") + part).encode()

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        n = self.lens[ids]
        ends = np.cumsum(n)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + n, n)].tobytes()


_loaded: dict[tuple[str, str], ByteBPE] = {}


def _model(path: str, pattern: str) -> ByteBPE:
    """One model and piece cache per Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE.from_file(path, pattern)
    return _loaded[path, pattern]


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids themselves (array<int>).

    No shuffle: a row is encoded and decoded where it is read. Null text is empty: no tokens, digests of nothing.
    Any text is encoded whole; special tokens are ordinary text. ``vocabulary`` is a rank file that every worker can open.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(vocabulary, pattern)
        for batch in slices(batches, limit=_SLICE):
            ids, ends = model.encode_texts(_valid(batch.column(1)))
            decoded = memoryview(model.decode(ids))
            bytes_to = np.concatenate(([0], np.cumsum(model.lens[ids])))
            n, enc, dec, at = np.diff(ends, prepend=0), [], [], 0
            for to in ends.tolist():
                digest = hashlib.sha256()
                for part in model.text_of(ids[at:to]):
                    digest.update(part)
                enc.append(digest.hexdigest())
                dec.append(hashlib.sha256(decoded[bytes_to[at] : bytes_to[to]]).hexdigest())
                at = to
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))], [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(id_col, text).mapInArrow(work, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe_encode(read(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
