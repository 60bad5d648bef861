"""Operators 3 and 4 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from colscope.llm import repeats, substring, suffix
from colscope.llm.decontam import per_row


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def lists(items):
    out = defaultdict(list)
    for k, v in items:
        out[k].append(v)
    return dict(out)


@pytest.fixture(params=["nasty", "table"])
def docs(request):
    return request.getfixturevalue("nasty") if request.param == "nasty" else request.getfixturevalue("table")("documents")


def places(rows, split, n):
    first, count = {}, defaultdict(int)
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = split(t)
        for s in range(len(w) - n + 1):
            g = w[s : s + n] if isinstance(w, bytes) else tuple(w[s : s + n])
            first.setdefault(g, (i, s))
            count[g] += 1
    return first, count


def brute_words(rows, n=20):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first, _ = places(rows, split, n)
    for i, t in rows:
        w = split(t)
        gone = {j for s in range(len(w) - n + 1) if first[tuple(w[s : s + n])] != (i, s) for j in range(s, s + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        yield i, (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def brute_bytes(rows, n=200, keep_first=False):
    split = lambda t: (t or "").encode()
    first, count = places(rows, split, n)
    for i, t in rows:
        b = split(t)
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] != (i, s) if keep_first else count[b[s : s + n]] > 1:
                gone[s : s + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        yield i, (len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])[: len(b)]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())


def test_substrings(docs, check):
    want = lists(brute_words(pairs(docs)))
    check(per_row(docs, substring.dedup_substrings(docs, shard_bytes=20_000), "doc_id", "text"), want, ["n_words", "n_removed", "kept_sha256"])
    assert any(v[1] for w in want.values() for v in w)


@pytest.mark.parametrize("keep_first", [False, True])
def test_suffixes(docs, check, keep_first):
    want = lists(brute_bytes(pairs(docs), keep_first=keep_first))
    got = per_row(docs, suffix.dedup_suffixes(docs, keep_first=keep_first, shard_bytes=20_000), "doc_id", "text")
    check(got, want, ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert any(v[1] for w in want.values() for v in w)


def test_one_shard_and_shuffle_join(nasty, check, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(repeats, "_FLUSH", 50)
    check(per_row(nasty, substring.dedup_substrings(nasty), "doc_id", "text"), lists(brute_words(pairs(nasty))), ["n_words", "n_removed", "kept_sha256"])
    check(per_row(nasty, suffix.dedup_suffixes(nasty, 50), "doc_id", "text"), lists(brute_bytes(pairs(nasty), 50)), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_of_nothing(none):
    assert substring.dedup_substrings(none).count() == 0
    assert suffix.dedup_suffixes(none).count() == 0


def test_runs_in_small_sections(monkeypatch):
    rnd = np.random.default_rng(1)
    texts = [bytes(rnd.integers(97, 99, n, dtype=np.uint8)) for n in (0, 5, 300, 199, 200, 201, 4000)]
    kind = repeats.Kind(200, 100, suffix.byte_tokens)
    whole = repeats.runs_of(*suffix.byte_tokens(texts), kind)
    cover = sum(whole.count)
    assert cover == sum(max(0, len(t) - 199) for t in texts)
    monkeypatch.setattr(repeats, "_SECTION", 257)
    parts = repeats.runs_of(*suffix.byte_tokens(texts), kind)
    a = {(d, s + i, h) for d, s, c, h in zip(whole.doc, whole.start, whole.count, whole.hash, strict=True) for i in range(c)}
    b = {(d, s + i, h) for d, s, c, h in zip(parts.doc, parts.start, parts.count, parts.hash, strict=True) for i in range(c)}
    assert a == b


@pytest.mark.parametrize("keep_first", [False, True])
def test_suffixes_across_sections(nasty, check, monkeypatch, keep_first):
    """Runs are split at other places of a text in each of the two passes over it."""
    whole = suffix.byte_tokens

    def tokens(texts):
        repeats._SECTION = 257 + 100 * (len(texts) % 5)  # in the worker
        return whole(texts)

    monkeypatch.setattr(suffix, "byte_tokens", tokens)
    got = per_row(nasty, suffix.dedup_suffixes(nasty, 50, keep_first=keep_first), "doc_id", "text")
    check(got, lists(brute_bytes(pairs(nasty), 50, keep_first)), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_longest_previous_factor():
    rnd = random.Random(5)
    for _ in range(40):
        t = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(60)))
        want = [max([0, *(next((k for k in range(len(t) - i) if t[i + k] != t[j + k]), len(t) - i) for j in range(i))]) for i in range(len(t))]
        assert suffix.longest_previous_factor(t).tolist() == want
        for n in (1, 3, 8):
            x = np.frombuffer(t, np.uint8)
            assert suffix.repeated_starts(x, n, False).tolist() == [w >= n for w in want]
            grams = [t[i : i + n] for i in range(len(t))]
            assert suffix.repeated_starts(x, n, True).tolist() == [len(g) == n and grams.count(g) > 1 for g in grams]


def test_factors_cross_boundaries():
    """Factors follow the reference as far as it goes; their windows are all those that the reference holds."""
    rnd = random.Random(9)
    reference = substring.Reference(3)
    reference.add([b"%d" % i for i in range(6)])
    reference.add([b"%d" % i for i in (3, 4, 5, 9, 10, 11)])
    assert list(reference.factors([b"%d" % i for i in (7, 1, 2, 3, 4, 5, 9, 10, 8)])) == [(1, 5, 0, 1), (4, 4, 1, 1)]
    for _ in range(200):
        reference, texts = substring.Reference(3), [[rnd.choice((b"a", b"b")) for _ in range(rnd.randrange(3, 9))] for _ in range(3)]
        for t in texts:
            reference.add(t)
        held = {tuple(t[i : i + 3]) for t in texts for i in range(len(t) - 2)}
        words = [rnd.choice((b"a", b"b", b"c")) for _ in range(40)]
        found = [i for at, n, *_ in reference.factors(words) for i in range(at, at + n - 2)]
        assert found == [i for i in range(38) if tuple(words[i : i + 3]) in held]
        for at, n, r, place in reference.factors(words):
            assert words[at : at + n] == texts[r][place : place + n]


@pytest.mark.parametrize("keep_first", [True, False])
def test_groups_beyond_a_block(nasty, check, monkeypatch, keep_first):
    """Groups of one anchor that no block holds go in pieces of equal checksums."""
    monkeypatch.setattr(suffix, "LARGE", 1)
    monkeypatch.setattr(suffix, "BLOCK", 300)
    got = per_row(nasty, suffix.dedup_suffixes(nasty, 50, keep_first=keep_first), "doc_id", "text")
    check(got, lists(brute_bytes(pairs(nasty), 50, keep_first)), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
