"""Operators 5 to 10 against brute force, on nasty rows and on the smallest test tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from colscope.llm import bpe, decontam, lines, quality, sharding, warc

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def pairs(df, text="text"):
    return [(r[0], r[1]) for r in df.select(df.columns[0], text).collect()]


def lists(items):
    out = defaultdict(list)
    for k, v in items:
        out[k].append(v)
    return dict(out)


@pytest.fixture(params=["nasty", "table"])
def docs(request):
    return request.getfixturevalue("nasty") if request.param == "nasty" else request.getfixturevalue("table")("documents")


# 6 ------------------------------------------------------------------------------------------------------------------
def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(hit), failed


def test_quality_counts(docs, check):
    out, model = quality.quality_rules(docs)
    check(out, lists((i, brute_counts(t)) for i, t in pairs(docs)), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert out.where("kept and base_failed").count() == 0
    assert 0 < model.prior < 1


def test_quality_agrees_with_labels(table):
    out, _ = quality.quality_rules(table("documents"))
    both = out.join(table("labels"), "doc_id").select("kept", "quality", "n_words").where("n_words >= 10").collect()
    assert sum(r.kept == bool(r.quality) for r in both) >= 0.95 * len(both)
    assert all(r.kept for r in both if r.quality) or sum(r.kept for r in both if r.quality) >= 0.98 * sum(r.quality for r in both)


def test_quality_stage_keeps_columns(nasty, none):
    out = quality.drop_low_quality(nasty)
    assert out.columns == nasty.columns and 0 < out.count() < nasty.count()
    assert quality.drop_low_quality(none).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------
def test_bpe_equals_library(docs, check):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(t):
        ids = enc.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    check(bpe.bpe_encode(docs, RANKS, P.PATTERN), lists((i, one(t)) for i, t in pairs(docs)), ["n_tokens", "ids_sha256", "decoded_sha256"])


def test_bpe_random_bytes_and_wide_pieces():
    model = bpe.ByteBPE.from_file(RANKS, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    rnd = random.Random(3)
    texts = ["", "a" * 700, " " * 900 + "x", " a  b ", "\x1c a \x1c", "x 　y", "\n\n a", "日本語" * 300]
    texts += ["".join(rnd.choice("abcdé日 \n\t'!1 ") for _ in range(rnd.randrange(900))) for _ in range(60)]
    for t in texts:
        assert model.encode(t) == enc.encode_ordinary(t)
        assert model.decode(model.encode(t)) == t.encode()


def test_bpe_of_nothing(none):
    assert bpe.bpe_encode(none, RANKS, P.PATTERN, with_ids=True).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------
def brute_warc(rows):
    data = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, b in data:
        if i is not None:
            first[b] = min(i, first.get(b, i))
    for i, b in data:
        to = first.get(b)
        revisit = to is not None and i != to
        yield i, (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", to if revisit else None)


def test_warc_round_trip(spark, table, check, tmp_path):
    rows = [(i, f"http://a/{i} x\r\n", h) for i, h in enumerate(["", None, "a", "a", "b" * 70000, "é\r\n\r\nx", "a", "b" * 70000, "WARC/1.1\r\n", "\x1f\x8b\x08"])]
    rows += [(None, None, "a"), (None, None, None), (2, "again", "a")]
    own = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("size", F.lit("x"))
    for k, df in enumerate((own, table("pages"), own.limit(0))):
        (at := tmp_path / str(k)).mkdir()
        records, gaps = warc.read_archives(warc.write_archives(df, f"file://{at}"))
        check(records, lists(brute_warc([(r.page_id, r.html) for r in df.collect()])), ["payload_bytes", "payload_digest", "record_type", "refers_to"], "page_id")
        assert gaps.count() == 0


def test_warc_least_size(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbbb"), (4, "u", "bbbbb")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(df, f"file://{tmp_path}", least=5))[0].collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


@pytest.mark.parametrize("zipped", [True, False])
def test_warc_salvage(zipped):
    rnd = random.Random(1)
    recs = [warc.record(i, f"http://h/{i}", bytes(rnd.randrange(97, 123) for _ in range(400))) for i in range(20)]
    parts = [warc.gzip_member(r) if zipped else r for r in recs]
    whole = b"".join(parts)
    assert len(warc.salvage(whole).records) == 20 and not warc.salvage(whole).gaps
    starts = [sum(map(len, parts[:i])) for i in range(21)]
    bad = bytearray(whole)
    bad[starts[3] + len(parts[3]) // 2] ^= 0xFF  # in a record
    bad[starts[7]] ^= 0xFF  # at a start
    cut = bytes(bad[: starts[19] + 40])  # cut short
    got = warc.salvage(cut)
    ids = [r.fields["warc-record-id"] for r in got.records]
    assert ids == [f"<urn:page:{i}>" for i in range(19) if i not in (3, 7)]
    assert [(a, n) for a, n, _ in got.gaps] == [(starts[3], len(parts[3])), (starts[7], len(parts[7])), (starts[19], 40)]
    junk = warc.salvage(b"junk" + whole[starts[1] :] if zipped else b"junk" + whole)
    assert junk.gaps[0][:2] == (0, 4)
    assert warc.salvage(b"").records == [] and warc.salvage(b"junk").gaps == [(0, 4, warc.salvage(b"junk").gaps[0][2])]
    assert zlib.crc32(whole) != zlib.crc32(cut)


# 9 ------------------------------------------------------------------------------------------------------------------
def low(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_decontam(docs, items, size=10):
    wins = defaultdict(set)
    for item, t in items:
        w = low(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[i : i + size])].add(item)
    lens = {len(x) for x in wins}
    for i, t in docs:
        w, hit, found = low(t), set(), set()
        for n in lens:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[g]
        names = ",".join(sorted(map(str, found)))
        yield i, (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))


COLS9 = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_decontamination(spark, nasty, table, check):
    rows = {(i, t) for i, t in pairs(nasty)}
    words = next(t for _, t in rows if t and len(t.split()) == 70).split()
    items = [(1, " ".join(words[5:40])), (2, "the the"), (3, None), (4, ""), (5, "no such words here at all my friend in this corpus"), (10, "X"), (6, " ".join(words[20:31])), (7, "é x")]
    own = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    for docs, tests in ((nasty, own), (table("documents"), table("benchmark"))):
        want = lists(brute_decontam(pairs(docs), pairs(tests)))
        found = decontam.decontaminate(docs, tests)
        got = decontam.per_row(docs, found, "doc_id", "text")
        check(got, want, COLS9)
        left = decontam.drop_contaminated(docs, tests)
        assert left.columns == docs.columns
        assert left.count() == sum(not v[4] for x in want.values() for v in x)


def test_decontamination_by_shuffle(nasty, spark, monkeypatch, check):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    items = spark.createDataFrame([(1, "the of the"), (2, "x x")], "item_id long, text string")
    check(decontam.per_row(nasty, decontam.decontaminate(nasty, items), "doc_id", "text"), lists(brute_decontam(pairs(nasty), pairs(items))), COLS9)


def test_decontamination_of_nothing(nasty, none, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(nasty, items).where("contaminated or n_items > 0").count() == 0
    assert decontam.decontaminate(none, items).count() == 0


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c a x b"), (2, "c b a"), (3, "a q q q q b")], "doc_id long, text string")
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    index = decontam.build_index(docs, terms, 2)
    assert [(r.id, r.start) for r in index.phrase(["a", "b"]).orderBy("id", "start").collect()] == [(1, 0)]
    near = sorted((r.id, r.start, r.end) for r in index.proximity(["a", "b"], 3).collect())
    assert near == [(1, 0, 1), (1, 1, 3), (1, 3, 5), (2, 1, 2)]


# 10 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("partitions", [1, 5])
def test_sharding(docs, partitions):
    got = sharding.shard_by_bytes(docs, 8, partitions=partitions).collect()
    rows = pairs(docs)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
    total, longest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    for k in range(8):
        own = [r for r in order if r.shard == k]
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= longest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_sharding_of_nothing(none):
    assert sharding.shard_by_bytes(none).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------
def chunks_of(df, **how):
    return {(r._cs_id, r._cs_key, r.start, r.len, r.chunk) for r in lines.line_chunks(df, **how).collect()}


def test_line_chunks_cover_texts(docs):
    for i, k, start, n, chunk in chunks_of(docs, longest=3):
        assert 2 <= n <= 3 and chunk.count("\n") == n - 1
    by_doc = defaultdict(list)
    for i, k, start, n, chunk in chunks_of(docs):
        by_doc[i, k].append((start, n))
    for spans in by_doc.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def brute_lines(docs_with_keys, chunks):
    first = {}
    order = lambda c: (c[0] is not None, c[0] or 0, c[1], c[2])
    kept = defaultdict(set)
    for c in sorted(chunks, key=order):
        if not c[4].strip(" \n\t\r"):
            continue
        if c[4] in first:
            kept[c[0], c[1]] |= set(range(c[2], c[2] + c[3]))
        first.setdefault(c[4], c)
    for i, k, t in docs_with_keys:
        gone = kept.get((i, k))
        yield i, t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)


def test_line_dedup(docs):
    want = Counter(brute_lines([(r.doc_id, r.k, r.text) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()], chunks_of(docs)))
    got = lines.dedup_lines(docs, drop_emptied=False)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert want != Counter(pairs(docs))
    dropped = lines.dedup_lines(docs)
    assert dropped.count() == sum(n for (i, t), n in want.items() if not (t is not None and not t.strip(" \n\t\r")) or (i, t) in set(pairs(docs)))


def test_line_boundaries_resist_shifts(spark):
    text = [f"line number {i} of this text" for i in range(200)]
    df = spark.createDataFrame([(1, "\n".join(text)), (2, "\n".join(text[:3] + ["one more"] + text[3:]))], "doc_id long, text string")
    left = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert left[1] == "\n".join(text) and left[2].count("\n") < 40 and "one more" in left[2]


def test_repeated_blocks_of_lines(spark, tmp_path):
    """op5 against blocks found without the chunks: passages of 2 to 12 lines between other lines, and whole copies."""
    rnd, n = random.Random(3), iter(range(10**6))
    fresh = lambda k: [f"line {next(n)}" if rnd.random() < 0.85 else "" for _ in range(k)]
    known = [[f"said {next(n)}" for _ in range(rnd.randrange(2, 13))] for _ in range(30)]
    texts = [sum((fresh(rnd.randrange(4)) + rnd.choice(known) for _ in range(4)), []) for _ in range(150)]
    texts += [list(t) for t in texts[:40]] + [["a", "", "", "b", ""], ["a", "", "", "b", ""], ["x", "x", "x"]]
    docs = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, whole, want = set(), set(), {}
    for i, t in docs:
        row, gone = t.split("\n"), set()
        full = [k for k, x in enumerate(row) if x.strip()]
        for a, b in zip(full, full[1:], strict=False):
            w = tuple(row[a : b + 1])
            gone |= set(range(a, b + 1)) if w in seen else set()
            seen.add(w)
        gone = set(range(len(row))) if t in whole else gone
        whole.add(t)
        want[i] = {k for k in gone if row[k]}, full
    for r in lines.op5_lines(spark, str(tmp_path)).collect():
        row, (gone, full) = dict(docs)[r.doc_id].split("\n"), want[r.doc_id]
        kept = [row[k] for k in full if k not in gone]
        assert r.kept_bytes - sum(map(len, kept)) <= len(row) and r.n_removed >= len(gone), (r, kept)
        assert r.kept_bytes >= sum(map(len, kept)), (r, kept)
        assert kept or r.kept_bytes == 0 or r.doc_id < 150, r


def test_line_dedup_of_nothing(none):
    assert lines.dedup_lines(none).count() == 0


# repairs ------------------------------------------------------------------------------------------------------------
def test_salvage_inside_members():
    parts = [warc.record(i, f"http://x/{i}", b"<p>page %d</p>" % i * 30) for i in range(3)]
    bad = parts[1].replace(b"page 1", b"pagX 1", 1)
    got = warc.salvage(warc.gzip_member(parts[0] + bad + parts[2]))
    assert [r.fields["warc-record-id"] for r in got.records] == ["<urn:page:0>", "<urn:page:2>"] and len(got.gaps) == 1
    cut = warc.gzip_member(b"".join(parts), 0)  # stored: damage near the end leaves what stands before it
    got = warc.salvage(cut[:-200] + warc.gzip_member(parts[2]))
    assert [r.fields["warc-record-id"] for r in got.records][:2] == ["<urn:page:0>", "<urn:page:1>"] and got.gaps


def test_salvage_of_plain_archive_with_lost_head():
    parts = [warc.record(i, None, b"\x1f\x8b\x08 is a magic %d" % i * 400) for i in range(3)]
    data = b"".join(parts)[len(parts[0]) - 5_000 :]
    assert [r.fields["warc-record-id"] for r in warc.salvage(data).records] == ["<urn:page:1>", "<urn:page:2>"]


def test_bpe_with_another_pattern():
    """Small and capital letters are pieces of their own here: the fast ways of the public pattern don't hold."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"Bc": 257, b" a": 258}
    assert bpe.ByteBPE(ranks, r"[a-z]+|[A-Z]+| +").encode("aBc ab") == [97, 66, 99, 32, 256]


def test_bpe_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE_BYTES", 2_000)
    model = bpe.ByteBPE({bytes([i]): i for i in range(256)}, bpe._public_pattern())
    for k in range(50):
        assert model.encode(f"word{k} " + "x" * 200 + "日本語" * 50) == list((f"word{k} " + "x" * 200 + "日本語" * 50).encode())
    assert len(model.cache) < 20 and max(map(len, model.cache)) <= 64


def test_bpe_chunks_at_any_white_space():
    model = bpe.ByteBPE.from_file(RANKS, P.PATTERN)
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    rnd = random.Random(5)
    signs = [" ", "  ", "a", "é", "日", "x1", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "\t", "\n", "\x1c", "'s", "“", "ế", "à", "…", "Å", "Р"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["", " ", "", " a", "a "]
    ids, ends = model.encode_texts(pa.array([t.encode() for t in texts], pa.binary()))
    at = 0
    for t, to in zip(texts, ends.tolist(), strict=True):
        assert ids[at:to].tolist() == library.encode_ordinary(t), t
        at = to
    assert at == len(ids)


def test_bpe_replaces_what_is_no_utf8(spark):
    docs = spark.sql("select * from values (1, cast(x'61ff2062' as string)), (2, cast(x'e6' as string)), (3, cast(x'97a5' as string)) as t(doc_id, text)")
    want = {1: b"a\xff b", 2: b"\xe6", 3: b"\x97\xa5"}
    for r in bpe.bpe_encode(docs, RANKS, P.PATTERN).collect():
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].decode("utf-8", "replace").encode()).hexdigest()
