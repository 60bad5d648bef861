"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Each record is a gzip member of its own. Reading checks the member's CRC, the record's frame and its payload digest. After a
failed check the reader looks for the next place where a member (or, in plain files, a version line) starts and goes on
there; the bytes between are logged as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, filesystem, new_folder, read, slices, write_file

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_DATE = "2020-01-01T00:00:00Z"  # fixed, so that the same input gives the same archive


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One uncompressed record. A revisit carries the HTTP head only, as the identical-payload-digest profile has it."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response")]
    if page_id is not None:
        fields += [("WARC-Record-ID", f"<urn:page:{page_id}>")]
    if url is not None:
        fields += [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))]
    fields += [("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Salvage:
    """Records in file order, and the gaps (offset, length, reason) that were skipped."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that starts at ``at``: fields, block, end. ValueError names the failed check."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header has no end")
    fields: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line has no colon")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not (n := fields.get("content-length", "")).isascii() or not n.isdigit():
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(n)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record has no end mark")
    block = data[start:stop]
    want = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and want.startswith("sha1:") and want[5:] != digest(block.partition(b"\r\n\r\n")[2]):
        raise ValueError("payload digest differs")
    return fields, block, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(content, end, failure) of the gzip member at ``at``; after a failure, what could be read before it and where it starts.

    Feeds a growing window, so that what follows the member isn't copied for each member.
    """
    size, z, parts, pos = 1 << 16, zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(data):
            parts.append(z.decompress(data[pos : pos + size]))
            pos += size
            size = min(size * 2, 1 << 24)
    except zlib.error as e:
        # once more in small steps: what stands before the damage
        z, parts, pos = zlib.decompressobj(31), [], at
        try:
            while pos < len(data):
                parts.append(z.decompress(data[pos : pos + 512]))
                pos += 512
        except zlib.error:
            return b"".join(parts), at, f"gzip: {e}"
    if not z.eof:
        return b"".join(parts), at, "gzip: member is cut short"
    return b"".join(parts), min(pos, len(data)) - len(z.unused_data), ""


def _plain(data: bytes, checked: bool) -> Iterator[tuple[int, int, dict[str, str], bytes] | tuple[int, int, str]]:
    """Records (start, end, fields, block) of uncompressed bytes, and gaps (start, end, reason) between them.

    checked: only records whose payload digest was compared count, as the bytes themselves are in doubt.
    """
    at, bad, why = 0, -1, ""
    while at < len(data):
        try:
            fields, block, end = _parse(data, at)
            if checked and not (fields.get("warc-type") == "response" and fields.get("warc-payload-digest", "").startswith("sha1:")):
                raise ValueError("nothing vouches for the record")
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)
            at = m.start() if (m := _VERSION.search(data, at + 1)) else len(data)
            continue
        if bad >= 0:
            yield bad, at, why
            bad = -1
        yield at, end, fields, block
        at = end
    if bad >= 0:
        yield bad, len(data), why


def salvage(data: bytes) -> Salvage:
    """All records of an archive (gzip members or plain) whose checks hold, and the gaps between them.

    Where a check fails, the reader goes on at the next place where a member or a version line starts. Of a damaged member
    those records are kept whose payload digest holds, and of a sound one with a damaged record the others; a gap inside a
    member is logged with the member's offset and length.
    """
    out, at, bad, why = Salvage(), 0, -1, ""
    start = re.compile(re.escape(_MAGIC) + b"|" + _VERSION.pattern)

    def close(end: int) -> None:
        nonlocal bad
        if bad >= 0:
            out.gaps.append((bad, end - bad, why))
            bad = -1

    while at < len(data):
        found: list[Record] = []
        failure, end = "", at
        if data[at : at + 3] == _MAGIC:
            body, end, failure = _member(data, at)
            inner = list(_plain(body, bool(failure)))
            found = [Record(at, x[2], x[3]) for x in inner if len(x) == 4]
            if not failure and len(found) < len(inner):
                close(at)
                out.gaps.append((at, end - at, next(x[2] for x in inner if len(x) == 3)))
        else:
            try:
                fields, block, end = _parse(data, at)
                found = [Record(at, fields, block)]
            except ValueError as e:
                failure = str(e)
        if failure:
            if bad < 0:
                bad, why = at, failure
            out.records += found
            at = m.start() if (m := start.search(data, at + 1)) else len(data)
            continue
        close(at)
        out.records += found
        at = end
    close(len(data))
    return out


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes one record per row below ``folder`` and returns the files (uri, n_records, n_bytes).

    Of rows with equal payloads of ``least`` bytes or more that with the smallest id is the response, the others are revisits
    of it. Equal rows (same id too) are the same response. Null html is an empty payload; a null id is the largest.
    Groups are found by (SHA-1, length) on narrow rows with partial aggregation; only digests that occur twice join back,
    over 16 salts, so a payload that a third of all pages share spreads over many tasks.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    salt = F.array(*map(F.lit, range(16)))
    first = (
        rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("sha", "size", "first", F.explode(salt).alias("salt"))
    )
    typed = rows.withColumn("salt", F.pmod(F.hash("id", "url"), F.lit(16))).join(first, ["sha", "size", "salt"], "left").select("id", "payload", "url", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = n = 0

        def close() -> pa.RecordBatch:
            data = b"".join(parts)
            name = f"{folder}/{hashlib.sha256(data).hexdigest()[:32]}.warc.gz"  # by content: a retry writes the same file
            write_file(name, data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([len(data)])], ["uri", "n_records", "n_bytes"])

        for batch in slices(batches):
            for page, payload, at, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = to is not None and page != to
                parts.append(gzip_member(record(page, at, payload, to, revisit)))
                size, n = size + len(parts[-1]), n + 1
                if size >= archive_bytes:
                    yield close()
                    parts, size, n = [], 0, 0
        if parts:
            yield close()

    return checkpoint(typed.mapInArrow(write, "uri string, n_records long, n_bytes long"))


def read_archives(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of all archives named in column ``uri`` (each whole in one task's memory), and the quarantined gaps."""

    def load(batches: Iterator[pa.RecordBatch], gaps: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = filesystem(uri)
                with fs.open_input_stream(path) as f:
                    found = salvage(f.read())
                if gaps:
                    at, n, why = zip(*found.gaps, strict=True) if found.gaps else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(why, pa.string())], ["uri", "offset", "length", "reason"])
                    continue
                out: list[tuple] = []
                for r in found.records:
                    f_ = r.fields
                    http = dict(x.partition(b": ")[::2] for x in r.block.partition(b"\r\n\r\n")[0].split(b"\r\n"))
                    size = len(r.payload) if f_.get("warc-type") == "response" else int(http.get(b"Content-Length", b"0"))
                    out.append((uri, r.offset, f_.get("warc-type"), _page(f_.get("warc-record-id")), f_.get("warc-target-uri"), size, f_.get("warc-payload-digest", "").removeprefix("sha1:"), _page(f_.get("warc-refers-to"))))
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

    names = ["uri", "offset", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to"]
    kinds = ["string", "long", "string", "long", "string", "long", "string", "long"]
    arrow = pa.schema([(a, pa.string() if b == "string" else pa.int64()) for a, b in zip(names, kinds, strict=True)])
    uris = files.select("uri")
    records = uris.mapInArrow(lambda b: load(b, False), ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))
    return records, uris.mapInArrow(lambda b: load(b, True), "uri string, offset long, length long, reason string")


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(read(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read_archives(files)[0].select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
