"""Helpers shared by the corpus operators.

Conventions that hold for every operator of this subpackage:

* a null text has no words and no bytes; a null id sorts before every other id;
* rows that are equal in both id and text are one document and get one result each, the same for all;
* columns that an operator adds internally start with ``_cs_`` and so never clash with columns of the input.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
_SLICE_BYTES = 6 << 20
_ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they need no installation of their own.

    Arrow batches are cut to BATCH_ROWS where the session leaves them at Spark's default: 10,000 long texts are too much for a worker.
    """
    sc = spark.sparkContext
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))
    if getattr(sc, "_colscope_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    aside = tempfile.mkdtemp(prefix="colscope-")
    with zipfile.ZipFile(to := f"{aside}/colscope.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(to)
    atexit.register(shutil.rmtree, aside, True)
    sc._colscope_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="colscope-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Gives back what ended jobs have left on the driver.

    Frames that Python has dropped hold plans, broadcasts and shuffles in the JVM until both collect; left to itself, the heap
    grows to its limit first, though little of it is alive. A whole collection also shrinks it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one, for files that workers write."""
    uri = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
    return uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes | memoryview) -> None:
    """Written aside, then renamed: a retried or speculative task leaves one whole file."""
    fs, path = filesystem(uri)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(aside) as out:
        out.write(data)
    fs.move(aside, path)


def remove_folder(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.delete_dir(path)


class LocalCopies:
    """Files of the shared folder as local paths that can be memory-mapped; remote ones are copied once per worker."""

    def __init__(self) -> None:
        self.dir: str | None = None

    def path(self, uri: str) -> str:
        fs, path = filesystem(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            return path
        self.dir = self.dir or tempfile.mkdtemp(prefix="colscope-")
        to = os.path.join(self.dir, os.path.basename(path))
        if not os.path.exists(to):
            with fs.open_input_stream(path) as src, open(to + ".tmp", "wb") as out:
                shutil.copyfileobj(src, out, 1 << 20)
            os.replace(to + ".tmp", to)
        return to

    def close(self) -> None:
        if self.dir:
            shutil.rmtree(self.dir, ignore_errors=True)
            self.dir = None


def long_id(df: DataFrame, id_col: str) -> Column:
    """An integer id in 64 bits, null as the smallest of them. TypeError for ids of another type."""
    if (kind := df.schema[id_col].dataType.typeName()) not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"column {id_col} must hold integers, not {kind}")
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))


def ascii_lower(c: Column) -> Column:
    """A-Z only. lower() equals that for pure ASCII text and has a fast path there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def shards_for(n_bytes: int, each: int) -> int:
    """How many shards, so that each holds about ``each`` bytes of text whatever the corpus size."""
    return max(4, -(-n_bytes // each))


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each has about ``limit`` bytes in column ``text``, one row at least. Gives memory back at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Python workers live on between tasks: what a task has freed goes back to the system, not to the allocator's reserve."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def texts_of(batch: pa.RecordBatch, i: int = 1) -> list[bytes]:
    """Column ``i`` as UTF-8 bytes, null as empty."""
    col = batch.column(i)
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def exchange(df: DataFrame, mapper: Callable, reducer: Callable, schema: str) -> DataFrame:
    """mapper: Arrow batches to batches (shard int, blob binary); reducer: all blobs of a shard to a table."""

    def reduce(table: pa.Table) -> pa.Table:
        out = reducer(table.column("shard")[0].as_py(), table.column("blob").to_pylist())
        release()
        return out

    return df.mapInArrow(mapper, "shard int, blob binary").groupBy("shard").applyInArrow(reduce, schema)


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a well-known 64-bit hash: a bijection that spreads every input bit."""
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Contiguous ranges of the hash space, so that sorting by hash also sorts by shard."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
