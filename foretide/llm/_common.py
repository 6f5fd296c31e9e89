"""Helpers shared by the operators: shared-folder tables, words, worker caches."""
from __future__ import annotations

import hashlib
import re
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: A-Z only: other letters keep their case.
LOWER = {c: c + 32 for c in range(65, 91)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset a local
    session gets one of its own; on a cluster that raises, as executors could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="foretide-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def table(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Writes a frame as Parquet in the shared folder and reads it back: later reads neither
    recompute it nor depend on the executor that made it."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*written: DataFrame) -> None:
    """Deletes tables that `table` wrote and nothing reads any more."""
    for df in written:
        delete(df.sparkSession, df.written_to)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of n rows for what is run inside: rows that are large themselves come singly."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Shipped:
    """A vocabulary file by broadcast, so that executors need not have it; `key` names its content."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.key, self.held = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    @property
    def data(self) -> bytes:
        return self.held.value


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def released(run):
    """A function of batches that gives its memory back to the system when it ends: idle workers
    otherwise keep the most that any stage needed."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def settled(df: DataFrame, what: str) -> DataFrame:
    """`table`, without the shuffle files that it took: they go when the write has ended."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = conf.get(key)
    conf.set(key, "true")
    try:
        return table(df, what)
    finally:
        conf.set(key, old)


#: Bytes of text that are hashed at a time; places of a byte in a word that have powers of their own.
CHUNK, PLACES = 1 << 17, 1 << 16


def _hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = np.random.default_rng(20240611).integers(0, 1 << 63, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    power = np.multiply.accumulate(np.full(PLACES, 0x9E3779B97F4A7C15, np.uint64))
    return value, space, power


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kept = worker_cache()
    if "hash_tables" not in kept:
        kept["hash_tables"] = _hash_tables()
    return kept["hash_tables"]


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds of each) from the column's own memory; null texts are empty."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def run_hashes(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes that begin at `start` (ascending, the first at 0) and end at the next.

    Sums over the bytes of a random value for the byte and a power for its place, mixed with the
    run's length; upper and lower case differ."""
    value, power = _cased(), _tables()[2]
    out, ends, lo = np.empty(len(start), np.uint64), np.append(start[1:], len(raw)), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(ends, start[lo] + CHUNK, "right")))
        x, y = int(start[lo]), int(ends[hi - 1])
        first = start[lo:hi] - x
        size = ends[lo:hi] - start[lo:hi]
        place = np.arange(y - x) - np.repeat(first, size)
        out[lo:hi] = mixed(np.add.reduceat(value[raw[x:y]] * power[place & (PLACES - 1)], first) + size.astype(np.uint64))
        lo = hi
    return out


def _cased() -> np.ndarray:
    kept = worker_cache()
    if "cased" not in kept:
        kept["cased"] = np.random.default_rng(20240613).integers(0, 1 << 63, 256, dtype=np.uint64)
    return kept["cased"]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words with A-Z lowered, words of each text), from the column's own memory.

    A word's hash is as in `run_hashes`, but for its case.  Texts of any length are taken CHUNK bytes
    at a time, cut between words; null texts have no words."""
    value, blank, power = _tables()
    raw, at = raw_texts(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space, opens = blank[raw], np.zeros(len(raw) + 1, bool)
    opens[at[:-1]] = True  # texts begin here
    hashes, begins, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(raw):
        hi = lo + CHUNK
        if hi < len(raw):
            # Back to the last place between words, or on to the next one behind a very long word.
            back = np.flatnonzero(space[lo:hi] | opens[lo + 1 : hi + 1])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:
                on = np.flatnonzero(space[hi:] | opens[hi:-1])
                hi += int(on[0]) if len(on) else len(raw)
        hi = min(hi, len(raw))
        own = np.flatnonzero(~space[lo:hi])
        if len(own):
            first = np.flatnonzero(np.concatenate(([True], np.diff(own) > 1)) | opens[lo + own])
            size = np.diff(np.append(first, len(own)))
            place = np.arange(len(own)) - np.repeat(first, size)
            sums = np.add.reduceat(value[raw[lo + own]] * power[place & (PLACES - 1)], first)
            hashes.append(mixed(sums + size.astype(np.uint64)) | np.uint64(2))
            begins.append(lo + own[first])
        lo = hi
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.diff(np.searchsorted(begin, at))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, whatever ships the function."""
    return sys.modules.setdefault("_foretide_worker", types.ModuleType("_foretide_worker")).__dict__
