"""Pieces shared by the operators: shared-folder tables, word columns, byte kernels.

A *word* is a maximal run of bytes other than space, tab, LF, VT, FF and CR
(``[^\\x20\\x09-\\x0D]+``).  The numpy kernels work on the UTF-8 bytes of an Arrow
batch, a bounded block of documents at a time, so the memory of a Python worker
follows the block size (or the longest single text), not the batch.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
BLOCK_BYTES = 1 << 20
#: Ids up to this number may be broadcast (8 bytes each, at most some 50 MB as a hash relation).
BROADCAST_IDS = 1_000_000

_kept: dict[str, SparkSession] = {}


# --------------------------------------------------------------------------- tables


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is set only where none is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_all() -> None:
    for path, spark in list(_kept.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has gone; the folder belongs to the cluster
            pass


atexit.register(_delete_all)


class Stored:
    """A table written to the shared folder; ``drop()`` removes it early."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        _kept[self.path] = spark
        df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        if _kept.pop(self.path, None) is not None:
            _delete(self.spark, self.path)


def store(df: DataFrame) -> Stored:
    """Cuts the lineage of ``df`` with a Parquet table that every executor can read again."""
    return Stored(df)


def keep_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (left_semi) or isn't (left_anti).

    ``ids`` has one column, ``doc_id``, and should be stored: it is counted first and
    broadcast only up to ``BROADCAST_IDS`` rows; beyond that both sides are shuffled.
    """
    name = fresh(docs, "id")[0]
    ids = ids.select(F.col("doc_id").alias(name))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id") == F.col(name), how)


# --------------------------------------------------------------------------- columns


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that ``df`` doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k = 0
        while f"__{name}{k or ''}".lower() in taken:
            k += 1
        out.append(f"__{name}{k or ''}")
        taken.add(out[-1].lower())
    return out


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(0)).cast("int")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; of a null text, an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and seed alone: 52 bits of an MD5 sum."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


# --------------------------------------------------------------------------- kernels

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("n", np.zeros(1))[0] < size:
        size = max(size, 1 << 16)
        base = np.full(size, _BASE, dtype=np.uint64)
        base[0] = 1
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        with np.errstate(over="ignore"):
            _powers.update(n=np.array([size]), up=np.cumprod(base), down=np.cumprod(inverse))
    return _powers["up"], _powers["down"]


SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block:
    """Some whole documents as bytes: ``buf`` and ``offsets`` (one more than documents)."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets = first, buf, offsets
        self.docs = len(offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of True in ``inside``; runs don't cross documents."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        lens = np.diff(self.offsets)
        first = self.offsets[:-1][lens > 0]
        last = self.offsets[1:][lens > 0] - 1
        starts[first] = inside[first]
        ends[last] = inside[last]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.edges(~SPACES[self.buf])

    def bounds(self, starts: np.ndarray) -> np.ndarray:
        """Index of the first run of each document, and the number of runs at the end."""
        return np.searchsorted(starts, self.offsets)


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column in blocks of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_bytes, side="right")) - 1)
        j = min(j, n)
        yield Block(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, segment: int = BLOCK_BYTES) -> np.ndarray:
    """64-bit hash of the bytes of each run; equal bytes give equal hashes anywhere."""
    out = np.empty(len(starts), dtype=np.uint64)
    values = _byte_values()
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + segment, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            up, down = power_tables(hi - lo + 1)
            sums = np.empty(hi - lo + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(values[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


_STEPS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3)]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` consecutive word hashes (empty if there are fewer)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            out += words[k : k + n] * _STEPS[k % 5] if k < 5 else mix(words[k : k + n] + np.uint64(k))
        return mix(out)


def shingle_sets(block: Block, width: int = 5) -> Iterator[np.ndarray]:
    """For each document of a lower-cased block: its distinct shingle hashes, sorted.

    With fewer words than ``width``, the whole sequence is the one shingle; without
    words there is none.
    """
    starts, ends = block.words()
    hashes = run_hashes(block.buf, starts, ends)
    cuts = block.bounds(starts)
    windows = window_hashes(hashes, width)
    for i in range(block.docs):
        a, b = int(cuts[i]), int(cuts[i + 1])
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield window_hashes(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def lowered(block: Block) -> Block:
    return Block(block.first, LOWER[block.buf], block.offsets)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it.

    Neighbouring projections are merged, so a column that a lambda names would be
    computed again for each element; a lambda's own variable isn't.
    """
    return F.transform(F.array(value), use)[0]


def trimmed(f):
    """``f`` for mapInArrow; when a task ends, its worker gives back the memory it no longer uses.

    Workers wait for further tasks beside the executor's heap, and would otherwise hold
    what their largest block took.
    """

    def run(batches):
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def tidy(spark: SparkSession) -> None:
    """Lets the driver find what is no longer used, so that Spark deletes its shuffle files.

    Shuffle files go when the driver's garbage is collected; an operator of several
    phases would otherwise hold those of all phases at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
