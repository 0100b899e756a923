"""Tables, written intermediates, and word hashing over Arrow text buffers."""

from __future__ import annotations

import ctypes
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom import session

U64 = np.uint64
BLOCK = 1 << 18
#: Bytes of text that one numpy step works on; longer texts are taken alone.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's switch to delete the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows read back from a table in the shared work folder, which ends their lineage.

    What was shuffled to make them is deleted at once.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return session.written(df, f"llm-{purpose}")
    finally:
        conf.set(_CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for made in tables:
        files = made.inputFiles()
        if files:
            spark = made.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), at


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or of one row."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


#: Narrow rows (an id or two) that may be broadcast: at most 16 MB of ids.
FEW_ROWS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """Narrow rows for a join with texts: broadcast if they are counted to be few, else shuffled."""
    return F.broadcast(ids) if ids.count() <= FEW_ROWS else ids


def byte_set(members: bytes) -> np.ndarray:
    """A mask over the 256 byte values."""
    mask = np.zeros(256, bool)
    mask[np.frombuffer(members, np.uint8)] = True
    return mask


SPACE = byte_set(bytes([0x20, *range(0x09, 0x0E)]))
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All bytes as they are.
PLAIN = np.arange(256, dtype=np.uint8)

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scrambled 64-bit values, one to one for a seed."""
    h = h + U64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _cut(data: np.ndarray, at: np.ndarray, pos: int, sep: np.ndarray) -> int:
    """Where a block that begins at pos ends: after a separator or at the end of a text."""
    last = int(at[-1])
    stop = pos + BLOCK
    if stop >= last:
        return last
    edge = int(at[np.searchsorted(at, stop, "right") - 1])
    found = np.flatnonzero(sep[data[pos:stop]])
    best = max(edge, pos + int(found[-1]) + 1 if len(found) else 0)
    if best > pos:
        return best
    while stop < last:  # a word longer than a block
        step = min(stop + BLOCK, int(at[np.searchsorted(at, stop, "right")]))
        found = np.flatnonzero(sep[data[stop:step]])
        if len(found):
            return stop + int(found[0]) + 1
        if step == at[np.searchsorted(at, step, "left")]:
            return step
        stop = step
    return last


def words(
    data: np.ndarray, at: np.ndarray, sep: np.ndarray, heads: tuple[int, ...] = (), fold: np.ndarray = LOWER
) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words (runs of bytes that are no separators) of consecutive texts, with bytes folded (A-Z to a-z).

    Returns the index of the first word of each text (and the end), the start bytes of the
    words, and hashes: of the whole words, then of their first bytes for each length in heads.
    Words of no more than that many bytes have the hash of the whole word.
    """
    starts: list[np.ndarray] = []
    hashes: list[list[np.ndarray]] = [[] for _ in range(1 + len(heads))]
    pos, last = int(at[0]), int(at[-1])
    while pos < last:
        stop = _cut(data, at, pos, sep)
        block = data[pos:stop]
        n = len(block)
        inside = np.empty(n + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(sep[block], out=inside[1:-1])
        edges = at[np.searchsorted(at, pos, "right") : np.searchsorted(at, stop, "left")] - pos
        first = inside[1:-1] & ~inside[:-2]
        final = inside[1:-1] & ~inside[2:]
        first[edges] = inside[1:-1][edges]
        final[edges - 1] = inside[1:-1][edges - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(final) + 1
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((fold[block].astype(U64) + U64(1)) * up[:n], out=total[1:])
        base, back = total[begin], down[begin]
        starts.append(begin + pos)
        hashes[0].append(mixed((total[end] - base) * back))
        for k, most in enumerate(heads):
            hashes[k + 1].append(mixed((total[np.minimum(end, begin + most)] - base) * back))
        pos = stop
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.searchsorted(begin, at), [begin], [
        np.concatenate(h) if h else np.zeros(0, U64) for h in hashes
    ]


def ids_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others cannot clash with those an operator adds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application.

    The archive lies in the shared work folder, from which every executor fetches it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent).as_posix())
    target = f"{session.work_folder(spark, 'llm-package')}/{package.name}.zip"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(raw.getvalue()))
    out.close()
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def give_back() -> None:
    """Return the free memory of this worker to the system: it waits for later tasks, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of rows in a batch for Python, and Spark's setting for it, whose default is eight times as much.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with this package at hand on the executors; between batches workers give back what is free.

    Batches are bounded in bytes for the rest of the session, unless a setting was made: the executor holds
    them outside its heap, and each worker holds several copies of its own.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if df.sparkSession.sparkContext.getConf().get(_BATCH) is None:
        conf.set(_BATCH, str(BATCH_BYTES))

    def spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            give_back()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(spaced(batches))
        give_back()

    return df.mapInArrow(bounded, schema)
