"""What the operators of this subpackage share: folders, lineage cuts and text kernels.

The text kernels work on whole Arrow batches with numpy: the UTF-8 bytes of many
documents lie in one buffer, so that splitting into words and hashing them takes
a few vector operations a chunk and no Python code a word.  A chunk ends with a
document, so memory is bounded by ``CHUNK_BYTES`` or by the longest document.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenlake.session import shared_dir, ship

#: Bytes of text that a kernel handles at once (a longer document alone).
CHUNK_BYTES = 1 << 20
#: ASCII white space that separates words: [\x20\x09-\x0D].
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: Rows of an Arrow batch: whole texts are long, and 10,000 of them (Spark's default) would not fit beside each other.
BATCH_ROWS = 1000
#: Words in a shingle.
SHINGLE_WORDS = 5
M64 = (1 << 64) - 1


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and kept as reliable checkpoint files (survives lost executors).

    What led to it is then garbage; it is collected at once, so that Spark drops
    the shuffle files of finished steps and iterations do not pile them up.
    """
    spark = frame.sparkSession
    shared_dir(spark)
    kept = frame.checkpoint(eager=True)
    del frame
    gc.collect()
    spark._jvm.System.gc()
    return kept


def write_table(frame: DataFrame) -> tuple[DataFrame, str]:
    """``frame`` as Parquet in the shared folder, for tables too large for a checkpoint; the table and its path."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


#: What a worker keeps from task to task, and the module whose tasks it ran last.
_KEPT: dict = {}
_OWNER: list[str] = [""]


def kept(key, make):
    """``make()``, made once a worker as long as it runs tasks of one operator."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def map_arrow(frame: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(frame.sparkSession)
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    owner = function.__module__

    def run(batches):
        if _OWNER[0] != owner:  # another operator's stores are not needed beside this one's
            _KEPT.clear()
            _OWNER[0] = owner
            release()
        yield from function(batches)
        release()

    return frame.mapInArrow(run, schema)


def settle(spark: SparkSession) -> None:
    """``release`` on the driver, after a model was fitted there; the JVM gives back what the collected sample took."""
    release()
    spark._jvm.System.gc()


def release() -> None:
    """Give a finished task's memory back: workers live on, and what one task needed would stay beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove what ``write_table`` wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text kernels


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _base() -> tuple[np.ndarray, np.uint64, np.uint64]:
    """Random value of each byte (A-Z as a-z), an odd base and its inverse modulo 2**64."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    base = 0xD1342543DE82EF95
    return values, np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n at least."""
    if not _POWERS or len(_POWERS["up"]) < n:
        _, base, inverse = _base()
        n = max(n, CHUNK_BYTES + 1)
        for name, x in (("up", base), ("down", inverse)):
            steps = np.full(n, x, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``CHUNK_BYTES``: first row, bytes, offsets (from 0).  Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, "right")) - 1)
        end = min(end, len(column))
        yield at, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True


def spans(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk: starts, ends and first word of each document (one longer than the documents)."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~separator[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased; equal for equal words everywhere."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    values, _, _ = _base()
    up, down = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


#: Odd factors of a shingle's words.
_PLACES = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(SHINGLE_WORDS)]


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``SHINGLE_WORDS`` words, repeats included, and each document's first one.

    A document with fewer words has one, of its whole sequence; without words, none.
    """
    k = SHINGLE_WORDS
    counts = np.diff(first)
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(out_counts, out=out_first[1:])
    m = len(words)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    full = np.zeros(m, np.uint64)
    for j in range(k):
        full += padded[j : j + m] * _PLACES[j]
    keep = np.ones(m, dtype=bool)
    for j in range(1, k):  # the last k - 1 words of a document begin no full shingle
        at = first[1:] - j
        keep[at[at >= first[:-1]]] = False
    short = np.flatnonzero((counts > 0) & (counts < k))
    for d in short:  # few words each
        a, n = first[d], counts[d]
        full[a] = (sum(int(words[a + j]) * int(_PLACES[j]) for j in range(n)) + 0x5851F42D4C957F2D * int(n)) & M64
        keep[a] = True
    return mix(full[keep]), out_first


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's sorted distinct shingle hashes (empty for no words)."""
    for row, buf, offs in text_chunks(column):
        starts, ends, first = spans(buf, offs)
        hashes, at = shingles(word_hashes(buf, starts, ends), first)
        for d in range(len(offs) - 1):
            part = hashes[at[d] : at[d + 1]]
            if len(part) > 1:
                part.sort()
                fresh = np.empty(len(part), dtype=bool)
                fresh[0] = True
                np.not_equal(part[1:], part[:-1], out=fresh[1:])
                part = part[fresh]
            yield row + d, part
