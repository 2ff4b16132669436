"""Pieces that several operators share: words, shingles, working tables, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SHINGLE = 5
#: Similarity from which near-duplicate operators act, in hundredths.
SIMILAR = 75
#: Entries that a worker's word cache may hold before it starts anew.
CACHE_WORDS = 400_000
#: Characters of text that a worker takes in hand at once; one longer text makes a group of its own.
GROUP_CHARS = 1_000_000

_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_column(text: Column) -> Column:
    """The words of a text, in order, as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """bytes.split() parts at the six characters of GAP and at no others."""
    return encoded(text, lower).split()


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0xD1342543DE82EF95
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLOCK = 1 << 19
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _hashes(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power)])
    return mix((sums[to] - sums[at]) * inverse[at])


def hashed(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and where each text's begin (with the end of all as last).

    A word's hash is a polynomial in its bytes, taken from running sums over blocks, so no word is handled singly.
    """
    data = np.frombuffer(b"\n".join(datas), np.uint8)
    edge = np.flatnonzero(np.diff(_SOLID[data], prepend=False, append=False))
    at, to = edge[::2], edge[1::2]
    parts, first = [], 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(to, at[first] + _BLOCK, "right")))
        low = at[first]
        parts.append(_hashes(data[low : to[last - 1]], at[first:last] - low, to[first:last] - low))
        first = last
    ends = np.cumsum(np.fromiter(map(len, datas), np.int64, len(datas)) + 1)
    bounds = np.searchsorted(at, np.concatenate([[0], ends]))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), bounds


def encoded(text: str | None, lower: bool = False) -> bytes:
    if not text:
        return b""
    data = text.encode("utf-8", "surrogatepass")
    return data.translate(_ASCII_LOWER) if lower else data


def word_hashes(words: list[bytes]) -> np.ndarray:
    return hashed([b" ".join(words)])[0]


#: Odd multipliers of the two window hashes.
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def window_hashes(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` word hashes, in time independent of `size`'s doubling."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = LANES[lane]
    with np.errstate(over="ignore"):
        # Runs of 1, 2, 4, ... words, put together by the binary digits of size.
        run, length, done, out = hashes ^ (base >> np.uint64(lane + 1)), 1, 0, None
        run = mix(run) if lane else run
        power = base
        while True:
            if size & length:
                part = run[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += length
            if length * 2 > size:
                break
            run = run[: len(run) - length] * power + run[length:]
            power = power * power
            length *= 2
        return mix(out)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the hashes of its distinct 5-word shingles, ascending; a shorter text's words make one; A-Z lower-cased."""
    hashes, bounds = hashed([encoded(t, lower=True) for t in texts])
    windows = window_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a < SHINGLE:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
            continue
        own = np.sort(windows[a : b - SHINGLE + 1])
        keep = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=keep[1:])
        out.append(own[keep])
    return out


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def groups(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about GROUP_CHARS bytes of text each, so that memory doesn't follow the batch."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_CHARS, "right"))
            upto = max(at + 1, upto)
            yield batch.slice(at, upto - at)
            at = upto


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by size, not only by rows: long texts would make them large in both processes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, a local session gets a temporary one and a cluster an error."""
    bounded_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get() if kept.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        base = tempfile.mkdtemp(prefix="ragmill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: later plans start from files that outlive executors."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, as the length of text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs
