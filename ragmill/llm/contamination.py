"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

An item is found in a document that holds at least 75 % of the item's distinct 5-word shingles, wherever
they stand. Items fall into partitions by their number of shingles (powers of two). An item's sketch is its
bottom-k MinHash: the k smallest of its shingle hashes in a scrambled order, with k set per partition so
that a document without any of the k can't reach the threshold for any item of the partition: k is one more
than the largest number of shingles that a matching document may lack. A sketch so misses nothing,
in contrast to sampled permutations. A document of any length is read once: the hashes of its shingles are
looked up among all sketches, and only the items that answer are verified, by counting their shingles
in the document, as text.

Benchmark items go to the executors in blocks of at most BLOCK_BYTES of text, whatever the benchmark's size;
documents are read once per block and never shuffled.

Defined cases: null and empty texts and items match nothing; an item of fewer than five words is one shingle
of all its words, found where a document's words hold them in a row; equal rows give equal rows; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of item texts that are broadcast at once; an item longer than this makes a block of its own.
BLOCK_BYTES = 8_000_000


def shingles(words: list[bytes]) -> set[bytes]:
    n = common.SHINGLE
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@dataclass
class Block:
    """Some benchmark items, ready for search."""

    items: list[tuple[int, str]]
    percent: int
    #: Window sizes in words (5, and fewer for short items): sorted sketch hashes and the items of each.
    sketches: dict[int, tuple[np.ndarray, list[list[int]]]] = field(default_factory=dict)
    sets: list[set[bytes]] = field(default_factory=list)

    def __post_init__(self) -> None:
        found: dict[int, dict[int, list[int]]] = {}
        lists = [common.words_of(text, lower=True) for _, text in self.items]
        self.sets = [shingles(w) for w in lists]
        widths = [min(common.SHINGLE, len(w)) for w in lists]
        partitions: dict[tuple[int, int], list[int]] = {}
        for i, s in enumerate(self.sets):
            if s:
                partitions.setdefault((widths[i], len(s).bit_length()), []).append(i)
        for (width, _), members in sorted(partitions.items()):
            # The largest item of the partition may lack the most shingles.
            k = max(len(self.sets[i]) - math.ceil(len(self.sets[i]) * self.percent / 100) + 1 for i in members)
            for i in members:
                hashes = np.unique(common.window_hashes(common.word_hashes(lists[i]), width))
                for h in common.mix(hashes)[np.argsort(common.mix(hashes))][:k].tolist():
                    found.setdefault(width, {}).setdefault(h, []).append(i)
        for width, by_hash in found.items():
            keys = np.array(sorted(by_hash), np.uint64)
            self.sketches[width] = keys, [by_hash[int(h)] for h in keys]

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shared shingles, shingles of the item) of the items that a text holds."""
        words = common.words_of(text, lower=True)
        hashes = common.word_hashes(words)
        wanted: set[int] = set()
        for width, (keys, owners) in self.sketches.items():
            windows = common.mix(common.window_hashes(hashes, width))
            windows = windows[windows <= keys[-1]]
            at = np.searchsorted(keys, windows)
            for k in np.unique(at[keys[at] == windows]):
                wanted.update(owners[k])
        if not wanted:
            return []
        held = shingles(words)
        out = []
        for i in sorted(wanted):
            short = len(next(iter(self.sets[i])).split()) < common.SHINGLE
            shared = len(self.sets[i] & held) if not short else int(b" " + next(iter(self.sets[i])) + b" " in b" " + b" ".join(words) + b" ")
            if 100 * shared >= self.percent * len(self.sets[i]):
                out.append((self.items[i][0], shared, len(self.sets[i])))
        return out


_BLOCKS: dict[str, Block] = {}


def _block(token: str, items: list[tuple[int, str]], percent: int) -> Block:
    """The prepared block, kept by a worker until it is given another."""
    if token not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[token] = Block(items, percent)
    return _BLOCKS[token]


def blocks(benchmark: DataFrame, folder: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct items with words, in blocks of bounded size; the driver holds one block at a time."""
    items = benchmark.select("item_id", "text").where(F.col("text").rlike(common.WORD)).distinct()
    items = common.stored(items.withColumn("bytes", F.octet_length("text").cast("long")), folder, "items")
    total = items.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, math.ceil(total / (BLOCK_BYTES / 2)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        block: list[tuple[int, str]] = []
        size = 0
        for row in (items if n == 1 else items.where(part == k)).select("item_id", "text").toLocalIterator():
            if block and size + len(row["text"]) > BLOCK_BYTES:
                yield sorted(block, key=str)
                block, size = [], 0
            block.append((row["item_id"], row["text"]))
            size += len(row["text"])
        if block:
            yield sorted(block, key=str)


SCHEMA = "doc_id long, item_id long, n_shared long, n_item_shingles long, containment double"


def find(docs: DataFrame, benchmark: DataFrame, percent: int = common.SIMILAR) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, n_shared, n_item_shingles, containment."""
    spark = docs.sparkSession
    folder = common.work_folder(spark)
    found = None
    for k, block in enumerate(blocks(benchmark, folder)):
        part = _find(spark, docs, block, percent, f"{folder}/{k}")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def _find(spark: SparkSession, docs: DataFrame, block: list[tuple[int, str]], percent: int, token: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _block(token, shared.value, percent).search
        for group in common.groups(batches):
            pairs = zip(group.column(0).to_pylist(), group.column(1).to_pylist(), strict=True)
            rows = [(doc, item, n, of_item, n / of_item) for doc, text in pairs for item, n, of_item in search(text)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "n_shared", "n_item_shingles", "containment"],
            )

    return docs.select("doc_id", "text").mapInArrow(of, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = common.SIMILAR) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; judged row by row, so no join and no shuffle."""
    spark = docs.sparkSession
    folder = common.work_folder(spark)
    kept = docs
    for k, block in enumerate(blocks(benchmark, folder)):
        shared = spark.sparkContext.broadcast(block)
        kept = kept.mapInArrow(functools.partial(_keep, shared=shared, percent=percent, token=f"{folder}/{k}"), docs.schema)
    return kept


def _keep(batches: Iterable[pa.RecordBatch], shared, percent: int, token: str) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    search = _block(token, shared.value, percent).search
    for group in common.groups(batches):
        texts = group.column(group.schema.get_field_index("text")).to_pylist()
        yield group.filter(pa.array([not search(t) for t in texts], pa.bool_()))
