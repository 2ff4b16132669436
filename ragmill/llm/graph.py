"""Connected components of links, and bounded filters of ids, as distributed steps over stored tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the smallest id reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until each id is a root or has one
    neighbour, a root. The large-star step is a grouped minimum (combined before the shuffle) and a join, the small-star
    step a minimum over one id's smaller neighbours, so no task needs a whole component. The minima that tell whether it
    is done are those of the next large-star step, and the labels.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    for step in itertools.count(1):
        both = edges.union(edges.select("v", "u"))
        below = F.when(F.col("v") < F.col("u"), F.col("v"))
        ends = both.groupBy("u").agg(F.min("v").alias("low"), F.max(below).alias("below"), F.max("v").alias("high"))
        ends = ends.select("u", F.least("u", "low").alias("m"), F.expr("low < u AND (below > low OR high > u)").alias("open"))
        ends = common.stored(ends, folder, f"{name}-ends-{step}")
        if not ends.where("open").limit(1).count():
            return ends.select(F.col("u").alias("id"), F.col("m").alias("component"))
        large = both.where("v > u").join(ends.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Each smaller neighbour goes to the least of them, and the id itself does so in place of that one: edges don't become more.
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = common.stored(small, folder, f"{name}-{step}")


#: The primes of XXH64, whose hash of a long Spark's xxhash64 gives with seed 42.
PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64(values: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for longs, so that filters are filled in the JVM and asked in numpy."""
    p1, p2, p3, p4, p5 = PRIMES
    with np.errstate(over="ignore"):
        x = (np.uint64(42 + 8) + p5) ^ (_rotated(values * p2, 31) * p1)
        x = _rotated(x, 27) * p1 + p4
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))


#: Bits per member of a filter, and the most bits that one may have (32 MB).
BITS_EACH = 16
MOST_BITS = 1 << 28
#: Values of which a filter is made where they come together (1 MB); the words of more are put together before.
FEW = 1 << 17


class Bitmap:
    """A Bloom filter of 64-bit values with two hashes: may say yes wrongly, never no."""

    def __init__(self, words: np.ndarray, full: bool = False) -> None:
        self.words = words
        #: Whether there are more members than it has room for, so that too many others pass.
        self.full = full

    def has(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        last = np.uint64(len(self.words) * 64 - 1)
        hashes = xxhash64(values.view(np.uint64))
        for at in (hashes & last, (hashes >> np.uint64(32)) & last):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


def bitmap(values: DataFrame, column: str) -> Bitmap:
    """Of a column of longs, sized by how many differ up to MOST_BITS, which bounds what is sent to and from the driver."""
    values = values.select(F.col(column).cast("long").alias("x"))
    rows, n = values.agg(F.count("*"), F.approx_count_distinct("x")).first()
    n = min(rows, n)
    bits = 1 << 12
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    if rows <= FEW:
        h = xxhash64(values.where("x IS NOT NULL").toArrow().column("x").to_numpy().view(np.uint64))
        at = np.concatenate([h, h >> np.uint64(32)]) & np.uint64(bits - 1)
        out = np.zeros(bits >> 6, np.uint64)
        np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return Bitmap(out, n * 4 > bits)

    at = F.expr(f"explode(array(h & {bits - 1}, shiftrightunsigned(h, 32) & {bits - 1}))").alias("at")
    words = (
        values.select(F.xxhash64("x").alias("h"))
        .select(at)
        .selectExpr("at >> 6 AS word", "1L << CAST(at & 63 AS INT) AS bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return Bitmap(out.view(np.uint64), n * 4 > bits)


def inside(docs: DataFrame, key: str, chosen: Bitmap, wanted: bool) -> DataFrame:
    """The rows, with all columns, whose key is in a bitmap or null; or with wanted false, the others."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    at = docs.columns.index(key)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at)
            known = shared.value.has(ids.fill_null(0).to_numpy().view(np.uint64)) | ids.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(known if wanted else ~known))

    return docs.mapInArrow(of, docs.schema)


def one_each(docs: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """Of each group (doc_id, component_id) the document that names it, once; rows with a null doc_id stay.

    Rows that surely stay aren't moved: only those whose id may be dropped or repeated are joined.
    """
    ids = groups.where("doc_id IS NOT NULL")
    drop = common.stored(ids.where("doc_id <> component_id").select("doc_id").distinct(), folder, "drop")
    again = common.stored(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), folder, "again")
    doubtful = bitmap(drop.unionByName(again), "doc_id")
    checked = inside(docs, "doc_id", doubtful, True)
    nulls = checked.where("doc_id IS NULL")
    checked = checked.where("doc_id IS NOT NULL").join(drop, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return inside(docs, "doc_id", doubtful, False).unionByName(checked.select(*docs.columns)).unionByName(nulls)
