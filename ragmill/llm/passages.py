"""Removal of repeated passages by a log-structured index of window fingerprints.

A window is WINDOW words in a row. Of the 8-word runs in a window, the one of lowest hash (of equals the
last) is its anchor, so equal windows have equal anchors, and neighbouring windows mostly share one. The
index holds the hashes of anchors in sorted, immutable runs, bucketed alike. Each batch of documents becomes
a run; it is merge-joined with the runs before it, bucket by bucket and without moving them, and what occurs
twice is noted. When there are more than MOST_RUNS runs, they are merged into one.

Anchors only choose what to verify: windows whose anchor occurs twice are compared by 128-bit hashes of
their words, over all documents. A window that is frequent in what one task reads travels once from there.
Copies of whole documents are settled before: they cover each other, and one of them stands for all.

Defined cases: null and empty texts have no words; fewer than WINDOW words hold no window; rows that repeat
a document repeat its windows; equal rows give equal rows; a null doc_id is kept; an empty table gives an
empty table; extra columns are ignored. Rows of one doc_id with different texts count as one document's.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import Bitmap, bitmap

WINDOW = 35
ANCHOR = 8
BATCHES = 3
MOST_RUNS = 2
CHUNK_WORDS = 1_500_000
PART_WINDOWS = 2_000_000
_MASK = (1 << 64) - 1
_NO_ID = 1 << 63
_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 8-word runs of some words, and for each window the place of its anchor among them."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = common.window_hashes(hashes, ANCHOR)
    span = window - ANCHOR + 1
    places = np.empty(len(runs) - span + 1, np.int64)
    low = np.uint64((1 << 20) - 1)
    for a in range(0, len(places), 500_000):
        part = runs[a : a + 500_000 + span - 1]
        # The high bits of the hash, then the place from the end: the minimum over a span, by doubling, has both.
        key = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        n = len(part) - span + 1
        best = np.minimum(key[:n], key[span - width : span - width + n])
        places[a : a + n] = a + (low - (best & low)).astype(np.int64)
    return runs, places


class FingerprintIndex:
    """Sorted runs of distinct fingerprints as bucketed tables in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.runs: list[str] = []
        self.prefix = f"run_{uuid.uuid4().hex}"
        self.made = 0

    def _write(self, keys: DataFrame) -> str:
        """keys: distinct (key, n)."""
        self.made += 1
        name = f"{self.prefix}_{self.made}"
        writer = keys.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key")
        writer.option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in a batch's fingerprints (key); gives those that now occur twice and, in an earlier batch, maybe not."""
        name = self._write(batch.groupBy("key").agg(F.count("*").alias("n")))
        new = self.spark.table(name)
        again = new.where("n > 1").select("key")
        for run in self.runs:
            # Both sides are bucketed and sorted alike: a merge join that moves neither.
            again = again.unionByName(new.hint("merge").join(self.spark.table(run), "key", "left_semi").select("key"))
        again = common.stored(again, self.folder, f"{name}-again")
        self.runs.append(name)
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return again

    def compact(self) -> None:
        """Merges all runs into one and drops them."""
        merged = None
        for run in self.runs:
            table = self.spark.table(run).select("key", "n")
            merged = table if merged is None else merged.unionByName(table)
        name = self._write(merged.groupBy("key").agg(F.sum("n").alias("n")))
        self.close()
        self.runs = [name]

    def close(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")


def _firsts(places: np.ndarray) -> np.ndarray:
    """Places without repeats; anchors of neighbouring windows never go back."""
    if not len(places):
        return places
    keep = np.ones(len(places), bool)
    np.not_equal(places[1:], places[:-1], out=keep[1:])
    return places[keep]


def _idents(batch: pa.RecordBatch) -> np.ndarray:
    """A hash of doc_id and text for each row, so that texts with one doc_id are told apart."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1)
    found = (xxhash.xxh3_64_intdigest(t.as_buffer() or b"", seed=_NO_ID if i is None else i & _MASK) for i, t in zip(ids, texts, strict=True))
    return np.fromiter(found, np.uint64, len(ids)).view(np.int64)


def _prints(docs: DataFrame, window: int) -> DataFrame:
    """A row per document: id, doc_id, n words, a digest of the word sequence, digest of the words joined, anchors."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches):
            rows = []
            datas = [common.encoded(t) for t in group.column(1).to_pylist()]
            every, bounds = common.hashed(datas)
            runs, all_places = anchors(every, window)
            for ident, doc_id, data, a, b in zip(_idents(group).tolist(), group.column(0).to_pylist(), datas, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                words, hashes = data.split(), every[a:b]
                places = _firsts(all_places[a : max(a, b - window + 1)])
                rows.append(
                    (
                        ident,
                        doc_id,
                        len(words),
                        xxhash.xxh3_128_digest(hashes.tobytes()),
                        hashlib.sha256(b" ".join(words)).hexdigest(),
                        runs[places].view(np.int64),
                    )
                )
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "doc_id", "n", "sid", "sha", "keys"]
            )

    kind = "id long, doc_id long, n long, sid binary, sha string, keys array<long>"
    return docs.select("doc_id", "text").mapInArrow(of, kind)


def _chosen(docs: DataFrame, chosen: Bitmap, wanted: bool) -> DataFrame:
    """(id, text) of the rows whose id is in a filter; or with wanted false, of the others."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pick(batch, shared.value, wanted)

    return docs.select("doc_id", "text").mapInArrow(of, "id long, text string")


def _pick(batch: pa.RecordBatch, chosen: Bitmap, wanted: bool) -> pa.RecordBatch:
    """See _chosen."""
    values = _idents(batch)
    known = chosen.has(values)
    return pa.RecordBatch.from_arrays([pa.array(values), batch.column(1)], names=["id", "text"]).filter(pa.array(known if wanted else ~known))


def _repeated(docs: DataFrame, spares: Bitmap, checked: DataFrame, keys: Bitmap, window: int, parts: int) -> DataFrame:
    """(id, starts): windows that occur twice, by place, in the rows of docs outside spares and in checked (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, spares))

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for group in common.groups(batches):
            every, bounds = common.hashed([common.encoded(t) for t in group.column(1).to_pylist()])
            runs, places = anchors(every, window)
            hit = shared.value[0].has(runs)[places] if len(places) else np.empty(0, bool)
            for i, a, b in zip(group.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                starts = np.flatnonzero(hit[a : max(a, b - window + 1)])
                if len(starts):
                    lanes = [common.window_hashes(every[a:b], window, lane)[starts] for lane in (0, 1)]
                    held.append((*lanes, np.full(len(starts), i, np.int64), starts.astype(np.int32)))
                    size += len(starts)
                if size >= CHUNK_WORDS:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def first_dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from dealt(_pick(batch, shared.value[1], False) for batch in batches)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, ids, starts in chunks(batches):
            order = np.lexsort((y, x))
            x, y, ids, starts = x[order], y[order], ids[order], starts[order]
            new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            first = np.flatnonzero(new)
            many = np.diff(np.r_[first, len(x)]) > 1
            # A window that this chunk holds twice is known to be repeated; only news of it goes on.
            here = np.repeat(many, np.diff(np.r_[first, len(x)]))
            place = int(x[0] % np.uint64(parts))
            rows = [(parts + place, b"", b"", ids[here].tobytes(), starts[here].tobytes())] if here.any() else []
            x, y, ids, starts, many = x[first], y[first], ids[first], starts[first], many
            starts = np.where(many, np.int32(-1), starts)
            part = (x % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            x, y, ids, starts, part = x[order], y[order], ids[order], starts[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(part)], strict=True):
                rows.append((int(part[a]), x[a:b].tobytes(), y[a:b].tobytes(), ids[a:b].tobytes(), starts[a:b].tobytes()))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "x", "y", "ids", "starts"])

    def matched(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        ids, starts = read("ids", np.int64), read("starts", np.int32)
        if table.column("part")[0].as_py() < parts:
            x, y = read("x", np.uint64), read("y", np.uint64)
            order = np.lexsort((y, x))
            x, y, ids, starts = x[order], y[order], ids[order], starts[order]
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            lengths = np.diff(np.r_[first, len(x)])
            twice = np.repeat((lengths > 1), lengths) & (starts >= 0)
            ids, starts = ids[twice], starts[twice]
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
        ends = np.r_[first[1:], len(ids)].astype(np.int64)
        return pa.table({"id": pa.array(ids[first], pa.int64()), "starts": pa.array([starts[a:b].tobytes() for a, b in zip(first, ends, strict=False)], pa.binary())})

    kind = "part int, x binary, y binary, ids binary, starts binary"
    dealt_rows = docs.select("doc_id", "text").mapInArrow(first_dealt, kind).unionByName(checked.mapInArrow(dealt, kind))
    return dealt_rows.groupBy("part").applyInArrow(matched, "id long, starts binary")


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows that begin at starts cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change[:n]) > 0


def _cut(marked: DataFrame, window: int, with_text: bool) -> DataFrame:
    """(id, n_removed, sha, and with_text the kept text) of (id, text, starts) rows."""
    kind = "id long, n_removed long, kept_sha string" + ", kept string" * with_text

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches):
            rows = []
            for i, text, lists in zip(group.column(0).to_pylist(), group.column(1).to_pylist(), group.column(2).to_pylist(), strict=True):
                words = common.words_of(text)
                starts = np.frombuffer(b"".join(lists), np.int32).astype(np.int64)
                gone = covered(len(words), starts, window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append((i, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode())[: 3 + with_text])
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds[: 3 + with_text], strict=True)], names=["id", "n_removed", "kept_sha", "kept"][: 3 + with_text])

    return marked.mapInArrow(of, kind)


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs; batches: into so many parts docs comes to the index."""
    spark = docs.sparkSession
    folder = common.work_folder(spark)
    prints = common.stored(_prints(docs, window), folder, "prints")
    groups = prints.groupBy("sid").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    groups = common.stored(groups.where("copies > 1"), folder, "copies")
    # All copies but the first of each group stay out of the index; they are wholly covered or too short for a window.
    spare = common.stored(prints.join(groups, "sid").where("id <> first").select("id"), folder, "spare")
    chosen = prints.where(F.size("keys") > 0).join(spare, "id", "left_anti").select("id", "keys")
    total = prints.agg(F.sum(F.size("keys"))).first()[0] or 0

    index = FingerprintIndex(spark, folder, max(4, -(-total // PART_WINDOWS) * 4))
    again = None
    for k in range(batches):
        batch = chosen.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k).select(F.explode("keys").alias("key"))
        found = index.add(batch)
        again = found if again is None else again.unionByName(found)
    index.close()

    # Documents that are surely no spare copies stay where they are read; the rest is compared with the spare ones.
    spares = bitmap(spare, "id")
    checked = _chosen(docs, spares, True).join(spare, "id", "left_anti").dropDuplicates(["id"])
    parts = max(1, -(-total * 6 // PART_WINDOWS))
    found = common.stored(_repeated(docs, spares, checked, bitmap(again, "key"), window, parts), folder, "repeated")
    marks = found.groupBy("id").agg(F.collect_list("starts").alias("starts"))
    touched = bitmap(found, "id")
    texts = _chosen(docs, touched, True)
    cut = _cut(texts.join(marks, "id").select("id", "text", "starts").dropDuplicates(["id"]), window, False)
    whole = (F.col("copies") > 1) & (F.col("n") >= window)
    return (
        prints.select("id", "doc_id", "n", "sid", "sha")
        .join(groups.select("sid", "copies"), "sid", "left")
        .join(cut, "id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_words"),
            F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        )
    )
