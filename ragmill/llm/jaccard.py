"""Near-duplicate components by a self-join on the Jaccard similarity of word shingles.

Token-combination prefixes: a document's tokens (64-bit hashes of its distinct 5-word shingles) have one
order for all documents, tokens of the rare class first and each class by hash. Two documents that link
share a token in their prefixes of m + 1 tokens, m being what each may lack of the other.

* Equal sets are one node from the start, so copies cost no pairs.
* Rare class: tokens in at most COMMON prefixes are indexed singly. The number of shared prefix tokens
  bounds the overlap from above and so drops most candidates without their texts.
* Frequent class: a document skips frequent tokens and extends its prefix until it has m + 1 rare ones. One
  that has too few rare ones takes frequent tokens too, as many more as the combinations need, and indexes
  pairs of frequent tokens of one hash class instead of single ones.
* Candidates are verified on their whole sets. Of a group, first a star is verified; pairs within a
  component that already stands can change nothing and are left out, all others are verified too, so no link
  between components is lost and a large group costs no quadratic number of pairs.

Defined cases: null and empty texts have no shingles and are alone; fewer than five words make one shingle;
rows that repeat a document get its row each; of rows with one doc_id and several texts each has its own text's
component, and the components of all texts that this doc_id stands for are one; a null doc_id gives a null component; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import Bitmap, bitmap, components, one_each

#: Prefixes that may hold a token of the rare class; see Index for how this grows to bound what is broadcast.
COMMON = 16
#: Frequent tokens that are broadcast at most (8 bytes each).
MOST_FREQUENT = 1 << 20
#: Tokens of one group of the counting and pairing steps, and those that a task works on at once, about. A task may have several
#: Python workers, and a worker keeps what it once took, so these and BLOCK are what bounds an executor's memory.
PART_TOKENS = 250_000
CHUNK_TOKENS = 250_000
#: Pairs that a task compares, holds or gives back at once, about.
BLOCK = 1 << 18
_LAST = np.uint64(2**64 - 1)


def may_lack(n: int, percent: int) -> int:
    """Tokens of a set of n that a set linked with it may lack."""
    return n - -(-percent * n // 100)


def head_size(n: int, percent: int) -> int:
    """Stored tokens: the prefix, with room for frequent tokens."""
    m = may_lack(n, percent)
    return min(n, m + 1 + m // 8 + 12)


def _sets(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, sid, tokens) of every row: size, digest and head of its set."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches):
            sets = common.shingle_sets(group.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    group.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[: head_size(len(s), percent)].tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "sid", "tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n long, sid binary, tokens binary")


def _tokens(docs: DataFrame, only: Bitmap) -> DataFrame:
    """(id, n, tokens): the whole sets of documents with words and an id in only, roughly."""
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if batch.num_rows:
                batch = batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy().view(np.uint64))))
            for group in common.groups([batch] if batch.num_rows else []):
                sets = common.shingle_sets(group.column(1).to_pylist())
                table = pa.RecordBatch.from_arrays(
                    [group.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["id", "n", "tokens"],
                )
                yield table.filter(pa.array([len(s) > 0 for s in sets]))

    return docs.select("doc_id", "text").mapInArrow(of, "id long, n long, tokens binary")


@dataclass(frozen=True)
class Flat:
    """Sets one after the other."""

    ids: np.ndarray
    n: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray

    @cached_property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)])

    def each(self, values: np.ndarray) -> np.ndarray:
        """A value of each set for each of its tokens."""
        return np.repeat(values, self.lengths)

    def prefix(self, percent: int) -> np.ndarray:
        """Whether each token is in the plain prefix of its set."""
        return np.arange(len(self.tokens)) - self.each(self.bounds[:-1]) <= self.each(may_lack(self.n, percent))


@dataclass(frozen=True)
class Rule:
    """How signatures are made; the same for all documents."""

    percent: int
    frequent: np.ndarray  # sorted

    @cached_property
    def marks(self) -> np.ndarray:
        """By a token's low bits whether it may be frequent, so that few tokens are looked up."""
        out = np.zeros(1 << max(12, (8 * len(self.frequent)).bit_length()), bool)
        out[self.frequent & np.uint64(len(out) - 1)] = True
        return out

    def rare(self, tokens: np.ndarray) -> np.ndarray:
        out = np.ones(len(tokens), bool)
        if len(self.frequent):
            likely = np.flatnonzero(self.marks[tokens & np.uint64(len(self.marks) - 1)])
            at = np.searchsorted(self.frequent, tokens[likely])
            at[at == len(self.frequent)] = 0
            out[likely] = self.frequent[at] != tokens[likely]
        return out

    def singles(self, tokens: np.ndarray, n: int) -> tuple[np.ndarray, bool]:
        """The first m + 1 rare tokens; whether there were so many."""
        need = may_lack(n, self.percent) + 1
        found = tokens[self.rare(tokens)][:need]
        return found, len(found) == need

    def all_singles(self, some: Flat) -> tuple[np.ndarray, np.ndarray]:
        """singles() of many sets: whether each token is among them; whether each set has so many."""
        is_rare = self.rare(some.tokens)
        upto = np.concatenate([[0], np.cumsum(is_rare)])
        need = may_lack(some.n, self.percent) + 1
        before = upto[some.bounds[:-1]]
        own = is_rare & (upto[1:] - some.each(before) <= some.each(need))
        return own, upto[some.bounds[1:]] - before >= need

    def combinations(self, tokens: np.ndarray, n: int) -> np.ndarray:
        """Hashes of pairs of frequent tokens of one class, for a whole set with too few rare tokens.

        A prefix of m + classes + 1 tokens holds at least classes + 1 of the shared ones. If all of these are
        frequent, two fall into one class. The number of classes goes by the size of the set; sets of linked
        documents are within one power of two, so each set is indexed under its own and the next number.
        """
        is_rare = self.rare(tokens)
        rare, frequent = tokens[is_rare], tokens[~is_rare]
        out = []
        for level in (n.bit_length() - 1, n.bit_length()):
            classes = max(1, 1 << max(0, level - 4))
            held = frequent[: max(0, may_lack(n, self.percent) + classes + 1 - len(rare))]
            of = common.mix(held) % np.uint64(classes)
            order = np.argsort(of, kind="stable")
            x, of, mixed = held[order], of[order], common.mix(held[order] + np.uint64(level))
            for apart in range(1, len(x)):  # pairs that stand so far apart within a class
                same = of[apart:] == of[:-apart]
                if not same.any():
                    break
                out.append(common.mix(mixed[:-apart][same] ^ x[apart:][same]))
            if len(rare) + len(frequent) == 1 or len(tokens) <= classes + may_lack(n, self.percent):
                # Too small a set for a pair to be sure: its frequent tokens one by one.
                out.append(common.mix(held + np.uint64(level) * common.LANES[0]))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches (id, n, tokens, ...) with about CHUNK_TOKENS tokens each at most; a larger set makes one of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)) // 8
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_TOKENS, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def _flats(batches: Iterable[pa.RecordBatch]) -> Iterator[Flat]:
    """Sets of batches (id, n, tokens, ...) with about CHUNK_TOKENS tokens at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in _slices(batches):
        tokens = batch.column(2).cast(pa.large_binary())
        ends = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, tokens.offset * 8)
        flat = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.uint64)
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), flat, np.diff(ends) // 8))
        size += len(flat)
        if size >= CHUNK_TOKENS:
            yield Flat(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield Flat(*map(np.concatenate, zip(*held, strict=True)))


_COUNTS = "part int, tokens binary, counts binary"


def _count(heads: DataFrame, rule: Rule, parts: int, beyond: bool) -> DataFrame:
    """(token, n): tokens in at least two signatures; beyond: only what signatures hold beyond the plain prefix."""
    shared = heads.sparkSession.sparkContext.broadcast(rule)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = shared.value
        for some in _flats(batches):
            chosen = some.prefix(rule.percent)
            if beyond:
                own, full = rule.all_singles(some)
                chosen = own & ~chosen & some.each(full | (some.lengths == some.n))
            tokens, counts = np.unique(some.tokens[chosen], return_counts=True)
            part = (tokens % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            tokens, counts, part = tokens[order], counts[order].astype(np.uint32), part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            ends = np.r_[cuts[1:], len(part)] if len(part) else []
            rows = [(int(part[a]), tokens[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts, ends, strict=True)]
            yield _table(rows, [("part", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def summed(table: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
        total = np.add.reduceat(counts, starts) if len(starts) else counts
        tokens = tokens[starts]
        keep = total >= (1 if beyond else 2)
        return pa.table({"token": pa.array(tokens[keep].view(np.int64)), "n": pa.array(total[keep])})

    return heads.mapInArrow(dealt, _COUNTS).groupBy("part").applyInArrow(summed, "token long, n long")


def _table(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])


_PAIRS = "a long, b long, n_a long, n_b long, c long"


def _pairs(heads: DataFrame, rule: Rule, repeated: Bitmap, parts: int, most: int) -> DataFrame:
    """Candidates (a, b, n_a, n_b, c) with c shared single tokens of one part, a < b; n below 0 marks sets without a full prefix.

    A token with more than `most` documents isn't paired here; it comes as (token, token, 0, 0, 0). Pairs are given back by BLOCK of
    them, so one may come several times, each with a part of its c.
    """
    shared = heads.sparkSession.sparkContext.broadcast((rule, repeated))

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, repeated = shared.value
        for some in _flats(batches):
            own, full = rule.all_singles(some)
            own = np.flatnonzero(own & some.each(full | (some.lengths == some.n)))  # others come as whole sets too
            own = own[repeated.has(some.tokens[own])]
            token, doc, size = some.tokens[own], some.each(some.ids)[own], some.each(np.where(full, some.n, -some.n))[own]
            part = (token % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            token, doc, size, part = token[order], doc[order], size[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            ends = np.r_[cuts[1:], len(part)] if len(part) else []
            rows = [(int(part[a]), token[a:b].tobytes(), doc[a:b].tobytes(), size[a:b].tobytes()) for a, b in zip(cuts, ends, strict=True)]
            yield _table(rows, [("part", pa.int32()), ("tokens", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary())])

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b, n_a, n_b = np.concatenate(found, axis=1)
        order = np.lexsort((b, a))
        a, b, n_a, n_b = a[order], b[order], n_a[order], n_b[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
        c = np.diff(np.r_[first, len(a)])
        c[n_a[first] == 0] = 0
        return pa.record_batch({"a": a[first], "b": b[first], "n_a": n_a[first], "n_b": n_b[first], "c": c})

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        token = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint64)
        doc = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64)
        size = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.int64)
        order = np.lexsort((doc, token))
        token, doc, size = token[order], doc[order], size[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])] if len(token) else np.empty(0, bool)
        token, doc, size = token[new], doc[new], size[new]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
        lengths = np.diff(np.r_[starts, len(token)])
        over = token[starts[lengths > most]].view(np.int64)
        found, held = [np.array([over, over, over * 0, over * 0])], 0
        for length in np.unique(lengths[(lengths > 1) & (lengths <= most)]):  # all tokens with so many documents, by BLOCK of pairs
            every = starts[lengths == length]
            i, j = np.triu_indices(int(length), 1)
            for k in range(0, len(every), step := max(1, BLOCK // len(i))):
                at = every[k : k + step, None]
                a, b = (at + i).ravel(), (at + j).ravel()
                small, large = np.minimum(abs(size[a]), abs(size[b])), np.maximum(abs(size[a]), abs(size[b]))
                fits = 100 * small >= rule_percent * large
                found.append(np.array([doc[a[fits]], doc[b[fits]], size[a[fits]], size[b[fits]]]))
                held += found[-1].shape[1]
                if held > BLOCK:
                    yield counted(found)
                    found, held = [np.empty((4, 0), np.int64)], 0
        yield counted(found)

    rule_percent = rule.percent
    kind = "part int, tokens binary, docs binary, sizes binary"
    return heads.mapInArrow(dealt, kind).groupBy("part").applyInArrow(paired, _PAIRS)


def _joined(pairs: DataFrame, sets: DataFrame, keep: Callable[[np.ndarray, int, np.ndarray, int], bool]) -> DataFrame:
    """The pairs (a, b, ...) whose sets, given as (id, n, tokens), satisfy keep."""
    # Of the sets only those that a side needs are moved, and perhaps a few more. The smaller ids, among them those that a
    # group shares, come first: pairs that meet at one of them are short as yet, and their sets are then dealt by the other.
    first, second = (bitmap(pairs, side) for side in ("a", "b"))
    one = _filtered(sets, first).select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    other = _filtered(sets, second).select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    joined = pairs.join(one, "a").join(other, "b").select("n_a", "n_b", "tokens_a", "tokens_b", *pairs.columns)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            sets = zip(batch.column(2), batch.column(3), strict=True)
            kept = [keep(np.frombuffer(x.as_buffer(), np.uint64), n, np.frombuffer(y.as_buffer(), np.uint64), m) for (n, m), (x, y) in zip(numbers, sets, strict=True)]
            yield batch.select(batch.schema.names[4:]).filter(pa.array(kept, pa.bool_()))

    return joined.mapInArrow(of, pairs.schema)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) that link."""

    def links(x: np.ndarray, _: int, y: np.ndarray, __: int) -> bool:
        n = _shared(x, y)
        return 100 * n >= percent * (len(x) + len(y) - n)

    return _joined(pairs, sets, links)


def _possible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their heads, the lowest tokens of each set: below the lower end both are known whole."""

    def may(x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
        end = min(x[-1] if len(x) < n else _LAST, y[-1] if len(y) < m else _LAST)
        x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
        most = _shared(x, y) + min(n - len(x), m - len(y))
        return 100 * most >= percent * (n + m - most)

    return _joined(pairs, heads, may)


def _filtered(sets: DataFrame, ids: Bitmap) -> DataFrame:
    """The rows of sets with an id in a bitmap."""
    shared = sets.sparkSession.sparkContext.broadcast(ids)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy().view(np.uint64))))

    return sets.mapInArrow(of, sets.schema)


def _marked(sets: DataFrame, ids: Bitmap) -> DataFrame:
    """sets with doubtful: whether the id may be among ids."""
    shared = sets.sparkSession.sparkContext.broadcast(ids)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array(shared.value.has(batch.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, "doubtful"])

    return sets.mapInArrow(of, "id long, n long, tokens binary, doubtful boolean")


def _members(pairs: DataFrame) -> DataFrame:
    """The ids in pairs (a, b), some more than once."""
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def near_duplicates(docs: DataFrame, percent: int = common.SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: whole components of links with Jaccard >= percent / 100."""
    folder = common.work_folder(docs.sparkSession)
    sets = common.stored(_sets(docs, percent), folder, "sets")
    nodes = common.stored(
        sets.where("sid IS NOT NULL AND doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("node"), F.max("n").alias("n")), folder, "nodes"
    )
    labels = _labels(docs, sets, nodes, folder, percent).withColumnRenamed("id", "node")
    return (
        sets.join(nodes.select("sid", "node").join(labels, "node", "left"), "sid", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, percent: int = common.SIMILAR) -> DataFrame:
    """The rows of docs without those whose component holds a smaller doc_id; all columns stay."""
    folder = common.work_folder(docs.sparkSession)
    groups = common.stored(near_duplicates(docs, percent), folder, "groups")
    return one_each(docs, groups, folder)


def _labels(docs: DataFrame, sets: DataFrame, nodes: DataFrame, folder: str, percent: int) -> DataFrame:
    """(id, component) of all nodes that link."""
    spark = docs.sparkSession
    # Documents that surely stand for their set stay where they are read; of the others those that don't are left out.
    ids = nodes.select(F.col("node").alias("id"))
    copies = sets.join(nodes.select("sid", "node"), "sid").where("doc_id <> node").select(F.col("doc_id").alias("id"))
    copies = common.stored(copies.join(ids, "id", "left_anti"), folder, "spare")
    every = sets.where("sid IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "n", "tokens")
    every = common.stored(_marked(every, bitmap(copies, "id")), folder, "every")
    doubtful = common.stored(every.where("doubtful").drop("doubtful").join(copies, "id", "left_anti"), folder, "doubtful")
    heads = every.where("NOT doubtful").drop("doubtful").unionByName(doubtful)
    common.release(spark)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total * (100 - percent) // (100 * PART_TOKENS)))

    counts = common.stored(_count(heads, Rule(percent, np.empty(0, np.uint64)), parts, False), folder, "counts")
    common.release(spark)
    limit = COMMON
    while counts.where(F.col("n") > limit).count() > MOST_FREQUENT:
        limit *= 2  # prefixes hold a bounded number of tokens, so the frequent ones stay below their bound
    frequent = _longs(counts.where(F.col("n") > limit), "token")

    # Tokens of one prefix only are left out, so there are fewer parts than in the count.
    pair_parts = max(1, -(-((counts.agg(F.sum(F.least("n", F.lit(4 * limit)))).first()[0] or 0)) // PART_TOKENS))
    whole = None
    step = 0
    while True:
        # Whatever changes the rule, prefixes grow by it: what they take in beyond their frequent tokens is counted
        # again, as it may be frequent itself. That goes over the sets that the rule has touched so far; once the rule
        # stands, all are looked through for others that it touches, and sets whose head is too short for it come whole.
        step += 1
        rule = Rule(percent, frequent)
        touched = common.stored(_touched(heads, rule), folder, f"touched-{step}")
        short = touched.where("short").select("id")
        short = common.stored(short if whole is None else short.join(whole.select("id"), "id", "left_anti"), folder, f"short-{step}")
        if short.limit(1).count():
            near = bitmap(short, "id")
            fresh = _tokens(docs, near).join(short, "id", "left_semi")
            fresh = common.stored(fresh, folder, f"whole-{step}")
            whole = fresh if whole is None else whole.unionByName(fresh)
        changed = touched.drop("short") if whole is None else touched.drop("short").unionByName(whole)
        settled = True
        for turn in itertools.count(1):
            more = common.stored(_count(changed, rule, max(1, parts // 8), True), folder, f"more-{step}-{turn}")
            added = _longs(more.where(F.col("n") > limit), "token")
            if len(added) <= max(8, len(frequent) // 50):
                break
            frequent = np.union1d(frequent, added)
            rule, settled = Rule(percent, frequent), False
        if not settled:
            continue
        # The rest is small; what still crowds a token is caught when pairs are made.
        repeated = bitmap(counts.select("token").unionByName(more.select("token")), "token")
        signed = heads if whole is None else heads.unionByName(whole)
        raw = common.stored(_pairs(signed, rule, repeated, pair_parts, 4 * limit), folder, "raw")
        over = _longs(raw.where("c = 0"), "a")
        if not len(over):
            break
        frequent = np.union1d(frequent, over)
    # Both prefixes end somewhere in the order. What the one that ends first shares with the other set, it
    # shares with its prefix, and beyond its prefix it has n - m - 1 tokens.
    beyond = lambda n: F.ceil(F.abs(n) * percent / 100) - 1
    total_n = F.abs("n_a") + F.abs("n_b")
    overlap = F.ceil(total_n * percent / (100 + percent) - F.lit(1e-9))
    may_link = (F.col("n_a") < 0) | (F.col("n_b") < 0) | (F.col("c") + F.greatest(beyond(F.col("n_a")), beyond(F.col("n_b"))) >= overlap)
    # Documents with too few rare tokens: few next to all, as their signatures are many.
    crowded = common.stored(_crowded(changed, rule), folder, "crowded")
    combo_parts = max(1, -(-(crowded.agg(F.sum(F.col("n") * 2)).first()[0] or 0) // PART_TOKENS))
    alone = crowded.select("id", "n", "tokens", F.col("id").alias("component"))
    met = _combination_pairs(alone, rule, combo_parts, True).select("a", "b", F.lit(True).alias("met"))
    candidates = (
        raw.unionByName(met, allowMissingColumns=True)
        .groupBy("a", "b")
        .agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("c").alias("c"), F.max("met").alias("met"))
        .where(F.col("met") | may_link)
        .select("a", "b")
    )
    candidates = common.stored(candidates, folder, "candidates")
    paired = common.stored(_filtered(heads, bitmap(_members(candidates), "id")), folder, "paired")
    candidates = common.stored(_possible(candidates, paired, percent), folder, "possible")
    common.release(spark)

    members = _members(candidates).union(crowded.select("id"))
    chosen = bitmap(members, "id")
    verifiable = _tokens(docs, chosen)
    # The filter lets few others through; once it is too small for its members, they are joined as well.
    verifiable = common.stored(verifiable.join(members, "id", "left_semi") if chosen.full else verifiable, folder, "verifiable")

    star = candidates.groupBy("b").agg(F.min("a").alias("a"))
    star = common.stored(star, folder, "star")
    links = common.stored(_verified(star, verifiable, percent), folder, "links-1")
    labels = components(links, folder, "first")
    open_pairs = common.stored(_across(candidates.join(star, ["a", "b"], "left_anti"), labels), folder, "open")
    labels = _merged(labels, common.stored(_verified(open_pairs, verifiable, percent), folder, "links-2"), folder, "second")
    tagged = crowded.join(labels, "id", "left").select("id", "n", "tokens", F.coalesce("component", "id").alias("component"))
    rest = common.stored(_combination_pairs(tagged, rule, combo_parts, False).distinct(), folder, "rest")
    return _merged(labels, common.stored(_verified(rest, verifiable, percent), folder, "links-3"), folder, "all")


def _merged(labels: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """The components of those that stand and of more links between x and y, the components that the linked ones are in."""
    if not links.limit(1).count():
        return labels
    moved = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), folder, name)
    moved = moved.select(F.col("id").alias("component"), F.col("component").alias("whole"))
    # A component that stands holds its own id; one that doesn't is a document that had no link.
    joined = labels.join(moved, "component", "full")
    return common.stored(joined.select(F.coalesce("id", "component").alias("id"), F.coalesce("whole", "component").alias("component")), folder, f"{name}-labels")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose members are in different components as yet, with these as x and y."""
    of = lambda key, name: labels.select(F.col("id").alias(key), F.col("component").alias(name))
    joined = pairs.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    return joined.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x <> y")


def _touched(heads: DataFrame, rule: Rule) -> DataFrame:
    """The sets with a frequent token in their plain prefix, whose signatures alone the rule changes; short: whether more than
    the head is needed, as it holds too few rare tokens."""
    shared = heads.sparkSession.sparkContext.broadcast(rule)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = shared.value
        for batch in _slices(batches):
            for some in _flats([batch]):
                plain = ~rule.rare(some.tokens) & some.prefix(rule.percent)
                changed = np.diff(np.concatenate([[0], np.cumsum(plain)])[some.bounds]) > 0
                short = pa.array(~rule.all_singles(some)[1] & (some.lengths < some.n))
                yield pa.RecordBatch.from_arrays([*batch.columns, short], names=[*batch.schema.names, "short"]).filter(pa.array(changed))

    return heads.mapInArrow(of, "id long, n long, tokens binary, short boolean")


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """The distinct columns of an array of two rows."""
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    return pairs[:, np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)]] if pairs.shape[1] else pairs


def _crowded(signed: DataFrame, rule: Rule) -> DataFrame:
    """Whole sets (id, n, tokens) with too few rare tokens for a prefix of single ones."""
    shared = signed.sparkSession.sparkContext.broadcast(rule)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in batch.column(2)]
            keep = [len(t) == n and not shared.value.singles(t, n)[1] for n, t in zip(batch.column(1).to_pylist(), sets, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return signed.mapInArrow(of, "id long, n long, tokens binary").dropDuplicates(["id", "tokens"])


def _combination_pairs(crowded: DataFrame, rule: Rule, parts: int, star: bool) -> DataFrame:
    """Candidates (a, b, x, y), x and y their components, of crowded(id, n, tokens, component) that meet in a combination of frequent tokens.

    All rare tokens of these documents are indexed singly, so a pair that meets here only shares frequent ones:
    at most the smaller number f of those. With n tokens it can so link with sets of at most
    f * (100 + p) / p - n tokens, which leaves out what strays too far from a group without a comparison.
    star: of each combination the pairs with the document that strays least; else all pairs between components. These may be as many
    as the product of strays and group, so they are given back by BLOCK of distinct ones, and one may come several times.
    """
    shared = crowded.sparkSession.sparkContext.broadcast(rule)
    percent = rule.percent

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = shared.value
        for batch in _slices(batches):
            rows = {"key": [], "id": [], "n": [], "most": [], "component": []}
            for i, n, t, component in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                tokens = np.frombuffer(t.as_buffer(), np.uint64)
                keys = rule.combinations(tokens, n)
                most = int((~rule.rare(tokens)).sum()) * (100 + percent) // percent - n
                rows["key"].append(keys)
                for name, value in (("id", i), ("n", n), ("most", most), ("component", component)):
                    rows[name].append(np.full(len(keys), value, np.int64))
            if not rows["key"]:
                continue
            flat = {k: np.concatenate(v) for k, v in rows.items()}
            part = (flat["key"] % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            flat, part = {k: v[order] for k, v in flat.items()}, part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            ends = np.r_[cuts[1:], len(part)] if len(part) else []
            out = [(int(part[a]), *(v[a:b].tobytes() for v in flat.values())) for a, b in zip(cuts, ends, strict=True)]
            yield _table(out, [("part", pa.int32()), *((k, pa.binary()) for k in flat)])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        read = lambda name, kind=np.int64: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        key, doc, n, most, component = read("key", np.uint64), read("id"), read("n"), read("most"), read("component")
        order = np.lexsort((doc, n, key))
        key, doc, n, most, component = key[order], doc[order], n[order], most[order], component[order]
        ids, first = np.unique(doc, return_index=True)
        of_ids = component[first]

        def given(pairs: np.ndarray) -> pa.RecordBatch:
            a, b = pairs
            x, y = (of_ids[np.searchsorted(ids, side)] for side in (a, b))
            return pa.record_batch({"a": a, "b": b, "x": x, "y": y})

        found = [np.empty((2, 0), np.int64)]
        if len(key):
            starts, lengths = _runs(key)
            # Sizes ascend within a key, so the first is the least; what can't even link with that is out.
            able = most >= np.repeat(n[starts], lengths)
            key, doc, n, most, component = key[able], doc[able], n[able], most[able], component[able]
        if len(key) and star:
            starts, lengths = _runs(key)
            reach = most / n
            top = np.flatnonzero(reach == np.repeat(np.maximum.reduceat(reach, starts), lengths))
            hub = np.repeat(top[np.searchsorted(top, starts)], lengths)
            fits = (n <= most[hub]) & (most >= n[hub]) & (doc != doc[hub])
            found.append(np.array([np.minimum(doc, doc[hub])[fits], np.maximum(doc, doc[hub])[fits]]))
        elif len(key):
            starts, lengths = _runs(key)
            open_ = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
            size = 0
            for a, length in zip(starts[open_].tolist(), lengths[open_].tolist(), strict=True):
                k = slice(a, a + length)
                _, of, members = np.unique(component[k], return_inverse=True, return_counts=True)
                # Whoever is outside the largest component meets all others: nobody else is in two of them.
                outside = a + np.flatnonzero(of != members.argmax())
                for at in range(0, len(outside), step := max(1, BLOCK // length)):
                    i = outside[at : at + step, None]
                    x, y = np.nonzero((component[i] != component[k]) & (n[k] <= most[i]) & (most[k] >= n[i]))
                    x, y = doc[i[x, 0]], doc[a + y]
                    found.append(np.array([np.minimum(x, y), np.maximum(x, y)]))
                    size += len(x)
                    if size > BLOCK or len(found) > 1000:
                        found = [_distinct(np.concatenate(found, axis=1))]
                        size = 0
                        if found[0].shape[1] > 4 * BLOCK:
                            yield given(found[0])
                            found = [np.empty((2, 0), np.int64)]
        yield given(_distinct(np.concatenate(found, axis=1)))

    kind = "part int, key binary, id binary, n binary, most binary, component binary"
    return crowded.mapInArrow(dealt, kind).groupBy("part").applyInArrow(paired, "a long, b long, x long, y long")


def _longs(rows: DataFrame, column: str) -> np.ndarray:
    """A column of bounded length, as sorted unsigned integers."""
    return np.unique(rows.select(column).toArrow().column(column).to_numpy().view(np.uint64))
