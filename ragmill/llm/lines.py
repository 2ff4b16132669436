"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

A line is removed if it equals an earlier line or is within EDITS edits of a line that first occurs earlier
(by doc_id, then by place), anywhere in the table. Lines are judged on the input, so a removed line still
counts as an earlier one. Lines without a word stay; lines of fewer than LEAST code points are compared for
equality only.

Two lines within t edits share one of t + 1 segments of the shorter one, at a place that its length and the
segment's number confine. Distinct lines are indexed by (length, segment number, hash of the segment); each
probes the indexes of its own and up to t smaller lengths with the substrings that can match. Of the pairs that
meet, those go that differ in too many of eight blocks or in their letters; the rest is verified by a banded
bit-parallel edit distance (Hyyrö 2003): one word holds the 2t + 1 diagonals.

A signature that more than CROWD lines index (near copies of one line) isn't paired as it is. The counts of
letters and digits of two lines within t edits, d apart in length, differ by at most 2t - d in all, so of
2t - d + 1 groups of them one has equal counts: the signature is extended by the counts of each group in turn.
Where more than LARGE lines that share a signature differ in one short window only (a number in a fixed
sentence), it is extended by what is left of the window after up to t deletions instead: what all of them begin
and end with doesn't change their distance, and texts within t edits have such a rest in common. Then two
rounds: every line is compared with the first one under each of its keys, and only lines that this doesn't
settle are paired with the others there, if their counts agree. No pair that could decide about a line is left
out.

Equal lines are one row (128-bit hash of the line) before any join, so frequent lines cost no pairs.

Defined cases: null and empty texts have no lines to remove, null stays null; a text whose lines all go is
empty; rows equal in doc_id and text get the same result; a null doc_id comes after all others; an empty
table gives an empty table; extra columns are kept by `dedup` and ignored by `judge`. A line of fewer than LEAST
code points goes only if it equals an earlier one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import let

EDITS = 2
LEAST = 40
#: Lines that may index a signature before it is extended by counts.
CROWD = 16
#: Lines that may index a signature before the window in which they differ is looked for, and how wide it may be.
LARGE = 256
WIDEST = 24
LETTERS = "etaoinsrhldcumfpgwybvk"
#: Counted besides in the lines of crowds.
DIGITS = "0123456789"
_LAST = (1 << 63) - 1
#: Lines whose texts are looked up by a broadcast; more are looked up by a shuffled join.
BROADCAST_LINES = 500_000


def _cuts(edits: int) -> list[tuple[int, int, int]]:
    """(length less, segment, shift) of every signature of a line."""
    return [
        (less, i, shift)
        for less in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    ]


def indexed(edits: int) -> list[int]:
    """Places of a line's own segments among its signatures; a shorter or equal line may match any of the others too."""
    return [k for k, (less, _, shift) in enumerate(_cuts(edits)) if less == 0 and shift == 0]


def same_length(edits: int) -> list[int]:
    """Places of the signatures that look for lines of the same length."""
    return [k for k, (less, _, _) in enumerate(_cuts(edits)) if less == 0]


def signatures(line: Column, length: Column, edits: int) -> Column:
    """Hashes of a line's segments, and of the substrings that another line's segments may match; null outside the line.

    One lambda over the constant cuts: written out, they'd make a method too long to be compiled.
    """
    cuts = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in _cuts(edits)])

    def one(c: Column) -> Column:
        other = length - c["less"]
        start = F.floor(other * c["i"] / (edits + 1)).cast("int") + 1 + c["shift"]
        end = F.floor(other * (c["i"] + 1) / (edits + 1)).cast("int") + c["shift"]
        return F.when((start >= 1) & (end <= length), F.xxhash64(other, c["i"], F.substr(line, start, end - start + 1)))

    return F.transform(cuts, one)


def blocks_agree(a: Column, b: Column, edits: int, blocks: int = 8) -> Column:
    """Whether all but `edits` of a's blocks stand in b, at most `edits` places off: true of any lines within reach."""
    found = F.lit(0)
    for k in range(blocks):
        start = F.floor(F.length(a) * k / blocks).cast("int")
        size = F.floor(F.length(a) * (k + 1) / blocks).cast("int") - start
        low = F.greatest(F.lit(1), start + 1 - edits)
        area = F.substr(b, low, start + 1 + size + edits - low)
        found = found + F.contains(area, F.substr(a, start + 1, size)).cast("int")
    return found >= blocks - edits


def letter_counts(line: Column, symbols: str = LETTERS) -> Column:
    """How often each of symbols occurs in a line."""
    return F.transform(F.array(*map(F.lit, symbols)), lambda c: F.length(line) - F.length(F.replace(line, c, F.lit(""))))


def letters_agree(a: Column, b: Column, apart: Column, edits: int, symbols: str = LETTERS) -> Column:
    """Whether counts of symbols in lines `apart` in length differ by at most 2 * edits - apart: true of any lines within reach."""
    total = sum((F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(len(symbols))), F.lit(0))
    return total <= 2 * edits - apart


def letter_keys(counts: Column, edits: int, symbols: str = LETTERS) -> Column:
    """For each difference in length d, an array with a hash of each of 2 * edits - d + 1 groups of counts; one at least is equal in lines within reach."""
    schemes = []
    for apart in range(edits + 1):
        n = 2 * edits - apart + 1
        schemes.append(F.array(*[F.xxhash64(F.lit(apart), F.lit(g), *[F.get(counts, F.lit(i)) for i in range(g, len(symbols), n)]) for g in range(n)]))
    return F.array(*schemes)


def remainders(text: Column, edits: int) -> Column:
    """What is left of a short text after up to `edits` deletions; texts within reach of each other have one in common."""
    left = F.array(text)
    for _ in range(edits):
        # A deletion past the end leaves the text as it is.
        less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
        left = F.array_distinct(F.flatten(F.transform(left, less)))
    return left


def begin_alike(a: Column, b: Column) -> Column:
    """How many characters two texts begin with in common."""
    chars = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    other = F.array_position(F.zip_with(chars(a), chars(b), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(other == 0, F.length(a)).otherwise(other - 1).cast("int")


def edit_distance_within(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines, whose lengths differ by at most `edits`, are within so many edits; b runs past a.

    Bit d of a word stands for row j - edits + d of the table's column j. Up to row m the band's lowest
    diagonal is followed, then the last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    chars = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    flip = lambda x: F.lit(full).bitwiseXOR(x)

    def step(m: Column, x: Column, y: Column, s: Column, j: Column) -> Column:
        same = F.lit(0)
        for d in range(width):
            row = j - edits + d
            hit = (row >= 1) & (row <= m) & (F.get(x, row - 1) == F.get(y, j - 1))
            same = same.bitwiseOR(F.when(hit, F.lit(1 << d)).otherwise(F.lit(0)))
        return let(
            same,
            lambda eq: let(
                ((eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full)),
                lambda d0: let(
                    F.struct(
                        s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"]))).alias("hp"),
                        d0.bitwiseAND(s["vp"]).alias("hn"),
                        F.shiftright(d0, 1).alias("down"),
                    ),
                    lambda h: F.struct(
                        h["hn"].bitwiseOR(flip(h["down"].bitwiseOR(h["hp"]))).alias("vp"),
                        h["down"].bitwiseAND(h["hp"]).alias("vn"),
                        (
                            s["score"]
                            + F.when(j + edits <= m, F.when(d0 >= 1 << (width - 1), 0).otherwise(1)).otherwise(
                                F.getbit(h["hp"].cast("long"), m - j + edits).cast("int") - F.getbit(h["hn"].cast("long"), m - j + edits).cast("int")
                            )
                        ).alias("score"),
                    ),
                ),
            ),
        )

    start = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("score"))
    return let(
        F.struct(chars(a).alias("x"), chars(b).alias("y")),
        lambda p: F.aggregate(
            F.sequence(F.lit(1), F.size(p["y"])), start, lambda s, j: step(F.size(p["x"]), p["x"], p["y"], s, j), lambda s: s["score"] <= edits
        ),
    )


def _order(docs: DataFrame) -> DataFrame:
    """A row per document: its place in the order of documents, as (d, t), and its text."""
    return docs.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("text", F.lit("")).alias("text")
    )


def _lines(docs: DataFrame) -> DataFrame:
    """(d, t, p, line) of every line with a word."""
    split = _order(docs).select("d", "t", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return split.where(F.col("line").rlike(common.WORD))


def _key() -> list[Column]:
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")]


def _near(pairs: DataFrame, known: DataFrame, folder: str, name: str, edits: int) -> DataFrame:
    """(h, g) of the later line of each pair (h, h2) that is within reach."""
    other = known.select(*[F.col(c).alias(f"{c}2") for c in known.columns])
    late = F.col("at") > F.col("at2")
    both = pairs.join(known, "h").join(other, "h2").withColumn("apart", F.abs(F.length("line") - F.length("line2")))
    both = both.where((F.col("apart") <= edits) & letters_agree(F.col("counts"), F.col("counts2"), F.col("apart"), edits))
    both = both.where(blocks_agree(F.col("line"), F.col("line2"), edits))
    likely = common.stored(both.select("line", "line2", *[F.when(late, F.col(c)).otherwise(F.col(f"{c}2")).alias(c) for c in ("h", "g")]), folder, f"{name}-likely")
    # Pairs are few and long to verify, so they are dealt out evenly.
    likely = likely.repartition(F.xxhash64("line", "line2"))
    return common.stored(likely.where(edit_distance_within(F.col("line"), F.col("line2"), edits)).select("h", "g").distinct(), folder, name)


def _first_met(keys: DataFrame) -> DataFrame:
    """Pairs (h, h2) of each line with the first line under each of its keys, where that comes earlier."""
    here = F.struct("at", "h")
    first = keys.groupBy("key").agg(F.min(here).alias("any"), F.min(F.when(F.col("own"), here)).alias("owner"))
    met = keys.join(first, "key").select("h", "at", F.when(F.col("own"), F.col("any")).otherwise(F.col("owner")).alias("x"))
    return met.where("x.at < at").select("h", F.col("x.h").alias("h2")).distinct()


def _windows(members: DataFrame, edits: int) -> DataFrame:
    """(sig, head, tail) of the signatures in members (sig, size, line) whose lines, but for so many characters at both ends that are the
    same in all, are at most WIDEST long and have fewer remainders than lines share the signature."""
    back = F.reverse("line")
    ends = members.groupBy("sig", "size").agg(
        F.min("line").alias("a"), F.max("line").alias("b"), F.min(back).alias("c"), F.max(back).alias("d"),
        F.min(F.length("line")).alias("least"), F.max(F.length("line")).alias("most"),
    )
    # What the first and the last of sorted texts begin with, all between them do.
    ends = ends.withColumn("head", begin_alike(F.col("a"), F.col("b")))
    ends = ends.withColumn("tail", F.least(begin_alike(F.col("c"), F.col("d")), F.col("least") - F.col("head")))
    counts = F.array(*[F.lit(sum(math.comb(w, k) for k in range(edits + 1))) for w in range(WIDEST + 1)])
    return ends.where(F.col("size") > F.get(counts, F.col("most") - F.col("head") - F.col("tail"))).select("sig", "head", "tail")


def _met(keys: DataFrame, settled: DataFrame, edits: int) -> DataFrame:
    """Pairs (h, h2) that meet in a key, with letters that agree, and of which the later one is not settled."""
    rows = keys.join(settled.select("h").distinct().withColumn("done", F.lit(True)), "h", "left").withColumn("done", F.col("done").isNotNull())
    index = rows.where("own").select("key", *[F.col(c).alias(f"{c}2") for c in ("h", "at", "n", "counts", "done")])
    # Of two lines of one length either may probe the other, so one does.
    meet = (F.col("h") != F.col("h2")) & (~F.col("own") | (F.col("h") < F.col("h2"))) & ~F.when(F.col("at") > F.col("at2"), F.col("done")).otherwise(F.col("done2"))
    meet = meet & letters_agree(F.col("counts"), F.col("counts2"), F.abs(F.col("n") - F.col("n2")), edits, LETTERS + DIGITS)
    return rows.join(index, (rows["key"] == index["key"]) & meet).select("h", "h2").distinct()


def removed(docs: DataFrame, folder: str, edits: int = EDITS, least: int = LEAST, crowd: int = CROWD, large: int = LARGE) -> DataFrame:
    """(d, t, ps): the places of the lines that go, by document."""
    lines = _lines(docs)
    at = F.struct("d", "t", "p")
    sigs = F.when(F.col("n") >= least, signatures(F.col("line"), F.col("n"), edits))
    occurrences = lines.withColumn("n", F.length("line")).select(*_key(), at.alias("at"), sigs.alias("sigs"))
    # The signatures follow from the line, so any of a group's will do.
    grouped = occurrences.groupBy("h", "g").agg(F.min(F.struct("at", "sigs")).alias("x"))
    distinct = common.stored(grouped.select("h", "g", "x.at", "x.sigs"), folder, "distinct")
    # From here one half of a line's hash names it; should two lines share it, both are looked at.
    rows = distinct.where(F.col("sigs").isNotNull()).select("h", F.posexplode("sigs").alias("k", "sig")).where(F.col("sig").isNotNull())
    own = F.col("k").isin(indexed(edits))
    sizes = rows.where(own).groupBy("sig").agg(F.count("*").alias("size"))
    crowded = common.stored(sizes.where(F.col("size") > crowd), folder, "crowded")
    index = rows.where(own).join(crowded, "sig", "left_anti").select(F.col("sig").alias("sig2"), F.col("h").alias("h2"))
    probes = rows.select("h", "sig", F.col("k").isin(same_length(edits)).alias("same"))
    # Of two lines of one length either may probe the other, so one does.
    meet = F.expr("sig = sig2 AND h <> h2 AND (h < h2 OR NOT same)")
    pairs = common.stored(probes.join(index, meet).select(F.greatest("h", "h2").alias("h"), F.least("h", "h2").alias("h2")).distinct(), folder, "pairs")
    less = F.get(F.array(*[F.lit(x) for x, _, _ in _cuts(edits)]), F.col("k"))
    many = common.stored(rows.join(crowded, "sig", "left_semi").select("h", "sig", own.alias("own"), less.alias("less")), folder, "many")

    wanted = pairs.select("h").union(pairs.select("h2")).union(many.select("h")).distinct()
    wanted = common.stored(distinct.join(wanted, "h", "left_semi").select("h", "g", "at.*"), folder, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_LINES else wanted
    # A text is split once for each line, not once for each letter.
    found = let(F.get(F.split("text", "\n"), F.col("p")), lambda line: F.struct(line.alias("line"), letter_counts(line).alias("counts")))
    known = _order(docs).join(wanted, ["d", "t"]).select("h", "g", at.alias("at"), found.alias("found")).select("h", "g", "at", "found.*")
    known = common.stored(known.distinct(), folder, "texts")

    counts = F.concat("counts", letter_counts(F.col("line"), DIGITS))
    held = known.join(many.select("h").distinct(), "h", "left_semi").select("h", "at", "line", F.length("line").alias("n"), counts.alias("counts"))
    held = common.stored(held, folder, "held")
    windows = _windows(many.join(crowded.where(F.col("size") > large), "sig").join(held.select("h", "line"), "h"), edits)
    windows = common.stored(windows, folder, "windows")
    wide = many.join(windows, "sig", "left_anti").join(held.drop("line"), "h")
    # A line is indexed for all differences in length, and probes for the one of its signature.
    groups = letter_keys(F.col("counts"), edits, LETTERS + DIGITS)
    hashes = F.when(F.col("own"), F.flatten(groups)).otherwise(F.get(groups, F.col("less")))
    wide = wide.select("h", "at", "n", "counts", "own", "sig", F.explode(hashes).alias("key"))
    narrow = many.join(windows, "sig").join(held, "h")
    middle = F.substr("line", F.col("head") + 1, F.col("n") - F.col("head") - F.col("tail"))
    narrow = narrow.select("h", "at", "n", "counts", "own", "sig", F.explode(remainders(middle, edits)).alias("left"))
    keyed = wide.withColumn("key", F.xxhash64("sig", "key")).unionByName(narrow.withColumn("key", F.xxhash64("sig", "left")).drop("left"))
    keyed = common.stored(keyed.drop("sig").distinct(), folder, "keys")
    near = _near(pairs.union(_first_met(keyed)).distinct(), known, folder, "near", edits)
    near = near.union(_near(_met(keyed, near, edits), known, folder, "near-again", edits)).distinct()
    # Of a line within reach of an earlier one every occurrence goes; of others all but the first.
    verdict = distinct.select("h", "g", "at").join(near.withColumn("near", F.lit(True)), ["h", "g"], "left")
    occurrences = lines.select(*_key(), at.alias("place"))
    gone = occurrences.join(verdict, ["h", "g"]).where(F.col("near").isNotNull() | (F.col("place") != F.col("at")))
    return common.stored(gone.select("place.*").groupBy("d", "t").agg(F.collect_set("p").alias("ps")), folder, "gone")


def _kept(text: Column, places: Column) -> Column:
    """The text without the lines at places, in time by its lines and places."""
    return let(
        F.struct(F.split(text, "\n").alias("ls"), places.alias("ps")),
        lambda x: let(
            F.struct(x["ls"].alias("ls"), F.array_except(F.sequence(F.lit(0), F.size(x["ls"]) - 1), x["ps"]).alias("left")),
            lambda y: F.array_join(F.transform(y["left"], lambda i: F.get(y["ls"], i)), "\n"),
        ),
    )


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs with their texts shortened; all columns stay."""
    gone = removed(docs, common.work_folder(docs.sparkSession), edits, least)
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    text = F.when(F.col("ps").isNull(), F.col("row.text")).otherwise(_kept(F.col("row.text"), F.col("ps")))
    return keyed.join(gone, ["d", "t"], "left").select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def judge(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_removed, text (shortened) of every row."""
    gone = removed(docs, common.work_folder(docs.sparkSession), edits, least)
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    return keyed.join(gone, ["d", "t"], "left").select(
        "doc_id",
        F.when(F.coalesce("text", F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("ps"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("ps").isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col("ps"))).alias("text"),
    )
