"""How filters interact: what each removes, alone or after others, in every order they can be applied in.

A document's failures are one bit per filter. Documents are counted by part and bits first, so everything after that
works on at most 2 ** len(FILTERS) cells a part, however large the corpus or a part is. The cells are then unpivoted
against the steps of all orders; a running bit-or window over a cell's steps tells whether an earlier filter of the
order has removed it, conditional sums give the counts of a step, and a window over a filter's steps in all orders
gives its total.

Texts are read once: a thin table (doc_id, part, digest of the text, bits) is written and read twice. Copies of a text
are found by its SHA-256. The least doc_id of a digest is aggregated before it moves, and rows look it up by digest and
doc_id together, so a text that a third of all documents share isn't gathered in one task.

Defined cases: a null text is an empty one and equal to it; a null language is the part ''; a row without doc_id, or
with the least doc_id of its text (also if that row is repeated), repeats nothing; rows without a label, or with a null
one, lose nothing good or toxic; of several labels of a doc_id a 1 counts; equal rows are counted each; an empty table
gives no rows; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality import let

LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = r"[#$%&*|]"
#: The filters on one text by letter: whether a text fails, from its facts.
OWN: dict[str, Callable[[Column], Column]] = {
    "A": lambda q: q["words"] < LEAST_WORDS,
    "B": lambda q: q["distinct"] * 100 < q["words"] * LEAST_DISTINCT_PERCENT,
    "C": lambda q: q["capitals"] * 100 > q["points"] * MOST_CAPITALS_PERCENT,
    "D": lambda q: q["symbols"],
}
#: The filter on repeated texts.
REPEATED = "E"
FILTERS = "".join(OWN) + REPEATED


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def facts(text: Column) -> Column:
    """A struct of what the filters on one text look at."""
    count = let(common.words_column(text), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    return F.struct(
        count["words"].cast("long").alias("words"),
        count["distinct"].cast("long").alias("distinct"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("capitals"),
        F.length(text).cast("long").alias("points"),
        text.rlike(SYMBOLS).alias("symbols"),
    )


def own_failures(text: Column) -> Column:
    """The bits of the filters on one text that it fails."""
    failed = lambda q: sum((F.when(f(q), F.lit(bit(x))).otherwise(F.lit(0)) for x, f in OWN.items()), F.lit(0))
    return let(facts(text), failed)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of docs: the bits of all filters that it fails."""
    text = F.coalesce("text", F.lit(""))
    thin = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("own"))
    thin = common.stored(thin, common.work_folder(docs.sparkSession), "failures")
    known = thin.where(F.col("doc_id").isNotNull())
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeated = F.when(F.col("first").isNull(), F.lit(bit(REPEATED))).otherwise(F.lit(0))
    judged = known.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("own") + repeated).alias("mask"))
    return judged.unionByName(thin.where(F.col("doc_id").isNull()).select("doc_id", "part", F.col("own").alias("mask")))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, and those among them that labels call good or toxic."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    count = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from cells; bit k of a mask is the k-th letter of filters."""
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])).alias("filter_order")
    steps = counted.select("*", orders).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).where(F.col("filter") != "")
    steps = steps.withColumn("bit", F.expr(f"shiftleft(1, locate(filter, '{filters}') - 1)")).withColumn("step", (F.col("at") + 1).cast("int"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    steps = steps.withColumn("fails", fails).withColumn("earlier", F.coalesce(F.bit_or(fails).over(before), F.lit(0)))
    gone, failed, alone = F.col("earlier") != 0, F.col("fails") != 0, F.col("mask") == F.col("bit")
    total = lambda which, name, c="n": F.sum(F.when(which, F.col(c)).otherwise(F.lit(0))).cast("long").alias(name)
    rows = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~gone & ~failed, "kept"),
        total(~gone & failed, "removed"),
        total(gone & failed, "redundant"),
        total(alone, "unique_fails"),
        total(~gone & failed, "good_lost", "good"),
        total(~gone & failed, "toxic_lost", "toxic"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley over all of docs."""
    return audit(cells(failures(docs), labels))
