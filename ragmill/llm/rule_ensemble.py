"""Text quality by a sparse ensemble of rules, after Friedman and Popescu (2008).

Each text gives a row of statistics. A forest of shallow trees is grown on the statistics of labelled texts, and every
path from a root to a node of it becomes a rule: a conjunction of bounds on statistics. Logistic regression with a lasso
penalty weighs the rules and drops most. What is left is one Spark expression over the statistics, so scoring runs in
the JVM like any other projection.

Whole texts are read once: statistics, some 200 bytes a document, are written and read again for teaching and scoring.
Trees and weights are fitted by Spark on at most `rows` labelled documents, those whose ids have the smallest hashes;
text is in none of it. Of PENALTIES the strongest is taken whose loss on a fifth of these, kept back, is near
the best one's.

Defined cases: a null or empty text has statistics of 0 and a score like any other; a null doc_id is not held out and
teaches nothing; labels other than 0 and 1 teach nothing, and of several labels of a doc_id a 1 counts; without rows of
both labels the score is the share of 1 among them, with one more of each; equal rows get equal rows; an empty table
gives an empty table; columns besides doc_id and text (doc_id and quality of labels) are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import common
from .quality import let

#: Most labelled documents that teach.
SAMPLE = 40_000
#: Documents whose id hashes to 0 modulo this are held out.
HELD_OUT_OF = 5
#: Scores from which a text is taken for good.
GOOD_FROM = 0.3
TREES, DEPTH, LEAST_ROWS = 20, 3, 5
#: Lasso penalties, the strongest first.
PENALTIES = (0.03, 0.01, 0.003, 0.001)
#: How much worse than the best penalty's the loss of the one taken may be.
NEAR = 1.02
SEED = 11
MARKS = r"[#*$%&|<>@^~=+]"


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


#: Each statistic from a text, its words and its lines that hold a word.
STATISTICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "log_words": lambda t, w, l: F.log1p(F.size(w).cast("double")),
    "log_chars": lambda t, w, l: F.log1p(F.length(t).cast("double")),
    "word_length": lambda t, w, l: _share(F.length(F.array_join(w, "")), F.size(w)),
    "words_a_line": lambda t, w, l: _share(F.size(w), F.size(l)),
    "marks": lambda t, w, l: _share(_count(t, MARKS), F.length(t)),
    "bars": lambda t, w, l: _share(F.size(F.filter(w, lambda x: x == "|")), F.size(w)),
    "marked_words": lambda t, w, l: _share(F.size(F.filter(w, lambda x: x.rlike(f"{MARKS}.*{MARKS}"))), F.size(w)),
    "cries": lambda t, w, l: _share(_count(t, "[!?]"), F.size(w)),
    "unlettered": lambda t, w, l: _share(_count(t, r"[^\p{L}\x20\x09-\x0D]"), F.length(t)),
    "digits": lambda t, w, l: _share(_count(t, r"\p{N}"), F.length(t)),
    "capitals": lambda t, w, l: _share(_count(t, r"\p{Lu}"), F.length(t)),
    "sentences": lambda t, w, l: _share(F.size(F.filter(w, lambda x: x.rlike("[.!?]$"))), F.size(w)),
    "commas": lambda t, w, l: _share(_count(t, "[,;]"), F.size(w)),
    "distinct_words": lambda t, w, l: _share(F.size(F.array_distinct(w)), F.sqrt(F.size(w).cast("double"))),
    "distinct_word_share": lambda t, w, l: _share(F.size(F.array_distinct(w)), F.size(w)),
    "distinct_pair_share": lambda t, w, l: _share(F.size(F.array_distinct(_pairs(w, lambda a, b: F.xxhash64(a, b)))), F.size(w) - 1),
    "repeats_in_a_row": lambda t, w, l: _share(F.size(F.filter(_pairs(w, lambda a, b: a == b), lambda x: x)), F.size(w)),
    "repeated_lines": lambda t, w, l: _share(F.size(l) - F.size(F.array_distinct(l)), F.size(l)),
    "ended_lines": lambda t, w, l: _share(F.size(F.filter(l, lambda x: x.rlike(r"[.!?:;\"”»][\x20\x09-\x0D]*$"))), F.size(l)),
}


def _count(t: Column, characters: str) -> Column:
    """How many characters of a class a text holds; runs are taken out together."""
    return F.length(t) - F.length(F.regexp_replace(t, f"{characters}+", ""))


def _pairs(words: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of every word and the one after it."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), f)


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text."""
    t = F.coalesce(text, F.lit(""))
    parts = F.struct(t.alias("t"), common.words_column(text).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(common.WORD)).alias("l"))
    return let(parts, lambda p: F.struct(*[f(p["t"], p["w"], p["l"]).alias(name) for name, f in STATISTICS.items()]))


#: A rule's bounds: (statistic, whether above, threshold), above meaning > and else <=.
Rule = tuple[tuple[str, bool, float], ...]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(name) > x if above else F.col(name) <= x for name, above, x in rule])


def paths(nodes: list[Row]) -> list[Rule]:
    """The distinct rules of a forest's nodes (treeID, nodeData), one for the way to each node but roots; of bounds on one side the tightest."""
    split = {(n["treeID"], n["nodeData"]["id"]): n["nodeData"] for n in nodes}
    names, found, waiting = [*STATISTICS], {}, [((tree, node), ()) for tree, node in sorted(split) if node == 0]
    for at, way in waiting:
        bounds: dict[tuple[str, bool], float] = {}
        for name, above, x in way:
            bounds[name, above] = (max if above else min)(x, bounds.get((name, above), x))
        if bounds:
            found[tuple(sorted((*side, x) for side, x in bounds.items()))] = None
        node = split[at]
        if node["leftChild"] >= 0:
            name, x = names[node["split"]["featureIndex"]], node["split"]["leftCategoriesOrThreshold"][0]
            waiting += [((at[0], node[child]), (*way, (name, above, x))) for child, above in (("leftChild", False), ("rightChild", True))]
    return [*found]


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and a base; without rules the base alone decides."""

    base: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def probability(self) -> Column:
        """The probability of label 1 over columns named as STATISTICS."""
        odds = reduce(lambda a, b: a + b, [F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules], F.lit(self.base))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def held_out() -> Column:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT_OF))
    return F.coalesce(remainder == 0, F.lit(False))


def taught(facts: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(label, kept_back, statistics) of labelled documents that aren't held out: those of at most `rows` ids, by a hash."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # The chosen ids are bounded by `rows`, so their side of the join can be broadcast.
    kept_back = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 0
    return facts.join(F.broadcast(chosen), "doc_id").select("label", kept_back.alias("kept_back"), *STATISTICS)


def grown(rows: DataFrame, folder: str) -> list[Rule]:
    """The rules of a forest grown on (label, statistics)."""
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy="onethird",
        # No sampling of rows, also not for thresholds, as a sample would depend on how rows lie in partitions.
        bootstrap=False, subsamplingRate=1.0, maxBins=math.isqrt(SAMPLE) + 1, seed=SEED,
    )
    forest.fit(VectorAssembler(inputCols=[*STATISTICS], outputCol="features").transform(rows)).write().overwrite().save(f"{folder}/forest")
    return paths(rows.sparkSession.read.parquet(f"{folder}/forest/data").collect())  # TREES * 2 ** (DEPTH + 1) nodes at most


def weighed(rows: DataFrame, rules: list[Rule], penalty: float) -> Ensemble:
    """Lasso weights of rules from (label, votes), a vector of which rules hold."""
    model = LogisticRegression(labelCol="label", featuresCol="votes", regParam=penalty, elasticNetParam=1.0, maxIter=50, tol=1e-5).fit(rows)
    kept = [(rule, round(w, 6)) for rule, w in zip(rules, model.coefficients.toArray().tolist(), strict=True)]
    return Ensemble(round(float(model.intercept), 6), tuple((rule, w) for rule, w in kept if w))


def loss(rows: DataFrame, ensemble: Ensemble) -> float:
    p = F.least(F.greatest(ensemble.probability(), F.lit(1e-9)), F.lit(1 - 1e-9))
    return rows.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("x")).first()["x"]


def fit(rows: DataFrame, folder: str) -> Ensemble:
    """The ensemble of (label, kept_back, statistics); folder: where rows with their votes and the forest are written."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        good, bad = counts.get(1.0, 0) + 1, counts.get(0.0, 0) + 1
        return Ensemble(math.log(good / bad))
    rules = grown(rows, folder)
    if not rules:  # no statistic tells the labels apart
        return Ensemble(math.log(counts[1.0] / counts[0.0]))
    votes = F.array(*[holds(rule).cast("double") for rule in rules])
    voted = common.stored(rows.withColumn("votes", votes), folder, "voted").withColumn("votes", array_to_vector("votes"))
    teaching, kept_back = voted.where(~F.col("kept_back")), voted.where(F.col("kept_back"))
    penalty = PENALTIES[-1]
    if teaching.select("label").distinct().count() == 2 and kept_back.limit(1).count():
        losses = [loss(kept_back, weighed(teaching, rules, p)) for p in PENALTIES]
        penalty = next(p for p, x in zip(PENALTIES, losses, strict=True) if x <= NEAR * min(losses))
    return weighed(voted, rules, penalty)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; taught by the labelled rows that aren't held out."""
    folder = common.work_folder(docs.sparkSession)
    facts = common.stored(docs.select("doc_id", statistics(F.col("text")).alias("q")), folder, "statistics").select("doc_id", "q.*")
    lessons = common.stored(taught(facts, labels, rows), folder, "lessons")
    probability = fit(lessons, folder).probability()
    scored = facts.select("doc_id", held_out().alias("held_out"), probability.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))
