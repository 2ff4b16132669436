"""Quality rules as weak supervision: rules vote or abstain, EM finds their accuracies, a posterior decides.

Every rule looks at one measure of a text and votes good, bad or nothing. Two-class expectation-maximisation
over the counts of vote patterns (at most 3 ** len(RULES) of them, whatever the corpus) estimates how often
each rule is right about good and about bad texts. A text is kept if its posterior probability of being good
is at least KEEP. Measures, votes and posterior are DataFrame expressions; only the pattern counts reach the
driver.

Defined cases: a null or empty text has no words, fails the base rules and isn't kept; equal rows give equal
rows; an empty table gives an empty table (and the model's starting values); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
KEEP = 0.5
#: Sample texts whose share of bad ones is taken as this before the votes are seen, with the weight of so many texts.
PRIOR_GOOD, PRIOR_WEIGHT = 0.85, 20.0
#: Pseudo-counts of bad votes, abstentions and good votes on bad and on good texts: right votes are likelier than wrong ones.
PSEUDO = ((3.0, 2.0, 1.0), (0.5, 2.0, 4.0))
#: Where expectation-maximisation starts: how likely a text without a bad vote, and one with, is good.
START = (0.95, 0.1)
ROUNDS = 25


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and binds it for body, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows that occur at least twice among the same words."""

    def slow(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            placed,
            lambda s: let(
                F.array_sort(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]),
                        ),
                        lambda x: x["i"],
                    )
                ),
                lambda p: F.aggregate(
                    F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            ),
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        hashed,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        ),
    )
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(h)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(counted)


def measures(text: Column) -> Column:
    """A struct of the measures of a text."""
    t = F.coalesce(text, F.lit(""))
    return let(
        F.struct(common.words_column(text).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(common.WORD)).alias("l")),
        lambda p: F.struct(
            F.size(p["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(p["w"], "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(p["l"]) - F.size(F.array_distinct(p["l"]))).cast("long").alias("n_dup_lines"),
            _repeat_words(p["w"]).cast("long").alias("n_repeat_words"),
            F.size(p["l"]).cast("long").alias("n_lines"),
            F.size(F.filter(p["w"], lambda x: x.rlike(f"[{SYMBOLS}]"))).cast("long").alias("n_marked"),
            F.length(F.regexp_replace(F.array_join(p["w"], ""), r"\p{L}", "")).cast("long").alias("n_unlettered"),
            F.size(F.array_distinct(p["w"])).cast("long").alias("n_distinct"),
            (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
            (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long").alias("n_cries"),
            F.size(F.filter(p["l"], lambda x: x.rlike(r"[.!?:;\"”»][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        ),
    )


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, good where `good` holds, else abstains; both are functions of the measures."""

    name: str
    bad: Callable[[Column], Column]
    good: Callable[[Column], Column]


RULES = (
    Rule("symbols", lambda q: _share(q["n_symbols"], q["word_chars"]) > 0.1, lambda q: _share(q["n_symbols"], q["word_chars"]) < 0.05),
    Rule("marked words", lambda q: _share(q["n_marked"], q["n_words"]) > 0.2, lambda q: _share(q["n_marked"], q["n_words"]) < 0.05),
    Rule("letters", lambda q: _share(q["n_unlettered"], q["word_chars"]) > 0.12, lambda q: _share(q["n_unlettered"], q["word_chars"]) < 0.08),
    Rule("capitals", lambda q: _share(q["n_upper"], q["word_chars"]) > 0.3, lambda q: _share(q["n_upper"], q["word_chars"]) < 0.15),
    Rule("cries", lambda q: _share(q["n_cries"], q["n_words"]) > 0.3, lambda q: _share(q["n_cries"], q["n_words"]) < 0.1),
    Rule("repeated words", lambda q: _share(q["n_repeat_words"], q["n_words"]) > 0.15, lambda q: _share(q["n_repeat_words"], q["n_words"]) < 0.05),
    Rule("repeated lines", lambda q: _share(q["n_dup_lines"], q["n_lines"]) > 0.3, lambda q: _share(q["n_dup_lines"], q["n_lines"]) < 0.1),
    Rule(
        "variety",
        lambda q: (q["n_words"] >= 50) & (_share(q["n_distinct"], F.sqrt(q["n_words"].cast("double"))) < 3),
        lambda q: (q["n_words"] >= 50) & (_share(q["n_distinct"], F.sqrt(q["n_words"].cast("double"))) > 5),
    ),
    Rule(
        "word length",
        lambda q: ~_share(q["word_chars"], q["n_words"]).between(2.5, 14),
        lambda q: _share(q["word_chars"], q["n_words"]).between(3.5, 10),
    ),
    Rule("sentences", lambda q: (q["n_lines"] >= 4) & (_share(q["n_ended"], q["n_lines"]) < 0.1), lambda q: _share(q["n_ended"], q["n_lines"]) > 0.5),
)
BAD, ABSTAIN, GOOD = 0, 1, 2


def vote(rule: Rule, q: Column) -> Column:
    return F.when(rule.bad(q), F.lit(BAD)).when(rule.good(q), F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT)


def pattern(q: Column) -> Column:
    """All votes as one number in base three."""
    code = F.lit(0)
    for rule in RULES:
        code = code * 3 + vote(rule, q)
    return code


@dataclass(frozen=True)
class Model:
    """Prior probability of a good text, and by rule how often good and bad texts get each of the three votes."""

    good: float
    rates: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def evidence(self, rule: int, vote: int) -> float:
        """Log likelihood ratio of good. Abstaining says nothing; a bad vote never speaks for good, nor a good one for bad."""
        if vote == ABSTAIN:
            return 0.0
        bad, good = self.rates[rule]
        x = math.log(good[vote] / (good[GOOD] + good[BAD])) - math.log(bad[vote] / (bad[GOOD] + bad[BAD]))
        return min(x, 0.0) if vote == BAD else max(x, 0.0)

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.good / (1 - self.good)) + sum(self.evidence(r, v) for r, v in enumerate(votes))

    def accuracy(self, rule: int) -> float:
        """Estimated share of the rule's votes that are right."""
        bad, good = self.rates[rule]
        right = self.good * good[GOOD] + (1 - self.good) * bad[BAD]
        return right / (right + self.good * good[BAD] + (1 - self.good) * bad[GOOD])


def votes_of(code: int) -> tuple[int, ...]:
    out = []
    for _ in RULES:
        code, v = divmod(code, 3)
        out.append(v)
    return tuple(out[::-1])


def fit(counts: dict[int, int]) -> Model:
    """Expectation-maximisation over the counts of vote patterns, which are taken in a fixed order, so results repeat.

    It starts from the belief START that a text with a bad vote, or without one, is good.
    """
    seen = [(votes_of(code), n) for code, n in sorted(counts.items())]
    beliefs = [START[BAD in votes] for votes, _ in seen]
    for k in range(ROUNDS + 1):
        total = sum(n for _, n in seen)
        good = sum(n * p for (_, n), p in zip(seen, beliefs, strict=True))
        tally = [[list(PSEUDO[0]), list(PSEUDO[1])] for _ in RULES]
        for (votes, n), p in zip(seen, beliefs, strict=True):
            for r, v in enumerate(votes):
                tally[r][1][v] += n * p
                tally[r][0][v] += n * (1 - p)
        model = Model(
            (good + PRIOR_GOOD * PRIOR_WEIGHT) / (total + PRIOR_WEIGHT),
            tuple(tuple(tuple(x / sum(t) for x in t) for t in rule) for rule in tally),
        )
        if k < ROUNDS:
            beliefs = [1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(votes))))) for votes, _ in seen]
    return model


def pattern_counts(patterns: DataFrame) -> dict[int, int]:
    """Texts by vote pattern, from the column `code`; null codes, of texts that the base rules reject anyway, don't teach."""
    rows = patterns.where(F.col("code").isNotNull()).groupBy("code").count().collect()
    return {r["code"]: r["count"] for r in rows}


def lesson(q: Column) -> Column:
    """The vote pattern of a text that the base rules pass, else null."""
    return F.when(~base_failed(q), pattern(q))


def posterior(q: Column, model: Model) -> Column:
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for r, rule in enumerate(RULES):
        by_vote = [model.evidence(r, v) for v in (BAD, ABSTAIN, GOOD)]
        odds = odds + F.when(rule.bad(q), F.lit(by_vote[BAD])).when(rule.good(q), F.lit(by_vote[GOOD])).otherwise(F.lit(by_vote[ABSTAIN]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, probability, kept. Texts are measured once; the measures are stored."""
    folder = common.work_folder(docs.sparkSession)
    measured = common.stored(docs.select("doc_id", measures(F.col("text")).alias("q")), folder, "measures")
    q = F.col("q")
    model = fit(pattern_counts(measured.select(lesson(q).alias("code"))))
    return measured.select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(q).alias("base_failed"),
        posterior(q, model).alias("probability"),
        (~base_failed(q) & (posterior(q, model) >= KEEP)).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Texts are measured twice, so that none is shuffled.

    Measures are bound inside one expression: as a column, every use in a filter would measure the text again.
    """
    # The round trip through an array keeps the optimizer from copying the expression into the filter on it.
    codes = docs.select(F.explode(F.array(let(measures(F.col("text")), lesson))).alias("code"))
    model = fit(pattern_counts(codes))
    return docs.where(let(measures(F.col("text")), lambda q: ~base_failed(q) & (posterior(q, model) >= KEEP)))
