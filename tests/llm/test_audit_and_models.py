"""Filter audit, Delta Lloyd and the rule ensemble against plain versions and held-out labels."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragmill.llm import filter_audit, lloyd, rule_ensemble

from . import brute
from .conftest import make, odd_rows, sentence

FOLDER = "/root/testdata/sf0.01"


def audited(rows, labels):
    """rows: (doc_id, text, lang). The audit from its definition, document by document."""
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    marks = collections.defaultdict(lambda: [0, 0])
    for doc, quality, toxic in labels:
        if doc is not None:
            marks[doc][0] |= quality == 1
            marks[doc][1] |= toxic == 1
    failed = []
    for doc, text, lang in rows:
        text = text or ""
        w = brute.words(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc is not None and doc > least[text],
        }
        failed.append((lang or "", {k for k, v in fails.items() if v}, marks.get(doc, (0, 0)) if doc is not None else (0, 0)))
    out, totals = {}, collections.Counter()
    for part in {lang for lang, _, _ in failed}:
        own = [(f, m) for lang, f, m in failed if lang == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = set()
            for step, letter in enumerate(order, 1):
                removed = [i for i, (f, _) in enumerate(own) if i not in gone and letter in f]
                redundant = sum(letter in own[i][0] for i in gone)
                gone.update(removed)
                out[part, order, step] = [
                    len(own) - len(gone), len(removed), redundant, sum(f == {letter} for f, _ in own),
                    sum(own[i][1][0] for i in removed), sum(own[i][1][1] for i in removed),
                ]
                totals[part, letter] += len(removed)
    return sorted((*key, *values, totals[key[0], key[1][key[2] - 1]]) for key, values in out.items())


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit_equals_a_plain_one(spark):
    rng = random.Random(3)
    long = sentence(rng, 220)
    rows = [(i, t, rng.choice(["en", "fr", None])) for i, t in odd_rows()]
    rows += [(100 + k, t, "en") for k, t in enumerate([long, long, long + " #", "A B C " * 70, long.upper(), " | ".join(long.split()), "x" * 100_000])]
    rows += [(90, long, "fr"), (90, long, "fr"), (None, long, ""), (None, long, "en")]
    docs = make(spark, [(i, t) for i, t, _ in rows]).drop("lang")
    langs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert docs.count() == langs.count()
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(110)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")).withColumn("n", F.lit(9))
    odd = langs.withColumn("mask", F.lit("m")).withColumn("own", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("first", F.lit(1)).withColumn("good", F.lit(1))
    found = filter_audit.interactions(odd, table)
    assert found.columns == AUDIT
    assert sorted(map(tuple, found.collect())) == audited(rows, labels)


def test_filter_audit_of_no_documents(spark, no_documents):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(no_documents, labels).count() == 0
    one = filter_audit.interactions(make(spark, [(1, None)]), labels.where("false")).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed, r.good_lost) for r in one] == [("en", 0, 1, 0)] + [("en", 0, 0, 0)] * 4


def test_audit_moves_no_text(spark):
    plan = filter_audit.failures(make(spark, odd_rows()))._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan


def kmeans(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owners, strict=True) if o == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    spread = collections.Counter()
    for _, d, n in found:
        spread[n] += d
    return sorted(((i, n, d, spread[n], sum(spread.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, owner string")


def test_clustering_equals_plain_k_means(spark):
    rng = random.Random(9)
    size = 6
    rows = [(i, [rng.gauss(i % 3, 0.5) for _ in range(size)]) for i in range(120)]
    rows += [(200, [0.5] * size), (200, [0.5] * size), (201, [0.5] * size), (None, [1.0] * size), (202, [-3.001] * size), (203, [0.0] * size)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [None] + [1.0] * 5), (305, [float("nan")] * size), (306, [float("inf")] + [0.0] * 5)]
    for k, rounds in ((5, 4), (7, 0), (1, 3), (500, 2)):
        found = lloyd.cluster(embeddings(spark, rows).repartition(3), k, rounds, size)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, found.collect()), key=str) == kmeans(rows, k, rounds, size), (k, rounds)


def test_clustering_of_large_numbers_and_none(spark):
    rows = [(i, [400_000.0 * (-1) ** i + i, i * 3000.0]) for i in range(9)]
    assert sorted(map(tuple, lloyd.cluster(embeddings(spark, rows), 3, 3, 2).collect()), key=str) == kmeans(rows, 3, 3, 2)
    with pytest.raises(Exception, match="beyond"):
        lloyd.cluster(embeddings(spark, [(1, [1e30, 0.0])]), 3, 3, 2).collect()
    empty = lloyd.cluster(embeddings(spark, [(1, [1.0])]))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"


def test_a_round_compares_what_can_have_changed():
    """Vectors whose centroid stood are compared with moved ones only, with the same result as a full comparison."""
    rng = np.random.default_rng(4)
    v = rng.integers(-50, 50, (400, 8))
    old = v[:12].copy()
    owner, distance = lloyd.reassigned(v, np.full(400, -1), np.zeros(400, np.int64), old, np.arange(12))
    new = old.copy()
    moved = np.array([1, 4, 10])
    new[moved] += 3
    new[4] = new[2]  # a tie with a smaller number
    found = lloyd.reassigned(v, owner, distance, new, moved)
    wanted = lloyd.reassigned(v, np.full(400, -1), np.zeros(400, np.int64), new, np.arange(12))
    assert (found[0] == wanted[0]).all() and (found[1] == wanted[1]).all()
    seen = []
    real = lloyd.distances
    lloyd.distances = lambda a, b: seen.append(a.shape[0] * b.shape[0]) or real(a, b)
    try:
        lloyd.reassigned(v, owner, distance, new, moved)
    finally:
        lloyd.distances = real
    lost = int(np.isin(owner, moved).sum())
    assert sum(seen) == lost * 12 + (400 - lost) * 3


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = rule_ensemble.score(docs, labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in scored.collect())


def test_rules_follow_the_paths_of_trees(spark):
    """Nodes of a written tree as rules; their columns hold for the rows that reach the node."""
    names = [*rule_ensemble.STATISTICS]
    node = lambda i, l=-1, r=-1, f=-1, x=(): {"id": i, "leftChild": l, "rightChild": r, "split": {"featureIndex": f, "leftCategoriesOrThreshold": list(x)}}
    tree = [{"treeID": 0, "nodeData": n} for n in (node(0, 1, 4, 2, [0.5]), node(1, 2, 3, 2, [0.2]), node(2), node(3), node(4))]
    rules = rule_ensemble.paths(tree + [{"treeID": 1, "nodeData": n["nodeData"]} for n in tree])
    a = names[2]
    assert rules == [((a, False, 0.5),), ((a, True, 0.5),), ((a, False, 0.2),), ((a, False, 0.5), (a, True, 0.2))]
    values = spark.createDataFrame([(0.1,), (0.2,), (0.4,), (0.9,)], f"{a} double")
    ensemble = rule_ensemble.Ensemble(0.5, tuple(zip(rules, (1.0, -2.0, 0.25, -0.75), strict=True)))
    found = [r.p for r in values.select(ensemble.probability().alias("p")).collect()]
    wanted = [0.5 + 1.0 + 0.25, 0.5 + 1.0 + 0.25, 0.5 + 1.0 - 0.75, 0.5 - 2.0]
    assert found == pytest.approx([1 / (1 + math.exp(-x)) for x in wanted])


def test_statistics_equal_plain_ones(spark):
    rows = [(i, t) for i, (_, t) in enumerate(odd_rows())] + [(99, "One, two | three!! FOUR four four\nOne, two\n\nOne, two\n"), (100, "w " * 30_000)]
    found = make(spark, rows).select("doc_id", rule_ensemble.statistics(F.col("text")).alias("s")).collect()
    share = lambda a, b: a / b if b else 0.0
    for r in found:
        t = dict(rows)[r.doc_id] or ""
        w, lines = brute.words(t), [x for x in t.split("\n") if brute.WORD.search(x)]
        pairs = list(zip(w, w[1:], strict=False))
        wanted = {
            "log_words": math.log1p(len(w)), "log_chars": math.log1p(len(t)), "word_length": share(sum(map(len, w)), len(w)), "words_a_line": share(len(w), len(lines)),
            "bars": share(w.count("|"), len(w)), "cries": share(t.count("!") + t.count("?"), len(w)), "commas": share(t.count(",") + t.count(";"), len(w)),
            "capitals": share(sum(c.isupper() for c in t), len(t)), "distinct_words": share(len(set(w)), math.sqrt(len(w))), "distinct_word_share": share(len(set(w)), len(w)),
            "distinct_pair_share": share(len(set(pairs)), len(w) - 1), "repeats_in_a_row": share(sum(a == b for a, b in pairs), len(w)),
            "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
        }
        for name, x in wanted.items():
            assert r.s[name] == pytest.approx(x), (name, t[:60])


def test_classifier_without_both_labels(spark, documents, no_documents):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 0, 0), (3, None, 1), (4, 7, 1)], "doc_id long, quality int, toxic int")
    rows = rule_ensemble.score(documents, labels).collect()
    taught = [i for i, _ in odd_rows() if i is not None and i < 30 and zlib.crc32(str(i).encode()) % 5]
    assert {round(r.score, 9) for r in rows} == {round((len(taught) + 1) / (len(taught) + 2), 9)} and len(rows) == documents.count()
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in rule_ensemble.score(documents, labels.where("false")).collect()} == {0.5}
    assert rule_ensemble.score(no_documents, labels).count() == 0
    same = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    alike = make(spark, [(i, "equal texts") for i in range(40)])
    assert len({r.score for r in rule_ensemble.score(alike, same).collect()}) == 1
