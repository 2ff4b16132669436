"""Findings of the fourth round: what op8 holds at once, and how page texts are made."""

import json
import random
import time

import numpy as np
from pyspark.sql import functions as F

from ragmill.llm import graph, jaccard
from ragmill.operators import layout
from ragmill.sources.layouts import Dumps


def test_pairs_come_back_by_blocks(spark, monkeypatch):
    """All pairs of a part, and all between strays and a group, were held at once and given back in one table."""
    monkeypatch.setattr(jaccard, "BLOCK", 3000)
    tokens = np.unique(np.random.default_rng(4).integers(0, 2**63, 40).astype(np.uint64))
    heads = spark.createDataFrame([(k, 40, tokens.tobytes()) for k in range(60)], "id long, n long, tokens binary")
    repeated = graph.bitmap(spark.createDataFrame([(int(t),) for t in tokens], "token long"), "token")
    rows = jaccard._pairs(heads, jaccard.Rule(75, np.empty(0, np.uint64)), repeated, 1, 64).collect()
    shared = {}
    for r in rows:
        shared[r.a, r.b] = shared.get((r.a, r.b), 0) + r.c
    assert shared == {(a, b): 11 for b in range(60) for a in range(b)} and len(rows) >= 2 * len(shared)
    strays = heads.selectExpr("*", "id AS component").unionByName(heads.selectExpr("id + 100 AS id", "n", "tokens", "id + 100 AS component"))
    strays = strays.unionByName(heads.selectExpr("id + 200 AS id", "n", "tokens", "id + 200 AS component"))
    rows = jaccard._combination_pairs(strays, jaccard.Rule(75, tokens), 1, False).collect()
    ids = [k + at for at in (0, 100, 200) for k in range(60)]
    assert {(r.a, r.b, r.x, r.y) for r in rows} == {(a, b, a, b) for a in ids for b in ids if a < b} and len(rows) > len(ids) * (len(ids) - 1) // 2


def test_sets_are_taken_by_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", 10)
    sizes = [4, 4, 4, 25, 0, 3]
    batch = pa.record_batch({"id": list(range(6)), "n": sizes, "tokens": pa.array([np.arange(k, dtype=np.uint64).tobytes() for k in sizes], pa.binary())})
    assert [b.column(0).to_pylist() for b in jaccard._slices([batch, batch.slice(0, 0)])] == [[0, 1], [2], [3], [4, 5]]


def test_page_texts_over_columns_are_those_by_words(spark, tmp_path):
    """Ties, slopes, places that miss a number, strikes and small pages, as the way by words has them."""
    rng = random.Random(6)
    pages = []
    for k in range(120):
        words = []
        for i in range(rng.choice([0, 1, 5, 40])):
            x0, top = rng.choice([90, 100.5, 120, 300]), rng.choice([80, 80.05, 80.15, 80.25, 81.75, 82.65, 83.5, 120, 124.35])
            word = {"text": rng.choice(["a", "b", "\u00e9", " ", "\u00a0x\t", "z"]), "x0": x0, "top": top + rng.choice([0, 0, i * 1.5]), "x1": x0 + 30, "bottom": top + 10}
            if k % 10 == 0:
                word[rng.choice(["text", "x0", "top", "x1", "bottom"])] = rng.choice([None, "NaN"])
            words.append(word)
        size = {0: (600, 800), 1: (50, 20), 2: (None, 800)}.get(k % 9, (600, 800))
        strike = [{"subtype": "StrikeOut", "rect": [100, 70 + 4 * i, 110, 72 + 4 * i]} for i in range(k % 4)]
        pages.append({"external_id": f"p{k}", "page_number": 1, "width": size[0], "height": size[1], "words": None if k == 7 else words, "annotations": strike})
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one.json").write_text("\n".join(map(json.dumps, pages)))
    source = Dumps(spark, str(tmp_path / "d"))
    lines = layout.lines_by(source.readable_words(), ["external_id", "page_number"]).orderBy("external_id", "line").collect()
    wanted = {r.external_id: "\n".join(x.text for x in lines if x.external_id == r.external_id) for r in lines}
    assert {r.external_id: r.text for r in source.texts().collect()} == wanted and len(wanted) > 50


def test_page_texts_cost_little_a_word(spark):
    """A word took some 60 microseconds of functions over arrays, which 1 GB of documents with 267 million words didn't allow."""
    words = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.struct(F.lit("word").alias("text"), *[(i % 10 * 50 + F.floor(i / 10) * (15 if c in ("top", "bottom") else 0) + at).cast("double").alias(c) for c, at in zip(layout.BOX, (90, 70, 120, 80), strict=True)]))
    mark = F.array(F.struct(F.lit("StrikeOut").alias("subtype"), F.array(*map(F.lit, (100.0, 100.0, 110.0, 110.0))).alias("rect"), F.lit(None).cast("array<double>").alias("quadpoints")))
    pages = spark.range(0, 1500, 1, 1).select("id", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), words.alias("words"), mark.alias("annotations"))
    began = time.time()
    layout.page_texts(pages, ["id"]).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 12
