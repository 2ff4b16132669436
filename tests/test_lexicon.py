"""The stored inverted index against a scan and a plain version, and what its plans read."""

import random

import pytest
from pyspark.sql import functions as F

from ragmill.functions import stem
from ragmill.operators import lexicon, search, store


def cover(tokens, wanted):
    """Minimal stretches by trying all pairs of ends."""
    wanted = set(wanted)
    has = lambda i, j: wanted <= set(tokens[i : j + 1])
    out = 0.0
    for i in range(len(tokens)):
        for j in range(i, len(tokens)):
            if has(i, j):
                if not has(i + 1, j):
                    out += 0.1 / (1 + sum(t not in wanted for t in tokens[i : j + 1]))
                break
    return out


def chunks(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = [(i * 7, " ".join(rng.choice("alpha beta gamma d e f g h".split()) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return rows + [(-1, None), (-2, ""), (-3, "Beta, ALPHA!"), (-4, "alpha " * 500)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "id long, content string, lexeme string, number int")


def plain(rows, wanted, k=None):
    scored = [(i, cover(t.lower().replace(",", "").replace("!", "").split(), wanted)) for i, t in rows if t]
    scored = sorted(((i, s) for i, s in scored if s), key=lambda r: (-round(r[1], 9), r[0]))
    return [(i, round(s, 9)) for i, s in scored[:k]]


def found(df):
    return sorted(((r.id, round(r.lexical_score, 9)) for r in df.collect()), key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("wanted", [["alpha"], ["alpha", "beta"], ["gamma", "beta", "alpha", "beta"], ["alpha", "nowhere"], []])
def test_scan_equals_a_plain_version(spark, wanted):
    rows = chunks(spark, 80)
    scored = search.cover_density(search.lexical_match(frame(spark, rows), wanted), wanted)
    assert found(scored) == (plain(rows, wanted) if wanted else [])


def test_index_equals_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexicon, "BLOCK", 16)
    monkeypatch.setattr(lexicon, "FIRST_BLOCKS", 3)
    rows = chunks(spark)
    index = lexicon.Lexicon(spark, str(tmp_path / "index"), buckets=8)
    assert index.topk(["alpha"], 5).count() == 0
    index.add(frame(spark, rows[:200]))
    index.add(frame(spark, rows[200:]))
    for wanted in (["alpha"], ["alpha", "beta"], ["gamma", "d", "h"], ["alpha", "nowhere"]):
        assert found(index.scores(wanted)) == plain(rows, wanted)
        for k in (1, 7, 1000):
            assert found(index.topk(wanted, k, decimals=9)) == plain(rows, wanted, k)
    assert index.topk([], 3).count() == 0


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexicon, "BLOCK", 10)
    monkeypatch.setattr(lexicon, "FIRST_BLOCKS", 2)
    rows = [(i, "alpha " * (30 if 40 <= i < 50 else 1)) for i in range(200)]
    index = lexicon.Lexicon(spark, str(tmp_path / "index"))
    index.add(frame(spark, rows))
    asked = []
    real = index.scores
    monkeypatch.setattr(index, "scores", lambda lexemes, blocks=None: asked.append(blocks.count()) or real(lexemes, blocks))
    assert [r.id for r in index.topk(["alpha"], 5).collect()] == [40, 41, 42, 43, 44]
    assert asked == [2, 1] and index.heads(["alpha"]).count() == 20


def test_a_query_reads_its_lexemes_folders_only(spark, tmp_path):
    index = lexicon.Lexicon(spark, str(tmp_path / "index"), buckets=16)
    index.add(frame(spark, chunks(spark)))
    blocks = index._blocks(index.state()[1], ["alpha"])
    own = spark.range(1).select(lexicon.bucket(F.lit("alpha"), 16)).first()[0]
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert f"bucket#" in plan and "PartitionFilters: [" in plan and "PushedFilters: [IsNotNull(lexeme), EqualTo(lexeme,alpha)]" in plan
    files = {r.f.split("bucket=")[1].split("/")[0] for r in blocks.select(F.input_file_name().alias("f")).collect()}
    assert files == {str(own)}
    heads = index.heads(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in heads


def test_replaced_and_removed_chunks(spark, tmp_path):
    rows = dict(chunks(spark, 100))
    index = lexicon.Lexicon(spark, str(tmp_path / "index"))
    index.add(frame(spark, rows.items()))
    before = index.state()
    new = {i: "beta alpha" for i in list(rows)[:40:2]} | {9999: "alpha beta"}
    index.replace(frame(spark, new.items()), spark.createDataFrame([(9998,)], "id long"))
    rows |= new
    gone = list(rows)[1:60:3]
    index.replace(frame(spark, []), spark.createDataFrame([(i,) for i in gone], "id long"))
    again = {gone[0]: "alpha beta beta"}
    index.replace(frame(spark, again.items()), frame(spark, again.items()))
    rows = {i: t for i, t in rows.items() if i not in gone} | again
    wanted = ["alpha", "beta"]
    assert found(index.scores(wanted)) == plain(rows.items(), wanted)
    reopened = lexicon.Lexicon(spark, str(tmp_path / "index"))
    reopened.compact()
    assert len(reopened.state()[1]) == 1 and not reopened.state()[2] and reopened.state()[0] == before[0] + 4
    assert found(reopened.topk(wanted, 25, decimals=9)) == plain(rows.items(), wanted, 25)


def test_a_run_that_is_not_committed_is_not_seen(spark, tmp_path):
    index = lexicon.Lexicon(spark, str(tmp_path / "index"))
    index.add(frame(spark, [(1, "alpha")]))
    failing = frame(spark, [(2, "alpha")]).withColumn("content", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        index.replace(failing, frame(spark, [(1, "")]))
    assert [r.id for r in index.scores(["alpha"]).collect()] == [1]


def test_index_of_stems(spark, tmp_path):
    rows = frame(spark, [(1, "the frames of a beacon"), (2, "framing beacons"), (3, "frames")])
    index = lexicon.Lexicon(spark, str(tmp_path / "index"), stem.english_lexeme)
    index.add(rows)
    query = stem.query_lexemes("The beacon's frames")
    assert found(index.topk(query[:1] + query[-1:], 5)) == found(search.lexical_topk(rows, query[:1] + query[-1:], 5, stem.english_lexeme))


def test_numbers_follow_the_order_without_one_task(spark):
    rows = spark.range(1000).selectExpr("id * 37 % 1000 AS k", "id").repartition(7)
    numbered = store.numbered(rows, "k")
    assert [(r.k, r.number) for r in numbered.orderBy("k").collect()] == [(i, i) for i in range(1000)]
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert store.numbered(rows.where("false"), "k").count() == 0
    table = spark.createDataFrame([(5,), (90,)], "id long")
    made = store.with_ids(rows.limit(4).drop("id"), table, "k")
    assert [r.id for r in made.orderBy("k").collect()] == [91, 92, 93, 94]
    first = store.with_ids(rows.limit(1), table.where("false"), "k").first()
    assert first.id == 1
