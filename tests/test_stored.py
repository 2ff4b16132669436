"""Snapshots, ingestion that commits, and embeddings that are kept, with models and jobs that fail."""

import datetime
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from ragmill.operators import layout
from ragmill.plans import embeddings
from ragmill.plans.ingest import Upload, ingest_into
from ragmill.plans.providers import Chain, NoReranker, OfflineAnswerer, OfflineEmbedder, providers
from ragmill.schema import CHUNK, DOCUMENT, FIGURE, PAGE
from ragmill.sources.snapshots import Change, Conflict, Snapshots

NOW = datetime.datetime(2024, 1, 1)
KIND = "id long, text string"


class Logged:
    """Writes every call down; fails on texts that hold `bad`, or always."""

    dimension = 3

    def __init__(self, log, model="logged", bad=None, always=False):
        self.log, self.model, self.bad, self.always = str(log), model, bad, always

    def embed(self, texts):
        if self.always or self.bad and any(self.bad in t for t in texts):
            raise OSError("down")
        pathlib.Path(self.log, uuid.uuid4().hex).write_text("\x00".join(texts))
        return [[float(len(t)), 1.0, 2.0] for t in texts]

    def one(self, text):
        return self.embed([text])[0]


def calls(log):
    return sorted(f.read_text().split("\x00") for f in pathlib.Path(log).iterdir())


def test_versions_of_tables(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "t"), buckets=4)
    rows = lambda *pairs: spark.createDataFrame(pairs, KIND)
    read = lambda name, **more: sorted(map(tuple, tables.read(name, KIND, **more).collect()), key=str)
    assert read("a") == [] and tables.state() == (0, {})
    everything = [(i, "old") for i in range(20)] + [(None, "old")]
    assert tables.commit({"a": Change(rows(*everything), "id"), "b": Change(rows((1, "x")), "id")}) == 1
    some = rows((3, "?"), (7, "?"))
    touched = tables.buckets_of(some, "id")
    new = tables.read("a", KIND, touched).withColumn("text", F.when(F.col("id").isin(3, 7), F.lit("new")).otherwise(F.col("text"))).where("id <> 9 OR id IS NULL")
    assert tables.commit({"a": Change(new, "id", touched)}) == 2
    gone = {9} if 9 in [r.id for r in tables.read("a", KIND, touched, version=1).collect()] else set()
    assert read("a") == sorted(((i, "new" if i in (3, 7) else t) for i, t in everything if i not in gone), key=str)
    assert read("a", version=1) == sorted(everything, key=str) and read("b") == [(1, "x")]
    untouched = [b for b in range(4) if b not in touched]
    assert all(tables.state()[1]["a"].get(b) == tables.state(1)[1]["a"].get(b) for b in untouched)
    assert tables.commit({"b": Change(rows(), "id")}) == 3 and read("b") == []
    assert any("/b/1-" in path for path in tables.unused(keep=1)) and not any("/b/1-" in path for path in tables.unused(keep=3))
    with pytest.raises(ValueError):
        tables.state(9)


def test_a_commit_that_fails_changes_nothing(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "t"), buckets=2)
    good = spark.createDataFrame([(1, "old")], KIND)
    tables.commit({"a": Change(good, "id"), "b": Change(good, "id")})
    lost = good.withColumn("text", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        tables.commit({"a": Change(good.withColumn("text", F.lit("new")), "id"), "b": Change(lost, "id")})
    assert tables.state()[0] == 1 and tables.read("a", KIND).first().text == "old"
    # The first table was written: its folder is there and no version names it.
    assert len(list((tmp_path / "t" / "a").iterdir())) == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    one, two = (Snapshots(spark, str(tmp_path / "t"), buckets=2) for _ in range(2))
    rows = lambda text: Change(spark.createDataFrame([(1, text)], KIND), "id")
    monkeypatch.setattr(two, "state", lambda version=None: (0, {}))
    names = iter(["a" * 32, "b" * 32])
    monkeypatch.setattr(uuid, "uuid4", lambda: type("U", (), {"hex": next(names)})())
    assert one.commit({"a": rows("first")}) == 1
    with pytest.raises(Conflict):
        two.commit({"a": rows("second")})
    assert one.read("a", KIND).first().text == "first"


def test_each_distinct_text_is_embedded_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["a", " a ", "bb", "a", None, "", " \n", "ccc"])], "id long, content string, digest_ string").repartition(3)
    for folder in (None, str(tmp_path / "made")):
        log = tmp_path / f"log-{folder is None}"
        log.mkdir()
        found = {r.id: (r.model, list(r.embedding)) for r in embeddings.embedded(rows, Logged(log), folder, batch_size=2, parts=3).collect()}
        assert sorted(t for call in calls(log) for t in call) == ["a", "bb", "ccc"] and all(len(c) <= 2 for c in calls(log))
        assert found == {i: ("logged", [float(n), 1.0, 2.0] if n else [0.0] * 3) for i, n in enumerate([1, 1, 2, 1, 0, 0, 0, 3])}
    assert embeddings.embedded(rows.where("false"), Logged(tmp_path)).count() == 0


def test_a_chain_falls_back(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id long, content string").repartition(1)
    chain = Chain([Logged(tmp_path / "a", "first", bad="bad"), Logged(tmp_path / "b", "second")])
    found = {r.content: r.model for r in embeddings.embedded(rows, chain, batch_size=1).collect()}
    assert found == {"good": "first", "bad": "second", "fine": "first"} and calls(tmp_path / "b") == [["bad"]]
    assert chain.one("bad") == [3.0, 1.0, 2.0] and chain.model == "first"
    with pytest.raises(OSError):
        Chain([Logged(tmp_path, always=True)]).embed(["x"])
    with pytest.raises(ValueError):
        Chain([OfflineEmbedder(3), OfflineEmbedder(4)])


def test_a_run_that_failed_is_carried_on(spark, tmp_path):
    (tmp_path / "log").mkdir()
    texts = [f"text {i}" for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "id long, content string")
    folder = str(tmp_path / "made")
    with pytest.raises(Exception, match="down"):
        embeddings.embedded(rows, Logged(tmp_path / "log", bad="text 17"), folder, batch_size=5, parts=8)
    done = {r.digest for r in embeddings.kept(rows, folder).collect()}
    assert 0 < len(done) < 40
    for f in (tmp_path / "log").iterdir():
        f.unlink()
    found = embeddings.embedded(rows, Logged(tmp_path / "log"), folder, batch_size=5, parts=8)
    assert found.where("embedding IS NULL").count() == 0 and found.count() == 80
    assert sum(map(len, calls(tmp_path / "log"))) == 40 - len(done)


def upload(spark, texts, bad=None):
    names = [(f"e{i}", t) for i, t in texts.items()]
    of = lambda rows, kind: spark.createDataFrame(rows, kind)
    boxes = ", ".join(f"{c} double" for c in layout.BOX)
    words = [(n, 1, w, 60.0 + 50 * k, 300.0, 100.0 + 50 * k, 310.0) for n, _ in names for k, w in enumerate(("Fig.", "1—A"))]
    return Upload(
        files=of([(n, "title", None, None, "c", 1) for n, _ in names], "external_id string, title string, description string, source_uri string, checksum string, total_pages int"),
        texts=of([(n, 1, t) for n, t in names], "external_id string, page_number int, text string"),
        tables=of([(n, 1, 0, [["a", "b"], ["1", "2"]]) for n, _ in names], "external_id string, page_number int, table_index int, rows array<array<string>>"),
        pages=of([(n, 1, 600.0, 800.0, 0) for n, _ in names], "external_id string, page_number int, width double, height double, rotation int"),
        words=of(words, f"external_id string, page_number int, text string, {boxes}"),
        shapes=of([(n, 1, "image", 80.0, 200.0, 400.0, 290.0) for n, _ in names], f"external_id string, page_number int, kind string, {boxes}"),
    )


def test_an_ingestion_commits_all_tables_or_none(spark, tmp_path):
    (tmp_path / "log").mkdir()
    tables = Snapshots(spark, str(tmp_path / "t"), buckets=4)
    state = lambda: {
        "documents": sorted((r.id, r.external_id, r.title) for r in tables.read("document", DOCUMENT).collect()),
        "chunks": sorted((r.document_id, r.chunk_index, r.content, len(r.embedding)) for r in tables.read("chunk", CHUNK).collect()),
        "pages": sorted((r.document_id, r.page_number) for r in tables.read("page", PAGE).collect()),
        "figures": sorted((r.document_id, r.figure_label) for r in tables.read("figure", FIGURE).collect()),
    }
    assert ingest_into(tables, upload(spark, {i: f"text {i}" for i in range(6)}), Logged(tmp_path / "log"), NOW, "gs://b") == 1
    before = state()
    table = "a | b\n-----\n1 | 2"
    assert before["chunks"] == sorted((i + 1, k, c, 3) for i in range(6) for k, c in enumerate((f"text {i}", table)))
    assert before["pages"] == [(i + 1, 1) for i in range(6)] and before["figures"] == [(i + 1, "FIGURE 1") for i in range(6)]
    second = upload(spark, {2: "other two", 9: "nine"})
    with pytest.raises(Exception, match="down"):
        ingest_into(tables, second, Logged(tmp_path / "log", bad="nine"), NOW, "gs://b")
    assert state() == before and tables.state()[0] == 1
    asked = sum(map(len, calls(tmp_path / "log")))
    assert ingest_into(tables, second, Logged(tmp_path / "log"), NOW, "gs://b") == 2
    after = state()
    # Every text once over all three runs: the table's text and what stood before were asked for already.
    assert sum(map(len, calls(tmp_path / "log"))) == 6 + 1 + 2 >= asked
    assert {c for d, _, c, _ in after["chunks"] if d in (3, 7)} == {"other two", "nine", table} and len(after["chunks"]) == 14
    assert after["documents"][-1][:2] == (7, "e9") and after["figures"][-1] == (7, "FIGURE 1")
    assert [r.content for r in tables.read("chunk", CHUNK, version=1).where("document_id = 3 AND chunk_index = 0").collect()] == ["text 2"]


def test_providers_by_name():
    made = providers({}, {})
    assert isinstance(made["embedder"], OfflineEmbedder) and isinstance(made["reranker"], NoReranker) and isinstance(made["answerer"], OfflineAnswerer)
    makers = {"remote": lambda env: ("remote", env["KEY"])}
    assert providers({"EMBEDDER": "remote", "KEY": "k"}, makers)["embedder"] == ("remote", "k")
    assert isinstance(providers({"RERANKER": "remote"}, makers)["reranker"], NoReranker)
    with pytest.raises(RuntimeError, match="KEY"):
        providers({"ANSWERER": "remote"}, makers)
    with pytest.raises(ValueError):
        providers({"EMBEDDER": "other"}, makers)
