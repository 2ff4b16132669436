"""A stored inverted index: posting blocks by lexeme, read for a query's lexemes only, replaced and compacted in runs.

A run is a table of blocks. Chunks get dense numbers in the order of their ids, and a block holds the postings of one
lexeme in BLOCK chunks with adjacent numbers, so a lexeme that every chunk has is cut into many blocks and no task
gathers it. All lexemes of a run have their blocks cut at the same places: a query first joins the heads of blocks
(lexeme, block, most postings a chunk), without ids and positions, keeps the blocks that have all its lexemes, and gets
from the heads an upper bound of the score that a chunk in them can reach.

Blocks lie in folders by a hash of their lexeme (`bucket`) and are sorted by lexeme, so a query lists and reads the
folders of its lexemes, of these the columns it needs, and skips row groups of other lexemes.

Replacing chunks writes a run of their new postings and a run number for each id from which on its postings count
(`from`): older ones are passed over. compact() writes one run of all that counts. A manifest (one Parquet file for
each state, appended) says which runs make up the index; a reader sees the last state that was written whole.

Defined cases: null and empty contents, and rows without id, have no postings; ids are unique within one build or
replacement (the postings of rows with one id are merged); an id that is removed but isn't there changes nothing; an
empty index or a query without lexemes finds nothing; columns besides id and content are ignored. One writer at a time:
of two that commit the same state, the reader sees one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search, store

#: Chunks in a block, and folders of a run.
BLOCK, BUCKETS = 512, 64
#: Blocks that are scored first, to find a score that others must reach.
FIRST_BLOCKS = 32
MANIFEST = "state long, runs array<string>, tombstones array<string>"


def bucket(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


class Lexicon:
    """The index in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, lexeme: Callable[[Column], Column] | None = None, buckets: int = BUCKETS) -> None:
        """lexeme: a function of the token column that gives null for stop words, the same at every use of the folder."""
        self.spark, self.folder, self.lexeme, self.buckets = spark, folder.rstrip("/"), lexeme, buckets
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{self.folder}/manifest")

    def state(self) -> tuple[int, list[str], list[str]]:
        """The number of the last state, its runs from old to new, and its tombstone tables."""
        last = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").orderBy(F.col("state").desc()).first()
        return (last["state"], list(last["runs"]), list(last["tombstones"])) if last else (0, [], [])

    def _commit(self, before: int, runs: list[str], tombstones: list[str]) -> None:
        self.spark.createDataFrame([(before + 1, runs, tombstones)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def add(self, chunks: DataFrame) -> None:
        """A run of chunks(id, content) whose ids are new to the index."""
        state, runs, tombstones = self.state()
        self._commit(state, [*runs, self._written(chunks)], tombstones)

    def replace(self, chunks: DataFrame, ids: DataFrame) -> None:
        """What the index holds of ids(id) goes; chunks(id, content) come, in one state."""
        state, runs, tombstones = self.state()
        run = self._written(chunks)
        name = f"tombstones-{uuid.uuid4().hex}"
        gone = ids.select("id").unionByName(chunks.select("id")).distinct()
        gone.withColumn("from", F.lit(len(runs))).write.parquet(f"{self.folder}/{name}")
        self._commit(state, [*runs, run], [*tombstones, name])

    def compact(self) -> None:
        """One run of the postings that count. Tables of older states stay until their folders are removed."""
        state, runs, tombstones = self.state()
        if len(runs) > 1 or tombstones:
            rows = self._postings(self._blocks(runs), tombstones)
            self._commit(state, [self._cut(rows.join(store.numbered(rows.select("id").distinct(), "id"), "id"))], [])

    def _written(self, chunks: DataFrame) -> str:
        """Writes a run of chunks(id, content). Texts are dealt by id, where their postings are gathered; these move once, to their blocks."""
        known = chunks.where(F.col("id").isNotNull()).select("id", "content")
        numbers = store.numbered(known.select("id").distinct(), "id")
        placed = known.repartition("id").join(numbers, "id").select("id", "number", F.posexplode(search.tokens(F.col("content"))).alias("position", "token"))
        made = self.lexeme(F.col("token")) if self.lexeme else F.col("token")
        rows = placed.select("id", "number", "position", made.alias("lexeme")).where(F.col("lexeme").isNotNull())
        return self._cut(rows.groupBy("id", "number", "lexeme").agg(F.sort_array(F.collect_list("position")).alias("positions")))

    def _cut(self, by_chunk: DataFrame) -> str:
        """Writes (id, number, lexeme, positions) as blocks."""
        name = f"run-{uuid.uuid4().hex}"
        block = F.floor(F.col("number") / BLOCK)
        dealt = by_chunk.select("id", "lexeme", "positions", block.alias("block"), F.floor(block / BLOCK).alias("part"), bucket(F.col("lexeme"), self.buckets).alias("bucket"))
        # Grouping by these keys and more needs no further exchange.
        blocks = dealt.repartition("bucket", "part").groupBy("bucket", "part", "lexeme", "block")
        blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("id", "positions"))).alias("chunks"), F.max(F.size("positions")).alias("most"), F.count("*").alias("n"))
        blocks.drop("part").sortWithinPartitions("bucket", "lexeme", "block").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return name

    def _blocks(self, runs: list[str], lexemes: list[str] | None = None) -> DataFrame:
        """(run, lexeme, block, chunks, most, n) of the runs, from the folders of the lexemes where they are given."""
        schema = "lexeme string, block long, chunks array<struct<id:long,positions:array<int>>>, most int, n long, bucket int"
        found = None
        for k, run in enumerate(runs):
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{run}").withColumn("run", F.lit(k))
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            found = self.spark.createDataFrame([], schema + ", run int")
        if lexemes is not None:
            # The folders of the lexemes, as literals: only these are listed.
            folders = sorted(r["b"] for r in self.spark.createDataFrame([(x,) for x in lexemes], "x string").select(bucket(F.col("x"), self.buckets).alias("b")).distinct().collect())
            found = found.where(F.col("bucket").isin(folders) & F.col("lexeme").isin(lexemes))
        return found.drop("bucket")

    def _postings(self, blocks: DataFrame, tombstones: list[str]) -> DataFrame:
        """(lexeme, id, positions) of blocks, without what tombstones pass over."""
        rows = blocks.select("run", "lexeme", F.explode("chunks").alias("c")).select("run", "lexeme", "c.id", "c.positions")
        if tombstones:
            dead = self.spark.read.schema("id long, `from` int").parquet(*[f"{self.folder}/{x}" for x in tombstones]).groupBy("id").agg(F.max("from").alias("from"))
            rows = rows.join(dead, (rows["id"] == dead["id"]) & (rows["run"] < dead["from"]), "left_anti")
        return rows.drop("run")

    def scores(self, lexemes: list[str], blocks: DataFrame | None = None) -> DataFrame:
        """(id, lexical_score) of the chunks that hold all lexemes, of all blocks or of the given (run, block)."""
        wanted = sorted(set(lexemes))
        _, runs, tombstones = self.state()
        found = self._blocks(runs, wanted)
        found = found if blocks is None else found.join(blocks, ["run", "block"], "left_semi")
        hits = self._postings(found, tombstones).groupBy("id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("by_lexeme"))
        hits = hits.where(F.size("by_lexeme") == len(wanted))
        flat = F.flatten(F.transform("by_lexeme", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("position"), x["lexeme"].alias("lexeme")))))
        return hits.select("id", search.cover_score(F.sort_array(flat), wanted).alias("lexical_score"))

    def heads(self, lexemes: list[str]) -> DataFrame:
        """(run, block, bound) of blocks that have all lexemes; no chunk in one scores more than bound.

        A minimal stretch ends at a posting that none before it ended at, and the postings before the first stretch, one
        less than there are lexemes, end none.
        """
        wanted = sorted(set(lexemes))
        _, runs, _ = self.state()
        rows = self._blocks(runs, wanted).select("run", "block", "lexeme", "most").groupBy("run", "block")
        ends = F.sum("most") - (len(wanted) - 1)
        return rows.agg(F.count("*").alias("have"), (ends * search.COVER).alias("bound")).where(F.col("have") == len(wanted)).select("run", "block", "bound")

    def topk(self, lexemes: list[str], k: int, decimals: int | None = None) -> DataFrame:
        """The k best rows (id, lexical_score), ties by id; decimals: scores that are equal after rounding are tied.

        The blocks with the largest bounds are scored first. Then only blocks whose bound reaches the k-th score are read.
        """
        wanted = sorted(set(lexemes))
        rounded = F.col("lexical_score") if decimals is None else F.round("lexical_score", decimals)
        best = lambda rows: rows.orderBy(rounded.desc(), "id").limit(k)
        if not wanted:
            return self.spark.createDataFrame([], "id long, lexical_score double")
        heads = self.heads(wanted)
        first = heads.orderBy(F.col("bound").desc(), "run", "block").limit(FIRST_BLOCKS).collect()
        if len(first) < FIRST_BLOCKS:  # these are all
            return best(self.scores(wanted, self._named(first)))
        scored = best(self.scores(wanted, self._named(first))).collect()
        least = scored[-1]["lexical_score"] if len(scored) == k else 0.0
        slack = 10.0 ** -(decimals or 12)
        return best(self.scores(wanted, heads.where(F.col("bound") >= F.lit(least - slack)).select("run", "block")))

    def _named(self, blocks: list) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(b["run"], b["block"]) for b in blocks], "run int, block long"))
