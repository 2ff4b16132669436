"""Stored tables as versioned snapshots: every change of several tables is one commit, which readers see whole or not at all.

A table's rows lie in buckets by a hash of a key. A commit writes the touched buckets of each table into new folders and
then appends one row, in one file, to the table of commits: it says for each table in which folder each bucket lies. The
folders that it doesn't name belong to no version; what a killed job leaves is never read. A reader takes the row with
the highest version; older versions can be read for as long as their folders are kept.

Two writers that start from one version both append a row of the next one: the smaller token wins, and the other gets an
error and starts again from the new version.

Defined cases: a table that no commit names is empty; a bucket without rows has no folder; a null key falls in a bucket like
other keys; columns that the schema lacks aren't stored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
COMMITS = "version long, token string, tables map<string,map<int,string>>"


class Conflict(Exception):
    """Another commit took the version."""


@dataclass(frozen=True)
class Change:
    """The rows that the touched buckets hold after a change, dealt by a key; touched None: all buckets."""

    rows: DataFrame
    key: str
    touched: list[int] | None = None


class Snapshots:
    """The tables in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(f"{self.folder}/commits")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits")

    def state(self, version: int | None = None) -> tuple[int, dict[str, dict[int, str]]]:
        """The last version, or the given one, and the folder of each table's buckets."""
        rows = self._commits() if version is None else self._commits().where(F.col("version") == version)
        row = rows.orderBy(F.col("version").desc(), "token").first()
        if row is None and version is not None:
            raise ValueError(f"there is no version {version}")
        return (row["version"], row["tables"]) if row else (0, {})

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets that rows fall in."""
        return sorted(r["b"] for r in rows.select(self.bucket(key).alias("b")).distinct().collect())

    def read(self, name: str, schema: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some of its buckets, as it is now, or was in a version. Other buckets aren't listed."""
        places = self.state(version)[1].get(name, {})
        paths = [f"{self.folder}/{path}/bucket_={b}" for b, path in sorted(places.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, changes: Mapping[str, Change]) -> int:
        """Writes the changes and gives the new version; if anything fails before the last step, the old one stays."""
        version, before = self.state()
        token = uuid.uuid4().hex
        tables = {name: dict(places) for name, places in before.items()}
        for name, change in changes.items():
            path = f"{name}/{version + 1}-{token}"
            rows = change.rows.withColumn("bucket_", self.bucket(change.key))
            if change.touched is not None:
                rows = rows.where(F.col("bucket_").isin(change.touched))
            rows.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.folder}/{path}")
            kept = {b: old for b, old in before.get(name, {}).items() if change.touched is not None and b not in set(change.touched)}
            tables[name] = kept | {b: path for b in self._written(path)}
        self.spark.createDataFrame([(version + 1, token, tables)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        if self._commits().where(F.col("version") == version + 1).orderBy("token").first()["token"] != token:
            raise Conflict(f"version {version + 1} was taken")
        return version + 1

    def _written(self, path: str) -> list[int]:
        """The buckets that a write made, from the names of its folders."""
        found = self.spark.read.option("basePath", f"{self.folder}/{path}").schema("bucket_ int").parquet(f"{self.folder}/{path}")
        return sorted(r["bucket_"] for r in found.select("bucket_").distinct().collect())

    def unused(self, keep: int = 2) -> list[str]:
        """Folders that commits before the last `keep` versions name and these don't: what can be removed."""
        last = self.state()[0]
        named: dict[bool, set[str]] = defaultdict(set)
        for row in self._commits().collect():
            for places in row["tables"].values():
                named[row["version"] > last - keep].update(places.values())
        return sorted(f"{self.folder}/{path}" for path in named[False] - named[True])
