"""Tables made of folders that never change and a commit row that names the ones that count.

A write puts its rows into a fresh folder and then adds one commit row; until that row is there, readers see the table as
it was, and a folder whose commit never came is not part of it. A folder may replace rows of earlier ones by key; the
replacing happens when the table is read, so a write costs what it brings, not what is there. After ``MOST_FOLDERS``
folders a write merges them into one. One writer at a time; folders that no commit names any more are left where they are.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators.ordered import null_safe_join

MOST_FOLDERS = 32
COMMIT = "version long, mark long, folders array<struct<name:string,replaces:boolean>>"


class Head(NamedTuple):
    """The commit that counts: its number, the caller's mark, and folders with whether their rows replace earlier ones."""

    version: int = 0
    mark: int | None = None
    folders: tuple[tuple[str, bool], ...] = ()


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.keys, self.partition_by = spark, path, schema, keys, partition_by

    def head(self) -> Head:
        """The last commit; version 0 before the first."""
        try:
            commits = self.spark.read.schema(COMMIT).json(f"{self.path}/commits")
            last = commits.orderBy(F.desc("version")).first()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            last = None
        return Head(last["version"], last["mark"], tuple(map(tuple, last["folders"]))) if last else Head()

    def read(self, head: Head | None = None) -> DataFrame | None:
        """The rows as of a commit (the last one unless given), or None before the first; of rows with equal keys the latest stays."""
        folders = (head or self.head()).folders
        if not folders:
            return None
        parts = [
            self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").withColumn("_order", F.lit(order))
            for order, (name, _) in enumerate(folders)
        ]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if any(replaces for _, replaces in folders[1:]):
            latest = rows.groupBy(*self.keys).agg(F.max("_order").alias("_order"))
            rows = null_safe_join(rows, latest, [*self.keys, "_order"], "left_semi")
        return rows.drop("_order")

    def add(self, rows: DataFrame, replaces: bool = False, mark: int | None = None) -> Head:
        """Commit ``rows`` (a subset of the schema's columns in any order).

        With ``replaces`` they take the place of rows with equal keys; otherwise their keys must be new. ``mark`` is a growing
        number of the caller's (a batch number, say): rows whose mark is already committed are not written again.
        """
        head = self.head()
        if mark is not None and head.mark is not None and mark <= head.mark:
            return head
        folders = (*head.folders, (self._write(rows), replaces))
        if len(folders) > MOST_FOLDERS:
            folders = ((self._write(self.read(Head(folders=folders))), False),)
        return self._point(Head(head.version + 1, mark if mark is not None else head.mark, folders))

    def _write(self, rows: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        writer = (rows.hint("rebalance", *self.partition_by) if self.partition_by else rows).write
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{name}")
        return name

    def _point(self, head: Head) -> Head:
        row = self.spark.createDataFrame([(head.version, head.mark, list(head.folders))], COMMIT)
        row.coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return head
