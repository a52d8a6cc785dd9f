"""Derived tables that are written once and shared by all queries that need them.

A table's place is named by a fingerprint of what it is made from: the files of its inputs (path, size and time of
change), its parameters and the layout's version.  Changed input or parameters therefore give another table; a table
is used only if its write was finished, which a one-row table beside it says.  Everything lies in the shared folder
named by ``spark.checkpoint.dir``, so executors may be lost at any time and lineage ends at each table.

Two sessions that make the same table at the same time write to different folders; the first marker to be committed
wins, and the other folder is not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrank.session import ensure_checkpoint_dir

VERSION = 2     # of the layouts; a change of what a table holds needs another number
_FINISHED: dict[tuple[str, str], str] = {}    # (application, place) -> folder of the data


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of the files of a Parquet input: their paths, sizes and times of change.  Reads footers only; one row comes back."""
    m = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = m.agg(F.count(F.lit(1)), F.sum("file_size"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()
    return f"{path}:{row[0]}:{row[1]}:{row[2]}"


class Store:
    """Reuse of derived tables over the inputs ``paths`` (name -> Parquet path)."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], root: str | None = None):
        self.spark, self.paths = spark, paths
        self.root = (root or ensure_checkpoint_dir(spark)).rstrip("/") + "/segrank-store"
        self._prints: dict[str, str] = {}

    def place(self, name: str, inputs: list[str], params: dict) -> str:
        for i in inputs:
            if i not in self._prints:
                self._prints[i] = fingerprint(self.spark, self.paths[i])
        told = json.dumps([VERSION, name, [self._prints[i] for i in sorted(inputs)], params], sort_keys=True)
        return f"{self.root}/{name}-{hashlib.sha256(told.encode()).hexdigest()[:24]}"

    def _finished(self, place: str) -> str | None:
        """Where the table's data are, if its write has ended.  The marker is looked for each time (a listing, no job), as the
        folder may be cleared within a session; it is read once."""
        key = (self.spark.sparkContext.applicationId, place)
        try:
            done = self.spark.read.schema("data string").parquet(f"{place}/done")
        except AnalysisException:      # nothing there
            _FINISHED.pop(key, None)
            return None
        if key not in _FINISHED:
            row = done.first()
            if row is None:
                return None
            _FINISHED[key] = row["data"]
        return _FINISHED[key]

    def _finish(self, place: str, data: str) -> str:
        self.spark.createDataFrame([(data,)], "data string").coalesce(1).write.mode("ignore").parquet(f"{place}/done")
        return self._finished(place) or data

    def table(self, name: str, inputs: list[str], build: Callable[[], DataFrame], **params) -> DataFrame:
        """The table ``name``, made by ``build`` unless it is there."""
        place = self.place(name, inputs, params)
        data = self._finished(place)
        if data is None:
            data = f"{place}/data-{uuid.uuid4().hex[:12]}"
            build().write.option("compression", "zstd").parquet(data)
            data = self._finish(place, data)
        return self.spark.read.parquet(data)

    def bucketed(self, name: str, inputs: list[str], build: Callable[[], DataFrame], by: list[str], sort: list[str], buckets: int,
                 **params) -> DataFrame:
        """As :meth:`table`, in ``buckets`` files by a hash of ``by``, each sorted by ``sort`` (empty: as the rows come): a join or an aggregation
        on ``by`` needs no exchange of it.  ``build`` gives rows that are dealt so already (``repartition(buckets, *by)``)."""
        place = self.place(name, inputs, params | {"by": by, "sort": sort, "buckets": buckets})
        data = self._finished(place)
        if data is None:
            data = f"{place}/data-{uuid.uuid4().hex[:12]}"
            writer = build().write.format("parquet").option("path", data).option("compression", "zstd").bucketBy(buckets, *by)
            (writer.sortBy(*sort) if sort else writer).saveAsTable(self._name(data))
            data = self._finish(place, data)
        if not self.spark.catalog.tableExists(self._name(data)):      # another session wrote it
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(data).schema)
            quoted = lambda cs: ", ".join(f"`{c}`" for c in cs)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(data)} ({columns}) USING parquet CLUSTERED BY ({quoted(by)}) "
                           f"{f'SORTED BY ({quoted(sort)}) ' if sort else ''}INTO {buckets} BUCKETS LOCATION '{data}'")
        return self.spark.table(self._name(data))

    @staticmethod
    def _name(data: str) -> str:
        return "segrank_" + hashlib.sha256(data.encode()).hexdigest()[:24]
