"""Versions of a table as folders: each written whole, made current by one rename, and never written twice for one batch."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import importing

VERSION = re.compile(r"version=(\d{10})-([A-Za-z0-9_.]+)$")


class Snapshots:
    """The versions under a folder, `version=<number>-<token>`. The highest number is current; the token says which batch wrote it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str]]:
        """(number, token) in order."""
        root = self._path(self.root)
        if not self._files.exists(root):
            return []
        found = [VERSION.search(s.getPath().getName()) for s in self._files.listStatus(root)]
        return sorted((int(m[1]), m[2]) for m in found if m)

    def read(self, number: int | None = None) -> DataFrame | None:
        """The current version, or a certain one; None before the first."""
        known = dict(self.versions())
        if not known:
            return None
        number = max(known) if number is None else number
        return self.spark.read.parquet(f"{self.root}/version={number:010d}-{known[number]}")

    def write(self, rows: DataFrame, token: str) -> int:
        """Makes rows the current version and returns its number. A token that has written before changes nothing. Files are written beside the
        versions first; a job that dies there leaves a folder that is never read. One writer at a time: if another one has taken the
        number meanwhile, the rename fails, and so does this."""
        if not re.fullmatch("[A-Za-z0-9_.]+", token):
            raise ValueError("a token is letters, digits, dots and underscores")
        known = self.versions()
        for number, said in known:
            if said == token:
                return number
        number = max((n for n, _ in known), default=0) + 1
        draft = f"{self.root}/_draft-{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        if any(n == number for n, _ in self.versions()) or not self._files.rename(self._path(draft), self._path(f"{self.root}/version={number:010d}-{token}")):
            raise RuntimeError(f"version {number} was written by another job")
        return number


def import_batch(store: Snapshots, incoming: DataFrame, mode: str, token: str) -> int:
    """Applies an import (paper_id, number, text, status) in a mode of importing.apply_import to the current version, or begins with it. For a
    stream: `writeStream.foreachBatch(lambda rows, n: import_batch(store, rows, mode, f"{name}.{n}"))`; a batch that is run again
    changes nothing."""
    now = store.read()
    if now is None:
        now = incoming.limit(0)
    columns = ["paper_id", "number", "text", "status"]
    return store.write(importing.apply_import(now.select(*columns), incoming.select(*columns), mode).select(*columns, "action"), token)


def import_stream(store: Snapshots, incoming: DataFrame, mode: str, checkpoint: str, name: str = "import"):
    """A stream of imports into the store; returns the writer, to be started."""
    return incoming.writeStream.foreachBatch(lambda rows, n: import_batch(store, rows, mode, f"{name}.{n}") and None).option("checkpointLocation", checkpoint)
