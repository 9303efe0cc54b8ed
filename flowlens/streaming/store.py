"""Tables that a stream keeps up to date: runs of rows, a manifest, and compaction.

Every micro-batch adds one run (a folder) to each table of a store and then commits a manifest
that names all runs in use.  Only named runs count, so a batch that fails leaves nothing behind,
and one that is retried after its commit is recognised by its number and skipped.  Runs
have levels: when ``FANOUT`` runs of a level have gathered, they are merged into one run of the next,
so a reader touches at most FANOUT runs a level and each row is rewritten once a level, however many
batches there were.  Runs that neither of the last manifests names are deleted.

A manifest is a small JSON file under a name of its own, written aside and renamed; the
highest number counts.  One writer at a time, any number of readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

FANOUT = 8
#: Manifests that stay, so that readers of the one before are not disturbed.
KEPT_MANIFESTS = 2

Merge = Callable[[DataFrame], DataFrame]


@dataclass
class Manifest:
    """Runs of every table as [level, folder], the last batch they hold, and facts that go with it."""

    number: int = 0
    upto: int = -1
    runs: dict[str, list[list]] = field(default_factory=dict)
    facts: dict[str, Any] = field(default_factory=dict)


class Store:
    """Named tables below ``path``; ``merges`` combines the rows of several runs (None: rows are kept as they are)."""

    def __init__(self, spark: SparkSession, path: str, merges: dict[str, Merge | None], fanout: int = FANOUT):
        self.spark, self.path, self.merges, self.fanout = spark, path.rstrip("/"), merges, fanout
        self._jvm = spark.sparkContext._jvm

    # --- files, through the folder's own file system
    def _at(self, name: str = ""):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        system, path = self._at("manifest")
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _load(self, number: int) -> Manifest:
        system, path = self._at(f"manifest/{number:012d}.json")
        stream = system.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def manifest(self) -> Manifest:
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else Manifest()

    def _commit(self, new: Manifest) -> None:
        system, aside = self._at(f"manifest/_{uuid.uuid4().hex}")
        _, path = self._at(f"manifest/{new.number:012d}.json")
        stream = system.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(vars(new)).encode()))
        finally:
            stream.close()
        if not system.rename(aside, path):
            raise RuntimeError(f"{path} exists: the store has another writer")

    def _vacuum(self) -> None:
        """Delete runs and manifests that are out of use."""
        numbers = self._numbers()
        used = {run for n in numbers[-KEPT_MANIFESTS:] for runs in self._load(n).runs.values() for _, run in runs}
        system, path = self._at("runs")
        if system.exists(path):
            for s in system.listStatus(path):
                if s.getPath().getName() not in used:
                    system.delete(s.getPath(), True)
        for n in numbers[:-KEPT_MANIFESTS]:
            system.delete(self._at(f"manifest/{n:012d}.json")[1], False)

    # --- tables
    def _run(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/runs/{name}")
        return name

    def _union(self, runs: list[list], merge: Merge | None) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/runs/{run}") for _, run in runs])
        return merge(rows) if merge else rows

    def append(self, batch_id: int, tables: dict[str, DataFrame], facts: dict[str, Any] | None = None) -> bool:
        """Add a batch's rows; false if the store holds this batch already."""
        now = self.manifest()
        if batch_id <= now.upto:
            return False
        runs = {name: [*now.runs.get(name, [])] for name in {*now.runs, *tables}}
        for name, df in tables.items():
            merge = self.merges[name]
            runs[name].append([0, self._run(merge(df) if merge else df)])
        self._commit(Manifest(now.number + 1, batch_id, runs, {**now.facts, **(facts or {})}))
        self.compact()
        return True

    def compact(self) -> None:
        """Merge the runs of every level that has gathered ``fanout`` of them."""
        now = self.manifest()
        runs = {name: [*of] for name, of in now.runs.items()}
        changed = False
        for name, of in runs.items():
            level = 0
            while level <= max((lv for lv, _ in of), default=-1):
                own = [r for r in of if r[0] == level]
                if len(own) >= self.fanout:
                    merged = [level + 1, self._run(self._union(own, self.merges[name]))]
                    # order of arrival: merged runs stand where the last of theirs stood
                    of[:] = [r for r in of if r not in own and r[0] > level] + [merged] + [r for r in of if r not in own and r[0] < level]
                    changed = True
                level += 1
        if changed:
            self._commit(Manifest(now.number + 1, now.upto, runs, now.facts))
            self._vacuum()

    def read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """The merged rows of a table; without runs an empty table of ``schema``, or None."""
        runs = self.manifest().runs.get(name, [])
        if not runs:
            return self.spark.createDataFrame([], schema) if schema else None
        return self._union(runs, self.merges[name])


def summed(keys: list[str]) -> Merge:
    """Merge that adds up all other columns."""
    return lambda df: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in keys])


def newest(keys: list[str], by: list[str]) -> Merge:
    """Merge that keeps, for each key, the row with the largest ``by`` (other columns decide ties)."""
    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys and c not in by]
        first = F.max(F.struct(*by, *rest)).alias("__s")
        return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"__s.{c}") for c in df.columns])
    return merge
