"""Snapshot reads over versioned rows, and tables as chains of published versions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Snapshot:
    """What a transaction may see: its own id, the first id not yet given, the ids then running."""

    me: int
    upper: int
    running: tuple[int, ...] = ()

    def visible(self, xmin: Column, xmax: Column, creator_done: Column, deleter_done: Column) -> Column:
        """True for row versions made by this or an earlier committed transaction and not deleted by one."""
        ran = lambda x: x.isin(*self.running) if self.running else F.lit(False)
        made = (xmin == self.me) | ((xmin < self.upper) & ~ran(xmin) & creator_done)
        there = (xmax == 0) | ((xmax != self.me) & ((xmax >= self.upper) | ran(xmax) | ~deleter_done))
        return made & there


def snapshot_read(rows: DataFrame, status: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Visible rows of a table with xmin and xmax; status(xid, committed) is joined by id.

    Catalyst broadcasts status while it is below the session's size limit and else merges by xid;
    the skew-join rule splits an xid that wrote a large share of the rows. Unknown ids count as not committed.
    """
    creator = status.select(F.col("xid").alias("_cx"), F.col("committed").alias("_cok"))
    deleter = status.select(F.col("xid").alias("_dx"), F.col("committed").alias("_dok"))
    joined = rows.join(creator, rows["xmin"] == F.col("_cx"), "left").join(deleter, rows["xmax"] == F.col("_dx"), "left")
    no = F.lit(False)
    seen = snapshot.visible(rows["xmin"], rows["xmax"], F.coalesce("_cok", no), F.coalesce("_dok", no))
    return joined.filter(seen).select(*[rows[c] for c in rows.columns if c not in ("xmin", "xmax")])


class ConflictError(RuntimeError):
    """Another transaction published the table first."""


@dataclass
class VersionedTables:
    """Tables as published Parquet folders; every publish goes to a new folder, so readers keep theirs."""

    spark: SparkSession
    folder: str
    paths: dict[str, list[str]] = field(default_factory=dict)

    def publish(self, name: str, df: DataFrame, expected: int | None = None) -> int:
        """Writes the next version and returns its number; raises if expected isn't the current number."""
        if expected is not None and expected != len(self.paths.get(name, ())):
            raise ConflictError(name)
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        if expected is not None and expected != len(self.paths.get(name, ())):
            raise ConflictError(name)
        self.paths.setdefault(name, []).append(path)
        return len(self.paths[name])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        if name not in self.paths:
            raise ValueError(f"unknown table: {name}")
        return self.spark.read.parquet(self.paths[name][-1 if version is None else version - 1])

    def begin(self) -> Transaction:
        return Transaction(self, {name: len(v) for name, v in self.paths.items()})


@dataclass
class Transaction:
    """Repeatable reads of the versions pinned at its start, own changes seen, first committer wins."""

    tables: VersionedTables
    pinned: dict[str, int]
    staged: dict[str, DataFrame] = field(default_factory=dict)
    open: bool = True

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("no transaction is open")

    def read(self, name: str) -> DataFrame:
        self._check()
        if name in self.staged:
            return self.staged[name]
        if name not in self.pinned:
            raise ValueError(f"unknown table: {name}")
        return self.tables.read(name, self.pinned[name])

    def write(self, name: str, df: DataFrame) -> None:
        self._check()
        self.staged[name] = df

    def commit(self) -> None:
        self._check()
        self.open = False
        for name in self.staged:
            if self.pinned.get(name, 0) != len(self.tables.paths.get(name, ())):
                raise ConflictError(name)
        for name, df in self.staged.items():
            self.tables.publish(name, df, self.pinned.get(name, 0))

    def rollback(self) -> None:
        self._check()
        self.open = False
        self.staged.clear()
