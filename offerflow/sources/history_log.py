"""Keyed state as base plus deltas: the offer history, the attempts at scoring.

A merge changes few rows of a large table: it adds some of the batch's and drops
those that they replace. Only these changes are written, as a folder of added rows
and a folder of tombstones (keys of dropped rows); the rest of the table is read,
never rewritten. A row is part of a version if no later tombstone names its key.

Compaction keeps reading cheap. Many small deltas become one delta; once deltas
hold more than half as many rows as the base, all become a new base. A row is
thus rewritten a number of times that grows with the logarithm of the table,
and what a run writes follows its batch.

A commit notes where it comes from (a stream's epoch and batch, say), and ``noted``
finds it again after a failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import ORDER, join_null_safe, merge_changes, merge_history, stamp_import
from .log_table import LogTable, Manifest

#: Deltas that are read beside the base before they become one.
DELTAS = 8
#: Deltas' share of the base's rows at which all become a new base.
SHARE = 0.5

_SEEN = T.StructType([T.StructField("job_url", T.StringType())])


class DeltaLog:
    """Rows by key; ``more`` are further sections of the caller's."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, key: Sequence[str], more: dict | None = None):
        self.key = list(key)
        tomb = T.StructType([schema[c] for c in self.key])
        self.log = LogTable(spark, base, {"rows": schema, "gone": tomb, **(more or {})})

    def exists(self) -> bool:
        return bool(self.log.versions())

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest if none is given)."""
        m = self.log.manifest(version)
        return self._alive(m, m.rows("rows")).drop("v")

    def _alive(self, m: Manifest, folders) -> DataFrame:
        rows = self.log.get("rows", folders)
        if not m.rows("gone"):
            return rows
        # the last tombstone of a key: rows that came after it live
        gone = self.log.get("gone", m.rows("gone")).groupBy(*self.key).agg(F.max("v").alias("gone_v"))
        return join_null_safe(rows, gone, self.key, "left_anti", also=lambda g: rows["v"] < g["gone_v"], more=["gone_v"])

    def noted(self, **info) -> Manifest | None:
        """The newest version whose writer noted all of ``info``."""
        for v in reversed(self.log.versions()):
            m = self.log.manifest(v)
            if all(m.info.get(k) == x for k, x in info.items()):
                return m
        return None

    def write(self, added: DataFrame, dropped: DataFrame, sections: dict | None = None, **info) -> Manifest:
        """Commit a delta: rows, and keys of rows of earlier versions that are no more."""
        m = self.log.manifest()
        n = m.version + 1
        rows = {**m.rows("rows"), n: self.log.put("rows", n, added)}
        gone = {**m.rows("gone"), n: self.log.put("gone", n, dropped)}
        return self.log.publish(Manifest(n, {**m.sections, **(sections or {}), "rows": _filled(rows), "gone": _filled(gone, 0)}, info))

    def compact(self, deltas: int = DELTAS, share: float = SHARE) -> Manifest | None:
        """Make one delta of many, or a new base of all; null if there is nothing to do."""
        m = self.log.manifest()
        base, *later = sorted(m.rows("rows"))
        changed = sum(m.rows("rows")[v] for v in later) + sum(m.rows("gone").values())
        n = m.version + 1
        if changed > share * m.rows("rows")[base]:
            sections = {**m.sections, "rows": {n: self.log.put("rows", n, self._alive(m, m.rows("rows")))}, "gone": {}}
        elif len(later) > deltas:
            merged = self.log.put("rows", n, self._alive(m, later))
            gone = self.log.put("gone", n, self.log.get("gone", m.rows("gone")).select(*self.key).distinct())
            sections = {**m.sections, "rows": {base: m.rows("rows")[base], n: merged}, "gone": {n: gone} if gone else {}}
        else:
            return None
        sections |= self.compacted(m, n, deltas)
        return self.log.publish(Manifest(n, sections, m.info))

    def compacted(self, m: Manifest, n: int, deltas: int) -> dict:
        """Further sections rewritten on the way."""
        return {}

    def prune(self, keep: int = 2) -> list[str]:
        return self.log.prune(keep)


def _filled(folders: dict[int, int], least: int = 1) -> dict[int, int]:
    """Without empty folders (the first ``least`` stay)."""
    return {v: n for i, (v, n) in enumerate(sorted(folders.items())) if n or i < least}


def _numbered(rows: DataFrame) -> DataFrame:
    """A row without a number gets one from its content, so that a tombstone can name it."""
    return rows.withColumn("seq", F.coalesce("seq", F.xxhash64(*rows.columns)))


class HistoryLog(DeltaLog):
    """The merged history; a section beside it keeps the ledger of all matched
    addresses, committed by the same manifest, so the two never disagree."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, scope: Sequence[str] = ()):
        """``schema`` holds the arrival order; ``scope`` are the columns (the search, say) that histories are apart by."""
        super().__init__(spark, base, schema, ORDER, {"seen": _SEEN})
        self.scope = tuple(scope)

    def create(self, history: DataFrame, merged: bool = False, seen: DataFrame | None = None) -> Manifest:
        """Version 0. ``merged``: the history is itself the output of a merge."""
        if not set(ORDER) <= set(history.columns):
            history = stamp_import(history)
        sections = {"rows": {0: self.log.put("rows", 0, _numbered(history))}, "gone": {}, "seen": {}}
        if seen is not None:
            sections["seen"] = _filled({0: self.log.put("seen", 0, seen)}, 0)
        return self.log.publish(Manifest(0, sections, {"merged": merged}))

    def seen(self, version: int | None = None) -> DataFrame:
        """The ledger's addresses (may repeat)."""
        return self.log.get("seen", self.log.manifest(version).rows("seen")).drop("v")

    def append(self, new: DataFrame, seen: DataFrame | None = None, **info) -> Manifest:
        """Merge new rows; writes the rows that the merge adds and drops, and ``seen`` addresses."""
        m, new = self.log.manifest(), _numbered(new)
        n, sections = m.version + 1, {}
        if seen is not None:
            sections["seen"] = _filled({**m.rows("seen"), n: self.log.put("seen", n, seen)}, 0)
        if m.info.get("merged"):
            added, dropped = merge_changes(self.read(), new, self.scope)
            return self.write(added, dropped, sections, **info, merged=True)
        # a raw history has repeats of its own: merged whole, once
        rows = {n: self.log.put("rows", n, merge_history(self.read(), new, False, self.scope))}
        return self.log.publish(Manifest(n, {**m.sections, **sections, "rows": rows, "gone": {}}, {**info, "merged": True}))

    def compacted(self, m: Manifest, n: int, deltas: int) -> dict:
        if len(m.rows("seen")) <= deltas:
            return {}
        return {"seen": {n: self.log.put("seen", n, self.log.get("seen", m.rows("seen")).select("job_url").distinct())}}
