"""State as a log: numbered folders of rows under named sections, and manifests.

``<base>/<section>/v=<n>/`` holds the Parquet files that commit ``n`` wrote into a
section; ``<base>/manifest/<n>.json`` names, per section, the folders (with their row
counts) that version ``n`` consists of. A manifest appears by one rename that
fails if the number is taken, so a version is there whole or not at all, and of two
writers one fails. Readers take the newest manifest once and read its folders
only: what later commits or a compaction write does not concern them.

``prune`` deletes the folders that none of the last manifests names. The driver
handles manifests (a few numbers per commit), never rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class TakenError(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Manifest:
    """One version: section -> {folder number: rows}, and what its writer noted."""

    version: int
    sections: dict[str, dict[int, int]]
    info: dict = field(default_factory=dict)

    def rows(self, section: str) -> dict[int, int]:
        return self.sections.get(section, {})


class LogTable:
    def __init__(self, spark: SparkSession, base: str, schemas: Mapping[str, T.StructType]):
        """``schemas``: the columns of every section (without ``v``, the folder's number)."""
        self.spark, self.base, self.schemas = spark, base.rstrip("/"), dict(schemas)

    # ---- manifests

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """A version's manifest; the newest if none is given; null for an empty log."""
        if version is None:
            every = self.versions()
            if not every:
                return None
            version = every[-1]
        stream = self._fs().open(self._path("manifest", f"{version}.json"))
        try:
            d = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(version, {s: {int(v): n for v, n in folders.items()} for s, folders in d["sections"].items()}, d["info"])

    def publish(self, m: Manifest) -> Manifest:
        """The commit: the manifest appears under its number, or the number is taken."""
        jvm = self.spark.sparkContext._jvm
        fs, target = self._fs(), self._path("manifest", f"{m.version}.json")
        draft = self._path("manifest", f".{m.version}.{jvm.java.util.UUID.randomUUID().toString()}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"sections": m.sections, "info": m.info}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
        except Exception as exc:
            fs.delete(draft, False)
            if fs.exists(target):
                raise TakenError(f"{self.base}: version {m.version} is taken") from exc
            raise
        return m

    # ---- rows

    def put(self, section: str, version: int, rows: DataFrame, by: str | None = None) -> int:
        """Write a folder (a retry replaces what a failed attempt left) and count its rows."""
        path = f"{self.base}/{section}/v={version}"
        writer = rows.select(*self.schemas[section].names).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(self.schemas[section]).parquet(path).count()

    def get(self, section: str, folders) -> DataFrame:
        """The rows of some folders, with ``v``."""
        schema = T.StructType([*self.schemas[section].fields, T.StructField("v", T.IntegerType())])
        paths = [f"{self.base}/{section}/v={v}" for v in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/{section}").parquet(*paths)

    def prune(self, keep: int = 2) -> list[str]:
        """Delete the manifests before the last ``keep`` and the folders that only
        they name. A reader of an older version fails; returns what was deleted."""
        fs, every = self._fs(), self.versions()
        kept = [self.manifest(v) for v in every[-keep:]]
        newest, gone = (every[-1] if every else -1), []
        for v in every[:-keep]:
            fs.delete(self._path("manifest", f"{v}.json"), False)
        for section in self.schemas:
            folder = self._path(section)
            used = {v for m in kept for v in m.rows(section)}
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                name = status.getPath().getName()
                number = int(name[2:]) if name.startswith("v=") else newest + 1
                if number <= newest and number not in used:  # a newer one may be a commit under way
                    fs.delete(status.getPath(), True)
                    gone.append(f"{section}/{name}")
        return sorted(gone)
