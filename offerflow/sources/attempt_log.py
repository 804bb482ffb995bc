"""The table of attempts at scoring, kept as a log in the shared folder.

Its rows name their text by digest; a section beside them holds each text once,
however many searches wait for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.attempts import KEY, from_results
from ..schemas import ATTEMPT, ATTEMPT_ROW, TEXT
from .history_log import DeltaLog, _filled
from .log_table import Manifest


class AttemptLog(DeltaLog):
    def __init__(self, spark: SparkSession, base: str):
        super().__init__(spark, base, ATTEMPT_ROW, KEY, {"texts": TEXT})

    def create(self, results: DataFrame | None = None) -> Manifest:
        """Version 0: empty, or the pairs of stored results (profile_id, url), which are never scored again."""
        rows = self.log.spark.createDataFrame([], ATTEMPT_ROW) if results is None else from_results(results)
        return self.log.publish(Manifest(0, {"rows": {0: self.log.put("rows", 0, rows)}, "gone": {}, "texts": {}}, {}))

    def pairs(self, version: int | None = None) -> DataFrame:
        """The rows with ``text_id`` in the place of the text."""
        return super().read(version)

    def texts(self, version: int | None = None) -> DataFrame:
        """(text_id, description), each once."""
        return self.log.get("texts", self.log.manifest(version).rows("texts")).drop("v")

    def read(self, version: int | None = None) -> DataFrame:
        return self.pairs(version).join(self.texts(version), "text_id", "left").select(*ATTEMPT.names)

    def upsert(self, rows: DataFrame, texts: DataFrame, **info) -> Manifest:
        """Rows in the place of those of the same key; writes these rows only, and of
        ``texts`` (text_id, description) those that they name and that are not stored yet."""
        m = self.log.manifest()
        n = m.version + 1
        new = texts.join(_named(rows), "text_id", "left_semi")
        if m.rows("texts"):
            new = new.join(self.texts().select("text_id"), "text_id", "left_anti")
        stored = {**m.rows("texts"), n: self.log.put("texts", n, new.dropDuplicates(["text_id"]))}
        out = self.write(rows, rows.select(*KEY), {"texts": _filled(stored, 0)}, **info)
        return self.compact() or out

    def compacted(self, m: Manifest, n: int, deltas: int) -> dict:
        """The texts that rows still name, in one folder."""
        if len(m.rows("texts")) <= deltas:
            return {}
        texts = self.log.get("texts", m.rows("texts")).drop("v").join(_named(self._alive(m, m.rows("rows"))), "text_id", "left_semi")
        return {"texts": _filled({n: self.log.put("texts", n, texts)}, 0)}


def _named(rows: DataFrame) -> DataFrame:
    return rows.where("text_id is not null").select("text_id").distinct()
