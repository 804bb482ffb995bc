"""Helpers shared by the operators: table access, scratch tables, Arrow rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerflow.session import scratch_path

#: Texts per Arrow batch. Texts may be long, so far fewer than Spark's 10,000.
TEXTS_PER_BATCH = 1000
#: Bytes per Arrow batch, about: rows may also be whole groups.
BATCH_BYTES = 16 << 20
#: Rows of a narrow table per file, and files that any such table may have.
FILE_ROWS, FEW_FILES = 100_000, 12


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conf_number(text: str) -> int:
    """A number as settings hold it: plain, or bytes with a unit (64m, 67108864b, 8MB)."""
    found = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", text.strip().lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to TEXTS_PER_BATCH and BATCH_BYTES (never
    raise it): a Python worker then holds some thousand texts at a time, not ten
    thousand, and fewer if they, or the groups that rows may be, are large."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf_number(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write a table below spark.checkpoint.dir and read it back: cuts the
    lineage with files that every executor can read again."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a narrow table of at most ``rows`` rows, in no more partitions than these
    call for. Each task of a sort or hash table takes its pages of memory and each
    file starts processes (chmod, on a local disk), however few rows it has."""
    return df.coalesce(max(FEW_FILES, -(-rows // FILE_ROWS)))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, one per stem."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``rows`` rows;
    else unmarked, and adaptive execution joins it by shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def map_texts(docs: DataFrame, columns: list[str], row: Callable[..., tuple], schema: str | StructType,
              setup: Callable[[], object] | None = None) -> DataFrame:
    """One output row per document: ``row(state, *values)`` over Arrow batches.

    Only ``columns`` are read, so further columns, whatever their names, do
    not matter. ``setup`` runs once per task (models, tables)."""

    from pyspark.sql.types import _parse_datatype_string

    out_type = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rows = [row(state, *values) for values in zip(*cols, strict=True)]
            made = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), type=f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)

    return docs.select(*columns).mapInArrow(run, out_type)


def keep_rows(docs: DataFrame, column: str, keep: Callable[[object, list], list[bool]],
              setup: Callable[[], object] | None = None) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose ``column`` value passes."""

    at = docs.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            yield batch.filter(pa.array(keep(state, batch.column(at).to_pylist()), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, keep=None) -> DataFrame:
    """(doc_id, text, <label>) of at most ``limit`` labelled documents, chosen by
    a hash of the id. The bound makes broadcasting the chosen ids safe."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    chosen = (rows.groupBy("doc_id").agg(F.max(label).alias(label))
              .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(limit))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


class Remembered(dict):
    """Results of a function by argument, computed on first use. Two generations
    of ``limit`` entries bound a worker's memory: when the young one is full it
    becomes the old one, whose entries move up again when they are used."""

    def __init__(self, compute: Callable, limit: int = 500_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found
