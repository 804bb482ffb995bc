"""Sources and sinks: JSON-array imports, history snapshots, result appends,
profile and CV readers, report text. Every writer targets a shared folder
(see ``session.scratch_path``); nothing passes through the driver.

JSON arrays (the reference's file format) are read with ``multiLine`` and
an explicit schema; a multi-line array is one split, so an import is read
once and kept as Parquet afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import HISTORY_JSON, RESULT_JSON

SNAPSHOT_PREFIX = "v="
#: Bits of ``monotonically_increasing_id`` that number the rows of a task.
ROW_BITS = 33
#: Records in a file of results at most: a gzip file is read by one task.
RESULTS_PER_FILE = 250_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, array: bool = True) -> DataFrame:
    """Records of a JSON array file (``array=True``) or JSON lines. A missing
    path gives an empty frame; malformed input lands in ``_corrupt_record``."""
    if not path_exists(spark, path):
        return _empty(spark, schema)
    return (spark.read.schema(schema).option("multiLine", array).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, rejected raw records)."""
    bad = F.col("_corrupt_record").isNotNull()
    # Spark refuses scans that read only the corrupt-record column; tying the
    # reject filter to a data column keeps that column in the read schema.
    anchor = F.length(F.coalesce(F.col(df.columns[0]).cast("string"), F.lit(""))) >= 0
    return df.where(~bad & anchor).drop("_corrupt_record"), df.where(bad & anchor).select("_corrupt_record")


def read_history(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """Offer history; corrupt records are set aside, never erase the rest."""
    good, _ = split_corrupt(read_json_records(spark, path, HISTORY_JSON, array))
    return good


def import_history(spark: SparkSession, path: str, array: bool = True) -> tuple[DataFrame, DataFrame]:
    """(offers with an arrival order, rejected raw records) of an offer history:
    batch -1, in the order of files and of records within a file. ``seq`` holds this
    order whole, however many files there are: the rank of a file's part above
    ``ROW_BITS`` bits for the row."""
    good, bad = split_corrupt(read_json_records(spark, path, HISTORY_JSON, array))
    cols = [f.name for f in HISTORY_JSON.fields if f.name != "_corrupt_record"]
    numbered = good.select(*cols, F.lit(-1).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("source_rank"),
                           F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"),
                           F.monotonically_increasing_id().alias("_row"))
    # names and offsets of the parts only: one small window gives them their ranks
    parts = numbered.select("_file", "_start").distinct().select(
        "_file", "_start", F.row_number().over(Window.orderBy("_file", "_start")).cast("long").alias("_rank"))
    # a part is read by one task: its rows' numbers within the task are distinct and ascend
    seq = F.shiftleft("_rank", ROW_BITS) + F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return numbered.join(parts, ["_file", "_start"]).select(*cols, "batch_id", "source_rank", seq.alias("seq")), bad


def read_results(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    good, _ = split_corrupt(read_json_records(spark, path, RESULT_JSON, array))
    return good


def history_seen(history: DataFrame) -> DataFrame:
    return history.select("job_url").where(F.col("job_url").isNotNull()).distinct()


# Defaults of a saved search (current generation).
PROFILE_DEFAULTS = {"location": "Katowice", "remote_only": False, "max_days_old": 14}
PROFILE_JSON = T.StructType([
    T.StructField("profile_id", T.LongType()),
    T.StructField("job_titles", T.ArrayType(T.StringType())),
    T.StructField("experience_levels", T.ArrayType(T.StringType())),
    T.StructField("exclude_keywords", T.ArrayType(T.StringType())),
    T.StructField("location", T.StringType()),
    T.StructField("remote_only", T.BooleanType()),
    T.StructField("max_days_old", T.IntegerType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
])


def with_profile_defaults(df: DataFrame, legacy: bool = False) -> DataFrame:
    empty = F.array().cast("array<string>")
    days = 2 if legacy else PROFILE_DEFAULTS["max_days_old"]
    return df.select(
        "profile_id",
        F.col("job_titles"),
        F.coalesce("experience_levels", empty).alias("experience_levels"),
        F.coalesce("exclude_keywords", empty).alias("exclude_keywords"),
        F.coalesce("location", F.lit(PROFILE_DEFAULTS["location"])).alias("location"),
        F.coalesce("remote_only", F.lit(PROFILE_DEFAULTS["remote_only"])).alias("remote_only"),
        F.coalesce("max_days_old", F.lit(days)).alias("max_days_old"),
        F.col("model_name"),
        F.coalesce("skills", empty).alias("skills"),
    )


def read_profiles(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Saved searches (one JSON object per search, or an array), with defaults."""
    if not path_exists(spark, path):
        return _empty(spark, PROFILE_JSON)
    raw = spark.read.schema(PROFILE_JSON).option("multiLine", array).json(path)
    return with_profile_defaults(raw.where(F.col("job_titles").isNotNull()))


def cv_text(c: str) -> Column:
    """A CV without trailing newlines."""
    return F.regexp_replace(c, r"\n+$", "")


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """CV text per search from ``<path>/profile_id=<n>/*.txt`` (one file per
    search, read whole); trailing newlines dropped."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("profile_id").cast("long"),
                     cv_text("value").alias("cv_text"))


def write_resumes(resumes: DataFrame, path: str) -> None:
    resumes.select("profile_id", F.col("cv_text").alias("value")).write.mode("overwrite").partitionBy(
        "profile_id").text(path)


def write_working_set(df: DataFrame, path: str) -> None:
    """Replace the working set (JSON lines; an empty frame writes no rows)."""
    df.write.mode("overwrite").json(path)


def _versions(spark: SparkSession, base: str) -> list[int]:
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(SNAPSHOT_PREFIX) and fs.exists(
                spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            try:
                out.append(int(name[len(SNAPSHOT_PREFIX):]))
            except ValueError:
                pass
    return sorted(out)


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write a new snapshot folder ``v=<n>``; readers switch to it only once
    its _SUCCESS marker exists, so a failed write leaves the old one."""
    path = f"{base.rstrip('/')}/{SNAPSHOT_PREFIX}{version}"
    df.write.mode("overwrite").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, base: str, below: int | None = None) -> int | None:
    vs = [v for v in _versions(spark, base) if below is None or v < below]
    return vs[-1] if vs else None


def read_snapshot(spark: SparkSession, base: str, version: int | None = None) -> DataFrame | None:
    v = latest_snapshot(spark, base) if version is None else version
    if v is None:
        return None
    return spark.read.parquet(f"{base.rstrip('/')}/{SNAPSHOT_PREFIX}{v}")


def append_results(results: DataFrame, path: str, partition: str = "batch_id") -> None:
    """Append results partitioned by batch; rerunning a batch replaces only
    its own partition (dynamic overwrite), so the sink is idempotent."""
    (results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def results_to_json(results: DataFrame) -> DataFrame:
    """Nested result rows as JSON text (non-ASCII kept)."""
    return results.select(F.to_json(F.struct("company", "title", "url", "location", "analysis")).alias("json"))


def write_results(results: DataFrame, path: str, *order: str) -> None:
    """Replace a result history of JSON lines, in gzip files sorted by ``order``.

    A record holds its offer's fields in full. Sorted by offer, the records of an offer
    stand next to each other, where gzip holds what they share about once. A plan that
    ends in a merge join on ``order`` has its rows so and is not sorted again."""
    rows = results.sortWithinPartitions(*order) if order else results
    (results_to_json(rows).write.mode("overwrite").option("compression", "gzip")
     .option("maxRecordsPerFile", RESULTS_PER_FILE).text(path))


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text, one folder per search, lines in order: range
    partitioning on (profile_id, ord) keeps the order across part files."""
    (lines.repartitionByRange("profile_id", "ord").sortWithinPartitions("profile_id", "ord")
     .select("profile_id", "html").write.mode("overwrite").partitionBy("profile_id").text(path))
