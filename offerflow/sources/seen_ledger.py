"""Addresses seen so far, kept in hash buckets with a Bloom filter each.

An address belongs to a bucket by its hash; a commit writes one file per bucket
(``v=<n>/bucket=<b>``, sorted) and, beside it, that file's Bloom filter. A batch
asks the filters first, by an equality join of its addresses with their blocks. Only the bucket files whose filter answers are read, and joined
bucket by bucket with the batch's few candidates as the broadcast side, so the
ledger itself is never shuffled. Filters have false positives, which the join
sorts out, and no false negatives.

A null address is never seen. Many small commits are compacted into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import BLOCK_KEYS, bits_of, block_of, holds, probes
from .log_table import LogTable, Manifest

BUCKETS = 32
#: Commits that are asked one by one before they become one.
COMMITS = 8
#: Candidates of a bucket that are broadcast, at most; beyond, adaptive execution joins.
CANDIDATES = 100_000

SCHEMAS = {
    "urls": T.StructType([T.StructField("job_url", T.StringType()), T.StructField("bucket", T.IntegerType())]),
    "filters": T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()),
                             T.StructField("bits", T.BinaryType())]),
}


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


@dataclass
class Found:
    """The known addresses of a batch, and what was read to find them."""

    urls: DataFrame
    files_read: int
    files: int
    candidates: int


class SeenLedger:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.log = LogTable(spark, base, SCHEMAS)

    def _blocks(self, rows: int) -> int:
        """Blocks of each bucket's filter; buckets are about even."""
        return max(1, -(-rows // (self.buckets * BLOCK_KEYS)))

    def _write(self, n: int, urls: DataFrame) -> int:
        rows = urls.select("job_url", bucket_of(F.col("job_url"), self.buckets).alias("bucket"))
        count = self.log.put("urls", n, rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "job_url"), by="bucket")
        bits = bits_of(self.log.get("urls", [n]), "job_url", self._blocks(count), "bucket")
        self.log.put("filters", n, bits)
        return count

    def _publish(self, n: int, kept: dict[int, int], urls: DataFrame, info: dict) -> Manifest:
        count = self._write(n, urls)
        folders = {**kept, n: count} if count else kept
        return self.log.publish(Manifest(n, {"urls": folders, "filters": folders}, info))

    def add(self, urls: DataFrame, **info) -> Manifest:
        """Commit the addresses of ``urls`` that are not in the ledger yet."""
        m = self.log.manifest()
        new = urls.select("job_url").where("job_url is not null").distinct()
        if m is None:
            return self._publish(0, {}, new, info)
        new = new.join(self.find(new).urls, "job_url", "left_anti")
        out = self._publish(m.version + 1, m.rows("urls"), new, info)
        return self.compact() or out

    def compact(self, commits: int = COMMITS) -> Manifest | None:
        """All commits but a base more than twice as large as the others together become one."""
        m = self.log.manifest()
        sizes = m.rows("urls")
        if len(sizes) <= commits:
            return None
        base = min(sizes)
        kept = {base: sizes[base]} if sizes[base] > 2 * (sum(sizes.values()) - sizes[base]) else {}
        old = self.log.get("urls", [v for v in sizes if v not in kept]).select("job_url")
        return self._publish(m.version + 1, kept, old, m.info)

    def read(self) -> DataFrame:
        return self.log.get("urls", self.log.manifest().rows("urls")).select("job_url")

    def find(self, offers: DataFrame) -> Found:
        """The distinct addresses of ``offers`` that the ledger holds."""
        m = self.log.manifest()
        none = self.spark.createDataFrame([], "job_url string")
        if m is None or not m.rows("urls"):
            return Found(none, 0, 0, 0)
        url = F.col("job_url")
        asked = offers.select("job_url").where("job_url is not null").distinct().withColumn("bucket", bucket_of(url, self.buckets))
        commits = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(self._blocks(n)).cast("long").alias("blocks"))
                            for v, n in m.rows("urls").items()])
        asked = asked.select("*", F.inline(commits)).select("job_url", "bucket", "v", block_of(url, F.col("blocks")).alias("block"))
        answered = (asked.join(self.log.get("filters", m.rows("filters")), ["v", "bucket", "block"])
                    .where(holds(F.col("bits"), probes(url))).select("job_url", "v", "bucket").checkpoint(eager=True))
        hits = answered.groupBy("v", "bucket").count().collect()  # at most commits x buckets numbers
        out, read = none, 0
        by_bucket: dict[int, list] = {}
        for r in hits:
            by_bucket.setdefault(r["bucket"], []).append(r)
        groups: list[list[int]] = [[]]  # buckets together up to the bound
        size = 0
        for b, rows in sorted(by_bucket.items()):
            n = sum(r["count"] for r in rows)
            if size and size + n > CANDIDATES:
                groups.append([])
                size = 0
            groups[-1].append(b)
            size += n
        for group in filter(None, groups):
            mine = [r for b in group for r in by_bucket[b]]
            cands = answered.where(F.col("bucket").isin(group)).select("job_url").distinct()
            if sum(r["count"] for r in mine) <= CANDIDATES:
                cands = F.broadcast(cands)
            files = self.spark.read.schema(SCHEMAS["urls"]).option("basePath", f"{self.log.base}/urls").parquet(
                *[f"{self.log.base}/urls/v={r['v']}/bucket={r['bucket']}" for r in mine])
            read += len(files.inputFiles())
            out = out.unionByName(files.join(cands, "job_url", "left_semi").select("job_url"))
        every = len(self.log.get("urls", m.rows("urls")).inputFiles())
        return Found(out.distinct(), read, every, sum(r["count"] for r in hits))

    def new_offers(self, offers: DataFrame) -> DataFrame:
        """Offers whose address is not in the ledger (a null address stays)."""
        return offers.join(self.find(offers).urls, "job_url", "left_anti")

    def known_offers(self, offers: DataFrame) -> DataFrame:
        return offers.join(self.find(offers).urls, "job_url", "left_semi")
