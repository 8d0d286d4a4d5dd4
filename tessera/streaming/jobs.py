"""Incremental jobs: the audit stream, action counts, scoring of new submissions. Lockouts are in ``lockout``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import similarity
from tessera.scratch import Scratch
from tessera.sources.io import access_to_audit

def audit_stream(access_log: DataFrame, trusted: list[str], path: str, checkpoint: str):
    """Appends the audit rows of an access log stream to a folder."""
    return access_to_audit(access_log, trusted).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def action_counts(audit: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Audit rows by action and tumbling window, for batch tables and streams."""
    return audit.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "action", "n")


def score_new(submissions: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, late: str = "1 day"):
    """Scores each new submission once: repeated contents within the watermark and documents that came before are left out.

    Which documents came before is state by key, so no micro-batch reads what was written. A micro-batch writes the folder of its own
    number, also when it runs again after a failure.
    """

    def run(rows: DataFrame, number: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{out}/epoch={number}")

    hashed = submissions.withColumn("content_hash", F.sha2("text", 256)).withWatermark("ts", late)
    new = hashed.dropDuplicatesWithinWatermark(["batch", "content_hash"]).dropDuplicates(["batch", "doc"])
    return new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


BANDS = "batch string, doc long, band int, key long, epoch int, slot int"
SIGNATURES = "batch string, doc long, whole long, epoch int, slot int"


class BandIndex:
    """Signature bands of all submissions so far, as tables by micro-batch and slot of the key; what comes is compared with itself and with them.

    Of equal signatures the first document stands for all, each other is paired with it. A micro-batch reads the slots of its own keys in the
    micro-batches before it and writes the folders of its own number, so one that runs again does the same again.
    """

    def __init__(self, spark: SparkSession, folder: str, *, bands: int = 32, rows: int = 4, slots: int = 16):
        self.spark, self.folder, self.bands, self.rows, self.slots = spark, folder.rstrip("/"), bands, rows, slots

    def _slot(self, key: str) -> Column:
        return F.pmod(F.col(key), F.lit(self.slots)).cast("int").alias("slot")

    def _before(self, name: str, schema: str, epoch: int, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        mine = [r["slot"] for r in rows.select("slot").distinct().collect()]  # at most ``slots``
        return self.spark.read.schema(schema).parquet(path).where((F.col("epoch") < epoch) & F.col("slot").isin(mine))

    def add(self, rows: DataFrame, epoch: int) -> DataFrame:
        """(batch, a, b) of the new rows (batch, doc, text) with one another and with all before; the index then has them."""
        scratch = Scratch(self.spark, "epoch")
        signed = similarity.minhash_signatures(rows.where("text is not null").select("batch", "doc", "text"), self.bands * self.rows)
        signed = signed.withColumn("whole", F.xxhash64("signature"))
        signed = scratch.save(signed.select("*", self._slot("whole")))
        own = signed.groupBy("batch", "whole").agg(F.min("doc").alias("first"))
        old = self._before("signatures", SIGNATURES, epoch, signed).select("batch", "whole", F.col("doc").alias("old"))
        placed = scratch.save(signed.join(own, ["batch", "whole"]).join(old, ["batch", "whole"], "left").withColumn("stands", F.coalesce("old", "first")))
        copies = placed.where("doc != stands").select("batch", F.least("doc", "stands").alias("a"), F.greatest("doc", "stands").alias("b"))
        new = placed.where("old is null and doc = first")
        key = lambda i: F.xxhash64(F.slice("signature", i * self.rows + 1, F.lit(self.rows)))
        band = F.transform(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda i: F.struct(i.alias("band"), key(i).alias("key")))
        keyed = new.select("batch", "doc", F.explode(band).alias("x")).select("batch", "doc", "x.band", "x.key")
        keyed = scratch.save(keyed.select("*", self._slot("key")))
        at = ["batch", "band", "key"]
        mine = keyed.select(*at, F.col("doc").alias("n"))
        among = mine.join(keyed.select(*at, F.col("doc").alias("m")), at).where("n < m")
        older = mine.join(self._before("bands", BANDS, epoch, keyed).select(*at, F.col("doc").alias("m")), at)
        pairs = among.unionByName(older).select("batch", F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b")).distinct().unionByName(copies)
        path = f"{self.folder}/pairs/epoch={epoch}"
        pairs.write.mode("overwrite").parquet(path)
        for name, table in (("signatures", new.select("batch", "doc", "whole", "slot")), ("bands", keyed)):
            table.write.mode("overwrite").partitionBy("slot").parquet(f"{self.folder}/{name}/epoch={epoch}")
        scratch.keep()
        return self.spark.read.schema(pairs.schema).parquet(path)

    def pairs(self) -> DataFrame:
        """All pairs found so far."""
        return self.spark.read.schema("batch string, a long, b long, epoch int").parquet(f"{self.folder}/pairs").drop("epoch")


def compare_new(submissions: DataFrame, index: BandIndex, checkpoint: str):
    """Compares each new submission of a stream (batch, doc, text) with one another and with all that came before; a document that comes again is left out."""
    new = submissions.select("batch", "doc", "text").dropDuplicates(["batch", "doc"])
    return new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: index.add(rows, number) and None)
