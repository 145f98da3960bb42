"""Exact dedup as a stateful stream (op 8).

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``. A stream of (digest, size, id, locator) is
aggregated by digest into state kept on disk (RocksDB), without watermark, so without expiry: for each digest the best
document so far (most code points, then smallest id), the locator of its content (the file it was read from, and the md5
of its text as it stands) and the number of documents. Every micro-batch aggregates before it shuffles, so that a group
of copies with a third of all rows sends one row for each task; the updated states of a batch are written, and the
latest of each digest counts. There are about ``BATCHES`` micro-batches, of ``LEAST_BATCH`` bytes at least.

Hits, which are digests met twice or more, are checked against full bytes: their documents are grouped by digest *and*
normalised text, again with a first aggregation in place; if a digest should stand for several texts, its documents are
classed by the texts themselves. Documents met once take no part in the check, and adaptive execution splits hot digests.

Cases. Null counts as empty; all empty texts are equal. Of equal texts and sizes the smallest id stays, a null id is
the largest; ``dedup`` marks all rows that repeat the kept id as kept, ``one_of_each`` returns exactly one row. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, exists, keep_aside, materialize, one_row_each, partitions, shared_dir, skew_join, source_bytes, text_md5

BATCHES, LEAST_BATCH = 8, 64 << 20
#: Digests with several documents that may be broadcast (64 characters each); more are joined by a shuffle.
BROADCAST = 100_000
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "spark.sql.streaming.stateStore."
_TOP = "struct<size: bigint, has_id: boolean, less: bigint, doc_id: bigint, md5: string, locator: string>"


def normalised(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=lambda text: F.sha2(text, 256), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size in code points, sha256 of the normalised text, the digest that keys the state, md5 of the text, locator."""
    own = normalised(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("size"), F.sha2(own, 256).alias("text_sha256"), digest(own).alias("digest"), text_md5(F.col(text_col)).alias("md5"), F.input_file_name().alias("locator"), *carry)


def best() -> list[Column]:
    """Of a group: the document that stays, and the group's size. The largest of (size, -id) decides; a null id comes last."""
    rank = F.struct("size", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("less"), "doc_id", "md5", "locator")
    return [F.max(rank).alias("top"), F.count("*").alias("group_size")]


class StreamingDedup:
    """State of all digests seen; ``run`` takes in what has come to the stream's source since the last run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.spark = folder, spark.newSession()
        self.spark.conf.set("spark.sql.shuffle.partitions", partitions(spark))
        self.spark.conf.set(_STATE + "providerClass", _PROVIDER)
        # a batch writes what it changed; whole states now and then
        self.spark.conf.set(_STATE + "rocksdb.changelogCheckpointing.enabled", "true")
        # many small stores: no files of megabytes set aside in each
        self.spark.conf.set(_STATE + "rocksdb.allowFAllocate", "false")
        self.spark.conf.set(_STATE + "rocksdb.boundedMemoryUsage", "true")
        self.spark.conf.set(_STATE + "rocksdb.maxMemoryUsageMB", "256")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    def run(self, source: str, schema, bytes_per_batch: int) -> None:
        """Batches of about so many bytes of files, so that their number follows the input and not how it is cut."""
        stream = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(source)
        state = stream.groupBy("digest").agg(*best())

        def write(batch: DataFrame, number: int) -> None:
            # overwritten if the batch is run again
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/updates/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def classes(self, spark: SparkSession) -> DataFrame:
        """digest, keep_id, keep_md5, keep_locator, group_size: the latest state of each digest."""
        schema = f"digest string, top {_TOP}, group_size long, batch long"
        if not exists(spark, f"{self.folder}/updates"):  # no batch: no rows
            updates = spark.createDataFrame([], schema)
        else:
            updates = spark.read.schema(schema).parquet(f"{self.folder}/updates/*")
        last = updates.groupBy("digest").agg(F.max(F.struct("batch", "top", "group_size")).alias("u"))
        return last.select("digest", F.col("u.top.doc_id").alias("keep_id"), F.col("u.top.md5").alias("keep_md5"), F.col("u.top.locator").alias("keep_locator"), F.col("u.group_size").alias("group_size"))


def _classed(docs: DataFrame, id_col: str, text_col: str, digest, bytes_per_batch: int | None, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, keep_id, keep_md5, keep_locator, group_size, text_sha256, md5, carried columns."""
    spark, names, carry = docs.sparkSession, carry, tuple(f"_c{i}" for i in range(len(carry)))  # free of clashes
    docs, id_col, text_col = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(names, carry, strict=True)]), "doc_id", "text"
    folder = f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    keep_aside(spark, folder)
    narrow = digests(docs, id_col, text_col, digest, carry)
    narrow.write.parquet(f"{folder}/digests")
    own = spark.read.schema(narrow.schema).parquet(f"{folder}/digests")
    state = StreamingDedup(spark, folder)
    state.run(f"{folder}/digests", narrow.schema, bytes_per_batch or max(LEAST_BATCH, source_bytes(own) // BATCHES))
    several = materialize(state.classes(spark).filter("group_size > 1"))
    # full bytes, on hits
    some = several.select("digest")
    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(normalised(F.col(text_col))).alias("digest"), normalised(F.col(text_col)).alias("t"))
    hits = full.join(F.broadcast(some), "digest", "left_semi") if some.count() <= BROADCAST else full.join(some, "digest")
    mixed = materialize(hits.groupBy("digest", "t").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("n_texts")).filter("n_texts > 1").select("digest"))
    out = ["doc_id", "keep_id", "keep_md5", "keep_locator", "group_size", "text_sha256", "md5", *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)]]
    if mixed.isEmpty():
        found = own.join(several, "digest", "left")
        return _or_itself(found).select(*out)
    # a digest of several texts: its documents are told apart by the texts themselves
    odd = materialize(skew_join(digests(docs.withColumn("_t", normalised(F.col(text_col))), id_col, text_col, digest, (*carry, "_t")), mixed, ("digest",)))
    by_text = odd.groupBy("digest", "_t").agg(*best()).select("digest", "_t", F.col("top.doc_id").alias("keep_id"), F.col("top.md5").alias("keep_md5"), F.col("top.locator").alias("keep_locator"), "group_size")
    plain = own.join(mixed, "digest", "left_anti")
    return _or_itself(plain.join(several, "digest", "left")).select(*out).unionByName(skew_join(odd, by_text, ("digest", "_t")).select(*out))


def _or_itself(found: DataFrame) -> DataFrame:
    """A document met once is its own class."""
    once = F.col("group_size").isNull()
    return found.withColumns({k: F.when(once, F.col(own)).otherwise(F.col(k)) for k, own in (("keep_id", "doc_id"), ("keep_md5", "md5"), ("keep_locator", "locator"))}).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=lambda text: F.sha2(text, 256), bytes_per_batch: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, keep_locator, group_size, kept, text_sha256 and the carried columns; one row for each row of docs."""
    found = _classed(docs, id_col, text_col, digest, bytes_per_batch, carry)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "keep_locator", "group_size", "kept", "text_sha256", *carry)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every class of equal texts exactly one row of docs, with its columns: the one that stays."""
    found = _classed(docs, id_col, text_col, lambda text: F.sha2(text, 256), None, ())
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("md5") == F.col("keep_md5"))).groupBy("doc_id", "md5").agg(F.count("*").alias("n"))
    return one_row_each(docs, chosen, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("keep_locator")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""
