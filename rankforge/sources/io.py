"""Readers, writers, sessions."""

from __future__ import annotations

import tempfile

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import Dataset


def session(name: str = "rankforge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master, as in tests, may do without one being set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as it is now, kept in the shared folder: what many later steps read is computed once, and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def read_csv(spark: SparkSession, path: str, data: Dataset) -> DataFrame:
    """Comma-separated, no header, no quoting, the declared schema."""
    return spark.read.schema(data.schema).option("header", "false").option("quote", "").option("sep", ",").csv(path)


def _numbers(record: DataFrame, data: Dataset) -> DataFrame:
    """record: a column ``x`` of hexadecimal digits, two for each signed byte."""

    def byte(i: int) -> Column:
        v = F.conv(F.substring("x", 2 * i + 1, 2), 16, 10).cast("int")
        return F.when(v > 127, v - 256).otherwise(v).cast("byte")

    return record.select(*[byte(i).alias(c) for i, c in enumerate([*data.feature_names, data.label])])


def unpack(contents: DataFrame, data: Dataset) -> DataFrame:
    """Records of signed bytes from whole contents (binary), each a multiple of the record length: cut by position, bytes by way of hex, all in the JVM."""
    n = data.features + 1
    whole = contents.filter(F.length("content") >= n).select("content", F.explode(F.sequence(F.lit(0), F.floor(F.length("content") / n) - 1)).alias("k"))
    return _numbers(whole.select(F.hex(F.expr(f"substring(content, cast(k * {n} + 1 as int), {n})")).alias("x")), data)


#: Bytes of a file that one task reads.
SPLIT = 64 << 20


def read_binary(spark: SparkSession, path: str, data: Dataset, split: int = SPLIT) -> DataFrame:
    """Fixed-length records of signed bytes. Files are split at record ends into parts of about ``split`` bytes; records stay in the JVM."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    conf = jvm.org.apache.hadoop.conf.Configuration(jsc.hadoopConfiguration())
    conf.set("mapreduce.input.fileinputformat.split.maxsize", str(max(split, data.features + 1)))
    records = jsc.sc().binaryRecords(path, data.features + 1, conf)
    frame = spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    return _numbers(DataFrame(frame, spark).select(F.hex(F.col("value")).alias("x")), data)


def read(spark: SparkSession, path: str, data: Dataset, partitions: int | None = None) -> DataFrame:
    df = read_binary(spark, path, data) if data.binary else read_csv(spark, path, data)
    return df.repartition(partitions) if partitions and partitions != df.rdd.getNumPartitions() else df


def balanced_partitions(default: int, executors: int, cores: int, local: bool = False) -> int:
    """default, rounded to a multiple of all slots; at least one."""
    slots = max(1, executors * cores)
    return default if local else max(1, round(default / slots) * slots)


def write_ranks(ranks: DataFrame, path: str, mode: str = "append") -> None:
    """ranks: name, ranking (array of feature indices). One line for each: the indices joined by commas."""
    ranks.orderBy("name").select(F.concat_ws(",", F.transform("ranking", lambda x: x.cast("string")))).coalesce(1).write.mode(mode).text(path)


def save_output(spark: SparkSession, path: str, data: bytes, append: bool = False) -> None:
    """One file of these bytes, through the file system that the path names; append adds to what is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    before = b""
    if append and fs.exists(target):  # read and written again, as not every file system appends; reports are small
        stream = fs.open(target)
        before = bytes(stream.readAllBytes())
        stream.close()
    out = fs.create(target, True)
    out.write(bytearray(before + data))
    out.close()


def log_time(spark: SparkSession, path: str, name: str, executors: int, minutes: float) -> None:
    row = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(name).alias("app"), F.lit(executors).alias("executors"), F.lit(float(minutes)).alias("minutes"))
    row.write.mode("append").csv(path)


def save_discretiser(model: Bucketizer, folder: str, name: str) -> None:
    model.write().overwrite().save(f"{folder}/{name}.parquet")


def load_discretiser(folder: str, name: str) -> Bucketizer:
    return Bucketizer.load(f"{folder}/{name}.parquet")
