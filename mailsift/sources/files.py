"""Readers for messages of one's own and writers for results."""

from pyspark.sql import functions as F

TASK_BYTES, SMALL_BYTES = 256 * 1024, 1 << 30


def read_eml(spark, path, glob="*.eml"):
    """One message per file that is not empty; the id is a hash of the path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.xxhash64(F.col("_metadata.file_path")).alias("msg_id"), F.col("value").alias("raw"))


def eml_stream(spark, path, glob="*.eml", files_per_batch=None):
    """Message files as they arrive, whole, with the ids that ``read_eml`` gives and the time of the file as ``ts``."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    return stream.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("msg_id"), F.col("_metadata.file_modification_time").alias("ts"),
        F.col("value").alias("raw"))


def read_table(spark, path, id_column, text_column, fmt="parquet"):
    """Messages of any columnar or JSON source."""
    return spark.read.format(fmt).load(path).select(
        F.col(id_column).cast("bigint").alias("msg_id"), F.col(text_column).cast("string").alias("raw"))


def spread(df, key, task_bytes=TASK_BYTES):
    """Deal a small input over many tasks by a hash of its key; a large one is left where it lies.

    The analysis costs far more than the reading, and a small file is often one row group, which
    cannot be split. From a gigabyte on, files have row groups enough and texts are not shuffled. The
    rule looks at the bytes of the files only, neither at splits nor at cores.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size > SMALL_BYTES else df.repartition(max(1, -(-size // task_bytes)), key)


def write_reports(reports, path):
    """JSON lines by band, compressed: every line is the report of a message with its ``msg_id`` in front.

    Reports repeat the titles, reasons and advice of rules, so gzip takes them to a small part of their size.
    """
    line = F.concat(F.lit('{"msg_id":'), F.col("msg_id").cast("string"), F.lit(","), F.expr("substring(report, 2)"))
    reports.select("band", line.alias("value")).write.mode("overwrite").partitionBy("band").text(path, compression="gzip")


def read_reports(spark, path):
    """(msg_id, band, report) of written reports; a filter on the band skips the files of the others."""
    return spark.read.schema("value string, band string").text(path).select(
        F.get_json_object("value", "$.msg_id").cast("bigint").alias("msg_id"), "band", F.col("value").alias("report"))


def write_partitioned(df, path, fmt="parquet", by="band"):
    """Results by band, so that a reader of one band skips the others."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).save(path)
