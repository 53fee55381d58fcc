"""Files in the folder that driver and executors share: where they go, one for each key, and when they end."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine (tests) a temporary folder, made once for a session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder; what is written there is deleted with the driver."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target))


@atexit.register
def _delete_left() -> None:
    while _LEFT:
        with suppress(Exception):  # the session may have ended before
            delete(*_LEFT.pop())


def write_texts(texts: DataFrame, path: str) -> None:
    """One text file for each row (file, text), in a folder named after the file.

    Spark's own commit makes them visible all at once; a task that is run anew leaves nothing twice. No text
    goes through the driver. A null text is an empty file; two rows of one file would give two files.
    """
    texts.select("file", F.coalesce("text", F.lit("")).alias("value")).write.option("lineSep", "\n").partitionBy("file").text(path)


#: Texts in a file of write_packed() at most.
PACKED = 2000


def write_packed(texts: DataFrame, path: str) -> None:
    """The rows (file, text) with many texts in a file: no directory, commit and listing for each, so that the cost is that of the text.

    For many small texts that are read back whole; a null text is an empty one.
    """
    texts.select("file", F.coalesce("text", F.lit("")).alias("text")).write.option("maxRecordsPerFile", PACKED).parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """file and text of what write_packed() wrote."""
    return spark.read.schema("file string, text string").parquet(path).withColumn("text", F.regexp_replace("text", r"\n\z", ""))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file and text of what write_texts() wrote."""
    out = spark.read.schema("value string, file string").text(path, wholetext=True)
    return out.select("file", F.regexp_replace("value", r"\n\z", "").alias("text"))
