"""What the operators of this package share: the shared folder, Arrow batch sizes, table reading."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper-case and lower-case ASCII letters, for translate(): only these are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Functions get Arrow batches of some so many bytes, so that what they make of one fits beside a second worker.
ARROW_BYTES = 4 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (tests, one machine) a temporary folder is made, once per session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


class _Open(threading.local):
    def __init__(self) -> None:
        self.scopes: list[list[str]] = []


_OPEN = _Open()
#: Tables outside of any scope: results that are read after their operator has ended. They go with the driver.
_LEFT: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_left() -> None:
    while _LEFT:
        with suppress(Exception):  # the session may have ended before
            _delete(*_LEFT.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; what goes on must be kept()."""
    _OPEN.scopes.append([])
    try:
        yield
    finally:
        for path in _OPEN.scopes.pop():
            _delete(spark, path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut and every later read sees the same rows."""
    return _written(df, tag, -1)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """written(), for the scope around the innermost scratch()."""
    return _written(df, tag, -2)


def _written(df: DataFrame, tag: str, scope: int) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, tag)
    if len(_OPEN.scopes) >= -scope:
        _OPEN.scopes[scope].append(path)
    else:
        _LEFT.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Deletes a table made by written(), once nothing reads it any more."""
    root = shared_folder(df.sparkSession).replace("file:", "").lstrip("/")
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.replace("file:", "").lstrip("/").startswith(root):
            _delete(df.sparkSession, path)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * ARROW_BYTES // max(batch.nbytes, ARROW_BYTES))
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def _give_back() -> None:
    """Memory that was freed goes back to the system: workers wait for the next task beside those at work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker holds ready from one task to the next: by name, its key and what was made.
_READY: dict[str, tuple[Hashable, Any]] = {}


def ready(name: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """make(), held ready in this worker under name until another key comes, or a task of mapped() that doesn't ask for name."""
    if name not in _READY or _READY[name][0] != key:
        _READY.pop(name, None)
        _READY[name] = key, make()
    return _READY[name][1]


def _let_go(names: tuple[str, ...]) -> None:
    """Workers outlive stages and queries: what earlier ones held ready under other names goes."""
    if others := _READY.keys() - set(names):
        for name in others:
            del _READY[name]
        _give_back()


#: Arrow settings that an application should give its session: Spark's own batches of 64 MB stand several times beside each worker.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "20000", "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}


def configured(query: Callable) -> Callable:
    """A query or stage (spark, ...) of this application: SETTINGS that the session doesn't have yet are set. Operators never set any."""

    @wraps(query)
    def run(spark: SparkSession, *more):
        for key, value in SETTINGS.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
        return query(spark, *more)

    return run


def mapped(df: DataFrame, rows: Callable, schema: T.StructType | str, names: tuple[str, ...] = ()) -> DataFrame:
    """df.mapInArrow with batches cut to some ARROW_BYTES, or one row. Spark's own batches end at spark.sql.execution.arrow.maxBytesPerBatch.

    names: what rows has held ready().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(names)
        try:
            yield from rows(_sliced(batches))
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def ascii_lower(text: Column | str) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(F.col(text) if isinstance(text, str) else text, UPPER, LOWER)


def own_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame) -> DataFrame:
    """df, joined by sorting even where Spark would rather broadcast it: a broadcast by several columns takes a page of some 32 MB on each executor until the driver collects it."""
    return df.hint("merge")


#: Keys whose rows go to every executor at most, where one key may have a large part of all rows.
HOT_KEYS = 20_000


def joined_to_one(many: DataFrame, one: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Rows of many with the row of one that has their keys; one has each key once, and in the column rows how many rows of many have it.

    Keys with more than a HOT_KEYS-th of those, at most HOT_KEYS of them, go to every executor, so their rows stay where they are;
    all others are joined by a shuffle, in which no key has more. Both tables are read twice: they should be written ones.
    """
    total = own_name(one, "total")
    marked = one.crossJoin(F.broadcast(one.agg(F.sum(rows).alias(total))))
    hot = F.col(rows) * HOT_KEYS > F.col(total)
    names = [c for c in one.columns if c != rows]
    often, seldom = marked.where(hot).select(*names), marked.where(~hot).select(*names)
    near = many.join(F.broadcast(often), keys)
    far = many.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(small(seldom), keys)
    return near.unionByName(far)


#: Rows to drop whose numbers go to every executor, 8 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Paths of files that go to every executor, some 200 bytes each.
BROADCAST_FILES = 100_000


def number_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a column of numbers that tell its rows apart, the same each time it is read; and that column's name.

    Rows of Parquet files are numbered by file and place. Anything else is written out with its numbers.
    """
    uid, path = own_name(df, "row_uid"), own_name(df, "row_path")
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(uid))
    except AnalysisException:
        return written(df.withColumn(uid, F.monotonically_increasing_id()), "numbered"), uid
    files = placed.select(path).distinct().withColumn("file_no", F.row_number().over(Window.orderBy(path)).cast("long"))
    files = written(files, "files")
    most = files.count()
    if most == 1:
        return placed.drop(path), uid
    number = own_name(placed, "file_no")
    placed = placed.join(F.broadcast(files.withColumnRenamed("file_no", number)) if most <= BROADCAST_FILES else files.withColumnRenamed("file_no", number), path)
    return placed.withColumn(uid, F.col(number) * F.lit(1 << 40) + F.col(uid)).select(*df.columns, uid), uid


def without_rows(df: DataFrame, uid: str, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of df whose number isn't in dropped's only column."""
    dropped = dropped.toDF(uid)
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return df.join(dropped, uid, "left_anti").select(*columns)
