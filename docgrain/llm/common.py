"""Shared plumbing: shared storage, checkpoints, exact distributed positions."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ship import ensure_shipped

#: ASCII white space as the contracts define it, and a run of anything else (a word).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: they hold whole texts, and a task has a batch or two in memory.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Makes a session fit for whole texts: the package reaches the executors, and Arrow batches are short."""
    ensure_shipped(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


_model: list = [None, None]


def worker_model(key, make):
    """The model that ``key`` names, made once per worker. A worker has one at a time: workers live on from
    stage to stage, and what an earlier stage needed mustn't stay with them."""
    if _model[0] != key:
        _model[:] = [None, None]
        release_memory()
        _model[:] = [key, make()]
    return _model[1]


def release_memory() -> None:
    """Gives memory that isn't in use any more back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Only in a local session that leaves it unset, as in
    tests, a temporary folder is made, set as the checkpoint folder, and removed at exit.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="docgrain-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name for files of ``what`` below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/docgrain-{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there; its lineage ends."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a small table that is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000


def small_or_not(df: DataFrame) -> DataFrame:
    """``df``, written once, counted, and marked for broadcast only if it is small."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: A key that holds more than this part of all rows is hot: there are fewer than this many such keys.
HOT = 1000


def named_rows(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``key`` and the number of its rows in ``count``.

    Rows of hot keys meet their row of ``table`` by a broadcast of at most HOT rows, so that no task
    gets them all; the others by a join on the key.
    """
    table = checkpointed(table)
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(count) * HOT > total).drop(count))
    cold = table.where(F.col(count) * HOT <= total).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null.

    Where single spaces and line breaks are all the white space there is, inside the text and one at
    a time, words are counted by their bytes; a pattern counts them in any other text.
    """
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    rare = F.contains(plain, F.lit("  ")) | F.startswith(plain, F.lit(" ")) | F.endswith(plain, F.lit(" "))
    for c in "\t\x0b\f\r":
        rare = rare | F.contains(text, F.lit(c))
    spaces = F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit("")))
    count = F.when(text == "", 0).when(rare, F.regexp_count(text, F.lit(WORD))).otherwise(spaces + 1)
    return F.coalesce(count, F.lit(0)).cast("long")


def with_position(
    df: DataFrame,
    group: list[str],
    order: list[str],
    key: Column,
    out: str,
    buckets: int = 256,
    bucket: Column | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``df`` with ``out``: the 0-based place (long) of each row among the rows of its ``group``.

    Rows stand in order of the columns ``order``, rows that agree on these in order of a hash of
    ``key`` and then of ``key``. No task ever holds a whole group: each (group, order value) is dealt
    over ``buckets`` hash buckets (or those of the column ``bucket``), rows are numbered within a bucket, and a bucket's start comes
    from a prefix sum over bucket counts, itself in two levels. ``df`` is evaluated twice (once with
    only the columns ``group``, ``order`` and ``key``), so it must be deterministic; a caller that has
    the rows by group, order and bucket passes these ``counts`` (columns ``__bucket``, ``__count``).
    ``group`` and ``order`` must not hold nulls; repeated rows get places of their own.
    """
    b, n, before, start = "__bucket", "__count", "__before", "__start"
    k = "__key"
    hashed = F.pmod(F.xxhash64(F.col(k), F.lit(17)), F.lit(buckets)).cast("int")
    df = df.withColumn(k, key).withColumn(b, hashed if bucket is None else bucket)
    fine = [*group, *order, b]
    if counts is None:
        counts = df.groupBy(*fine).agg(F.count(F.lit(1)).alias(n))
    starts = counts.withColumn(
        before, F.sum(n).over(Window.partitionBy(*group, *order).orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn(before, F.coalesce(before, F.lit(0)))
    if order:
        coarse = counts.groupBy(*group, *order).agg(F.sum(n).alias(n))
        coarse = coarse.withColumn(
            start, F.sum(n).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        ).withColumn(start, F.coalesce(start, F.lit(0)))
        coarse = coarse.select(*[F.col(c).alias(f"__c_{c}") for c in [*group, *order]], start)
        on = [F.col(c) == F.col(f"__c_{c}") for c in [*group, *order]]
        starts = starts.join(coarse, on, "inner").withColumn(before, F.col(before) + F.col(start))
    starts = starts.select(*[F.col(c).alias(f"__s_{c}") for c in fine], before)
    local = F.row_number().over(Window.partitionBy(*fine).orderBy(k)) - 1
    numbered = df.withColumn(out, local)
    on = [F.col(c) == F.col(f"__s_{c}") for c in fine]
    joined = numbered.join(starts, on, "inner")
    return joined.withColumn(out, F.col(out) + F.col(before)).drop(k, b, before, *[f"__s_{c}" for c in fine])
