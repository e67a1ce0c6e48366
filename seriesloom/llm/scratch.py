"""Scratch tables in the folder that all executors share, and skew-safe running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import spare

_own: dict[str, str] = {}
_open: list[list[DataFrame]] = []
_earlier: list[DataFrame] = []
#: Rows of a sieve's table at most: about 8 MB on each executor.
SIEVE = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="seriesloom-"))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seriesloom/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for made in _open:
        made.append(out)
    return out


@contextmanager
def scope() -> Iterator[None]:
    """At its end the tables saved within are deleted: what was made of them must have been written by then."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.pop(next(k for k, x in enumerate(_open) if x is made))
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`save` that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def stage(docs: DataFrame) -> Iterator[None]:
    """What earlier stages saved is deleted at the beginning, but for what ``docs`` still reads; what is saved within is for the next stage to delete."""
    files = "\n".join(docs.inputFiles())
    for t in list(_earlier):
        if t._scratch_path.rpartition("/")[2] not in files:
            discard(t)
            _earlier[:] = [x for x in _earlier if x is not t]
    _open.append(_earlier)
    try:
        yield
    finally:
        _open.pop(next(k for k, x in enumerate(_open) if x is _earlier))


def sieved(df: DataFrame, key: str, among: DataFrame, out: str) -> DataFrame:
    """Add ``out``: false for rows whose key is not in the column ``key`` of ``among``; true for the others and for a few more.

    A bit for each of 64 * SIEVE hashes, as a table of at most SIEVE rows, which
    is broadcast: what is false needs no join.  The more keys, the more rows are
    true; a join of those is exact at any size.
    """
    at, block, bits = spare(df, "__at", "__block", "__bits")
    spot = F.pmod(F.xxhash64(F.lit("sieve"), F.col(key)), F.lit(64 * SIEVE))
    marks = among.select(spot.alias("at")).groupBy(F.shiftright("at", 6).alias(block)).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias(bits))
    marks = save(marks, "sieve")
    joined = df.withColumn(at, spot).withColumn(block, F.shiftright(at, 6)).join(F.broadcast(marks), block, "left")
    hit = F.call_function("shiftright", F.col(bits), F.col(at).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop(at, block, bits)


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to each row (ties included) within ``keys`` in the order (bucket, *order).

    ``bucket`` must not decrease along the order.  Only the rows of one
    (keys, bucket) meet in a task; the bucket sums are added up apart, so a key
    with a third of all rows is spread over its buckets.  ``df`` is read twice:
    pass a saved table.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(bucket).alias("__bucket"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.col(bucket).eqNullSafe(F.col("__bucket"))
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.withColumn("__within", F.sum(value).over(within)).join(sums, on).withColumn(out, F.col("__within") + F.col("__before")).drop("__within", "__before", "__bucket", *[f"__{k}" for k in keys])
