"""Series from stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.meta import Interval, SeriesFrame, quoted


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_series(df: DataFrame, key: Sequence[str], index: str, interval: Interval = Interval(), check: bool = True) -> SeriesFrame:
    """A series table; (key, index) must identify each row."""
    out = SeriesFrame(df, tuple(key), index, interval)
    return out.check() if check else out


def orders_monthly(spark: SparkSession, folder: str) -> SeriesFrame:
    """Monthly order totals by region, nation and market segment."""
    months = F.trunc(F.col("o_orderdate").cast("date"), "month")
    orders = read_table(spark, folder, "orders").select("o_custkey", months.alias("month"), "o_totalprice")
    places = read_table(spark, folder, "nation").join(read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    who = read_table(spark, folder, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "region", "nation", F.col("c_mktsegment").alias("segment"))
    joined = orders.join(who, F.col("o_custkey") == F.col("c_custkey"))
    return SeriesFrame(joined.select("region", "nation", "segment", "month", F.col("o_totalprice").alias("price")), ("region", "nation", "segment"), "month", Interval("month"))


def events_daily(spark: SparkSession, folder: str) -> SeriesFrame:
    """Daily event values by event type: their sum, rounded to cents, and number."""
    day = F.col("ts").cast("date")
    out = read_table(spark, folder, "events").groupBy("event_type", day.alias("day")).agg(F.round(F.sum("value"), 2).alias("value"), F.count("*").alias("n"))
    return SeriesFrame(out, ("event_type",), "day", Interval("day"))


def write_table(frame: SeriesFrame | DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df = frame if isinstance(frame, DataFrame) else frame.df
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


__all__ = ["as_series", "events_daily", "orders_monthly", "quoted", "read_table", "write_table"]
