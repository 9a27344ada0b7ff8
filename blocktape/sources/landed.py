"""Landed tables that answer a question from few files: partitioned by pool and stretch, or bucketed by a key.

A stretch is a span of blocks or seconds.  A filter on the pool or on the span becomes a filter on
partitions, and what remains of it is pushed into the files, whose rows are in order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blocktape.sources.sinks import shared_folder

MOST_STRETCHES = 1_000_000  # pairs of pool and stretch that are sent to all tasks, 32 MB at most
LEAST_ROWS = 100_000  # that a stretch has on average, where spans follow the rows
HOT_ROWS = 1_000_000  # rows of one key from which it is joined apart
MOST_HOT = 100_000


def stretch(of: Column, span: int | Column) -> Column:
    return F.floor(of / F.lit(span)).cast("long")


def spans(df: DataFrame, by: str, span: int, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(pool, span): a multiple of ``span`` for each pool, such that it has no more stretches than its rows fill with ``least_rows``, and one or two beyond.

    A pool of few rows at far apart blocks would make a folder of each.
    """
    wide = F.max(by) - F.min(by) + 1
    stretches = F.ceil(F.count(F.lit(1)) / least_rows)
    return df.groupBy("pool").agg((span * F.greatest(F.ceil(wide / (stretches * span)), F.lit(1))).cast("long").alias("span"))


def with_span(df: DataFrame, of: DataFrame, span: int) -> DataFrame:
    """df with the span of its pool; the given one where the pool has none."""
    return df.join(of, "pool", "left").withColumn("span", F.coalesce("span", F.lit(span)))


def land(df: DataFrame, path: str, by: str, span: int | Column) -> None:
    """Writes df by pool and stretch of ``by``.  Files of one size: small stretches share a task and a large one is split; partitions that are in df are replaced."""
    rows = df.withColumn("stretch", stretch(F.col(by), span)).hint("rebalance", "pool", "stretch")
    rows.sortWithinPartitions("pool", "stretch", by).write.partitionBy("pool", "stretch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_landed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The landed table of rows of this schema: types of partitions are told, not guessed from their names."""
    plain = StructType([f for f in schema if f.name not in ("pool", "stretch")])
    return spark.read.schema(plain.add("pool", "string").add("stretch", "long")).parquet(path)


def window(table: DataFrame, by: str, span: int, low: int, high: int, pool: str | None = None, after_id: str | None = None) -> DataFrame:
    """Rows of a time or block range, both ends included, of one pool and past an id: whole partitions are left out, and the rest is filtered in the files."""
    rows = table.filter(F.col("stretch").between(low // span, high // span) & F.col(by).between(low, high))
    rows = rows.filter(F.col("pool") == pool) if pool is not None else rows
    rows = rows.filter(F.col("id") > after_id) if after_id is not None else rows
    return rows.drop("stretch")


def wanted_stretches(events: DataFrame, lacking: Column, span: int | Column) -> DataFrame:
    """(pool, stretch, rows) with rows that lack something."""
    return events.filter(lacking).groupBy("pool", stretch(F.col("block_number"), span).alias("stretch")).agg(F.count(F.lit(1)).alias("rows"))


def of_stretches(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted (pool, stretch) only: the list is made first, and other partitions are never opened.  A list beyond MOST_STRETCHES is joined without being sent."""
    few = wanted.count() <= MOST_STRETCHES
    keys = wanted.filter("rows > 0").select("pool", "stretch")
    return table.join(F.broadcast(keys) if few else keys, ["pool", "stretch"]).drop("stretch")


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table whose files are dealt by the key: tables of as many buckets are joined without an exchange."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark, 'bucketed')}/rows").saveAsTable(name)
    return spark.table(name)


def join_buckets(events: DataFrame, lookup: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """events left join lookup (one row per key), both bucketed by the key: bucket meets bucket.

    Rows of a key with more than ``hot_rows`` rows stay where they are, in tasks that split its bucket's files, and
    the few rows of the lookup come to them.
    """
    hot = events.groupBy(key).count().filter(F.col("count") > hot_rows).select(key)  # no exchange: a key is in one bucket
    n = hot.count()
    if n > MOST_HOT:
        raise ValueError(f"{n} keys of more than {hot_rows} rows")
    if not n:
        return events.hint("merge").join(lookup, key, "left")
    keys = F.broadcast(hot)  # checked
    cold = events.join(keys, key, "left_anti").hint("merge").join(lookup, key, "left")
    return cold.unionByName(events.join(keys, key, "left_semi").join(F.broadcast(lookup.join(keys, key, "left_semi")), key, "left"))
