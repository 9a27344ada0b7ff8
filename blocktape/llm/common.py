"""Shared helpers of the training-data operators: tables, written stages, bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20  # of one Arrow batch at most
BITMAP_BITS = 32768  # bits of one bitmap of Spark's bitmap functions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one is set only where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="blocktape-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def read_back(spark: SparkSession, path: str, schema) -> DataFrame:
    """What was written to a stage's folder, which is deleted when the driver ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back: it is computed once, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return read_back(df.sparkSession, path, df.schema)


def written_parts(frames: Iterable[DataFrame]) -> DataFrame:
    """All frames, of one schema, written one after another and read as one."""
    path = None
    for df in frames:
        path = path or f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return read_back(df.sparkSession, path, df.schema)


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow with batches that are bounded in bytes, for texts may be long; the session keeps that setting."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), BATCH_ROWS)))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.  lower() is the same, and faster, where all is ASCII."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(
        F.translate(whole, ASCII_UPPER, ASCII_UPPER.lower())
    )


def bit_of(key: Column, bits: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits).cast("long"))


def bitmaps(slots: DataFrame, column: str, *by: str) -> DataFrame:
    """(bucket, bitmap) rows of a bit set from a column of bit numbers: at most bits / 32768 rows of 4 KB; with ``by``, of a set for each of its values."""
    bucket = F.floor(F.col(column) / BITMAP_BITS).cast("long")
    return slots.groupBy(*by, bucket.alias("__bt_bucket")).agg(
        F.bitmap_construct_agg(F.pmod(F.col(column), F.lit(BITMAP_BITS).cast("long"))).alias("__bt_bitmap")
    )


def keep_marked(df: DataFrame, slot: Column, marks: DataFrame, into: str | None = None) -> DataFrame:
    """Rows whose bit is set in ``marks``; with ``into``, all rows and the test's result in that column.

    ``marks`` is bounded by the number of bits that its maker chose, so it is broadcast.
    """
    at = df.withColumn("__bt_slot", slot).withColumn("__bt_bucket", F.floor(F.col("__bt_slot") / BITMAP_BITS).cast("long"))
    how = "left" if into else "inner"
    out = at.join(F.broadcast(marks), "__bt_bucket", how)
    test = F.expr(
        "coalesce((shiftright(cast(conv(hex(substring(__bt_bitmap, cast(floor((__bt_slot % 32768) / 8) as int) + 1, 1)), 16, 10) as int),"
        " cast(__bt_slot % 8 as int)) & 1) = 1, false)"
    )
    out = out.withColumn(into, test) if into else out.filter(test)
    return out.drop("__bt_slot", "__bt_bucket", "__bt_bitmap")


def fresh(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Only these columns, so that others cannot clash with an operator's own: each name as it is, each key from the column it names.

    A missing column is a ValueError.
    """
    sources = {n: n for n in names} | renamed
    if missing := [c for c in sources.values() if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in sources.items()])
