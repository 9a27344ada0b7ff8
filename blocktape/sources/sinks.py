"""Writers of event logs, detections and reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def to_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema in its order and types; missing ones are NULL, others go."""
    empty = df.sparkSession.createDataFrame([], schema)
    return empty.unionByName(df.select(*[c for c in df.columns if c in schema.names]), allowMissingColumns=True).select(*schema.names)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, which all machines see, deleted when the driver ends; a local one is set only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="blocktape-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(hadoop)
    system.mkdirs(folder)  # only what is there can be marked
    system.deleteOnExit(folder)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Compute df once: written into the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession, 'table')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_together(*frames: DataFrame) -> list[DataFrame]:
    """Each frame staged, as jobs that run at the same time: small ones leave cores idle one after another."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(staged, frames))


def append(df: DataFrame, path: str, schema: StructType) -> None:
    to_schema(df, schema).write.mode("append").parquet(path)


def save_by_fee(df: DataFrame, path: str) -> None:
    """One folder per fee tier; only tiers that are in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fee_bps").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialized(spark: SparkSession, path: str, make: Callable[[], DataFrame], recompute: bool = False) -> DataFrame:
    """The table at path, made first if it is missing or is to be made anew."""
    if recompute or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fresh_version(spark: SparkSession, path: str, resume: bool) -> str:
    """The folder to write to: path/v<n>.  A fresh start takes the next number; resuming needs one that exists."""
    n = 0
    while exists(spark, f"{path}/v{n}"):
        n += 1
    if resume:
        if n == 0:
            raise FileNotFoundError(f"nothing to resume in {path}")
        return f"{path}/v{n - 1}"
    return f"{path}/v{n}"


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file with a header and a stable column order, for a table of a few rows."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.select("line").coalesce(1).write.mode("overwrite").text(path)


def write_results(df: DataFrame, path: str | None, order: str, preview: int = 20) -> DataFrame:
    """df as CSV with a header, a file per task, or without a path its first rows in order, to be shown."""
    if path is None:
        return df.orderBy(order).limit(preview)
    df.write.mode("overwrite").option("header", True).csv(path)
    return df


def first_events(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the log's order: each task keeps n at most, and the merge keeps n."""
    return df.orderBy(*order).limit(n)
