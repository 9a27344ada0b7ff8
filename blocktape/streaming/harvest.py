"""Resumable running state over a stream of event files.

Every micro-batch continues from the state that the batch before left, one row per pool, and writes
events and state into folders named by its number.  A batch that is run again after a crash overwrites
its own folders, so output and state stay in step; replayed and late events, at or before a pool's last
key, are dropped.  A change of parameters starts afresh, in folders of its own.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocktape.operators.enrich import batch_ranges
from blocktape.operators.state import ORDER, deduplicated, running_state

STATE = "pool string, block_number long, log_index long, l0 decimal(38,0), sqrt0 double, tick0 int"


def run_folder(root: str, **parameters) -> str:
    """The folder of one parameter set."""
    told = json.dumps(parameters, sort_keys=True, default=str)
    return f"{root}/run-{hashlib.sha256(told.encode()).hexdigest()[:16]}"


def continue_state(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Running state of a batch's new events from one state row per pool."""
    known = state.select("pool", F.struct("block_number", "log_index").alias("_last"))
    fresh = deduplicated(batch).join(known, "pool", "left")
    fresh = fresh.filter(F.col("_last").isNull() | (F.struct(*ORDER) > F.col("_last"))).drop("_last")
    return running_state(fresh, state.select("pool", "l0", "sqrt0", "tick0"))


def next_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """State after a batch; pools without an event keep theirs."""
    last = done.groupBy("pool").agg(
        F.max_by(F.struct(*ORDER, F.col("l_after").cast("decimal(38,0)").alias("l0"), F.col("sqrt_after").alias("sqrt0"), F.col("tick_after").cast("int").alias("tick0")), F.struct(*ORDER)).alias("k")
    )
    new = last.select("pool", "k.*")
    return new.unionByName(state.join(new, "pool", "left_anti")).select("pool", *ORDER, "l0", "sqrt0", "tick0")


def stream_running_state(spark: SparkSession, source: str, schema, start: DataFrame, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Run what is there of the stream to its end and return all rows written so far.

    ``start`` has one row per pool: pool, l0, sqrt0, tick0.  Called again with the same folder it goes on
    where it stopped.  Counters of each batch are in folder/counts.

    All new files make one batch, so call it once for each part of the log that has landed: files of a part
    may interleave blocks.  ``files_per_batch`` cuts smaller batches; files must then follow one another in
    block order, for rows at or before a pool's last key are dropped.
    """
    first = start.select("pool", F.lit(-1).cast("long").alias("block_number"), F.lit(-1).cast("long").alias("log_index"), F.col("l0").cast("decimal(38,0)"), F.col("sqrt0").cast("double"), F.col("tick0").cast("int"))

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = first if number == 0 else session.read.schema(STATE).parquet(f"{folder}/state/batch={number - 1}")
        continue_state(batch, state).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        done = session.read.parquet(f"{folder}/events/batch={number}")
        next_state(state, done).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        batch_ranges(done, "kind").write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{folder}/events").parquet(f"{folder}/events")


def forget_commit(spark: SparkSession, folder: str) -> None:
    """Removes the last batch's commit, as if the driver had ended before it: the next run does that batch again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/commits")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max((f.getPath() for f in system.listStatus(path) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    system.delete(last, False)


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, n_batches, n_events, first_block, last_block) over the counters that the batches have left."""
    told = spark.read.option("basePath", f"{folder}/counts").parquet(f"{folder}/counts")
    return told.groupBy("kind").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_events").alias("n_events"), F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"))


def closed_blocks(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events of blocks that a later event of the same pool has closed: detection can run on these."""
    last = state.select("pool", F.col("block_number").alias("_open"))
    return events.join(last, "pool").filter(F.col("block_number") < F.col("_open")).drop("_open")
