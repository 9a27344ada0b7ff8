"""Detection and running state on a live log whose files interleave.

Files are admitted a few at a time.  Rows wait in the state store until their block is closed, that is until
the watermark, the latest block time seen less a delay, has passed it: so rows that come in any order within the
delay are held back and none is lost, and rows delivered again are dropped.  Closed blocks then go to the window
code of batch detection, or to a running state that is kept by pool.  What a batch writes is in a folder
of its number, which a batch that is run again overwrites.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import StructType

from blocktape.functions.scalars import virtual_x, virtual_y
from blocktape.operators import detect
from blocktape.operators.state import ORDER

KEY = ["pool", *ORDER]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
TASK_CHUNKS = 4000  # of a task that folds rows
SHUFFLE = "spark.sql.shuffle.partitions"
ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
CHUNK = 50  # log places of a block whose rows wait in one list; readers and writers hold thousands of lists


def arriving(spark: SparkSession, source: str, schema: StructType, files: int | None = None, size: str | None = None) -> DataFrame:
    """The Parquet files of a folder as they land, at most so many, or about so many bytes (such as `512m`), to a batch."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return (reader.option("maxBytesPerTrigger", size) if size else reader).parquet(source)


def once(events: DataFrame, delay: str) -> DataFrame:
    """First row of each (pool, block_number, log_index); a key is remembered until the watermark on ``block_ts`` passes it, and rows behind it go.  Rows without a pool or block_ts are dropped."""
    sound = events.filter(F.col("pool").isNotNull() & F.col("block_ts").isNotNull())
    return sound.withWatermark("block_ts", delay).dropDuplicatesWithinWatermark(KEY)


def closed_chunks(events: DataFrame, delay: str) -> DataFrame:
    """(pool, block_number, block_ts, chunk, rows) of every block once it is closed: its rows, in lists of at most ``CHUNK`` log places that follow one another.

    ``block_ts`` is one time for all rows of a block; the state holds open blocks only.  A list is read and written whole,
    so a block of many rows has many.  ``log_index`` is the first field of a row.
    """
    whole = ["pool", "block_number", "block_ts"]
    rest = [c for c in events.columns if c not in (*whole, "log_index")]
    chunk = F.floor(F.col("log_index") / CHUNK).alias("chunk")
    return once(events, delay).groupBy(*whole, chunk).agg(F.collect_list(F.struct("log_index", *rest)).alias("rows"))


def closed_blocks(events: DataFrame, delay: str) -> DataFrame:
    """The rows of every block once it is closed."""
    whole = ["pool", "block_number", "block_ts"]
    return closed_chunks(events, delay).select(*whole, F.explode("rows").alias("r")).select(*whole, "r.*")


def detections(events: DataFrame) -> DataFrame:
    """(pattern_type, pool, block_number, pos, origin, opens, closes, n_victims) of all patterns; back-runs that end a sandwich are left out.

    One block frame serves all, and victims are counted by their places: none is looked up.
    """
    return patterns(detect.block_frame(events))


def patterns(frame: DataFrame) -> DataFrame:
    key, victims = ["pattern_type", "pool", "block_number", "pos"], (F.col("v_hi") - F.col("v_lo") + 1).cast("int").alias("n_victims")
    jit = detect.jit_spans(frame).select(*key, "origin", F.col("mint_tx").alias("opens"), F.col("burn_tx").alias("closes"), victims)
    sand = detect.sandwich_spans(frame).select(*key, "origin", F.col("front_tx").alias("opens"), F.col("back_tx").alias("closes"), victims)
    back = detect.without_sandwich_ends(detect.reverse_backruns(frame, frame), detect.sandwich_ends(frame))
    back = back.select(*key, F.col("arb_origin").alias("origin"), F.col("victim_tx").alias("opens"), F.col("back_tx").alias("closes"), F.lit(1).alias("n_victims"))
    return jit.unionByName(sand).unionByName(back)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for as long as a query is started, then what was."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str) -> list:
    """Take the stream to its present end, from where the folder's last run stopped; returns the progress of its last batches.

    Every batch opens and commits each store, with rows or not, so there are no more of them than cores; a folder keeps the
    number of its first run.  A batch commits its changes, not whole stores.  What Python takes comes in Arrow batches of 4 MB.
    The stores of an executor share one bound of memory.
    """
    spark = stream.sparkSession
    stores = min(int(spark.conf.get(SHUFFLE)), spark.sparkContext.defaultParallelism)
    # open blocks may outgrow the memory of an executor
    with setting(spark, PROVIDER, ROCKSDB), setting(spark, CHANGELOG, "true"), setting(spark, BOUNDED, "true"), setting(spark, SHUFFLE, str(stores)), setting(spark, ARROW, str(4 << 20)):
        query = stream.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def written_so_far(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").drop("batch")


def stream_detections(spark: SparkSession, source: str, schema: StructType, folder: str, delay: str, files: int | None = None) -> DataFrame:
    """All patterns of the blocks closed so far.  Called again with the same folder it goes on where it stopped."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/closed")  # one pass over the stores; the rest runs in the caller's session, with its adaptive plans
        closed = spark.read.schema(batch.schema).parquet(f"{folder}/closed")
        if number and closed.isEmpty():
            return  # no block has closed
        frame = detect.block_frame(closed).persist()  # each pattern reads it
        try:
            patterns(frame).write.mode("overwrite").parquet(f"{folder}/detections/batch={number}")
        finally:
            frame.unpersist()

    run(closed_blocks(arriving(spark, source, schema, files), delay), step, folder)
    return written_so_far(spark, folder, "detections")


CHUNK_KEY = ["pool", "block_number", "time", "chunk"]
HANDED_ON = ["block_number", "chunk", "time", "last_log", "swapped", "l", "s", "t", "later", "l0", "sqrt0", "tick0"]
ROW = {
    "log_index": "long", "kind": "string", "tick_lower": "int", "tick_upper": "int", "sqrt_event": "double",
    "liquidity_after": "decimal(38,0)", "tick_event": "int", "liquidity_delta": "decimal(38,0)",
}
ROWS = f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in ROW.items())}>>"


def is_swap(kind: Column) -> Column:
    return F.coalesce(kind == "swap", F.lit(False))


def typed_states(states: pd.DataFrame) -> pd.DataFrame:
    return states.astype({"rows": object, "l": object, "s": "Float64", "t": "Int32"})


class PoolState(StatefulProcessor):
    """Carries each pool's state through its closed chunks in order; its state is the last key with liquidity, price and tick after it.

    A chunk's rows pass as text as they come.  Only what the chunk hands on is kept until the pool's last frame, when the
    state before each chunk follows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "block_number long, log_index long, l string, s double, t int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told, before = [], []
        for frame in rows:
            told.extend(frame[HANDED_ON].itertuples(index=False, name=None))
            yield typed_states(frame[[*CHUNK_KEY, "rows"]].assign(l=None, s=None, t=None))
        told.sort(key=lambda r: r[:2])
        none = lambda x: None if pd.isna(x) else x
        whole = lambda x: None if pd.isna(x) else int(x)
        if self.last.exists():
            block, log, level, s, t = self.last.get()
            level = whole(level)
        else:
            block, log, level, s, t = -1, -1, whole(told[0][-3]), none(told[0][-2]), whole(told[0][-1])
        for b, chunk, time, end, swapped, new, root, tick, later, *_ in told:
            if (b, end) <= (block, log):
                continue
            block, log = b, end
            before.append((*key, b, time, chunk, None, None if level is None else str(level), s, t))
            if swapped:
                level, s, t = whole(new), none(root), whole(tick)
            for change in json.loads(later) if level is not None and t is not None else ():
                low, high = change.get("tick_lower"), change.get("tick_upper")
                if low is not None and high is not None and low <= t < high:
                    level += change.get("liquidity_delta") or 0
        if before:
            self.last.update((block, log, None if level is None else str(level), s, t))
            yield typed_states(pd.DataFrame(before, columns=[*CHUNK_KEY, "rows", "l", "s", "t"]))

    def close(self) -> None:
        pass


CARRIED = "pool string, block_number long, time long, chunk long, rows string, l string, s double, t int"


def carried_state(chunks: DataFrame, start: DataFrame) -> DataFrame:
    """Of each closed chunk one row with its rows as text, and one, without them, with liquidity, price and tick before it.

    State lives in the state store, one row per pool, which begins with the pool's row of ``start``: pool, l0, sqrt0, tick0.
    It is joined, not given as initial state, for with one a worker holds all of a pool's rows of a batch.
    What a chunk hands on is its last swap and the changes after it.
    """
    known = chunks.filter(F.col("block_number").isNotNull() & F.col("chunk").isNotNull())
    last = known.withColumn("last", F.array_max(F.filter("rows", lambda r: is_swap(r["kind"]))))
    later = F.filter("rows", lambda r: ~is_swap(r["kind"]) & (F.col("last").isNull() | (r["log_index"] > F.col("last.log_index"))))
    told = last.select(
        "pool", "block_number", F.unix_micros("block_ts").alias("time"), "chunk", F.array_max("rows.log_index").alias("last_log"), F.col("last").isNotNull().alias("swapped"),
        F.col("last.liquidity_after").cast("string").alias("l"), F.col("last.sqrt_event").alias("s"), F.col("last.tick_event").alias("t"), F.to_json(later).alias("later"), F.to_json("rows").alias("rows"),
    )
    first = start.select("pool", F.col("l0").cast("decimal(38,0)").cast("string").alias("l0"), F.col("sqrt0").cast("double").alias("sqrt0"), F.col("tick0").cast("int").alias("tick0"))
    return told.join(first, "pool", "left").groupBy("pool").transformWithStateInPandas(PoolState(), CARRIED, "Append", "None")


def keyed_state(carried: DataFrame) -> DataFrame:
    """The running state of the rows of closed chunks, each folded from the state before it: a pool's rows are spread over all tasks."""
    states = carried.filter("rows IS NULL").select(*CHUNK_KEY, F.col("l").cast("decimal(38,0)").alias("c_l"), F.col("s").alias("c_s"), F.col("t").alias("c_t"))
    tasks = -(-states.count() // TASK_CHUNKS) or 1  # by number, for text is far longer than its bytes in a shuffle tell
    texts = carried.filter("rows IS NOT NULL").select(*CHUNK_KEY, "rows").repartition(tasks, *CHUNK_KEY).join(states.repartition(tasks, *CHUNK_KEY).hint("shuffle_hash"), CHUNK_KEY)
    e = texts.select(*CHUNK_KEY, "c_l", "c_s", "c_t", F.explode(F.from_json("rows", ROWS)).alias("r")).select("*", "r.*")
    place = Window.partitionBy(*CHUNK_KEY).orderBy("log_index")
    upto, swap, whole = place.rowsBetween(Window.unboundedPreceding, 0), is_swap(F.col("kind")), lambda c: c.cast("decimal(38,0)")
    base = F.coalesce(
        F.last(F.when(swap, F.struct(F.col("liquidity_after").alias("l"), F.col("sqrt_event").alias("s"), F.col("tick_event").alias("t"))), ignorenulls=True).over(upto),
        F.struct(F.col("c_l").alias("l"), F.col("c_s").alias("s"), F.col("c_t").alias("t")),
    )
    e = e.withColumn("base", base).withColumns({"sqrt_after": F.col("base.s"), "tick_after": F.col("base.t")})
    e = e.withColumn("affects_active", F.when(~swap, (F.col("tick_lower") <= F.col("tick_after")) & (F.col("tick_after") < F.col("tick_upper"))))
    e = e.withColumn("delta_l_applied", F.when(~swap, F.coalesce(F.when(F.col("affects_active"), F.col("liquidity_delta")), whole(F.lit(0)))))
    e = e.withColumn("changes", F.coalesce(whole(F.sum("delta_l_applied").over(upto)), whole(F.lit(0))))
    at_swap = F.coalesce(F.last(F.when(swap, F.col("changes")), ignorenulls=True).over(upto), whole(F.lit(0)))
    e = e.withColumn("l_after", whole(F.col("base.l") + F.col("changes") - at_swap))
    first = F.row_number().over(place) == 1
    e = e.withColumns({f"{v}_before": F.when(first, F.col(c)).otherwise(F.lag(f"{v}_after").over(place)) for v, c in (("l", "c_l"), ("sqrt", "c_s"), ("tick", "c_t"))})
    e = e.select(*KEY, "kind", *(f"{v}_{side}" for side in ("before", "after") for v in ("l", "sqrt", "tick")), "affects_active", "delta_l_applied")
    return e.withColumns({f"{v}_{side}": f(F.col(f"l_{side}"), F.col(f"sqrt_{side}")) for side in ("before", "after") for v, f in (("x", virtual_x), ("y", virtual_y))})


KINDS = ("swap", "mint", "burn")


class Counts(StreamingQueryListener):
    """Keeps what the batches of one run observe, by batch; a batch that is run again counts once."""

    def __init__(self, name: str) -> None:
        self.name, self.batches, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batches[event.progress.batchId] = seen.asDict()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def observed(chunks: DataFrame, name: str) -> DataFrame:
    """Closed chunks, their rows counted by kind as they pass."""
    n = lambda k: F.when(F.col("block_number").isNotNull(), F.size(F.filter("rows", lambda r: r["kind"] == k)))
    counted = chunks.withColumns({f"n_{k}": n(k) for k in KINDS})
    of = lambda k: F.when(F.col(f"n_{k}") > 0, F.col("block_number"))
    seen = counted.observe(name, *(c for k in KINDS for c in (F.sum(f"n_{k}").alias(f"n_{k}"), F.min(of(k)).alias(f"first_{k}"), F.max(of(k)).alias(f"last_{k}"))))
    return seen.select(*chunks.columns)


def stream_keyed_state(spark: SparkSession, source: str, schema: StructType, start: DataFrame, folder: str, delay: str, files: int | None = None) -> DataFrame:
    """All rows of the running state so far; what passed is counted into folder/metrics, without another pass.  Called again it goes on.

    Batches write closed chunks with the state before each; rows are folded from these where they are asked for.
    """
    start.write.mode("overwrite").parquet(f"{folder}/start")  # every batch joins it
    first = spark.read.schema(start.schema).parquet(f"{folder}/start")
    events = arriving(spark, source, schema, files).select("pool", "block_number", "block_ts", *(F.col(c).cast(kind).alias(c) for c, kind in ROW.items()))

    listener = Counts("closed")
    spark.streams.addListener(listener)
    try:
        rows = carried_state(observed(closed_chunks(events, delay), "closed"), first)
        run(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/closed/batch={number}"), folder)
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    told = [(n, k, m[f"n_{k}"], m[f"first_{k}"], m[f"last_{k}"]) for n, m in sorted(listener.batches.items()) for k in KINDS]
    # few rows, one per batch and kind; a run appends, and a batch that two runs report counts once
    spark.createDataFrame(told, "batch long, kind string, n_events long, first_block long, last_block long").coalesce(1).write.mode("append").parquet(f"{folder}/metrics")
    return keyed_state(written_so_far(spark, folder, "closed"))


def observed_counters(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, n_events, first_block, last_block) over what the runs of a folder have observed."""
    told = spark.read.parquet(f"{folder}/metrics").dropDuplicates(["batch", "kind"]).filter("n_events > 0")
    return told.groupBy("kind").agg(F.sum("n_events").alias("n_events"), F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"))


def end_mark(events: DataFrame, delay: str) -> DataFrame:
    """One row past the end of the log: when it lands, every block before it closes.  It belongs to no block that is reported."""
    last = events.agg((F.max("block_ts") + F.expr(f"interval {delay}") + F.expr("interval 1 second")).alias("block_ts"))
    own = {"pool": F.lit("__end"), "block_number": F.lit(-1).cast("long"), "log_index": F.lit(-1).cast("long")}
    return last.select(*(own.get(f.name, F.col("block_ts") if f.name == "block_ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema))
