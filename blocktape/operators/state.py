"""Running pool state and other ordered operators of the log.

Mint and burn add their liquidity where the current tick lies in their range; a swap sets liquidity,
price and tick.  A pool may be far larger than one task: its log is cut into ranges of blocks of about equal
rows, or buckets of a given number of blocks, each bucket is folded alone, a window over one row per bucket carries the state across, and what came before
a bucket's first swap is added once the carried tick is known.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocktape.functions.scalars import virtual_x, virtual_y
from blocktape.sources.sinks import staged

BUCKET_ROWS = 50_000  # of a bucket that follows the rows
ORDER = ["block_number", "log_index"]


def deduplicated(events: DataFrame) -> DataFrame:
    """First row of each (pool, block_number, log_index), ties by transaction."""
    w = Window.partitionBy("pool", *ORDER).orderBy("tx_hash")
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def after_key(events: DataFrame, block: int, log: int) -> DataFrame:
    """Events past the last written key, in lexicographic order."""
    return events.filter(F.struct(*ORDER) > F.struct(F.lit(block).cast("long").alias("block_number"), F.lit(log).cast("long").alias("log_index")))


def last_key(state: DataFrame) -> DataFrame:
    """Per pool the last row: its key and state after it."""
    kept = [c for c in ("l_after", "sqrt_after", "tick_after") if c in state.columns]
    return state.groupBy("pool").agg(F.max_by(F.struct(*ORDER, *kept), F.struct(*ORDER)).alias("k")).select("pool", "k.*")


def in_order(events: DataFrame, *order: str) -> DataFrame:
    """The events with ``seq``, their place from 0 in the order, written in ranges that follow one another: no task has them all."""
    ranges = staged(events.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as ranges
    start = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    at = ranges.join(sizes.select("_part", F.coalesce(start, F.lit(0)).alias("_start")), "_part")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return at.withColumn("seq", F.col("_start") + inner - 1).drop("_part", "_start")


def require_liquidity(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound, rejected): a swap without its liquidity cannot be carried on from."""
    bad = (F.col("kind") == "swap") & F.col("liquidity_after").isNull()
    return events.filter(~bad), events.filter(bad)


def running_state(events: DataFrame, snapshots: DataFrame, bucket_blocks: int | None = None) -> DataFrame:
    """The events with l/sqrt/tick/x/y before and after, affects_active and delta_l_applied (NULL on swaps).

    ``events`` has pool, block_number, log_index, kind, liquidity_delta, liquidity_after, sqrt_event,
    tick_event, tick_lower, tick_upper; ``snapshots`` one row per pool: l0, sqrt0, tick0.  Without
    ``bucket_blocks`` buckets follow the rows, however dense or far apart the blocks are.
    """
    swap = F.col("kind") == "swap"
    if bucket_blocks is None:  # written, so that every pass sees the same ranges; a bucket may end within a block
        ranges = events.repartitionByRange("pool", "block_number").sortWithinPartitions("pool", *ORDER)
        e = staged(ranges.withColumn("_bucket", F.floor(F.monotonically_increasing_id() / BUCKET_ROWS)))
        e = e.repartition(-(-e.count() // BUCKET_ROWS) or 1, "pool", "_bucket")  # tasks grow in number, not in rows
    else:
        e = events.withColumn("_bucket", F.floor(F.col("block_number") / bucket_blocks))
    w = Window.partitionBy("pool", "_bucket").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_seg", F.sum(swap.cast("int")).over(upto))
    in_seg = Window.partitionBy("pool", "_bucket", "_seg").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    base = lambda c: F.first(F.when(swap, F.col(c))).over(in_seg)
    e = e.withColumns({"_l": base("liquidity_after"), "_s": base("sqrt_event"), "_t": base("tick_event")})

    def active(tick: Column) -> Column:
        return F.when(~swap, (F.col("tick_lower") <= tick) & (tick < F.col("tick_upper")))

    # what each bucket hands on: its last swap with later changes, or, without a swap, its changes by the carried tick
    later = F.sum(F.when(active(F.col("_t")), F.col("liquidity_delta")).otherwise(0)).over(in_seg)
    e = e.withColumn("_own", F.when(F.col("_seg") > 0, F.col("_l") + F.coalesce(later, F.lit(0))))
    tail = e.groupBy("pool", "_bucket").agg(F.max_by(F.struct("_seg", F.col("_own").alias("l"), F.col("_s").alias("s"), F.col("_t").alias("t")), F.struct(*ORDER)).alias("z"))
    by_bucket = Window.partitionBy("pool").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("z._seg") > 0, F.struct("_bucket", "z.l", "z.s", "z.t"))
    carry = tail.select("pool", "_bucket", F.last(full, ignorenulls=True).over(by_bucket).alias("c"), "z._seg")
    carry = carry.join(snapshots, "pool", "left").select(
        "pool", "_bucket", F.coalesce("c._bucket", F.lit(-1)).alias("_from"), F.coalesce("c.l", "l0").alias("c_l"), F.coalesce("c.s", "sqrt0").alias("c_s"), F.coalesce("c.t", "tick0").alias("c_t")
    )
    e = e.join(carry, ["pool", "_bucket"])
    tick = F.when(F.col("_seg") > 0, F.col("_t")).otherwise(F.col("c_t"))
    e = e.withColumns({"tick_after": tick, "sqrt_after": F.when(F.col("_seg") > 0, F.col("_s")).otherwise(F.col("c_s"))})
    e = e.withColumn("affects_active", active(F.col("tick_after")))
    e = e.withColumn("delta_l_applied", F.when(F.col("affects_active"), F.col("liquidity_delta")).when(~swap, 0))
    # buckets without a swap between the last one with a swap and this: their changes are summed one row per bucket
    head = e.groupBy("pool", "_from", "_bucket").agg(F.coalesce(F.sum(F.when(F.col("_seg") == 0, F.col("delta_l_applied"))), F.lit(0)).alias("h"))
    earlier = Window.partitionBy("pool", "_from").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    head = head.select("pool", "_bucket", F.coalesce(F.sum("h").over(earlier), F.lit(0)).alias("_before"))
    e = e.join(head, ["pool", "_bucket"], "left")
    run = F.coalesce(F.sum("delta_l_applied").over(in_seg), F.lit(0))
    e = e.withColumn("l_after", F.when(F.col("_seg") > 0, F.col("_l") + run).otherwise(F.col("c_l") + F.coalesce("_before", F.lit(0)) + run))
    first_l = F.col("c_l") + F.coalesce("_before", F.lit(0))
    prev = lambda c, start: F.coalesce(F.lag(c).over(w), start)
    e = e.withColumns({"l_before": prev("l_after", first_l), "sqrt_before": prev("sqrt_after", F.col("c_s")), "tick_before": prev("tick_after", F.col("c_t"))})
    for side in ("before", "after"):
        l, s = F.col(f"l_{side}"), F.col(f"sqrt_{side}")
        e = e.withColumns({f"x_{side}": virtual_x(l, s), f"y_{side}": virtual_y(l, s)})
    return e.drop("_bucket", "_seg", "_l", "_s", "_t", "_own", "_from", "c_l", "c_s", "c_t", "_before")


@F.pandas_udf(T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())]))
def _exact_reserves(liquidity: pd.Series, sqrt_q96: pd.Series) -> pd.DataFrame:
    def pair(l: str | None, s: str | None) -> tuple[str | None, str | None]:
        if l is None or s is None or int(s) == 0:
            return None, None
        return str((int(l) << 96) // int(s)), str((int(l) * int(s)) >> 96)

    return pd.DataFrame([pair(l, s) for l, s in zip(liquidity, sqrt_q96, strict=True)], columns=["x", "y"], dtype=object)


def exact_reserves(liquidity: Column, sqrt_q96: Column) -> Column:
    """struct(x, y): virtual reserves cut to whole units, from whole numbers of any length as decimal text, and as such.

    The products have up to 288 bits, which no column type holds, so a small function takes Arrow batches.
    NULL where either is missing or the price is 0.
    """
    return _exact_reserves(liquidity.cast("string"), sqrt_q96.cast("string"))
