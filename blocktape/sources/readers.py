"""Scans of event logs, tidy tables and landed raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Accepted input names of each canonical column; the first that is present wins.
ALIASES = {
    "kind": ("eventType", "event", "kind"), "block_number": ("blockNumber", "block_number"), "log_index": ("logIndex", "log_index"),
    "tx_hash": ("transactionHash", "tx_hash"), "origin": ("origin", "owner", "sender"), "amount0": ("amount0",), "amount1": ("amount1",),
    "amount": ("liquidityDelta", "amount"), "tick_lower": ("tickLower", "tick_lower"), "tick_upper": ("tickUpper", "tick_upper"),
    "gas_used": ("gasUsed", "gas_used"), "gas_price": ("effectiveGasPrice", "gas_price"), "l_before": ("L_before", "l_before"),
    "sqrt_before": ("sqrt_before", "sqrtPriceX96_before"), "x_before": ("x_before",), "y_before": ("y_before",),
    "l_after": ("liquidityAfter_event", "L_after", "liquidity", "l_after"), "sqrt_event": ("sqrtPriceX96_event", "sqrt_after", "sqrt_event"),
    "tick_before": ("tick_before",), "tick_event": ("tick_event", "tick_after"), "tick_after": ("tick_after",), "pool": ("pool",),
}
REQUIRED = ("kind", "block_number", "log_index", "tx_hash", "amount0", "amount1")
TEXT = ("kind", "tx_hash", "origin", "pool")


def canonical(df: DataFrame, pool: str = "") -> DataFrame:
    """The canonical columns of an event table under any accepted names; a missing optional column is NULL."""
    from blocktape.functions.scalars import to_number

    out = []
    for name, options in ALIASES.items():
        found = next((o for o in options if o in df.columns), None)
        if found is None and name in REQUIRED:
            raise ValueError(f"no column for {name}: one of {', '.join(options)} is needed")
        c = F.lit(pool or None).cast("string") if found is None and name == "pool" else F.lit(None) if found is None else F.col(f"`{found}`")
        if name in TEXT:
            c = F.lower(F.trim(c.cast("string")))
        elif name in ("block_number", "log_index"):
            c = c.try_cast("long")
        else:
            c = to_number(c) if found else F.lit(None).cast("double")
        out.append(c.alias(name))
    return df.select(*out)


def sound_and_rejected(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a key and a kind; the rest, and mints or burns whose amounts look like a swap's, with a reason."""
    from blocktape.functions.scalars import direction

    reason = F.when(F.col("block_number").isNull() | F.col("log_index").isNull(), "no key").when(F.col("kind").isNull(), "no kind")
    reason = reason.when(F.col("kind").isin("mint", "burn") & direction(F.col("amount0"), F.col("amount1")).isNotNull(), "amounts of opposite sign")
    marked = events.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def read_events(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet, or CSV with a header (also gzipped), by the path's ending; any other ending is refused.

    CSV columns are text unless a schema is given: nothing is inferred by a second pass over the file.
    """
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".csv.gz", ".gz")):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"unknown format: {path}")


def first_existing(spark: SparkSession, *patterns: str) -> str:
    """The first path, or first match in order of a glob, that exists on whatever file system Spark reads."""
    jvm = spark.sparkContext._jvm
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        names = sorted(str(s.getPath().toString()) for s in found or [])
        if names:
            return names[0]
    raise FileNotFoundError(f"none of {', '.join(patterns)}")


def read_tidy(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """A detection table: the plain name, else one by fee, as Parquet before CSV."""
    return read_events(spark, first_existing(spark, *(f"{folder}/{stem}{end}" for end in (".parquet", ".csv", ".csv.gz", "_*.parquet", "_*.csv"))))


def flattened(raw: DataFrame, addresses: bool = True) -> DataFrame:
    """One flat log from raw entities of all kinds: a `transaction` struct (id, block) and text numbers become columns.

    Fields that a kind does not have are NULL whatever the entity holds; burns take liquidity away.  With
    ``addresses`` origin, sender, owner and recipient come in their one spelling, NULL where they are no addresses.
    """
    from blocktape.functions.scalars import address

    party = address if addresses else lambda c: c
    kind = F.lower("kind")
    swap, mint, burn = (kind == k for k in ("swap", "mint", "burn"))
    number = lambda c, t: F.col(c).try_cast(t)
    return raw.select(
        F.col("transaction.block").try_cast("long").alias("block_number"), number("logIndex", "long").alias("log_index"), number("timestamp", "long").alias("ts_unix"),
        F.col("transaction.id").alias("tx_hash"), F.initcap(kind).alias("kind"), party(F.col("origin")).alias("origin"),
        F.when(swap | mint, party(F.col("sender"))).alias("sender"), F.when(mint | burn, party(F.col("owner"))).alias("owner"), F.when(swap, party(F.col("recipient"))).alias("recipient"), number("amount0", "double").alias("amount0"),
        number("amount1", "double").alias("amount1"), F.when(swap, F.col("sqrtPriceX96")).alias("sqrt_event"), F.when(swap, number("tick", "int")).alias("tick_event"),
        F.when(mint | burn, number("tickLower", "int")).alias("tick_lower"), F.when(mint | burn, number("tickUpper", "int")).alias("tick_upper"),
        F.when(mint, number("amount", "decimal(38,0)")).when(burn, -number("amount", "decimal(38,0)")).alias("liquidity_delta"),
    )


def landed(raw: DataFrame, pool: str | None, low: int, high: int, after_id: str | None = None) -> DataFrame:
    """Rows of one pool within a time range, both ends included, past an id: pushed into the scan where these are columns of a file (`landed.window` leaves out whole partitions too)."""
    rows = raw.filter(F.col("ts_unix").between(low, high))
    rows = rows.filter(F.col("pool") == pool) if pool is not None else rows
    return rows.filter(F.col("id") > after_id) if after_id is not None else rows


def first_block(events: DataFrame, since: int) -> DataFrame:
    """Per pool the smallest of each kind's first block at or after a time."""
    first = events.filter(F.col("ts_unix") >= since).groupBy("pool", "kind").agg(F.min_by("block_number", F.struct("ts_unix", "block_number", "log_index")).alias("b"))
    return first.groupBy("pool").agg(F.min("b").alias("first_block"))


def snapshot_at(snapshots: DataFrame, block: int) -> DataFrame:
    """Per pool the last snapshot at or before a block."""
    kept = [c for c in snapshots.columns if c != "pool"]
    return snapshots.filter(F.col("block_number") <= block).groupBy("pool").agg(F.max_by(F.struct(*kept), "block_number").alias("s")).select("pool", "s.*")


def merged(swaps: DataFrame, mints: DataFrame, burns: DataFrame) -> DataFrame:
    """One log of the three landed kinds; burns take liquidity away.  `state.in_order` puts it into the order of (ts_unix, block_number, log_index)."""
    both = swaps.withColumn("kind", F.lit("swap")).unionByName(mints.withColumn("kind", F.lit("mint")), allowMissingColumns=True)
    burned = burns.withColumns({"kind": F.lit("burn"), "amount": -F.abs(F.col("amount"))})
    return both.unionByName(burned, allowMissingColumns=True)
