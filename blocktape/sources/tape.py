"""The event log that the queries read, derived from the `events` table by Spark.

An organic part maps events to swaps, mints and burns of two pools in two-hour blocks; a planted part
adds one block for every hundredth event, from six templates that hold known patterns.  Prices follow the
within-tick rule without fee: the square root of the price falls by 1e-7 times the signed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blocktape.functions.scalars import Q96

LIQUIDITY = 1e9
#: Rows of each template as (origin, kind, direction, lower tick, upper tick).
TEMPLATES = [
    [("a", "swap", 1, 0, 0), ("a", "mint", 0, -10, 10), ("v", "swap", 1, 0, 0), ("a", "burn", 0, -10, 10), ("a", "swap", -1, 0, 0)],
    [("a", "swap", -1, 0, 0), ("v", "swap", -1, 0, 0), ("w", "swap", -1, 0, 0), ("a", "swap", 1, 0, 0)],
    [("a", "swap", 1, 0, 0), ("v", "swap", 1, 0, 0), ("a", "swap", -1, 0, 0), ("v", "swap", -1, 0, 0), ("a", "swap", 1, 0, 0)],
    [("a", "mint", 0, -10, 10), ("v", "swap", 1, 0, 0), ("w", "swap", -1, 0, 0), ("a", "burn", 0, -10, 10)],
    [("a", "mint", 0, -10, 10), ("v", "swap", 1, 0, 0), ("a", "burn", 0, -10, 20)],
    [("a", "swap", 1, 0, 0), ("v", "swap", -1, 0, 0), ("a", "swap", -1, 0, 0)],
]


def _template(event_id: Column) -> Column:
    row = lambda p, r: F.struct(F.lit(p).alias("pos"), *(F.lit(v).alias(n) for n, v in zip(("origin", "kind", "d", "lo", "hi"), r, strict=True)))
    out = None
    for n, rows in enumerate(TEMPLATES):
        made = F.array(*(row(p + 1, r) for p, r in enumerate(rows)))
        test = F.floor(event_id / 100) % 6 == n
        out = F.when(test, made) if out is None else out.when(test, made)
    return out


def pool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical log; one row per event in order (pool, block_number, log_index)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    q = (F.floor(F.col("value") * 100 + 0.5) + 2).cast("long")
    block = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 7200).cast("long")
    organic = events.select(
        F.concat(F.lit("p"), (F.floor(F.col("user_id") / 3) % 2).cast("string")).alias("pool"),
        block.alias("block_number"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_unix"), "event_id", q.alias("q"),
        F.when(F.col("event_type") == "signup", "mint").when(F.col("event_type") == "error", "burn").otherwise("swap").alias("kind"),
        F.concat(F.lit("o"), (F.col("user_id") % 3).cast("string")).alias("origin"), "ts",
    )
    odd = F.col("q") % 2
    organic = organic.withColumns({
        "log_index": F.row_number().over(Window.partitionBy("pool", "block_number").orderBy("ts", "event_id")).cast("long"),
        "d": F.when(F.col("kind") != "swap", 0).when(odd == 0, 1).otherwise(-1),
        "lo": F.when(F.col("kind") != "swap", -20 + 10 * odd), "hi": F.when(F.col("kind") != "swap", 10 + 10 * odd),
    })
    planted = events.filter("event_id % 100 = 0").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_unix"), F.explode(_template(F.col("event_id"))).alias("t"))
    planted = planted.select(
        F.lit("planted").alias("pool"), (F.lit(100_000_000) + F.col("event_id")).alias("block_number"), "ts_unix", "event_id",
        (F.lit(3000) + (F.col("event_id") + 37 * F.col("t.pos")) % 4001).alias("q"), F.col("t.kind").alias("kind"), F.col("t.origin").alias("origin"),
        F.col("t.pos").cast("long").alias("log_index"), F.col("t.d").alias("d"),
        F.when(F.col("t.kind") != "swap", F.col("t.lo")).alias("lo"), F.when(F.col("t.kind") != "swap", F.col("t.hi")).alias("hi"),
    )
    names = ["pool", "block_number", "log_index", "ts_unix", "event_id", "kind", "origin", "q", "d", "lo", "hi"]
    both = organic.select(*names).unionByName(planted.select(*names))
    within = Window.partitionBy("pool", "block_number").orderBy("log_index").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.sum(F.col("d") * F.col("q")).over(within)
    swap = F.col("kind") == "swap"
    s0, s1 = F.col("s0"), F.col("s1")
    known = (F.col("log_index") == 1) | (F.col("log_index") % 4 != 1)
    stored = known & (F.col("log_index") % 5 == 0)
    after = both.withColumn("moved", moved).withColumns({"s1": 1.0 - 1e-7 * F.col("moved"), "s0": 1.0 - 1e-7 * (F.col("moved") - F.col("d") * F.col("q"))})
    return after.select(
        "pool", "block_number", "log_index", "ts_unix", "event_id", "kind",
        F.concat(F.lit("t"), "pool", F.lit("_"), F.col("block_number").cast("string"), F.lit("_"), F.col("log_index").cast("string")).alias("tx_hash"),
        "origin", "q",
        F.when(swap, LIQUIDITY * (1.0 / s1 - 1.0 / s0)).otherwise(2.0 * F.col("q")).alias("amount0"),
        F.when(swap, LIQUIDITY * (s1 - s0)).otherwise(3.0 * F.col("q")).alias("amount1"),
        F.when(~swap, 1e6 * (1 + F.col("q") % 5)).alias("amount"),
        F.col("lo").cast("int").alias("tick_lower"), F.col("hi").cast("int").alias("tick_upper"),
        (100_000 + F.col("q") % 1000).cast("double").alias("gas_used"), (10 + F.col("q") % 7).cast("double").alias("gas_price"),
        F.when(known, LIQUIDITY).alias("l_before"), F.when(known, s0 * Q96).alias("sqrt_before"),
        F.when(stored, LIQUIDITY / s0).alias("x_before"), F.when(stored, LIQUIDITY * s0).alias("y_before"),
        F.lit(LIQUIDITY).alias("l_after"), F.when(swap, s1 * Q96).alias("sqrt_event"),
    )


#: The same log in SQL, as common table expression `tape`.
TAPE_SQL = r"""
o1 AS (
  SELECT 'p' || ((user_id // 3) % 2)::VARCHAR AS pool, floor(epoch(ts))::BIGINT // 7200 AS block_number, floor(epoch(ts))::BIGINT AS ts_unix, event_id,
         floor(value * 100 + 0.5)::BIGINT + 2 AS q, ts,
         CASE event_type WHEN 'signup' THEN 'mint' WHEN 'error' THEN 'burn' ELSE 'swap' END AS kind, 'o' || (user_id % 3)::VARCHAR AS origin
  FROM events),
o2 AS (
  SELECT pool, block_number, row_number() OVER (PARTITION BY pool, block_number ORDER BY ts, event_id) AS log_index, ts_unix, event_id, kind, origin, q,
         CASE WHEN kind <> 'swap' THEN 0 WHEN q % 2 = 0 THEN 1 ELSE -1 END AS d,
         CASE WHEN kind <> 'swap' THEN -20 + 10 * (q % 2) END AS lo, CASE WHEN kind <> 'swap' THEN 10 + 10 * (q % 2) END AS hi
  FROM o1),
tpl(n, pos, origin, kind, d, lo, hi) AS (VALUES
  (0,1,'a','swap',1,0,0),(0,2,'a','mint',0,-10,10),(0,3,'v','swap',1,0,0),(0,4,'a','burn',0,-10,10),(0,5,'a','swap',-1,0,0),
  (1,1,'a','swap',-1,0,0),(1,2,'v','swap',-1,0,0),(1,3,'w','swap',-1,0,0),(1,4,'a','swap',1,0,0),
  (2,1,'a','swap',1,0,0),(2,2,'v','swap',1,0,0),(2,3,'a','swap',-1,0,0),(2,4,'v','swap',-1,0,0),(2,5,'a','swap',1,0,0),
  (3,1,'a','mint',0,-10,10),(3,2,'v','swap',1,0,0),(3,3,'w','swap',-1,0,0),(3,4,'a','burn',0,-10,10),
  (4,1,'a','mint',0,-10,10),(4,2,'v','swap',1,0,0),(4,3,'a','burn',0,-10,20),
  (5,1,'a','swap',1,0,0),(5,2,'v','swap',-1,0,0),(5,3,'a','swap',-1,0,0)),
pl AS (
  SELECT 'planted' AS pool, 100000000 + event_id AS block_number, pos::BIGINT AS log_index, floor(epoch(ts))::BIGINT AS ts_unix, event_id, kind, origin,
         3000 + (event_id + 37 * pos) % 4001 AS q, d, CASE WHEN kind <> 'swap' THEN lo END AS lo, CASE WHEN kind <> 'swap' THEN hi END AS hi
  FROM events JOIN tpl ON (event_id // 100) % 6 = n WHERE event_id % 100 = 0),
bo AS (SELECT * FROM o2 UNION ALL SELECT * FROM pl),
mv AS (
  SELECT *, sum(d * q) OVER (PARTITION BY pool, block_number ORDER BY log_index ROWS UNBOUNDED PRECEDING)::BIGINT AS moved FROM bo),
st AS (
  SELECT *, 1.0::DOUBLE - 1e-7 * moved::DOUBLE AS s1, 1.0::DOUBLE - 1e-7 * (moved - d * q)::DOUBLE AS s0,
         (log_index = 1 OR log_index % 4 <> 1) AS known FROM mv),
tape AS (
  SELECT pool, block_number, log_index, ts_unix, event_id, kind, 't' || pool || '_' || block_number || '_' || log_index AS tx_hash, origin, q,
         CASE WHEN kind = 'swap' THEN 1e9 * (1.0::DOUBLE / s1 - 1.0::DOUBLE / s0) ELSE 2.0::DOUBLE * q END AS amount0,
         CASE WHEN kind = 'swap' THEN 1e9 * (s1 - s0) ELSE 3.0::DOUBLE * q END AS amount1,
         CASE WHEN kind <> 'swap' THEN 1e6 * (1 + q % 5) END AS amount, lo::INT AS tick_lower, hi::INT AS tick_upper,
         (100000 + q % 1000)::DOUBLE AS gas_used, (10 + q % 7)::DOUBLE AS gas_price,
         CASE WHEN known THEN 1e9 END AS l_before, CASE WHEN known THEN s0 * 79228162514264337593543950336.0::DOUBLE END AS sqrt_before,
         CASE WHEN known AND log_index % 5 = 0 THEN 1e9 / s0 END AS x_before, CASE WHEN known AND log_index % 5 = 0 THEN 1e9 * s0 END AS y_before,
         1e9 AS l_after, CASE WHEN kind = 'swap' THEN s1 * 79228162514264337593543950336.0::DOUBLE END AS sqrt_event
  FROM st)
"""
