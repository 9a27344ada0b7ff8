"""Registered queries over the log that is derived from the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blocktape.functions import scalars as S
from blocktape.functions import theory as T
from blocktape.operators import augment, decode, detect, enrich, state
from blocktape.plans import report, sweep
from blocktape.functions import wide
from blocktape.sources import landed, readers, sinks
from blocktape.sources.sinks import shared_folder, staged, staged_together
from blocktape.sources.tape import pool_events
from blocktape.streaming import harvest, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GAMMA = 0.01


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(name: str, digits: int, source: str | Column | None = None) -> Column:
    c = F.col(source or name) if not isinstance(source, Column) else source
    return (F.round(c, digits) + 0.0).alias(name)


def rounded(digits: dict[str, int]) -> list[Column]:
    return [r(n, d) for n, d in digits.items()]


def joined(name: str, source: Column | None = None) -> Column:
    return F.array_join((F.col(name) if source is None else source).cast("array<string>"), ",").alias(name)


PRICES = {"p_victim_pre": 9, "p_victim_post": 9}
BEFORE = {"l0": 1, "x0": 2, "y0": 2}
FLOW = {"s_net_token0": 5, "s_net_token1": 5}


def backruns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.reverse_backruns(pool_events(spark, sf_dir))


def clean_backruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = staged(pool_events(spark, sf_dir))
    frame = detect.block_frame(tape)
    return detect.without_sandwich_ends(detect.reverse_backruns(tape, frame), detect.sandwich_ends(frame))


@query
def pool_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pool_events(spark, sf_dir)
    return t.select(
        "pool", "block_number", "log_index", "ts_unix", "event_id", "kind", "tx_hash", "origin", "q", "tick_lower", "tick_upper",
        *rounded({"amount0": 5, "amount1": 5, "amount": 1, "gas_used": 1, "gas_price": 1, "l_before": 1, "x_before": 2, "y_before": 2}),
        r("sqrt_before", 12, F.col("sqrt_before") / S.Q96), r("sqrt_event", 12, F.col("sqrt_event") / S.Q96),
    )


@query
def canonical_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias resolution, type coercion and the direction columns over the log under its raw names."""
    t = pool_events(spark, sf_dir).withColumnsRenamed({"kind": "eventType", "block_number": "blockNumber", "log_index": "logIndex", "tx_hash": "transactionHash", "amount": "liquidityDelta", "l_after": "liquidityAfter_event"})
    t = t.withColumns({"eventType": F.initcap("eventType"), "blockNumber": F.concat(F.lit("0x"), F.lower(F.hex("blockNumber"))), "amount0": F.col("amount0").cast("string")})
    t = t.withColumn("blockNumber", S.to_number(F.col("blockNumber")).cast("long"))
    good, _ = readers.sound_and_rejected(readers.canonical(t))
    a0, a1 = F.col("amount0"), F.col("amount1")
    return good.select("pool", "block_number", "log_index", "kind", "tx_hash", "origin", S.is_swap(F.col("kind"), a0, a1).alias("is_swap"), S.direction(a0, a1).alias("dir"), S.direction_label(S.direction(a0, a1)).alias("dir_label"), S.opposite(S.front_direction(a0, a1)).alias("back_dir"))


@query
def scalar_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of many spellings, made from each event, through the normalizing functions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id") % 5
    text = F.when(n == 0, F.concat(F.lit(" "), F.col("value").cast("decimal(18,2)").cast("string"))).when(n == 1, "None").when(n == 2, F.concat(F.lit("0x"), F.lower(F.hex("event_id")))).when(n == 3, "").otherwise(F.col("event_id").cast("string"))
    flag = F.when(n == 0, "TRUE").when(n == 1, " no").when(n == 2, "1").when(n == 3, "maybe").otherwise("False")
    when = F.when(n == 0, F.unix_timestamp("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    units = F.concat(F.when(n == 1, "-").otherwise(""), F.col("value").cast("decimal(18,2)").cast("string"))
    spelling = F.element_at(F.array(*map(F.lit, (*S.X_TO_Y, *S.Y_TO_X, "sideways"))), (F.col("event_id") % 15 + 1).cast("int"))
    spelling = F.when(n == 0, F.upper(spelling)).when(n == 1, F.concat(F.lit(" "), spelling)).otherwise(spelling)
    fee = F.when(n == 0, F.lit(None)).when(n == 1, 0.003).otherwise(n.cast("double"))
    return e.select("event_id", S.direction_label(spelling).alias("dir_label"), S.fee_column(fee).alias("fee_in_bps"), S.general(F.when(n != 3, F.col("value") / F.pow(F.lit(10.0), (F.col("event_id") % 12).cast("double")))).alias("as_text"), S.to_number(text).alias("as_number"), S.to_float(text).alias("as_float"), S.to_bool(flag).alias("as_bool"), S.to_unix(when).alias("as_unix"), S.raw_units(units, 6).cast("long").alias("as_units"), S.raw_units_exact(units, 1).alias("exact_at_1"))


@query
def reverse_backruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = backruns_of(spark, sf_dir)
    return b.select("pool", "block_number", "pos", "pattern_type", "victim_origin", "arb_origin", "victim_dir", "victim_tx", "back_tx", *rounded(BEFORE | PRICES | {"p_back_post": 9} | FLOW | {"back_a0": 5, "back_a1": 5}), joined("gas_used"), joined("gas_price"))


JIT_AMOUNTS = {"mint_amount": 1, "burn_amount": 1, "mint_amount0": 1, "mint_amount1": 1, "burn_amount0": 1, "burn_amount1": 1, "attacker_liq_share": 12}


@query
def jit_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = detect.jit_cycles(staged(pool_events(spark, sf_dir)))
    return j.select("pool", "block_number", "pos", "origin", "mint_tick_lower", "mint_tick_upper", "mint_tx", "burn_tx", "n_victims", joined("victim_txs"), *rounded(BEFORE | FLOW | JIT_AMOUNTS), joined("gas_used"), joined("gas_price"))


@query
def jit_cycles_outside_sandwiches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = staged(pool_events(spark, sf_dir))
    return detect.without_sandwich_cycles(detect.jit_cycles(t), detect.sandwiches(t)).select("pool", "block_number", "pos", "mint_tx", "burn_tx")


def sandwich_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "pool", "block_number", "pos", "pattern_type", "origin", "front_dir", "back_dir", "front_tx", "back_tx", "mint_tx", "burn_tx", "n_victims", joined("victim_txs"),
        *rounded(BEFORE | PRICES | FLOW | {"front_a0": 5, "front_a1": 5, "back_a0": 5, "back_a1": 5, "l_mint": 1, "l_burn": 1, "attacker_liq_share": 12}), joined("gas_used"), joined("gas_price"),
    )


@query
def sandwich_classical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sandwich_rows(detect.sandwiches(staged(pool_events(spark, sf_dir))).filter("pattern_type = 'Classical'"))


@query
def sandwich_jit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sandwich_rows(detect.sandwiches(staged(pool_events(spark, sf_dir))).filter("pattern_type = 'JIT-Sandwich'"))


@query
def sandwich_two_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern counts when at least two victims are asked for."""
    return detect.sandwiches(pool_events(spark, sf_dir), min_victims=2).groupBy("pool", "pattern_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_victims").alias("victims"))


@query
def backruns_minus_sandwich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_backruns(spark, sf_dir).select("pool", "block_number", "pos", "victim_tx", "back_tx")


SIZES = {"sigma_gross": 13, "sigma_net": 13, "sigma0_gross": 13, "sigma1_gross": 13, "sigma0_net": 13, "sigma1_net": 13, "i_theory": 12}


@query
def backrun_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = augment.backrun_metrics(clean_backruns(spark, sf_dir))
    return m.select("pool", "block_number", "pos", "viable_sigma", "reverted", "near_target", "reverse_label", *rounded(SIZES | {"i_measured": 11, "sigma_min_backrun": 12, "br_pi_star_token0": 6, "br_pi_star_per_x0": 15, "profit_obs_token0": 5, "profit_obs_per_x0": 13, "mmax_jit_token0": 7, "fee_fraction": 6}))


@query
def backrun_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = augment.backrun_metrics(clean_backruns(spark, sf_dir))
    return m.groupBy("pool", "reverse_label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("arb_origin").alias("n_origins"))


@query
def reverse_backrun_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-runs before the anti-join, by label."""
    m = staged(augment.backrun_metrics(backruns_of(spark, sf_dir)).select("reverse_label", "sigma_gross", "profit_obs_per_x0"))
    middle = report.quantiles(m.select("reverse_label", F.col("profit_obs_per_x0").alias("v")), ["reverse_label"], (0.5,))
    means = m.groupBy("reverse_label").agg(F.count(F.lit(1)).alias("n"), r("sigma_mean", 12, F.avg("sigma_gross")))
    return means.join(middle, "reverse_label", "left").select("reverse_label", "n", "sigma_mean", r("profit_p50", 12, F.col("q")[0]))


@query
def backrun_fee_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-runs that pay, by fee: missing (5 basis points), a fraction, basis points."""
    b, out = staged(backruns_of(spark, sf_dir)), None
    for name, fee in (("missing", None), ("fraction", 0.003), ("points", 30), ("hundred", 100.0)):
        m = augment.backrun_metrics(b, fee).groupBy(F.lit(name).alias("fee")).agg(F.first("fee_fraction").alias("fee_fraction"), F.count_if("viable_sigma").alias("n_viable"), r("mmax_sum", 3, F.sum("mmax_jit_token0")))
        out = m if out is None else out.unionByName(m)
    return out


@query
def jit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = augment.jit_metrics(detect.jit_cycles(staged(pool_events(spark, sf_dir))))
    return m.select("pool", "block_number", "pos", "victim_dir", *rounded(SIZES | {"profit_fee_token0": 8, "profit_il_token0": 4, "profit_total_token0": 4, "profit_total_per_x0": 12}))


def sandwich_table(spark: SparkSession, sf_dir: str, grid: int = 128) -> DataFrame:
    return augment.sandwich_metrics(detect.sandwiches(staged(pool_events(spark, sf_dir))), gamma=GAMMA, grid=grid)


@query
def sandwich_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sandwich_table(spark, sf_dir)
    digits = {"profit_token0_base": 4, "jit_fee_token0": 8, "lp_token_delta_token0": 4, "profit_token0": 4, "profit_per_x0": 12, "eps_gross": 13, "eps_net": 13, "i_measured": 11}
    digits |= {"br_pi_star_token0": 6, "sand_pi_obs_token0": 5, "br_pi_star_per_x0": 14, "sand_pi_obs_per_x0": 14, "eps_max_classic": 11, "eps_max_jit": 11, "eps_max": 11, "sigma_star_br_vs_jit_phi0": 12}
    return m.select("pool", "block_number", "pos", "victim_dir", "is_jit", joined("tx_sequence"), *rounded(SIZES | digits))


@query
def sandwich_best_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sandwich_table(spark, sf_dir)
    return m.select("pool", "block_number", "pos", r("eps_star", 11), r("sand_pi_star", 13), r("sand_pi_star_token0", 4))


# --- running state -------------------------------------------------------------------------------------------


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with what a swap sets and a mint or burn adds."""
    t, swap, q = pool_events(spark, sf_dir), F.col("kind") == "swap", F.col("q")
    sign = F.when(F.col("kind") == "mint", 1).otherwise(-1)
    return t.select(
        "pool", "block_number", "log_index", "kind", "tx_hash", "tick_lower", "tick_upper", "sqrt_event",
        F.when(swap, F.lit(1_000_000_000) + 1000 * (F.col("event_id") % 7)).cast("decimal(38,0)").alias("liquidity_after"),
        F.when(swap, q % 40 - 20).cast("int").alias("tick_event"), F.when(~swap, sign * 1_000_000 * (1 + q % 5)).cast("decimal(38,0)").alias("liquidity_delta"),
    )


def start_state(events: DataFrame) -> DataFrame:
    return events.select("pool").distinct().select("pool", F.lit(1_000_000_000).cast("decimal(38,0)").alias("l0"), F.lit(S.Q96).alias("sqrt0"), F.lit(0).alias("tick0"))


def state_rows(df: DataFrame) -> DataFrame:
    long = lambda n: F.col(n).cast("long").alias(n)
    return df.select(
        "pool", "block_number", "log_index", "kind", "affects_active", *(long(n) for n in ("delta_l_applied", "l_before", "l_after")), F.col("tick_before").cast("int").alias("tick_before"), F.col("tick_after").cast("int").alias("tick_after"),
        r("sqrt_after", 12, F.col("sqrt_after") / S.Q96), r("x_before", 2), r("y_after", 2),
    )


@query
def running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = staged(state_events(spark, sf_dir))
    return state_rows(state.running_state(e, start_state(e), bucket_blocks=50))


@query
def resume_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with replayed rows, cut at a key, and each pool's last key."""
    t = pool_events(spark, sf_dir)
    doubled = t.unionByName(t.filter("event_id % 10 = 0"))
    kept = state.after_key(state.deduplicated(doubled), 236_800, 3)
    return state.last_key(kept).join(kept.groupBy("pool").agg(F.count(F.lit(1)).alias("n_events")), "pool").select("pool", "block_number", "log_index", "n_events")


@query
def state_reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps without liquidity go to the reject table."""
    e = state_events(spark, sf_dir).withColumn("liquidity_after", F.when(F.col("log_index") % 9 != 0, F.col("liquidity_after")))
    good, bad = state.require_liquidity(e)
    count = lambda d, n: d.groupBy("pool").agg(F.count(F.lit(1)).alias(n))
    return count(good, "n_sound").join(count(bad, "n_rejected"), "pool", "left").select("pool", "n_sound", F.coalesce("n_rejected", F.lit(0)).cast("long").alias("n_rejected"))


def streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The running state by micro-batches over parts in block order, one of them delivered twice, and the run's folder; each part is one batch, however many files it has."""
    folder, e = shared_folder(spark, "stream"), staged(state_events(spark, sf_dir))
    cuts = e.agg(F.percentile_approx("block_number", [0.25, 0.5, 0.75], 1000)).first()[0]
    bounds = [-1, *cuts, 1 << 60]
    start, run = start_state(e), harvest.run_folder(folder, gamma=GAMMA)
    for n, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        part = e.filter((F.col("block_number") > low) & (F.col("block_number") <= high)).repartitionByRange("block_number").sortWithinPartitions("block_number", "log_index")
        for copy in range(2 if n == 1 else 1):
            part.write.parquet(f"{folder}/landed/part={n}-{copy}")
            done = harvest.stream_running_state(spark, f"{folder}/landed/*", e.schema, start, run)
    return done, run


@query
def stream_running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_rows(streamed(spark, sf_dir)[0])


@query
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches counted, the part that came twice only once."""
    return harvest.counters(spark, streamed(spark, sf_dir)[1]).select("kind", "n_events", "first_block", "last_block")


@query
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running state in a version of its own, resumed after its last commit was lost: the batch is run again in its place."""
    base, e = shared_folder(spark, "stream"), staged(state_events(spark, sf_dir))
    start, middle = start_state(e), e.agg(F.percentile_approx("block_number", 0.5, 1000)).first()[0]
    version = sinks.fresh_version(spark, f"{base}/versions", resume=False)
    done = None
    for n, part in enumerate((F.col("block_number") <= middle, F.col("block_number") > middle)):
        e.filter(part).write.parquet(f"{base}/landed/part={n}")
        version = sinks.fresh_version(spark, f"{base}/versions", resume=True) if n else version
        run = harvest.run_folder(version, gamma=GAMMA)
        done = harvest.stream_running_state(spark, f"{base}/landed/*", e.schema, start, run)
        if n == 0:
            harvest.forget_commit(spark, run)
    other = harvest.run_folder(version, gamma=2 * GAMMA)  # other parameters: a run of their own
    if other == run or sinks.exists(spark, other):
        raise RuntimeError("a run of other parameters was found")
    return state_rows(done)


@query
def closed_block_backruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-runs of the blocks that a later event of their pool has closed."""
    t = pool_events(spark, sf_dir)
    return detect.reverse_backruns(harvest.closed_blocks(t, state.last_key(t))).select("pool", "block_number", "pos", "back_tx")


PARTS = 10  # parts that a live log lands in, not counting repeats
FILE_ROWS = 1_000_000  # of a landed file, about


def with_block_time(events: DataFrame) -> DataFrame:
    """block_ts, one time for all events of a block: the start of an organic one's two hours, a planted one's only time."""
    return events.withColumn("block_ts", F.timestamp_seconds(F.when(F.col("pool") == "planted", F.col("ts_unix")).otherwise(F.col("block_number") * 7200)))


def in_block_order(times: DataFrame, blocks: int = 10_000) -> DataFrame:
    """(pool, block_number, block_ts) with no block before an earlier one of its pool: a state that goes on from block to block needs them closed in order.

    Copies of a log with other keys and the same times have later blocks at earlier times.
    """
    t = times.withColumn("_range", F.floor(F.col("block_number") / blocks))
    ranges = t.groupBy("pool", "_range").agg(F.max("block_ts").alias("_last"))  # one row per so many block numbers
    earlier = F.max("_last").over(Window.partitionBy("pool").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.max("block_ts").over(Window.partitionBy("pool", "_range").orderBy("block_number").rowsBetween(Window.unboundedPreceding, 0))
    known = t.withColumn("block_ts", inner).join(ranges.select("pool", "_range", earlier.alias("_earlier")), ["pool", "_range"])
    return known.select("pool", "block_number", F.greatest("block_ts", "_earlier").alias("block_ts"))


def landed_live(events: DataFrame, folder: str, parts: int = PARTS) -> tuple[str, int]:
    """Lands the log in parts that interleave: rows of a block are in three parts that follow one another, one part comes twice, and the last one marks the end.

    Returns the delay that holds them all, and the number of files of a part, which follows its rows and not the tasks that write it.
    """
    spark = events.sparkSession
    low, high, rows = events.agg(F.unix_timestamp(F.min("block_ts")), F.unix_timestamp(F.max("block_ts")), F.count(F.lit(1))).first()
    span = (high - low) // (parts - 2) + 1
    at = F.floor((F.unix_timestamp("block_ts") - low) / span) + F.pmod(F.xxhash64("tx_hash"), F.lit(3))
    cut = events.withColumn("_part", at.cast("int"))
    cut.write.partitionBy("_part").parquet(f"{folder}/cut")
    cut = spark.read.schema(cut.schema).parquet(f"{folder}/cut")
    files = -(-rows // (parts * FILE_ROWS)) or 1
    for n in range(parts):
        for copy in range(2 if n == 4 else 1):
            cut.filter(F.col("_part") == n).drop("_part").coalesce(files).write.parquet(f"{folder}/landed/part={n:03}-{copy}")
    live.end_mark(events, f"{3 * span} seconds").coalesce(1).write.parquet(f"{folder}/landed/part={parts:03}-0")
    return f"{3 * span} seconds", files


@query
def stream_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern, found on the log as it lands, one part to a batch."""
    e, folder = staged(with_block_time(pool_events(spark, sf_dir))), shared_folder(spark, "stream")
    delay, files = landed_live(e, folder)
    return live.stream_detections(spark, f"{folder}/landed/*", e.schema, f"{folder}/run", delay, files=files)


def live_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    folder, times = shared_folder(spark, "stream"), with_block_time(pool_events(spark, sf_dir)).select("pool", "block_number", "block_ts").distinct()
    e = staged(state_events(spark, sf_dir).join(in_block_order(times), ["pool", "block_number"]))
    delay, files = landed_live(e, folder)
    return live.stream_keyed_state(spark, f"{folder}/landed/*", e.schema, start_state(e), f"{folder}/run", delay, files=files), f"{folder}/run"


@query
def stream_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running state by pool in the state store, over ten parts that interleave."""
    return state_rows(live_state(spark, sf_dir)[0])


@query
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same run has observed as its rows passed."""
    return live.observed_counters(spark, live_state(spark, sf_dir)[1])


# --- scans ---------------------------------------------------------------------------------------------------


@query
def first_event_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_block(pool_events(spark, sf_dir), 1_704_500_000)


@query
def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pool's state at a block, from snapshots taken at every first event of a block."""
    t = pool_events(spark, sf_dir).filter("log_index = 1").select("pool", "block_number", "l_after", F.round(F.col("sqrt_before") / S.Q96, 12).alias("sqrt_p"))
    return readers.snapshot_at(t, 236_900)


@query
def time_window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed kinds within a time range and past an id, merged into one log."""
    t = pool_events(spark, sf_dir).withColumn("id", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    part = lambda k: readers.landed(t.filter(F.col("kind") == k), None, 1_704_400_000, 1_705_400_000, "000000000100")
    both = readers.merged(part("swap"), part("mint"), part("burn"))
    return both.select("ts_unix", "block_number", "log_index", "pool", "kind", "tx_hash", r("amount", 1))


SPAN = 100_000  # seconds of a landed stretch
BLOCKS = 20  # blocks of a landed stretch


@query
def landed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pool's events within a time range and past an id, from a table that is landed by pool and stretch of time."""
    t = pool_events(spark, sf_dir).withColumn("id", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    folder = f"{shared_folder(spark, 'landed')}/log"
    landed.land(t, folder, "ts_unix", SPAN)
    rows = landed.window(landed.read_landed(spark, folder, t.schema), "ts_unix", SPAN, 1_704_400_000, 1_705_400_000, "p0", "000000000100")
    return rows.select("ts_unix", "block_number", "log_index", "pool", "kind", "tx_hash")


@query
def landed_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity that swaps lack, from raw logs landed by pool and stretch of blocks, of which only stretches that lack any are opened."""
    e = staged(state_events(spark, sf_dir).withColumn("liquidity_after", F.when(F.col("log_index") % 2 == 0, F.col("liquidity_after"))))
    logs, folder = swap_logs(spark, sf_dir), f"{shared_folder(spark, 'landed')}/logs"
    spans = staged(landed.spans(e.filter("kind = 'swap'"), "block_number", BLOCKS))
    landed.land(landed.with_span(logs, spans, BLOCKS), folder, "block_number", F.col("span"))
    wanted = staged(landed.wanted_stretches(landed.with_span(e, spans, BLOCKS), (F.col("kind") == "swap") & F.col("liquidity_after").isNull(), F.col("span")))
    rows = landed.of_stretches(landed.read_landed(spark, folder, logs.schema), wanted)
    looked = enrich.swap_liquidity(rows, "swap", enrich.missing_ranges(e))
    return enrich.fill_liquidity(e, looked).select("pool", "block_number", "log_index", F.col("liquidity_after").cast("string").alias("liquidity_after"))


@query
def merged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three landed kinds as one log in order, each event with its place."""
    # the kinds are cut from what is written: each would make the log's windows again, in the few tasks that a union of them gets
    t = staged(pool_events(spark, sf_dir).select("ts_unix", "block_number", "log_index", "pool", "kind", "amount"))
    both = readers.merged(*(t.filter(F.col("kind") == k) for k in ("swap", "mint", "burn")))
    return state.in_order(both, "ts_unix", "block_number", "log_index", "pool").select("seq", "ts_unix", "block_number", "log_index", "pool", "kind")


@query
def entity_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of raw entities in any spelling come in one; what is none is NULL."""
    t = pool_events(spark, sf_dir)
    digits = F.lpad(F.lower(F.hex("event_id")), 40, "ab")
    of = lambda n: F.when((F.col("event_id") + n) % 4 == 0, F.concat(F.lit("0X"), F.upper(digits))).when((F.col("event_id") + n) % 4 == 1, F.concat(F.lit(" 0x"), digits)).when((F.col("event_id") + n) % 4 == 2, F.substring(digits, 1, 39)).otherwise(F.concat(F.lit("0x"), digits))
    text = lambda c: F.lit(None).cast("string").alias(c)
    raw = t.select("kind", F.struct(F.col("tx_hash").alias("id"), text("block")).alias("transaction"), *(of(n).alias(c) for n, c in enumerate(("origin", "sender", "owner", "recipient"))), *map(text, ("logIndex", "timestamp", "amount0", "amount1", "sqrtPriceX96", "tick", "tickLower", "tickUpper", "amount")))
    return readers.flattened(raw).select("tx_hash", "kind", "origin", "sender", "owner", "recipient")


@query
def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested raw entities of text numbers, flattened; fields that a kind does not have come out NULL."""
    t, text = pool_events(spark, sf_dir), lambda c: F.col(c).cast("string")
    raw = t.select(
        "kind", F.struct(F.col("tx_hash").alias("id"), text("block_number").alias("block")).alias("transaction"), text("log_index").alias("logIndex"), text("ts_unix").alias("timestamp"), "origin",
        F.lit("s").alias("sender"), F.lit("w").alias("owner"), F.lit("r").alias("recipient"), text("amount0").alias("amount0"), text("amount1").alias("amount1"), (text("q")).alias("sqrtPriceX96"),
        (F.col("q") % 40 - 20).cast("string").alias("tick"), F.lit("-10").alias("tickLower"), F.lit("10").alias("tickUpper"), (F.col("q") * 7).cast("string").alias("amount"),
    )
    f = readers.flattened(raw, addresses=False).withColumn("liquidity_delta", F.col("liquidity_delta").cast("long"))
    return f.select("block_number", "log_index", "ts_unix", "tx_hash", "kind", "origin", "sender", "owner", "recipient", "sqrt_event", "tick_event", "tick_lower", "tick_upper", "liquidity_delta", r("amount0", 5), r("amount1", 5))


@query
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as CSV, gzipped CSV and by appends to Parquet, read back by each path's ending, and counted by kind."""
    folder, t = shared_folder(spark, "files"), pool_events(spark, sf_dir).select("pool", "block_number", "log_index", "kind", "amount0", "amount1")
    t.write.option("header", True).csv(f"{folder}/log.csv")
    t.write.option("header", True).option("compression", "gzip").csv(f"{folder}/log.csv.gz")
    for kind in ("swap", "mint", "burn"):
        sinks.append(t.filter(F.col("kind") == kind).drop("amount1" if kind == "mint" else "tick"), f"{folder}/log.parquet", t.schema)
    out = None
    for n, end in enumerate(("csv", "csv.gz", "parquet")):
        e = readers.read_events(spark, f"{folder}/log.{end}", t.schema)
        part = e.groupBy(F.lit(n).alias("file"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count("amount1").alias("n_amount1"), r("net0", 2, F.sum("amount0")))
        out = part if out is None else out.unionByName(part)
    return out


@query
def tidy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections saved by fee, found again by their stem, and a table that is computed once and then read."""
    folder = shared_folder(spark, "tidy")
    jit = staged(detect.jit_cycles(pool_events(spark, sf_dir)).select("pool", "block_number", "pos", "n_victims"))
    for fee in (5, 30, 5):
        sinks.save_by_fee(jit.withColumn("fee_bps", F.lit(fee)), f"{folder}/by_fee.parquet")
    jit.write.parquet(f"{folder}/jit_cycles_5.parquet")
    found = readers.read_tidy(spark, folder, "jit_cycles")
    kept = [sinks.materialized(spark, f"{folder}/kept", lambda n=n: found.withColumn("run", F.lit(n))) for n in (0, 1)][-1]
    saved = spark.read.parquet(f"{folder}/by_fee.parquet").groupBy("pool").agg(F.count(F.lit(1)).alias("n_saved"), F.countDistinct("fee_bps").alias("n_fees"))
    return kept.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("run"), F.sum("n_victims").alias("victims")).join(saved, "pool")


@query
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern counts written as one CSV and as lines of text, read back."""
    folder = shared_folder(spark, "report")
    counts = staged(origin_counts(spark, sf_dir).filter("kind = 'pattern'"))
    sinks.write_report(counts, f"{folder}/patterns.csv", ["dataset", "key", "count"])
    sinks.write_lines(counts.select(F.concat_ws(" ", "dataset", F.col("count").cast("string")).alias("line")), f"{folder}/patterns.txt")
    lines = spark.read.text(f"{folder}/patterns.txt").select(F.split("value", " ").alias("x")).select(F.col("x")[0].alias("dataset"), F.col("x")[1].cast("long").alias("told"))
    table = spark.read.schema("dataset string, key string, count long").option("header", True).csv(f"{folder}/patterns.csv")
    # equal counts of two patterns make equal lines: every row has one line of its own
    nth = lambda df, *c: df.withColumn("_n", F.row_number().over(Window.partitionBy(*c).orderBy(*df.columns)))
    both = nth(table.withColumnRenamed("count", "told"), "dataset", "told").join(nth(lines, "dataset", "told"), ["dataset", "told", "_n"])
    return both.select("dataset", "key", F.col("told").alias("count"))


@query
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred events in the log's order."""
    return sinks.first_events(pool_events(spark, sf_dir).select("ts_unix", "block_number", "log_index", "pool", "kind"), 100, "ts_unix", "block_number", "log_index", "pool")


@query
def batch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.batch_ranges(pool_events(spark, sf_dir), "pool", "kind")


# --- enrichment and decoding ---------------------------------------------------------------------------------


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, g = F.col("event_id") % 5, F.col("event_id") % 4
    t = pool_events(spark, sf_dir)
    return t.withColumns({
        "origin": F.when(n == 0, None).when(n == 1, "").when(n == 2, "None").when(n == 3, "nan").otherwise(F.col("origin")),
        "gas_used": F.when(g == 0, 0.0).when(g == 1, None).otherwise(F.col("gas_used")), "effective_gas_price": F.when(g == 2, None).otherwise(F.col("gas_price") + 1),
    })


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of all transactions but every eleventh event's."""
    t = pool_events(spark, sf_dir).filter("event_id % 11 <> 0")
    return t.select("tx_hash", F.concat(F.lit("0x"), F.col("origin")).alias("from_addr"), (F.col("gas_used") * 2).alias("gas_used"), (F.col("gas_price") * 3).alias("gas_price"), (F.col("gas_price") * 4).alias("effective_gas_price"))


@query
def origin_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.fill_origin(gaps(spark, sf_dir), receipts(spark, sf_dir)).select("tx_hash", "event_id", "origin")


@query
def gas_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.fill_gas(gaps(spark, sf_dir), receipts(spark, sf_dir)).select("tx_hash", "event_id", *(r(c, 3) for c in enrich.GAS))


@query
def bucketed_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins and gas from tables dealt by transaction: bucket meets bucket, and the log is not shuffled."""
    e = landed.bucketed(gaps(spark, sf_dir), "tx_hash", 8)
    known = landed.bucketed(receipts(spark, sf_dir), "tx_hash", 8)
    lookup = known.groupBy("tx_hash").agg(F.min("from_addr").alias("from_addr"), F.min(F.struct(*enrich.GAS)).alias("_g"))
    both = landed.join_buckets(e, lookup, "tx_hash")
    own, need = F.when(~S.is_missing_text(F.col("origin")), F.col("origin")), enrich.missing_gas() & F.col("_g").isNotNull()
    filled = both.withColumns({c: F.when(need, F.col(f"_g.{c}")).otherwise(F.col(c)) for c in enrich.GAS} | {"origin": F.coalesce(own, "from_addr")})
    return filled.select("tx_hash", "event_id", "origin", *(r(c, 3) for c in enrich.GAS))


@query
def enrichment_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = gaps(spark, sf_dir)
    return enrich.worklist(e, S.is_missing_text(F.col("origin"))).join(enrich.worklist(e, enrich.missing_gas()), "tx_hash")


@query
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = gaps(spark, sf_dir)
    a = enrich.fill_rate(e, S.is_missing_text(F.col("origin"))).withColumn("attribute", F.lit("origin"))
    return a.unionByName(enrich.fill_rate(e, enrich.missing_gas()).withColumn("attribute", F.lit("gas")))


def swap_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs of the swaps: five words in hex; every thirteenth is cut short."""
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    t = pool_events(spark, sf_dir).filter("kind = 'swap'")
    tick = (F.col("q") % 40 - 20).cast("long")
    words = F.concat(
        F.lpad(F.lower(F.hex("q")), 64, "0"), F.lit("f" * 64), hexed(F.col("event_id"), 64), F.lit("0" * 32), hexed(F.col("event_id") % 90_000 + 1, 16), hexed(F.col("q") * 1_000_003, 16),
        F.when(tick < 0, F.concat(F.lit("f" * 48), F.lower(F.hex(tick)))).otherwise(F.lpad(F.lower(F.hex(tick)), 64, "0")),
    )
    data = F.concat(F.lit("0x"), F.when(F.col("event_id") % 13 == 0, F.substring(words, 1, 300)).otherwise(words))
    return t.select("pool", "block_number", "log_index", F.lit("swap").alias("topic0"), F.col("event_id").alias("seq"), data.alias("data"))


@query
def exact_reserves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-unit reserves of the swaps' liquidity at prices of up to 107 bits, digit by digit."""
    logs = enrich.decode_swap_logs(swap_logs(spark, sf_dir).filter("seq % 13 <> 0"))
    steps = F.create_map(*(F.lit(x) for n in range(21) for x in (n, str(1 << (96 - n)))))
    price = F.element_at(steps, (F.col("seq") % 21).cast("int")).cast("decimal(30,0)") * (F.col("seq") % 1000).cast("decimal(4,0)")
    at = logs.select("pool", "block_number", "log_index", state.exact_reserves(F.col("liquidity"), price.cast("decimal(38,0)")).alias("e"))
    return at.select("pool", "block_number", "log_index", "e.x", "e.y")


@query
def swap_log_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.decode_swap_logs(swap_logs(spark, sf_dir)).select("pool", "block_number", "log_index", F.col("liquidity").cast("string").alias("liquidity"), "tick")


@query
def wide_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity of up to 128 bits, more than a decimal holds, and amounts of up to 60 digits in whole units."""
    word = F.concat(F.lit("0" * 32), F.md5(F.col("seq").cast("string")))
    logs = swap_logs(spark, sf_dir).filter("seq % 13 <> 0").withColumn("data", F.concat(F.lit("0x" + "0" * 192), word, F.lit("0" * 64)))
    amount = F.concat(F.when(F.col("seq") % 3 == 0, "-").otherwise(""), F.col("seq").cast("string"), F.lit("1" * 40), F.lit("."), F.lpad((F.col("seq") % 97).cast("string"), 2, "0"))
    return enrich.decode_swap_logs(logs).select("pool", "block_number", "log_index", "liquidity_text", S.raw_units_text(amount, 6, strict=True).alias("units"), S.raw_units_text(amount, 1).alias("cut"))


@query
def liquidity_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = state_events(spark, sf_dir).withColumn("liquidity_after", F.when(F.col("log_index") % 2 == 0, F.col("liquidity_after")))
    looked = enrich.swap_liquidity(swap_logs(spark, sf_dir), "swap", enrich.missing_ranges(e))
    return enrich.fill_liquidity(e, looked).select("pool", "block_number", "log_index", F.col("liquidity_after").cast("string").alias("liquidity_after"))


def calldata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per swap whose calldata is built from its numbers, by event_id mod 8."""
    t = pool_events(spark, sf_dir).filter("kind = 'swap'")
    w = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    num = lambda v: F.lit(f"{v:064x}")
    token = lambda n: F.concat(F.lit("aa" * 19), F.lpad(F.lower(F.hex((F.col("event_id") + n) % 200)), 2, "0"))
    word_of = lambda a: F.concat(F.lit("0" * 24), a)
    q, lim = F.col("q").cast("long"), (F.col("q") - 1).cast("long")
    path = F.concat(token(1), F.lit("0001f4"), token(2), F.lit("000bb8"), token(3))  # 66 bytes
    padded = F.concat(path, F.lit("0" * 60))
    single = F.concat(word_of(token(1)), word_of(token(2)), num(500), word_of(token(9)), num(99), w(q), w(lim), num(0))
    routed = F.concat(num(32), num(160), word_of(token(9)), num(99), w(q), w(lim), num(66), padded)
    e_in, e_out = F.lit(decode.SELECTORS["exactInputSingle"]), F.lit(decode.SELECTORS["exactOutputSingle"])
    inner = F.concat(e_out, single, F.lit("0" * 56))
    multi = F.concat(num(32), num(2), num(64), num(128), num(4), F.lit("deadbeef" + "0" * 56), num(260), inner)
    command = F.concat(word_of(token(9)), w(q), w(lim), num(160), num(1), num(66), padded)
    execute = lambda c: F.concat(num(64), num(128), num(2), F.lit(c + "0" * 60), num(2), num(64), num(96), num(0), num(288), command)
    n = F.col("event_id") % 8
    sel = decode.SELECTORS
    data = (
        F.when(n == 0, F.concat(e_in, single)).when(n == 1, F.concat(e_out, single)).when(n == 2, F.concat(F.lit(sel["exactInput"]), routed))
        .when(n == 3, F.concat(F.lit(sel["exactOutput"]), routed)).when(n == 4, F.concat(F.lit(sel["multicall"]), multi))
        .when(n == 5, F.concat(F.lit(sel["execute"]), execute("0b80"))).when(n == 6, F.concat(F.lit(sel["execute"]), execute("0b01"))).otherwise(F.lit("12345678"))
    )
    own = F.when(n.isin(5, 6), decode.COMMAND_ROUTER).when(n == 1, decode.ROUTERS[1]).otherwise(F.concat(F.lit("0xE592"), F.substring(F.lit(decode.ROUTERS[0]), 7, 36)))
    to = F.when(F.col("event_id") % 10 == 9, "0x" + "12" * 20).when(F.col("event_id") % 10 == 8, None).otherwise(own)
    return t.select("event_id", "tx_hash", to.alias("to"), F.concat(F.lit("0x"), data).alias("input"), path.alias("path"), "q")


@query
def path_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of two hops; every fifth is cut short."""
    c = calldata(spark, sf_dir)
    p = F.when(F.col("event_id") % 5 == 0, F.substring("path", 1, 100)).otherwise(F.col("path"))
    return c.select("event_id", "tx_hash", joined("tokens", decode.path_tokens(p)), joined("fees", decode.path_fees(p)))


@query
def short_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of no, one, two and three tokens; one token alone is a path without a fee."""
    c = calldata(spark, sf_dir)
    p = F.substring(F.col("path"), F.lit(1), F.element_at(F.array(*map(F.lit, (0, 40, 86, 132))), (F.col("event_id") % 4 + 1).cast("int")))
    return c.select("event_id", "tx_hash", joined("tokens", decode.path_tokens(p)), joined("fees", decode.path_fees(p)))


@query
def slippage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slippage results written as CSV and read again, and the first twenty that are shown without a path."""
    c = calldata(spark, sf_dir)
    s = decode.slippage(c, c.select(F.concat(F.lit("0x"), F.col("tx_hash")).alias("tx_hash"), (F.col("q") + 3).alias("expected")))
    told = staged(s.select("tx_hash", "kind", "limit", "expected", r("tolerance_bps", 8), "error"))
    path = f"{shared_folder(spark, 'results')}/slippage.csv"
    sinks.write_results(told, path, "tx_hash")
    back = spark.read.schema(told.schema).option("header", True).csv(path)
    shown = sinks.write_results(told, None, "tx_hash").select("tx_hash", F.lit(True).alias("shown"))
    return back.join(shown, "tx_hash", "left").select(*told.columns, F.coalesce("shown", F.lit(False)).alias("shown"))


@query
def slippage_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.worklist(gaps(spark, sf_dir).withColumn("tx_hash", F.when(F.col("event_id") % 50 == 0, "None").otherwise(F.upper("tx_hash"))))


@query
def slippage_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calldata(spark, sf_dir)
    quotes = c.filter("event_id % 7 <> 0").select(F.concat(F.lit("0x"), F.col("tx_hash")).alias("tx_hash"), F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.col("q") + 3).alias("expected"))
    s = decode.slippage(c, quotes)
    return s.select("tx_hash", "kind", "token_in", "token_out", "fee", "amount_in", "amount_out", "limit", joined("fees"), "expected", r("tolerance_bps", 8), "error")


# --- reports -------------------------------------------------------------------------------------------------


def report_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables of jit, sandwich and backrun with their metrics, each kept once; the log is made once for all."""
    t = staged(pool_events(spark, sf_dir))
    frame = detect.block_frame(t)
    made = {
        "jit": lambda: augment.jit_metrics(detect.jit_cycles(t, frame)),
        "sandwich": lambda: augment.sandwich_metrics(detect.sandwiches(t, frame=frame), gamma=GAMMA),
        "backrun": lambda: augment.backrun_metrics(detect.without_sandwich_ends(detect.reverse_backruns(t, frame), detect.sandwich_ends(frame))),
    }
    return staged_together(*(made[n]().select(*REPORTED[n]) for n in names))


#: What reports read of each table: the rest, best sandwiches by grid above all, is never computed.
REPORTED = {
    "jit": ["pattern_type", "origin", "sigma_gross", "profit_total_per_x0"],
    "sandwich": ["pool", "block_number", "pos", "pattern_type", "origin", "victim_dir", "front_dir", "sigma_gross", "profit_per_x0", "sigma_min_backrun", "attacker_liq_share", "r", "front_a0", "front_a1", "back_a0", "back_a1", "s_net_token0", "s_net_token1"],
    "backrun": ["arb_origin", "sigma_gross", "profit_obs_per_x0", "reverse_label", "viable_sigma", "reverted", "near_target"],
}
DATASETS = ("jit", "sandwich", "backrun")


def metrics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jit, sand, back = report_tables(spark, sf_dir, *DATASETS)
    return report.summary({
        "jit": (jit, "sigma_gross", "profit_total_per_x0", "origin", "pattern_type", ()),
        "sandwich": (sand, "sigma_gross", "profit_per_x0", "origin", "pattern_type", ()),
        "backrun": (back, "sigma_gross", "profit_obs_per_x0", "arb_origin", "reverse_label", ("viable_sigma", "reverted", "near_target")),
    })


@query
def summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = {f"{a}_{b}": 12 for a in ("sigma", "profit") for b in ("mean", "p50", "p90", "p99")} | {f"{f}_true_share": 9 for f in ("viable_sigma", "reverted", "near_target")}
    return metrics_rows(spark, sf_dir).select("dataset", "n_rows", "n_unique_origins", "n_patterns", "sigma_n", "profit_n", "viable_sigma_n", "reverted_n", "near_target_n", *rounded(d))


@query
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown(metrics_rows(spark, sf_dir), DATASETS)


@query
def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles and distinct counts from the sketches that every stretch of blocks has left, held against the whole log."""
    t = staged(pool_events(spark, sf_dir).select("kind", "block_number", "q", "tx_hash"))
    left = staged(report.sketched(t, F.col("kind"), landed.stretch(F.col("block_number"), 50), F.col("q"), F.col("tx_hash")))
    told = report.merged_summary(left)
    ranks = [F.struct(F.avg((F.col("q") < F.col(f"p{p}")).cast("double")).alias("low"), F.avg((F.col("q") <= F.col(f"p{p}")).cast("double")).alias("high")).alias(f"r{p}") for p in (50, 90, 99)]
    true = t.join(told, t["kind"] == told["dataset"]).groupBy("dataset").agg(F.first("n_values").alias("n_values"), F.first("n_items").alias("_items"), F.countDistinct("tx_hash").alias("n_items"), *ranks)
    near = lambda p: ((F.col(f"r{p}.low") <= p / 100 + report.RANK_ERROR) & (F.col(f"r{p}.high") >= p / 100 - report.RANK_ERROR)).alias(f"p{p}_near")
    return true.select("dataset", "n_values", *map(near, (50, 90, 99)), (F.abs(F.col("_items") - F.col("n_items")) <= report.COUNT_ERROR * F.col("n_items")).alias("items_near"))


def origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jit, sand, back = report_tables(spark, sf_dir, *DATASETS)
    f = report.frequencies
    return report.combined(f(jit, "origin", "jit", "origin"), f(sand, "origin", "sandwich", "origin"), f(back, "arb_origin", "backrun", "origin"), f(sand, "pattern_type", "sandwich", "pattern"), f(back, "reverse_label", "backrun", "pattern"))


@query
def top_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(origin_counts(spark, sf_dir), 25)


@query
def pattern_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin_counts(spark, sf_dir).filter("kind = 'pattern'")


def series(spark: SparkSession, sf_dir: str, **how: bool) -> DataFrame:
    return staged(report.strategy_series(*report_tables(spark, sf_dir, *DATASETS), **({"by_origin": False} | how)))


@query
def strategy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select(r("sigma", 13), r("y", 12), "label", "origin", "under_threshold")


@query
def strategy_series_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with signed sizes, and of the classical sandwiches the self-funded ones only."""
    jit, sand, back = report_tables(spark, sf_dir, *DATASETS)
    s = report.strategy_series(jit, tape_units(sand), back, by_origin=True, absolute=False)
    return s.select(r("sigma", 13), r("y", 12), "label", "origin", "under_threshold")


@query
def highlighted_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.highlighted(series(spark, sf_dir), 1, 3, cap=3)


@query
def series_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return report.split_by_highlight(s, report.highlighted(s, 1, 2)).select("origin", "label", "under_threshold", "n_points", r("max_sigma", 12))


@query
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.series_summary(series(spark, sf_dir)).select("label", "n", r("median", 12), r("mean", 12), r("p90", 12))


def tape_units(sandwich: DataFrame) -> DataFrame:
    """Base units of the tape are ten thousands: five of them are the difference that legs of one size may have."""
    legs = {f"{leg}_a{n}": F.col(f"{leg}_a{n}") / 10000.0 for leg in ("front", "back") for n in (0, 1)}
    return sandwich.withColumns(legs | {"dec0": F.lit(0), "dec1": F.lit(0)})


@query
def self_funded_sandwiches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sandwiches whose two legs move the same amount, within five of the tape's base units; also after the fee is taken off."""
    sand = tape_units(report_tables(spark, sf_dir, "sandwich")[0])
    gross = report.self_funded(sand).select("pool", "block_number", "pos", "pattern_type", F.lit(False).alias("div_r"))
    return gross.unionByName(report.self_funded(sand, back_div_r=True).select("pool", "block_number", "pos", "pattern_type", F.lit(True).alias("div_r")))


@query
def sigma_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.value_range(series(spark, sf_dir), "y").select(r("lowest", 12), r("highest", 12), r("largest_abs", 12))


@query
def backrun_identity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.identity_rows(report_tables(spark, sf_dir, "sandwich")[0]).select("victim_dir", *rounded({"q_fr": 5, "v": 5, "alpha": 12, "q_br_obs": 5, "q_br_hat": 5}))


@query
def backrun_identity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(report.identity_rows(report_tables(spark, sf_dir, "sandwich")[0]))
    return report.identity_fit(rows).select("victim_dir", "overall", "n", *rounded(FIT_DIGITS))


FIT_DIGITS = {"corr_obs_hat": 7, "rmse": 4, "median_rel_error": 7, "share_br_below_fr": 9, "corr_av_gap": 7, "intercept": 2, "slope": 6}


@query
def backrun_identity_fit_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit with observed back-runs divided by what is left after the fee."""
    rows = staged(report.identity_rows(report_tables(spark, sf_dir, "sandwich")[0], back_div_r=True))
    return report.identity_fit(rows).select("victim_dir", "overall", "n", *rounded(FIT_DIGITS))


@query
def backrun_identity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scatter of front-runs against back-runs shows, in thousands of units."""
    rows = report.identity_rows(report_tables(spark, sf_dir, "sandwich")[0])
    return report.identity_pairs(rows, 1000.0).select("victim_dir", r("front_size", 8), r("back_size", 8), "below")


# --- sweeps over observed sizes ------------------------------------------------------------------------------

FEES_BPS = (1.0, 5.0, 30.0)


def observed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sizes of the log's swaps, as shares of a pool of a million units."""
    return pool_events(spark, sf_dir).filter("kind = 'swap'").select("q").distinct().withColumn("sigma", F.col("q") / F.lit(1e6))


@query
def strategy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit of each strategy at every observed size and fee."""
    s = staged(observed_sizes(spark, sf_dir))
    out = None
    for b in FEES_BPS:
        part = sweep.strategies(s, ["q"], b / 1e4, GAMMA)
        out = part if out is None else out.unionByName(part)
    return out.select("q", "fee_fraction", r("pi_jit", 12), r("pi_backrun", 12), r("pi_sandwich", 11))


@query
def epsilon_cap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.eps_caps(observed_sizes(spark, sf_dir), [0.0, 0.005, 0.01, 0.05], 0.997).select("q", "gamma", r("eps_max", 11), r("eps_max_jit", 11))


@query
def threshold_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fee, how many observed sizes pass the onset of back-runs and of sandwiches."""
    guides = report.threshold_guides(spark, list(FEES_BPS))
    s = observed_sizes(spark, sf_dir).crossJoin(F.broadcast(guides))  # three rows
    return s.groupBy("fee_bps").agg(r("sigma_min_backrun", 12, F.first("sigma_min_backrun")), r("sandwich_onset", 12, F.first("sandwich_onset")), F.count_if(F.col("sigma") >= F.col("sigma_min_backrun")).alias("n_backrun"), F.count_if(F.col("sigma") >= F.col("sandwich_onset")).alias("n_sandwich"))


ALPHA_MAX = 10.0


def optimum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best mixed bundle at every observed size and fee, or just-in-time liquidity alone where no back-run is funded."""
    s = staged(observed_sizes(spark, sf_dir)).withColumn("fee_bps", F.explode(F.array(*map(F.lit, FEES_BPS))))
    fee = F.col("fee_bps") / F.lit(1e4)
    best = sweep.mixed_optimum(s, ["q", "fee_bps"], fee, GAMMA, ALPHA_MAX)
    return best.withColumn("pi_best", F.coalesce("mixed_best", T.jit_profit(F.col("sigma"), fee, 1 - fee, F.lit(ALPHA_MAX))))


@query
def mixed_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth strategy of the comparison: profit of the best mixed bundle at every observed size and fee."""
    return optimum_rows(spark, sf_dir).select("fee_bps", "q", r("pi_best", 8), F.col("mixed_best").isNotNull().alias("feasible"))


@query
def regime_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front-run and added liquidity of the best bundle at every observed size and fee."""
    return optimum_rows(spark, sf_dir).select("fee_bps", "q", r("sigma", 9), r("eps_best", 6), r("alpha_best", 4), r("pi_best", 9), F.col("mixed_best").isNotNull().alias("feasible"))


@query
def mixed_curve(spark: SparkSession, sf_dir: str, n: int = 500) -> DataFrame:
    """Profit of the rational bundle (liquidity equal to the pool's, fee 0.3 %) along front-runs from 0 to the pool, at every observed size: its best point."""
    curve = sweep.rational_curve(observed_sizes(spark, sf_dir), ["q"], 0.0, 1.0, n, 1.0, 0.003)
    return curve.groupBy("q").agg(r("best", 10, F.max("profit")), r("worst", 10, F.min("profit")), F.count_if(F.col("profit") > 0).alias("n_paying"))


def profit_cube(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """The landscape of n x n points over front-runs and added liquidity, at every observed size."""
    return sweep.surface(observed_sizes(spark, sf_dir), sweep.grid(spark, "eps", 0.001, 0.99, n), sweep.grid(spark, "alpha", 0.001, 10.0, n), 0.997)


@query
def profit_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.surface_range(profit_cube(spark, sf_dir)).select("cells", r("lowest", 10), r("highest", 10), r("largest_abs", 10))


@query
def profit_surface_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extremes of the whole landscape: 500 x 500 points at every observed size."""
    return sweep.surface_range(profit_cube(spark, sf_dir, 500)).select("cells", r("lowest", 10), r("highest", 10), r("largest_abs", 10))


@query
def profit_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where profit changes its sign along added liquidity, over all observed sizes."""
    cells = sweep.zero_contour(observed_sizes(spark, sf_dir), sweep.grid(spark, "eps", 0.001, 0.99, 100), sweep.neighbours(spark, 0.001, 10.0, 100), 0.997)
    return cells.groupBy("i_eps").agg(F.count(F.lit(1)).alias("n_cells"), F.min("i_alpha").alias("first_alpha"))


@query
def alpha_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean slope of the mixed profit along added liquidity (400 points), at three front-runs, over all observed sizes."""
    curve = sweep.slope_along_alpha(observed_sizes(spark, sf_dir), sweep.grid(spark, "eps", 0.001, 0.02, 3), sweep.neighbours(spark, 0.001, 10.0, 400), 400, 0.997)
    return curve.groupBy("i_eps", "i_alpha").agg(r("mean_slope", 8, F.avg("slope")))
