"""Registered queries against their SQL, and sources, sinks and the stream."""

import math
import os
import random
import re
from decimal import Decimal

import duckdb
import pytest

from blocktape.functions import scalars as S
from blocktape.operators import decode, enrich, state
from blocktape.plans import report
from blocktape.plans.oracle import ORACLE
from blocktape.plans.queries import QUERIES, start_state, state_events, state_rows
from blocktape.sources import readers, sinks
from blocktape.streaming import harvest

CHEAP = [
    "pool_tape", "reverse_backruns", "jit_cycles", "sandwich_jit", "sandwich_metrics", "running_state", "summary_metrics", "gas_enrichment", "swap_log_decode", "slippage_tolerance", "epsilon_cap_sweep",
    "scalar_normalizers", "summary_lines", "self_funded_sandwiches", "backrun_identity_fit_net", "backrun_identity_pairs", "exact_reserves", "raw_entities", "log_files", "tidy_files",
    "report_files", "first_events", "slippage_worklist", "backrun_fee_tiers", "alpha_slope", "mixed_curve", "closed_block_backruns", "stream_counters", "strategy_series_by_origin",
    "landed_window", "landed_refill", "merged_log", "entity_addresses", "bucketed_enrichment", "wide_liquidity", "short_paths", "slippage_files", "merged_summaries", "stream_restart", "regime_transition", "top_origins",
]


def told(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    con.execute(ORACLE[name])
    have = [d[0] for d in con.description]
    assert sorted(have) == cols
    want = sorted(tuple(told(r[have.index(c)]) for c in cols) for r in con.fetchall())
    assert sorted(tuple(told(v) for v in r) for r in df.select(*cols).collect()) == want


def test_stream_equals_batch(spark, sf):
    batch = QUERIES["running_state"](spark, sf)
    assert QUERIES["stream_running_state"](spark, sf).exceptAll(batch).count() == 0


def test_stream_keeps_all_rows_of_parts_with_three_files(spark, sf):
    batch = QUERIES["running_state"](spark, sf)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        done = QUERIES["stream_running_state"](spark, sf)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert done.count() == batch.count() and done.exceptAll(batch).count() == 0


def test_refill_reaches_every_swap_that_lacks_liquidity(spark, sf):
    events = spark.createDataFrame([("a", 5, 1, "swap", None), ("a", 900_000, 1, "swap", None), ("b", 7, 0, "swap", None), ("b", 8, 0, "swap", Decimal(4)), ("b", 9, 0, "mint", None)], "pool string, block_number long, log_index long, kind string, liquidity_after decimal(38,0)")
    data = "0x" + "0" * 192 + f"{77:064x}" + "0" * 64
    logs = events.selectExpr("pool", "block_number", "log_index", "'swap' as topic0", "1 as seq", f"'{data}' as data")
    got = enrich.fill_liquidity(events, enrich.swap_liquidity(logs, "swap", enrich.missing_ranges(events))).collect()
    assert {(r.pool, r.block_number): r.liquidity_after for r in got} == {("a", 5): 77, ("a", 900_000): 77, ("b", 7): 77, ("b", 8): 4, ("b", 9): None}
    refilled = QUERIES["liquidity_refill"](spark, sf).filter("liquidity_after is not null").select("pool", "block_number", "log_index")
    own = state_events(spark, sf).filter("kind = 'swap' and log_index % 2 = 0").select("pool", "block_number", "log_index")
    sound = QUERIES["swap_log_decode"](spark, sf).filter("liquidity is not null").select("pool", "block_number", "log_index")
    assert refilled.exceptAll(own.union(sound).distinct()).count() == own.union(sound).distinct().exceptAll(refilled).count() == 0


def test_every_oracle_names_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_readers_and_sinks(spark, tmp_path):
    raw = spark.createDataFrame([("Swap", "0x10", 1, "0xAB", " O ", "1.5", "-2")], "eventType string, blockNumber string, logIndex long, transactionHash string, owner string, amount0 string, amount1 string")
    raw.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "log.csv"))
    c = readers.canonical(readers.read_events(spark, str(tmp_path / "log.csv")).withColumn("blockNumber", readers.F.lit(16)), pool="P").first()
    assert (c.kind, c.origin, c.amount0, c.pool, c.l_before) == ("swap", "o", 1.5, "p", None)
    with pytest.raises(ValueError):
        readers.canonical(raw.drop("amount0"))
    with pytest.raises(ValueError):
        readers.read_events(spark, "log.pkl")
    assert readers.first_existing(spark, str(tmp_path / "none*"), str(tmp_path / "l*.csv")).endswith("log.csv")
    where = str(tmp_path / "kept")
    assert sinks.materialized(spark, where, lambda: spark.range(3)).count() == 3
    assert sinks.materialized(spark, where, lambda: spark.range(5)).count() == 3
    assert sinks.materialized(spark, where, lambda: spark.range(5), recompute=True).count() == 5
    with pytest.raises(FileNotFoundError):
        sinks.fresh_version(spark, str(tmp_path / "runs"), resume=True)
    assert sinks.fresh_version(spark, str(tmp_path / "runs"), resume=False).endswith("v0")
    padded = sinks.to_schema(spark.range(1), state_schema(spark))
    assert padded.columns == ["id", "x"] and padded.first().x is None


def state_schema(spark):
    return spark.createDataFrame([], "id long, x double").schema


def test_calldata_cut_short_gives_no_guard():
    to = decode.ROUTERS[0].upper()
    assert decode.calldata_guard(None, to) is None and decode.calldata_guard("0x414bf389" + "00" * 31, to) is None and decode.calldata_guard("zz", to) is None
    assert decode.calldata_guard("0x414bf389" + "00" * 256, to)["kind"] == "exactInputSingle"
    assert all(decode.calldata_guard("0x414bf389" + "00" * 256, x) is None for x in (None, "0x12", decode.COMMAND_ROUTER))


def test_state_events_have_no_swap_without_liquidity(spark, sf):
    assert state_events(spark, sf).filter("kind = 'swap' and liquidity_after is null").count() == 0


def stream_parts(spark, sf, folder):
    """The log in three parts by block, written one after another by the caller."""
    e = state_events(spark, sf)
    cuts = sorted(r[0] for r in e.select("block_number").distinct().collect())
    low, high = cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3]
    parts = [e.filter(f"block_number <= {low}"), e.filter(f"block_number > {low} and block_number <= {high}"), e.filter(f"block_number > {high}")]
    return e, [lambda n=n, p=p: p.write.parquet(f"{folder}/landed/part={n}") for n, p in enumerate(parts)]


def test_stream_resumes_repeats_a_batch_and_starts_afresh(spark, sf, tmp_path):
    folder = str(tmp_path)
    e, land = stream_parts(spark, sf, folder)
    start, run = start_state(e), harvest.run_folder(folder, gamma=0.01)
    go = lambda where: harvest.stream_running_state(spark, f"{folder}/landed/*", e.schema, start, where)
    land[0]()
    go(run)
    land[1]()
    before = sorted(map(str, go(run).collect()))  # goes on where it stopped
    for name in ("1", ".1.crc"):  # as if the driver had died before the second batch was committed
        (tmp_path / os.path.basename(run) / "checkpoint" / "commits" / name).unlink()
    assert sorted(map(str, go(run).collect())) == before
    land[2]()
    want = state_rows(state.running_state(e, start))
    done = state_rows(go(run))
    assert done.count() == want.count() and done.exceptAll(want).count() == 0
    other = harvest.run_folder(folder, gamma=0.02)
    assert other != run and state_rows(go(other)).exceptAll(want).count() == 0
    told = {r.kind: r.n_events for r in harvest.counters(spark, run).collect()}
    assert told == {r["kind"]: r["count"] for r in e.groupBy("kind").count().collect()}


def test_quantiles_by_ranges(spark):
    g = random.Random(3)
    rows = [("a", g.choice([0.0, 0.0, 0.0, g.random()])) for _ in range(3000)] + [("b", 7.0)] * 5 + [("c", None), ("d", 1.0), ("d", 2.0)]
    levels = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    got = {r.k: list(r.q) for r in report.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], levels).collect()}
    for k in "abd":
        values = sorted(v for x, v in rows if x == k)
        for q, told in zip(levels, got[k], strict=True):
            at = (len(values) - 1) * q
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert told == pytest.approx(low + (high - low) * (at - math.floor(at)), abs=1e-12)
    assert "c" not in got


def test_reports_and_sweeps_gather_nothing_in_one_group(spark, sf):
    for name in ("summary_metrics", "series_summary", "reverse_backrun_summary", "backrun_identity_fit"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString().lower()
        assert "percentile" not in plan and "median(" not in plan and "collect_" not in plan, name
    plan = QUERIES["profit_surface"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for part in re.split("BroadcastExchange", plan)[1:]:
        assert "Range" in part.split("FileScan")[0]  # only parameter grids are sent to all


def test_numbers_as_text(spark):
    values = [0.0, 1.5, 100000.0, 999999.5, 1234567.0, 0.0001, 0.00001234567, -2.5e-300, 3e22, 123.456789]
    got = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "v double").select(S.general(S.F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{v:.6g}" for v in values] + [None] * 3
