"""Live logs whose files interleave, against the batch operators; restarts, repeats and the size of the state."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from blocktape.operators import state
from blocktape.plans import queries as Q
from blocktape.streaming import live


@pytest.fixture(scope="module")
def log(spark, sf):
    """One pool of planted patterns and a piece of an organic one, with block times."""
    t = Q.with_block_time(Q.pool_events(spark, sf)).filter("pool = 'planted' or pool = 'p0' and block_number < 236740")
    return Q.staged(t)


def land(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/landed/part={name}")


def parts(df, n=4):
    """Pieces in which a block's rows are spread over two that follow one another."""
    low, high = df.agg(F.unix_timestamp(F.min("block_ts")), F.unix_timestamp(F.max("block_ts"))).first()
    span = (high - low) // (n - 1) + 1
    at = F.floor((F.unix_timestamp("block_ts") - low) / span) + F.pmod(F.xxhash64("tx_hash"), F.lit(2))
    return [df.filter(at == k) for k in range(n)], f"{2 * span} seconds"


def test_patterns_found_live_equal_batch_detection_across_a_restart(spark, log, tmp_path):
    pieces, delay = parts(log)
    run = lambda: live.stream_detections(spark, f"{tmp_path}/landed/*", log.schema, f"{tmp_path}/run", delay, files=1)
    for n in (0, 1):
        land(pieces[n], tmp_path, n)
    early = run().collect()
    land(pieces[1], tmp_path, "1-again")
    for n in (2, 3):
        land(pieces[n], tmp_path, n)
    open_yet = run().collect()
    land(live.end_mark(log, delay), tmp_path, "end")
    got = sorted(map(tuple, run().collect()))
    assert got == sorted(map(tuple, live.detections(log).collect())) and len(got) > len(open_yet) > len(early)
    assert {r[0] for r in got} == {"Pure JIT", "Classical", "JIT-Sandwich", "ReverseBackrun"}
    assert spark.conf.get(live.PROVIDER, "") != live.ROCKSDB


def test_keyed_state_equals_the_batch_and_its_store_stays_small(spark, sf, log, tmp_path):
    times = log.select("pool", "block_number", "block_ts").distinct()
    e = Q.staged(Q.state_events(spark, sf).join(times, ["pool", "block_number"]))
    pieces, delay = parts(e)
    start, told = Q.start_state(e), []
    run = live.run
    live.run = lambda *a: told.extend(run(*a))
    try:
        for n, piece in enumerate([*pieces, pieces[2], live.end_mark(e, delay)]):
            land(piece, tmp_path, n)
            if n in (1, 5):  # the second call goes on in the same folder
                got = live.stream_keyed_state(spark, f"{tmp_path}/landed/*", e.schema, start, f"{tmp_path}/run", delay, files=1)
    finally:
        live.run = run
    want = state.running_state(e, start)
    both = [sorted(map(tuple, Q.state_rows(x).collect()), key=repr) for x in (got, want)]
    assert both[0] == both[1]
    counted = {r.kind: r.n_events for r in live.observed_counters(spark, f"{tmp_path}/run").collect()}
    assert counted == {r.kind: r["count"] for r in e.groupBy("kind").count().collect()}
    held = [{op.operatorName: op.numRowsTotal for op in p.stateOperators} for p in told]
    pools = {n for n in held[-1] if n.startswith("transformWithState")}
    assert len(held[-1]) == 3 and all(held[-1][n] == e.select("pool").distinct().count() for n in pools)
    # the stores never hold the whole log: blocks and keys behind the watermark are let go
    blocks, keys = ([v for h in held for n, v in h.items() if n.startswith(x)] for x in ("stateStoreSave", "dedupe"))
    assert max(blocks) < e.select("pool", "block_number").distinct().count() and keys[-1] < e.count(), held


def test_rows_come_once_and_late_ones_are_let_go(spark, log, tmp_path):
    seen = []
    for n, rows in enumerate([log, log.limit(50), log]):
        land(rows, tmp_path, n)
        live.run(live.once(live.arriving(spark, f"{tmp_path}/landed/*", log.schema, files=1), "1 second"), lambda batch, k: seen.append(batch.count()), f"{tmp_path}/run")
    assert sum(seen) == log.count()


def test_a_pool_with_random_orders_and_gaps(spark, tmp_path):
    g, rows = random.Random(3), []
    for b in range(12):
        for i in range(g.randint(1, 4)):
            kind = g.choice(["swap", "mint", "burn"])
            swap = kind == "swap"
            rows.append(("x", b, i, kind, f"t{b}_{i}", None if swap else -10, None if swap else 10, g.random() if swap else None, str(10**30 + b) if swap else None, g.randint(-20, 20) if swap else None, None if swap else str(g.choice([5, -5])), 1_000_000 + 60 * b))
    schema = "pool string, block_number long, log_index long, kind string, tx_hash string, tick_lower int, tick_upper int, sqrt_event double, liquidity_after string, tick_event int, liquidity_delta string, block_ts long"
    e = spark.createDataFrame(g.sample(rows, len(rows)), schema).withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("liquidity_after", "liquidity_delta")} | {"block_ts": F.timestamp_seconds("block_ts")})
    land(e, tmp_path, 0)
    land(live.end_mark(e, "1 minute"), tmp_path, 1)
    start = Q.start_state(e)
    got = live.stream_keyed_state(spark, f"{tmp_path}/landed/*", e.schema, start, f"{tmp_path}/run", "1 minute", files=1)
    columns = ["block_number", "log_index", "affects_active", "l_before", "l_after", "tick_before", "tick_after", "sqrt_after"]
    assert got.select(*columns).orderBy(*columns[:2]).collect() == state.running_state(e, start).select(*columns).orderBy(*columns[:2]).collect()


def test_batches_follow_the_parts_and_stores_the_cores_whatever_tasks_there_are(spark, log, tmp_path, monkeypatch):
    rows = log.limit(400).repartition(6)  # six tasks write
    delay, files = Q.landed_live(rows, str(tmp_path))
    assert files == 1 and all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "landed").iterdir())
    told, run = [], live.run
    monkeypatch.setattr(live, "run", lambda *a: told.extend(run(*a)))
    with live.setting(spark, live.SHUFFLE, "50"):
        got = live.stream_detections(spark, f"{tmp_path}/landed/*", log.schema, f"{tmp_path}/run", delay, files=files)
        assert spark.conf.get(live.SHUFFLE) == "50"
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.detections(rows).collect()))
    assert len([p for p in told if p.numInputRows]) <= Q.PARTS + 2
    assert {op.numShufflePartitions for p in told for op in p.stateOperators} == {spark.sparkContext.defaultParallelism}


def test_a_part_of_many_rows_lands_in_more_files(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "FILE_ROWS", 10)
    rows = log.limit(400).repartition(6)
    assert Q.landed_live(rows, str(tmp_path))[1] == -(-rows.count() // 100) > 1
    assert spark.read.parquet(*(str(p) for p in (tmp_path / "landed").iterdir() if p.name[-2:] == "-0")).filter("pool <> '__end'").exceptAll(rows).count() == 0


def test_a_block_of_many_rows_waits_in_short_lists_and_its_state_goes_on_from_one_to_the_next(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "CHUNK", 3)
    g, rows = random.Random(5), []
    for pool, share in (("x", 0.3), ("y", 0.0), ("z", 1.0)):  # of swaps
        for b in range(3):
            for i in range(11):
                swap = g.random() < share
                low = g.choice([-10, 0])
                level = None if g.random() < 0.1 else str(10**30 + g.randint(0, 9)) if pool == "z" else "7"
                kind = "swap" if swap else g.choice(["mint", "burn"])
                rows.append((pool, b, i, kind, f"t{b}_{i}", None if swap else low, None if swap else low + 10, g.random() if swap else None, level if swap else None, g.randint(-20, 20) if swap else None, None if swap else g.choice(["5", "-5", "0"]), 1_000_000 + 60 * b))
    schema = "pool string, block_number long, log_index long, kind string, tx_hash string, tick_lower int, tick_upper int, sqrt_event double, liquidity_after string, tick_event int, liquidity_delta string, block_ts long"
    e = spark.createDataFrame(g.sample(rows, len(rows)), schema).withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("liquidity_after", "liquidity_delta")} | {"block_ts": F.timestamp_seconds("block_ts")})
    for n, part in enumerate((e.filter("log_index % 2 = 0"), e.filter("log_index % 2 = 1 OR block_number = 1"), live.end_mark(e, "5 minutes"))):
        land(part, tmp_path, n)
    sizes, start = [], Q.start_state(e).filter("pool <> 'x'")  # x has no start
    live.run(live.closed_chunks(live.arriving(spark, f"{tmp_path}/landed/*", e.schema, files=1), "5 minutes"), lambda batch, k: sizes.extend(len(r.rows) for r in batch.collect()), f"{tmp_path}/sizes")
    assert sorted(sizes) == [2] * 9 + [3] * 27
    got = live.stream_keyed_state(spark, f"{tmp_path}/landed/*", e.schema, start, f"{tmp_path}/run", "5 minutes", files=1)
    told = {(r.pool, r.block_number, r.log_index): r for r in got.collect()}
    assert len(told) == len(rows)
    for pool in "xyz":  # folded row by row
        level, tick = (None, None) if pool == "x" else (10**9, 0)
        for r in sorted((r for r in rows if r[0] == pool), key=lambda r: r[1:3]):
            t = told[r[:3]]
            assert (t.l_before, t.tick_before) == (level, tick)
            if r[3] == "swap":
                level, tick, want = None if r[8] is None else int(r[8]), r[9], (None, None)
                assert t.sqrt_after == r[7]
            else:
                inside = None if tick is None else r[5] <= tick < r[6]
                want = (inside, int(r[10]) if inside else 0)
                level = level + want[1] if level is not None else None
            assert (t.affects_active, t.delta_l_applied) == want and (t.l_after, t.tick_after) == (level, tick)
    assert {r.kind: r.n_events for r in live.observed_counters(spark, f"{tmp_path}/run").collect()} == {r.kind: r["count"] for r in e.groupBy("kind").count().collect()}


def test_a_pools_rows_pass_frame_by_frame_and_are_not_kept():
    class Store:
        value = None
        exists, get = lambda self: self.value is not None, lambda self: self.value

        def update(self, value):
            self.value = value

    taken, store, later = [], Store(), json.dumps([{"log_index": 1, "tick_lower": -10, "tick_upper": 10, "liquidity_delta": 5}])

    def frames():
        for n in (2, 0, 1):
            taken.append(n)
            one = {"pool": "x", "block_number": n, "time": n, "chunk": 0, "last_log": 1, "swapped": n == 1, "l": "40" if n == 1 else None, "s": 0.5 if n == 1 else None, "t": 3 if n == 1 else None, "later": later, "rows": "[]" + " " * n, "l0": "7", "sqrt0": 1.0, "tick0": 20}
            yield pd.DataFrame([one])

    state = live.PoolState()
    state.last = store
    passed = state.handleInputRows(("x",), frames(), None)
    assert next(passed)["rows"].tolist() == ["[]  "] and taken == [2]
    assert [f["rows"].tolist() for f in (next(passed), next(passed))] == [["[]"], ["[] "]]
    (carried,) = passed
    assert carried[["block_number", "l", "s", "t"]].values.tolist() == [[0, "7", 1.0, 20], [1, "7", 1.0, 20], [2, "45", 0.5, 3]]
    assert store.value == (2, 1, "50", 0.5, 3)
    assert len(list(state.handleInputRows(("x",), frames(), None))) == 3 and store.value == (2, 1, "50", 0.5, 3)  # replayed


def test_a_log_whose_block_times_go_back_is_whole(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    copies = [events.withColumns({"event_id": F.col("event_id") + 1000 * n, "user_id": F.col("user_id") + 30 * n}) for n in range(2)]  # the same times
    copies[0].unionByName(copies[1]).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = (sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect()), key=repr) for name in ("stream_keyed_state", "running_state"))
    assert got == want


def test_a_block_is_given_no_time_before_an_earlier_one(spark):
    times = spark.createDataFrame([("x", b, t) for b, t in ((1, 5), (2, 3), (9, 4), (10, 2), (11, 7), (25, 6))] + [("y", 30, 1)], "pool string, block_number long, block_ts long")
    assert sorted(map(tuple, Q.in_block_order(times, 10).collect())) == [("x", 1, 5), ("x", 2, 5), ("x", 9, 5), ("x", 10, 5), ("x", 11, 7), ("x", 25, 7), ("y", 30, 1)]
