"""Detection and state against sequential restatements on random logs."""

import random

import pytest
from pyspark.sql import functions as F

from blocktape.operators import detect, state

COLUMNS = "pool string, block_number long, log_index long, kind string, tx_hash string, origin string, amount0 double, amount1 double, amount double, tick_lower int, tick_upper int, gas_used double, gas_price double, l_before double, sqrt_before double, x_before double, y_before double, l_after double, sqrt_event double"
Q = float(1 << 96)


def random_log(seed, blocks=300):
    rng, rows = random.Random(seed), []
    for b in range(blocks):
        for i in range(rng.randint(1, 9)):
            kind = rng.choices(["swap", "mint", "burn"], [5, 1.5, 1.5])[0]
            origin = rng.choice(["a", "b", "c", None]) if rng.random() < 0.9 else "A"
            if kind == "swap":
                d = rng.choice([1, -1, 1, -1, 1, -1, 0])
                a0, a1 = (5.0 * d, -4.0 * d) if d else (3.0, 2.0)
                ticks = (None, None)
            else:
                a0, a1, ticks = 2.0, 3.0, rng.choice([(-10, 10), (-10, 10), (0, 20), (None, 10)])
            rows.append(("p", b, i, kind, f"t{b}_{i}", origin, a0, a1, 7.0 if kind != "swap" else None, *ticks, 1.0, 2.0, None if i % 3 else 5.0, None if i % 3 else Q, None, None, 6.0, Q if kind == "swap" else None))
    return rows


def way(e):
    return "x" if e[6] > 0 > e[7] else "y" if e[6] < 0 < e[7] else None


def who(e):
    return (e[5] or "nan").lower()


def sequential(events, least):
    back, jit, sand = [], [], []
    n = len(events)
    for i in range(n - 1):
        a, b = events[i], events[i + 1]
        if a[3] == b[3] == "swap" and way(a) and way(b) and way(a) != way(b) and who(a) != who(b):
            back.append(i)
    i = 0
    while i < n:
        if events[i][3] == "mint":
            k = i + 1
            while k < n and events[k][3] == "swap" and who(events[k]) != who(events[i]):
                k += 1
            m = events[i]
            if k > i + 1 and k < n and events[k][3] == "burn" and who(events[k]) == who(m) and None not in (m[9], m[10]) and m[9:11] == events[k][9:11]:
                jit.append((i, k))
                i = k + 1
                continue
        i += 1
    i = 0
    while i < n:
        f = events[i]
        if f[3] != "swap":
            i += 1
            continue
        d = way(f) or ("x" if f[6] > 0 else "y")

        def victims(k, d=d, f=f):
            while k < n and events[k][3] == "swap" and way(events[k]) == d and who(events[k]) != who(f):
                k += 1
            return k

        def ends(k, d=d, f=f):
            return k < n and events[k][3] == "swap" and way(events[k]) not in (None, d) and who(events[k]) == who(f)

        if i + 1 < n and events[i + 1][3] == "mint" and who(events[i + 1]) == who(f):
            k = victims(i + 2)
            if k - (i + 2) >= least and k < n and events[k][3] == "burn" and who(events[k]) == who(f) and ends(k + 1):
                sand.append((i, k + 1, True))
                i = k + 2
                continue
        k = victims(i + 1)
        if k - (i + 1) >= least and ends(k):
            sand.append((i, k, False))
            i = k + 1
            continue
        i += 1
    return back, jit, sand


@pytest.mark.parametrize("least", [1, 2])
def test_patterns_match_a_sequential_scan(spark, least):
    rows = random_log(least)
    df = spark.createDataFrame(rows, COLUMNS)
    blocks = {}
    for row in rows:
        blocks.setdefault(row[1], []).append(row)
    want_b, want_j, want_s = set(), set(), set()
    for b, events in blocks.items():
        back, jit, sand = sequential(events, least)
        want_b |= {(b, i + 1) for i in back}
        want_j |= {(b, k + 1) for _, k in jit}
        want_s |= {(b, events[i][4], events[k][4], j) for i, k, j in sand}
    assert {(r.block_number, r.pos) for r in detect.reverse_backruns(df).collect()} == want_b
    assert {(r.block_number, r.pos) for r in detect.jit_cycles(df).collect()} == want_j
    got = detect.sandwiches(df, least)
    assert {(r.block_number, r.front_tx, r.back_tx, r.pattern_type == "JIT-Sandwich") for r in got.collect()} == want_s
    left = detect.without_sandwich_ends(detect.reverse_backruns(df), got)
    assert not {r.back_tx for r in left.collect()} & {s[2] for s in want_s}
    with pytest.raises(ValueError):
        detect.sandwiches(df, 0)


def test_detection_plan_has_one_exchange_and_no_python(spark):
    df = spark.createDataFrame(random_log(3, 20), COLUMNS)
    plan = detect.reverse_backruns(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_running_state_is_the_sequential_fold(spark, bucket):
    rng, rows, want = random.Random(bucket), [], {}
    for pool in ("p", "q"):
        l, s, t = 1000, 1.0, 0
        for b in range(40):
            for i in range(rng.randint(0, 3)):
                kind = rng.choices(["swap", "mint", "burn"], [1, 3, 3])[0]
                lo = rng.randint(-3, 1)
                delta = rng.randint(1, 9) * (1 if kind == "mint" else -1) if kind != "swap" else None
                before = l
                if kind == "swap":
                    l, s, t = rng.randint(500, 2000), float(rng.randint(1, 5)), rng.randint(-3, 3)
                    rows.append((pool, b, i, kind, l, s, t, None, None, None))
                else:
                    if lo <= t < lo + 2:
                        l += delta
                    rows.append((pool, b, i, kind, None, None, None, delta, lo, lo + 2))
                want[pool, b, i] = (before, l, t, s)
    df = spark.createDataFrame(rows, "pool string, block_number long, log_index long, kind string, liquidity_after long, sqrt_event double, tick_event int, liquidity_delta long, tick_lower int, tick_upper int")
    start = spark.createDataFrame([("p", 1000, 1.0, 0), ("q", 1000, 1.0, 0)], "pool string, l0 long, sqrt0 double, tick0 int")
    got = state.running_state(df, start, bucket_blocks=bucket).collect()
    assert {(r.pool, r.block_number, r.log_index): (r.l_before, r.l_after, r.tick_after, r.sqrt_after) for r in got} == want


def test_buckets_follow_the_rows_even_within_a_block(spark, monkeypatch):
    monkeypatch.setattr(state, "BUCKET_ROWS", 4)
    swap = lambda i: i % 7 == 3
    rows = [("p", 5 + i // 15, i % 15, "swap" if swap(i) else "mint", 1000 + i if swap(i) else None, float(i) if swap(i) else None, i % 3 if swap(i) else None, None if swap(i) else 1 + i, None if swap(i) else 0, None if swap(i) else 2) for i in range(30)]
    df = spark.createDataFrame(rows, "pool string, block_number long, log_index long, kind string, liquidity_after long, sqrt_event double, tick_event int, liquidity_delta long, tick_lower int, tick_upper int")
    start = spark.createDataFrame([("p", 1000, 1.0, 0)], "pool string, l0 long, sqrt0 double, tick0 int")
    got, want = (state.running_state(df, start, bucket_blocks=b) for b in (None, 1000))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    per_task = got.withColumn("_task", F.spark_partition_id()).groupBy("_task").count()
    assert per_task.count() > 1  # a pool's two blocks were one task's
