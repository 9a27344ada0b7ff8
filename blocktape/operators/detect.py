"""Same-block patterns of the event log by window functions alone: one shuffle on (pool, block_number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktape.functions.scalars import direction, front_direction, is_swap, opposite, price, virtual_x, virtual_y

BLOCK = ["pool", "block_number"]
#: What an attacker's earlier event tells a later one.
OWN = [
    "pos", "kind", "is_swap", "dir", "front_dir", "run_prev", "run_next", "dir_next", "nsc", "tick_lower", "tick_upper", "amount0", "amount1",
    "amount", "tx_hash", "l_before", "sqrt_before", "x_before", "y_before", "l_prev", "sqrt_prev", "sqrt_event", "gas_used", "gas_price",
]


def numbered(events: DataFrame) -> DataFrame:
    """The log with pos, the event's place in its block, and the direction columns."""
    a0, a1, kind = F.col("amount0"), F.col("amount1"), F.lower("kind")
    return events.withColumns({
        "kind": kind, "origin_key": F.coalesce(F.lower("origin"), F.lit("nan")), "dir": direction(a0, a1),
        "is_swap": is_swap(kind, a0, a1), "front_dir": front_direction(a0, a1),
        "pos": F.row_number().over(Window.partitionBy(*BLOCK).orderBy("log_index", "tx_hash")),
    })


def block_frame(events: DataFrame) -> DataFrame:
    """Each event with its neighbours in the block, its run of equal swaps, and its origin's last three events."""
    wb = Window.partitionBy(*BLOCK).orderBy("pos")
    wa = Window.partitionBy(*BLOCK, "origin_key").orderBy("pos")
    key = F.struct("is_swap", "dir")
    upto = wb.rowsBetween(Window.unboundedPreceding, 0)
    out = numbered(events).withColumn("_new", (~key.eqNullSafe(F.lag(key).over(wb))).cast("int"))
    out = out.withColumns({"run": F.sum("_new").over(upto), "nsc": F.sum((~F.col("is_swap")).cast("int")).over(upto)})
    out = out.withColumns({
        "dir_next": F.lead("dir").over(wb), "run_next": F.lead("run").over(wb), "run_prev": F.lag("run").over(wb), "nsc_prev": F.lag("nsc").over(wb),
        "l_prev": F.lag("l_after").over(wb), "sqrt_prev": F.lag("sqrt_event").over(wb),
        "next": F.lead(F.struct("is_swap", "dir", "origin_key", "origin", "tx_hash", "amount0", "amount1", "sqrt_event", "gas_used", "gas_price")).over(wb),
    })
    own = F.struct(*OWN)
    return out.withColumns({f"own{k}": F.lag(own, k).over(wa) for k in (1, 2, 3)})


def state_before(of: Column | None = None) -> dict[str, Column]:
    """L0, sqrt0, x0, y0: the event's own state before it, else the previous event's after-state in the block."""
    c = (lambda n: F.col(n)) if of is None else (lambda n: of[n])
    l0, s0 = F.coalesce(c("l_before"), c("l_prev")), F.coalesce(c("sqrt_before"), c("sqrt_prev"))
    x0 = F.when(c("x_before").isNotNull(), c("x_before")).otherwise(virtual_x(l0, s0))
    y0 = F.when(c("x_before").isNotNull(), c("y_before")).otherwise(virtual_y(l0, s0))
    return {"l0": l0, "sqrt0": s0, "x0": x0, "y0": y0}


def liquidity_share(of: Column) -> Column:
    """Minted liquidity over liquidity after the mint; NULL where that is unknown or 0."""
    m, before = of["amount"], F.coalesce(of["l_before"], of["l_prev"])
    return F.when(m + before != 0, m / (m + before))


def named(**columns: Column) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def reverse_backruns(events: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Swap followed at once by another origin's swap in the other direction.  Matches may overlap."""
    f = block_frame(events) if frame is None else frame
    n = F.col("next")
    hit = f.filter(F.col("is_swap") & n["is_swap"] & (F.col("dir") != n["dir"]) & (F.col("origin_key") != n["origin_key"]))
    return hit.select(
        *BLOCK, "pos",
        *named(
            pattern_type=F.lit("ReverseBackrun"), victim_origin=F.col("origin_key"), arb_origin=n["origin_key"], victim_dir=F.col("dir"),
            victim_tx=F.col("tx_hash"), back_tx=n["tx_hash"], **state_before(), p_victim_pre=price(state_before()["sqrt0"]),
            p_victim_post=price(F.col("sqrt_event")), p_back_post=price(n["sqrt_event"]), s_net_token0=F.col("amount0"), s_net_token1=F.col("amount1"),
            back_a0=n["amount0"], back_a1=n["amount1"], gas_used=F.array(F.col("gas_used"), n["gas_used"]), gas_price=F.array(F.col("gas_price"), n["gas_price"]),
        ),
    )


def with_victims(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Adds sums, hashes and gas of the rows between v_lo and v_hi, and gas lists over all of g_before, victims and g_after.

    A match's members are found by an equi-join on the block and a range of places in it.
    """
    e = numbered(events).select(*BLOCK, F.col("pos").alias("_p"), F.col("amount0").alias("_a0"), F.col("amount1").alias("_a1"), F.col("tx_hash").alias("_tx"), F.col("gas_used").alias("_gu"), F.col("gas_price").alias("_gp"))
    key = [*BLOCK, "pos"]
    spans = matches.select(*key, "v_lo", "v_hi").join(e, BLOCK).filter("_p between v_lo and v_hi")
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_tx", "_gu", "_gp")))
    members = spans.groupBy(*key).agg(F.sum("_a0").alias("s_net_token0"), F.sum("_a1").alias("s_net_token1"), ordered.alias("_v"))
    out = matches.join(members, key)
    victims = lambda n: F.transform("_v", lambda v: v[n])
    return out.withColumns({
        "victim_txs": victims("_tx"), "n_victims": F.size("_v"),
        "gas_used": F.concat("gu_before", victims("_gu"), "gu_after"), "gas_price": F.concat("gp_before", victims("_gp"), "gp_after"),
    }).drop("_v", "v_lo", "v_hi", "gu_before", "gu_after", "gp_before", "gp_after")


def _gas(before: list[Column], after: list[Column]) -> dict[str, Column]:
    return {f"{s}_{w}": F.array(*(c[n] for c in cs)) for s, n in (("gu", "gas_used"), ("gp", "gas_price")) for w, cs in (("before", before), ("after", after))}


def jit_spans(f: DataFrame) -> DataFrame:
    """Cycles found in a block frame, with the places v_lo to v_hi of their victims."""
    m, me = F.col("own1"), F.struct("gas_used", "gas_price")
    hit = f.filter(
        (F.col("kind") == "burn") & (m["kind"] == "mint") & (m["tick_lower"] == F.col("tick_lower")) & (m["tick_upper"] == F.col("tick_upper"))
        & (F.col("pos") - m["pos"] > 1) & (F.col("nsc_prev") == m["nsc"])
    )
    return hit.select(
        *BLOCK, "pos",
        *named(
            v_lo=m["pos"] + 1, v_hi=F.col("pos") - 1, pattern_type=F.lit("Pure JIT"), origin=F.col("origin_key"), mint_tick_lower=m["tick_lower"],
            mint_tick_upper=m["tick_upper"], mint_tx=m["tx_hash"], burn_tx=F.col("tx_hash"), l0=m["l_before"], sqrt0=m["sqrt_before"],
            x0=virtual_x(m["l_before"], m["sqrt_before"]), y0=virtual_y(m["l_before"], m["sqrt_before"]), mint_amount=m["amount"], burn_amount=F.col("amount"),
            mint_amount0=m["amount0"], mint_amount1=m["amount1"], burn_amount0=F.col("amount0"), burn_amount1=F.col("amount1"),
            attacker_liq_share=liquidity_share(m), **_gas([m], [me]),
        ),
    )


def jit_cycles(events: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Mint, one or more swaps by others, burn of the same range by the minter, with nothing else between."""
    return with_victims(jit_spans(block_frame(events) if frame is None else frame), events)


def sandwich_hits(frame: DataFrame, min_victims: int = 1) -> DataFrame:
    """Rows of the block frame that end a sandwich, with ``front`` and ``is_jit``, left to right without overlap.

    Candidates can only touch where one's back swap is the next one's front; of such a chain every other
    one is kept, from the first.
    """
    if min_victims < 1:
        raise ValueError("min_victims must be at least 1")
    one, two, three = (F.col(f"own{k}") for k in (1, 2, 3))
    ends = F.col("is_swap") & F.col("dir").isNotNull()
    classical = (
        ends & one["is_swap"] & (F.col("dir") == opposite(one["front_dir"])) & (F.col("pos") - one["pos"] - 1 >= min_victims)
        & (one["dir_next"] == one["front_dir"]) & (one["run_next"] == F.col("run_prev"))
    )
    jit = (
        ends & (one["kind"] == "burn") & (two["kind"] == "mint") & three["is_swap"] & (F.col("dir") == opposite(three["front_dir"]))
        & (two["pos"] == three["pos"] + 1) & (F.col("pos") == one["pos"] + 1) & (one["pos"] - two["pos"] - 1 >= min_victims)
        & (two["dir_next"] == three["front_dir"]) & (two["run_next"] == one["run_prev"])
    )
    front = F.when(F.col("is_jit"), three).otherwise(one)
    hit = frame.withColumn("is_jit", F.coalesce(jit, F.lit(False))).filter(F.col("is_jit") | classical).withColumn("front", front).withColumn("start", F.col("front.pos"))
    by_end = Window.partitionBy(*BLOCK).orderBy("pos")
    hit = hit.withColumn("_head", F.coalesce(F.col("start") != F.lag("pos").over(by_end), F.lit(True)).cast("int"))
    hit = hit.withColumn("_chain", F.sum("_head").over(by_end.rowsBetween(Window.unboundedPreceding, 0)))
    return hit.withColumn("_nth", F.row_number().over(Window.partitionBy(*BLOCK, "_chain").orderBy("pos"))).filter("_nth % 2 = 1")


def sandwich_spans(f: DataFrame, min_victims: int = 1) -> DataFrame:
    """Sandwiches found in a block frame, with the places v_lo to v_hi of their victims."""
    hit = sandwich_hits(f, min_victims)
    one, two, three = (F.col(f"own{k}") for k in (1, 2, 3))
    fr, j, me = F.col("front"), F.col("is_jit"), F.struct("gas_used", "gas_price")
    only = lambda c: F.when(j, c)
    gas, gas_jit = _gas([fr], [me]), _gas([fr, two], [one, me])
    return hit.select(
        *BLOCK, "pos",
        *named(
            v_lo=F.when(j, two["pos"]).otherwise(fr["pos"]) + 1, v_hi=F.when(j, one["pos"]).otherwise(F.col("pos")) - 1,
            pattern_type=F.when(j, "JIT-Sandwich").otherwise("Classical"), origin=F.col("origin_key"), front_dir=fr["front_dir"], back_dir=F.col("dir"),
            front_a0=fr["amount0"], front_a1=fr["amount1"], back_a0=F.col("amount0"), back_a1=F.col("amount1"), mint_tx=only(two["tx_hash"]),
            burn_tx=only(one["tx_hash"]), front_tx=fr["tx_hash"], back_tx=F.col("tx_hash"), **state_before(fr), p_victim_pre=price(fr["sqrt_event"]),
            p_victim_post=price(F.when(j, one["sqrt_prev"]).otherwise(F.col("sqrt_prev"))), l_mint=only(two["amount"]), l_burn=only(one["amount"]),
            mint_amount0=only(two["amount0"]), mint_amount1=only(two["amount1"]), burn_amount0=only(one["amount0"]), burn_amount1=only(one["amount1"]),
            attacker_liq_share=only(liquidity_share(two)), **{n: F.when(j, gas_jit[n]).otherwise(gas[n]) for n in gas},
        ),
    )


def sandwiches(events: DataFrame, min_victims: int = 1, frame: DataFrame | None = None) -> DataFrame:
    """Classical and just-in-time sandwiches with their victims' sums and lists."""
    return with_victims(sandwich_spans(block_frame(events) if frame is None else frame, min_victims), events)


def sandwich_ends(frame: DataFrame) -> DataFrame:
    """(back_tx) of all sandwiches: no victim is looked up for it."""
    return sandwich_hits(frame).select(F.col("tx_hash").alias("back_tx"))


def without_sandwich_ends(backruns: DataFrame, sandwich: DataFrame) -> DataFrame:
    """Back-runs whose back transaction ends no sandwich; a NULL transaction matches none."""
    return backruns.join(sandwich.select("back_tx").filter("back_tx is not null").distinct(), "back_tx", "left_anti")


def without_sandwich_cycles(cycles: DataFrame, sandwich: DataFrame) -> DataFrame:
    """Optional: cycles whose mint belongs to no sandwich."""
    return cycles.join(sandwich.select("mint_tx").filter("mint_tx is not null").distinct(), "mint_tx", "left_anti")
