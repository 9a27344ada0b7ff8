"""The registered queries in SQL, written apart from the DataFrame code: joins and subqueries where that uses windows."""

from __future__ import annotations

import math

from blocktape.functions.theory import backrun_threshold, backrun_vs_jit, sandwich_onset
from blocktape.sources.tape import TAPE_SQL

F5, R5 = 5 / 10_000.0, 1 - 5 / 10_000.0
GAMMA = 0.01
Q96 = "79228162514264337593543950336.0::DOUBLE"


def lit(x: float) -> str:
    return f"'{x!r}'::DOUBLE"


f, r = lit(F5), lit(R5)


def rd(name: str, digits: int, source: str | None = None) -> str:
    return f"round(({source or name})::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


def rds(digits: dict[str, int]) -> str:
    return ", ".join(rd(n, d) for n, d in digits.items())


def fin(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def div(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) <> 0 AND isfinite(({n}) / ({d})) THEN ({n}) / ({d}) END"


#: Events with place, direction and the place of the same origin's next event.
E_SQL = """
e AS (
  SELECT *, row_number() OVER (PARTITION BY pool, block_number ORDER BY log_index, tx_hash) AS pos, lower(origin) AS who,
         CASE WHEN amount0 > 0 AND amount1 < 0 THEN 'x2y' WHEN amount0 < 0 AND amount1 > 0 THEN 'y2x' END AS dir
  FROM tape),
o AS (SELECT *, lead(pos) OVER (PARTITION BY pool, block_number, who ORDER BY pos) AS own_next FROM e),
pre AS (
  SELECT a.*, coalesce(a.l_before, b.l_after) AS l0, coalesce(a.sqrt_before, b.sqrt_event) AS sq0
  FROM o a LEFT JOIN o b ON b.pool = a.pool AND b.block_number = a.block_number AND b.pos = a.pos - 1),
s AS (
  SELECT *, CASE WHEN x_before IS NOT NULL THEN x_before WHEN sq0 > 0 THEN l0 / (sq0 / Q96) END AS x0,
         CASE WHEN x_before IS NOT NULL THEN y_before WHEN sq0 > 0 THEN l0 * (sq0 / Q96) END AS y0, (sqrt_event / Q96) * (sqrt_event / Q96) AS p_event
  FROM pre)
""".replace("Q96", Q96)

BACK_SQL = f"""
back AS (
  SELECT a.pool, a.block_number, a.pos, 'ReverseBackrun' AS pattern_type, a.who AS victim_origin, b.who AS arb_origin, a.dir AS victim_dir,
         a.tx_hash AS victim_tx, b.tx_hash AS back_tx, a.l0, a.x0, a.y0, (a.sq0 / {Q96}) * (a.sq0 / {Q96}) AS p_victim_pre, a.p_event AS p_victim_post,
         b.p_event AS p_back_post, a.amount0 AS s_net_token0, a.amount1 AS s_net_token1, b.amount0 AS back_a0, b.amount1 AS back_a1,
         a.gas_used || ',' || b.gas_used AS gas_used, a.gas_price || ',' || b.gas_price AS gas_price
  FROM s a JOIN s b ON a.pool = b.pool AND a.block_number = b.block_number AND b.pos = a.pos + 1 AND a.dir <> b.dir AND a.who <> b.who)
"""

JIT_SQL = """
jm AS (
  SELECT m.pool, m.block_number, m.pos AS m_pos, b.pos AS pos
  FROM s m JOIN s b ON m.pool = b.pool AND m.block_number = b.block_number AND b.pos = m.own_next AND b.kind = 'burn'
  WHERE m.kind = 'mint' AND m.tick_lower = b.tick_lower AND m.tick_upper = b.tick_upper AND b.pos > m.pos + 1
    AND NOT EXISTS (SELECT 1 FROM s x WHERE x.pool = m.pool AND x.block_number = m.block_number AND x.pos > m.pos AND x.pos < b.pos AND x.kind <> 'swap')),
jv AS (
  SELECT jm.pool, jm.block_number, jm.pos, sum(v.amount0 ORDER BY v.pos) AS s_net_token0, sum(v.amount1 ORDER BY v.pos) AS s_net_token1, count(*) AS n_victims,
         string_agg(v.tx_hash, ',' ORDER BY v.pos) AS victim_txs, string_agg(v.gas_used::VARCHAR, ',' ORDER BY v.pos) AS vgu, string_agg(v.gas_price::VARCHAR, ',' ORDER BY v.pos) AS vgp
  FROM jm JOIN s v ON v.pool = jm.pool AND v.block_number = jm.block_number AND v.pos > jm.m_pos AND v.pos < jm.pos GROUP BY ALL),
jit AS (
  SELECT jm.pool, jm.block_number, jm.pos, m.who AS origin, m.tick_lower AS mint_tick_lower, m.tick_upper AS mint_tick_upper, m.tx_hash AS mint_tx, b.tx_hash AS burn_tx,
         n_victims, victim_txs, m.l_before AS l0, m.l_before / (m.sqrt_before / Q96) AS x0, m.l_before * (m.sqrt_before / Q96) AS y0, s_net_token0, s_net_token1,
         m.amount AS mint_amount, b.amount AS burn_amount, m.amount0 AS mint_amount0, m.amount1 AS mint_amount1, b.amount0 AS burn_amount0, b.amount1 AS burn_amount1,
         m.amount / (m.amount + m.l0) AS attacker_liq_share, m.gas_used || ',' || vgu || ',' || b.gas_used AS gas_used, m.gas_price || ',' || vgp || ',' || b.gas_price AS gas_price
  FROM jm JOIN jv USING (pool, block_number, pos)
  JOIN s m ON m.pool = jm.pool AND m.block_number = jm.block_number AND m.pos = jm.m_pos
  JOIN s b ON b.pool = jm.pool AND b.block_number = jm.block_number AND b.pos = jm.pos)
""".replace("Q96", Q96)


def sandwich_sql(least: int = 1) -> str:
    """Candidates by joins on consecutive own events; then from each block's first front to the next free one."""
    return f"""
c4 AS (
  SELECT f.pool, f.block_number, f.pos AS a, b.pos AS z, f.pos + 1 AS v_lo, b.pos - 1 AS v_hi, f.dir, false AS j
  FROM s f JOIN s b ON f.pool = b.pool AND f.block_number = b.block_number AND b.pos = f.own_next
  WHERE f.dir <> b.dir AND b.pos - f.pos - 1 >= {least}),
c3 AS (
  SELECT f.pool, f.block_number, f.pos AS a, b.pos AS z, m.pos + 1 AS v_lo, u.pos - 1 AS v_hi, f.dir, true AS j
  FROM s f JOIN s m ON f.pool = m.pool AND f.block_number = m.block_number AND m.pos = f.own_next AND m.pos = f.pos + 1 AND m.kind = 'mint'
  JOIN s u ON f.pool = u.pool AND f.block_number = u.block_number AND u.pos = m.own_next AND u.kind = 'burn'
  JOIN s b ON f.pool = b.pool AND f.block_number = b.block_number AND b.pos = u.own_next AND b.pos = u.pos + 1
  WHERE f.dir <> b.dir AND u.pos - m.pos - 1 >= {least}),
cand AS (
  SELECT * FROM (SELECT * FROM c4 UNION ALL SELECT * FROM c3) c
  WHERE NOT EXISTS (
    SELECT 1 FROM s v WHERE v.pool = c.pool AND v.block_number = c.block_number AND v.pos BETWEEN c.v_lo AND c.v_hi AND v.dir IS DISTINCT FROM c.dir)),
g AS (
  SELECT pool, block_number, min(a) AS a, 1 AS n FROM cand GROUP BY pool, block_number
  UNION ALL
  SELECT g.pool, g.block_number, (SELECT min(c.a) FROM cand c WHERE c.pool = g.pool AND c.block_number = g.block_number AND c.a > k.z), g.n + 1
  FROM g JOIN cand k ON k.pool = g.pool AND k.block_number = g.block_number AND k.a = g.a WHERE g.a IS NOT NULL),
sm AS (SELECT cand.* FROM cand JOIN g USING (pool, block_number, a)),
sv AS (
  SELECT sm.pool, sm.block_number, sm.a, sum(v.amount0 ORDER BY v.pos) AS s_net_token0, sum(v.amount1 ORDER BY v.pos) AS s_net_token1, count(*) AS n_victims,
         string_agg(v.tx_hash, ',' ORDER BY v.pos) AS victim_txs, string_agg(v.gas_used::VARCHAR, ',' ORDER BY v.pos) AS vgu, string_agg(v.gas_price::VARCHAR, ',' ORDER BY v.pos) AS vgp
  FROM sm JOIN s v ON v.pool = sm.pool AND v.block_number = sm.block_number AND v.pos BETWEEN sm.v_lo AND sm.v_hi GROUP BY ALL),
sand AS (
  SELECT sm.pool, sm.block_number, sm.z AS pos, CASE WHEN sm.j THEN 'JIT-Sandwich' ELSE 'Classical' END AS pattern_type, f.who AS origin, f.dir AS front_dir, b.dir AS back_dir,
         f.tx_hash AS front_tx, b.tx_hash AS back_tx, m.tx_hash AS mint_tx, u.tx_hash AS burn_tx, n_victims, victim_txs, f.l0, f.x0, f.y0, f.p_event AS p_victim_pre,
         (SELECT v.p_event FROM s v WHERE v.pool = sm.pool AND v.block_number = sm.block_number AND v.pos = sm.v_hi) AS p_victim_post, s_net_token0, s_net_token1,
         f.amount0 AS front_a0, f.amount1 AS front_a1, b.amount0 AS back_a0, b.amount1 AS back_a1, m.amount AS l_mint, u.amount AS l_burn,
         m.amount0 AS mint_amount0, m.amount1 AS mint_amount1, u.amount0 AS burn_amount0, u.amount1 AS burn_amount1, m.amount / (m.amount + m.l0) AS attacker_liq_share, sm.j AS is_jit,
         concat_ws(',', f.gas_used, m.gas_used, vgu, u.gas_used, b.gas_used) AS gas_used, concat_ws(',', f.gas_price, m.gas_price, vgp, u.gas_price, b.gas_price) AS gas_price,
         concat_ws(',', f.tx_hash, m.tx_hash, victim_txs, u.tx_hash, b.tx_hash) AS tx_sequence
  FROM sm JOIN sv USING (pool, block_number, a)
  JOIN s f ON f.pool = sm.pool AND f.block_number = sm.block_number AND f.pos = sm.a
  JOIN s b ON b.pool = sm.pool AND b.block_number = sm.block_number AND b.pos = sm.z
  LEFT JOIN s m ON sm.j AND m.pool = sm.pool AND m.block_number = sm.block_number AND m.pos = sm.v_lo - 1
  LEFT JOIN s u ON sm.j AND u.pool = sm.pool AND u.block_number = sm.block_number AND u.pos = sm.v_hi + 1)
"""


CLEAN_SQL = "clean AS (SELECT * FROM back WHERE NOT EXISTS (SELECT 1 FROM sand WHERE sand.back_tx = back.back_tx))"


def sizes_sql(source: str, name: str, x2y: str) -> str:
    """The source with p0 and the sizes."""
    return f"""
{name}_a AS (
  SELECT *, {div("y0", "x0")} AS p0, {div("s_net_token0", "x0")} AS sigma0_gross, {div("s_net_token1", "y0")} AS sigma1_gross, coalesce({x2y}, false) AS xy FROM {source}),
{name}_b AS (SELECT *, CASE WHEN xy THEN sigma0_gross ELSE sigma1_gross END AS sigma_gross FROM {name}_a),
{name}_c AS (
  SELECT *, {r} * sigma_gross AS sigma_net, {r} * sigma0_gross AS sigma0_net, {r} * sigma1_gross AS sigma1_net, 1.0::DOUBLE + {r} * sigma_gross AS u FROM {name}_b),
{name} AS (
  SELECT *, CASE WHEN xy THEN 1.0::DOUBLE / (u * u) - 1.0::DOUBLE ELSE u * u - 1.0::DOUBLE END AS i_theory, CASE WHEN xy THEN x0 ELSE y0 END AS base FROM {name}_c)
"""


SQRT_R = lit(math.sqrt(R5))
BEST = f"base * (({SQRT_R} * u - 1.0) * ({SQRT_R} * u - 1.0)) / ({r} * u)"
SMIN = lit(backrun_threshold(R5))


def native(x: str) -> str:
    return f"CASE WHEN xy THEN {x} ELSE {div(x, 'p0')} END"


def back_metrics(source: str) -> str:
    return sizes_sql(source, "bz", "victim_dir = 'x2y'") + f""",
bq AS (
  SELECT *, {div("p_victim_post", "p_victim_pre")} - 1.0 AS i_measured, {native(BEST)} AS br_pi_star_token0, -back_a0 + {div("-back_a1", "p0")} AS profit_obs_token0,
         coalesce(sigma_gross >= {SMIN}, false) AS viable_sigma, coalesce(CASE WHEN xy THEN p_back_post > p_victim_post ELSE p_back_post < p_victim_post END, false) AS reverted,
         coalesce(abs(p_back_post - {r} * p0) <= 0.01::DOUBLE * abs(p0), false) AS near_target, CASE WHEN xy THEN {f} * s_net_token0 ELSE {f} * {div("s_net_token1", "p0")} END AS mmax_jit_token0
  FROM bz),
bm AS (
  SELECT *, {SMIN} AS sigma_min_backrun, {f} AS fee_fraction, {div("br_pi_star_token0", "x0")} AS br_pi_star_per_x0, {div("profit_obs_token0", "x0")} AS profit_obs_per_x0,
         CASE WHEN NOT viable_sigma THEN 'subthreshold' WHEN NOT coalesce(CASE WHEN xy THEN i_measured < 0 ELSE i_measured > 0 END, false) THEN 'wrong_sign'
              WHEN NOT reverted THEN 'no_reversion' ELSE 'candidate' END AS reverse_label
  FROM bq)"""


JIT_METRICS = sizes_sql("jit", "jz", "s_net_token0 >= 0") + f""",
jq AS (
  SELECT *, CASE WHEN xy THEN 'x2y' ELSE 'y2x' END AS victim_dir,
         CASE WHEN xy THEN {f} * s_net_token0 * attacker_liq_share ELSE {f} * attacker_liq_share * {div("s_net_token1", "p0")} END AS profit_fee_token0,
         (burn_amount0 - mint_amount0) + {div("burn_amount1 - mint_amount1", "p0")} AS profit_il_token0 FROM jz),
jt AS (SELECT *, profit_fee_token0 + profit_il_token0 AS profit_total_token0, {div("profit_fee_token0 + profit_il_token0", "x0")} AS profit_total_per_x0 FROM jq)"""


def profit_of(eps: str, sigma: str = "sigma_gross", rr: str = r) -> str:
    t = f"(1.0 + {rr} * {eps} + {rr} * {sigma})"
    return f"({rr} * {rr} * {eps} * ({t} * {t}) / ((1.0 + {rr} * {eps}) + {rr} * {rr} * {eps} * {t}) - {eps})"


def cap_of(sigma: str, gamma: float, rr: str, scale: str = "1.0::DOUBLE") -> str:
    s = f"({rr} * {sigma})"
    root = f"sqrt({s} * {s} + 4.0 * (1.0 + {s}) * ({scale} * {scale}) / {lit(1.0 - gamma)})"
    return f"greatest(0.0::DOUBLE, (({root} - {s}) / (2.0 * {scale}) - 1.0) / {rr})"


FLOW = "(greatest(-front_a{t}, 0) + greatest(-back_a{t}, 0)) - (greatest(front_a{t}, 0) + greatest(back_a{t}, 0))"


def sand_metrics(grid: int) -> str:
    share = "least(greatest(attacker_liq_share, 0.0), 0.999999999999::DOUBLE)"
    return sizes_sql("sand", "sz", "front_dir = 'x2y'") + f""",
sq AS (
  SELECT *, front_dir AS victim_dir, {FLOW.format(t=0)} + {div(FLOW.format(t=1), "p0")} AS profit_token0_base,
         CASE WHEN is_jit AND attacker_liq_share > 0 THEN coalesce({native(f"{f} * (CASE WHEN xy THEN s_net_token0 ELSE s_net_token1 END) * attacker_liq_share")}, 0) ELSE 0 END AS jit_fee_token0,
         CASE WHEN is_jit THEN (burn_amount0 - mint_amount0) + {div("burn_amount1 - mint_amount1", "p0")} ELSE 0 END AS lp_token_delta_token0,
         CASE WHEN xy THEN abs(front_a0) / x0 ELSE abs(front_a1) / y0 END AS eps_gross, p_victim_post / p_victim_pre - 1.0 AS i_measured, {native(BEST)} AS br_pi_star_token0,
         {cap_of("sigma_gross", GAMMA, r)} AS eps_max_classic,
         CASE WHEN sigma_gross >= 0 THEN {cap_of("sigma_gross", GAMMA, r, f"(1.0::DOUBLE + coalesce({share} / (1.0 - {share}), 0.0))")} END AS eps_max_jit
  FROM sz),
sg AS (
  SELECT pool, block_number, pos, arg_max(eps, (pi, -j)) AS eps_star, max(pi) AS pi_star
  FROM (SELECT pool, block_number, pos, j, eps, {profit_of("eps")} AS pi
        FROM (SELECT pool, block_number, pos, sigma_gross, j, CASE WHEN j = {grid - 1} THEN eps_max_classic ELSE j * (eps_max_classic / {grid - 1}.0::DOUBLE) END AS eps
              FROM sq, range({grid}) t(j)))
  GROUP BY ALL),
st2 AS (
  SELECT sq.*, eps_star, {native("(base * pi_star)")} AS sand_pi_star_token0, {native("(base * " + profit_of("eps_gross") + ")")} AS sand_pi_obs_token0, {r} * eps_gross AS eps_net,
         profit_token0_base + jit_fee_token0 + lp_token_delta_token0 AS profit_token0, CASE WHEN is_jit THEN coalesce(eps_max_jit, eps_max_classic) ELSE eps_max_classic END AS eps_max,
         {lit(backrun_vs_jit(F5, 0.0, R5))} AS sigma_star_br_vs_jit_phi0, {SMIN} AS sigma_min_backrun
  FROM sq JOIN sg USING (pool, block_number, pos)),
sw AS (
  SELECT *, {div("profit_token0", "x0")} AS profit_per_x0, {div("br_pi_star_token0", "x0")} AS br_pi_star_per_x0, {div("sand_pi_obs_token0", "x0")} AS sand_pi_obs_per_x0,
         {div("sand_pi_star_token0", "x0")} AS sand_pi_star FROM st2)"""


def with_(*parts: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(p.strip() for p in parts)}\n{body}"


T_, E_, B_, J_ = TAPE_SQL, E_SQL, BACK_SQL, JIT_SQL
BEFORE = {"l0": 1, "x0": 2, "y0": 2}
FLOWS = {"s_net_token0": 5, "s_net_token1": 5}
PRICES = {"p_victim_pre": 9, "p_victim_post": 9}
SIZES = {"sigma_gross": 13, "sigma_net": 13, "sigma0_gross": 13, "sigma1_gross": 13, "sigma0_net": 13, "sigma1_net": 13, "i_theory": 12}
KEY = "pool, block_number, pos"
ORACLE: dict[str, str] = {}

ORACLE["pool_tape"] = with_(T_, body=f"""
SELECT pool, block_number, log_index, ts_unix, event_id, kind, tx_hash, origin, q, tick_lower, tick_upper,
       {rds({"amount0": 5, "amount1": 5, "amount": 1, "gas_used": 1, "gas_price": 1, "l_before": 1, "x_before": 2, "y_before": 2})},
       {rd("sqrt_before", 12, f"sqrt_before / {Q96}")}, {rd("sqrt_event", 12, f"sqrt_event / {Q96}")} FROM tape""")
ORACLE["canonical_log"] = with_(T_, E_, body="""
SELECT pool, block_number, log_index, kind, tx_hash, origin, kind = 'swap' OR dir IS NOT NULL AS is_swap, dir,
       CASE dir WHEN 'x2y' THEN 'x_to_y' WHEN 'y2x' THEN 'y_to_x' END AS dir_label,
       CASE WHEN coalesce(dir, CASE WHEN amount0 > 0 THEN 'x2y' ELSE 'y2x' END) = 'x2y' THEN 'y2x' ELSE 'x2y' END AS back_dir FROM e""")
ORACLE["scalar_normalizers"] = """
SELECT event_id, CASE WHEN event_id % 15 < 7 THEN 'x_to_y' WHEN event_id % 15 < 14 THEN 'y_to_x' END AS dir_label,
       CASE event_id % 5 WHEN 0 THEN 5.0 WHEN 1 THEN 0.003::DOUBLE * 10000 ELSE event_id % 5 END::DOUBLE AS fee_in_bps,
       CASE WHEN event_id % 5 <> 3 THEN printf('%.6g', value / pow(10.0::DOUBLE, event_id % 12)) END AS as_text, CASE event_id % 5 WHEN 0 THEN value::DECIMAL(18,2)::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN event_id WHEN 3 THEN NULL ELSE event_id END::DOUBLE AS as_number,
       CASE event_id % 5 WHEN 0 THEN value::DECIMAL(18,2)::DOUBLE WHEN 4 THEN event_id END::DOUBLE AS as_float,
       CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 4 THEN false END AS as_bool, floor(epoch(ts))::BIGINT AS as_unix,
       (value::DECIMAL(18,2) * CASE WHEN event_id % 5 = 1 THEN -1000000 ELSE 1000000 END)::BIGINT AS as_units, (value::DECIMAL(18,2) * 100)::BIGINT % 10 = 0 AS exact_at_1
FROM events"""
ORACLE["reverse_backruns"] = with_(T_, E_, B_, body=f"""
SELECT {KEY}, pattern_type, victim_origin, arb_origin, victim_dir, victim_tx, back_tx, {rds(BEFORE | PRICES | {"p_back_post": 9} | FLOWS | {"back_a0": 5, "back_a1": 5})}, gas_used, gas_price FROM back""")
JIT_AMOUNTS = {"mint_amount": 1, "burn_amount": 1, "mint_amount0": 1, "mint_amount1": 1, "burn_amount0": 1, "burn_amount1": 1, "attacker_liq_share": 12}
ORACLE["jit_cycles"] = with_(T_, E_, J_, body=f"""
SELECT {KEY}, origin, mint_tick_lower, mint_tick_upper, mint_tx, burn_tx, n_victims::INT AS n_victims, victim_txs, {rds(BEFORE | FLOWS | JIT_AMOUNTS)}, gas_used, gas_price FROM jit""")
S_ = sandwich_sql()
ORACLE["jit_cycles_outside_sandwiches"] = with_(T_, E_, J_, S_, recursive=True, body=f"""
SELECT {KEY}, mint_tx, burn_tx FROM jit WHERE NOT EXISTS (SELECT 1 FROM sand WHERE sand.mint_tx = jit.mint_tx)""")
SAND_COLS = f"""SELECT {KEY}, pattern_type, origin, front_dir, back_dir, front_tx, back_tx, mint_tx, burn_tx, n_victims::INT AS n_victims, victim_txs,
 {rds(BEFORE | PRICES | FLOWS | {"front_a0": 5, "front_a1": 5, "back_a0": 5, "back_a1": 5, "l_mint": 1, "l_burn": 1, "attacker_liq_share": 12})}, gas_used, gas_price FROM sand"""
ORACLE["sandwich_classical"] = with_(T_, E_, S_, recursive=True, body=f"{SAND_COLS} WHERE NOT is_jit")
ORACLE["sandwich_jit"] = with_(T_, E_, S_, recursive=True, body=f"{SAND_COLS} WHERE is_jit")
ORACLE["sandwich_two_victims"] = with_(T_, E_, sandwich_sql(2), recursive=True, body="""
SELECT pool, pattern_type, count(*) AS n, sum(n_victims)::BIGINT AS victims FROM sand GROUP BY ALL""")
ORACLE["backruns_minus_sandwich"] = with_(T_, E_, B_, S_, CLEAN_SQL, recursive=True, body=f"SELECT {KEY}, victim_tx, back_tx FROM clean")
CB = (T_, E_, B_, S_, CLEAN_SQL, back_metrics("clean"))
BACK_DIGITS = SIZES | {"i_measured": 11, "sigma_min_backrun": 12, "br_pi_star_token0": 6, "br_pi_star_per_x0": 15, "profit_obs_token0": 5, "profit_obs_per_x0": 13, "mmax_jit_token0": 7, "fee_fraction": 6}
ORACLE["backrun_metrics"] = with_(*CB, recursive=True, body=f"SELECT {KEY}, viable_sigma, reverted, near_target, reverse_label, {rds(BACK_DIGITS)} FROM bm")
ORACLE["backrun_labels"] = with_(*CB, recursive=True, body="SELECT pool, reverse_label, count(*) AS n, count(DISTINCT arb_origin) AS n_origins FROM bm GROUP BY ALL")
ORACLE["reverse_backrun_summary"] = with_(T_, E_, B_, back_metrics("back"), body=f"""
SELECT reverse_label, count(*) AS n, {rd("sigma_mean", 12, "avg(sigma_gross)")}, {rd("profit_p50", 12, "quantile_cont(profit_obs_per_x0, 0.5)")} FROM bm GROUP BY reverse_label""")
TIERS = (("missing", 5 / 10_000.0), ("fraction", 0.003 * 10_000 / 10_000.0), ("points", 30 / 10_000.0), ("hundred", 100 / 10_000.0))
ORACLE["backrun_fee_tiers"] = with_(T_, E_, B_, sizes_sql("back", "bz", "victim_dir = 'x2y'"), body=" UNION ALL ".join(
    f"SELECT '{name}' AS fee, {lit(fee)} AS fee_fraction, count(*) FILTER (sigma_gross >= {lit(backrun_threshold(1 - fee))}) AS n_viable,"
    f" {rd('mmax_sum', 3, f'sum(CASE WHEN xy THEN {lit(fee)} * s_net_token0 ELSE {lit(fee)} * (s_net_token1 / p0) END)')} FROM bz" for name, fee in TIERS))  # fmt: skip
ORACLE["jit_metrics"] = with_(T_, E_, J_, JIT_METRICS, body=f"""
SELECT {KEY}, victim_dir, {rds(SIZES | {"profit_fee_token0": 8, "profit_il_token0": 4, "profit_total_token0": 4, "profit_total_per_x0": 12})} FROM jt""")
SAND_DIGITS = {"profit_token0_base": 4, "jit_fee_token0": 8, "lp_token_delta_token0": 4, "profit_token0": 4, "profit_per_x0": 12, "eps_gross": 13, "eps_net": 13, "i_measured": 11}
SAND_DIGITS |= {"br_pi_star_token0": 6, "sand_pi_obs_token0": 5, "br_pi_star_per_x0": 14, "sand_pi_obs_per_x0": 14, "eps_max_classic": 11, "eps_max_jit": 11, "eps_max": 11, "sigma_star_br_vs_jit_phi0": 12}
ORACLE["sandwich_metrics"] = with_(T_, E_, S_, sand_metrics(128), recursive=True, body=f"SELECT {KEY}, victim_dir, is_jit, tx_sequence, {rds(SIZES | SAND_DIGITS)} FROM sw")
ORACLE["sandwich_best_epsilon"] = with_(T_, E_, S_, sand_metrics(128), recursive=True, body=f"SELECT {KEY}, {rds({'eps_star': 11, 'sand_pi_star': 13, 'sand_pi_star_token0': 4})} FROM sw")

STATE_SQL = """
se AS (
  SELECT pool, block_number, log_index, kind, tick_lower, tick_upper, sqrt_event, CASE WHEN kind = 'swap' THEN 1000000000 + 1000 * (event_id % 7) END AS l_set,
         CASE WHEN kind = 'swap' THEN q % 40 - 20 END AS t_set, CASE kind WHEN 'mint' THEN 1000000 * (1 + q % 5) WHEN 'burn' THEN -1000000 * (1 + q % 5) END AS dl,
         count(*) FILTER (kind = 'swap') OVER (PARTITION BY pool ORDER BY block_number, log_index ROWS UNBOUNDED PRECEDING) AS seg
  FROM tape),
s2 AS (
  SELECT *, coalesce(max(l_set) OVER g, 1000000000) AS base, coalesce(max(t_set) OVER g, 0) AS tick, coalesce(max(sqrt_event) OVER g, Q96) AS sq
  FROM se WINDOW g AS (PARTITION BY pool, seg)),
s3 AS (SELECT *, CASE WHEN kind <> 'swap' THEN tick_lower <= tick AND tick < tick_upper END AS affects_active FROM s2),
s4 AS (
  SELECT *, CASE WHEN kind <> 'swap' THEN CASE WHEN affects_active THEN dl ELSE 0 END END AS delta_l_applied,
         base + coalesce(sum(CASE WHEN affects_active THEN dl END) OVER (PARTITION BY pool, seg ORDER BY block_number, log_index ROWS UNBOUNDED PRECEDING), 0) AS l_after FROM s3),
s5 AS (
  SELECT *, coalesce(lag(l_after) OVER p, 1000000000) AS l_before, coalesce(lag(tick) OVER p, 0) AS tick_before, coalesce(lag(sq) OVER p, Q96) AS sq_before
  FROM s4 WINDOW p AS (PARTITION BY pool ORDER BY block_number, log_index))
""".replace("Q96", Q96)
ORACLE["running_state"] = with_(T_, STATE_SQL, body=f"""
SELECT pool, block_number, log_index, kind, affects_active, delta_l_applied::BIGINT AS delta_l_applied, l_before::BIGINT AS l_before, l_after::BIGINT AS l_after,
       tick_before::INT AS tick_before, tick::INT AS tick_after, {rd("sqrt_after", 12, f"sq / {Q96}")}, {rd("x_before", 2, f"l_before::DOUBLE / (sq_before / {Q96})")},
       {rd("y_after", 2, f"l_after::DOUBLE * (sq / {Q96})")} FROM s5""")
ORACLE["stream_running_state"] = ORACLE["running_state"]
ORACLE["stream_counters"] = with_(T_, body="SELECT kind, count(*) AS n_events, min(block_number) AS first_block, max(block_number) AS last_block FROM tape GROUP BY kind")
ORACLE["stream_keyed_state"] = ORACLE["running_state"]
ORACLE["stream_restart"] = ORACLE["running_state"]
ORACLE["stream_metrics"] = ORACLE["stream_counters"]
ORACLE["stream_detections"] = with_(T_, E_, J_, B_, S_, CLEAN_SQL, recursive=True, body=f"""
SELECT 'Pure JIT' AS pattern_type, {KEY}, origin, mint_tx AS opens, burn_tx AS closes, n_victims::INT AS n_victims FROM jit
UNION ALL SELECT pattern_type, {KEY}, origin, front_tx, back_tx, n_victims::INT FROM sand
UNION ALL SELECT 'ReverseBackrun', {KEY}, arb_origin, victim_tx, back_tx, 1 FROM clean""")
ORACLE["closed_block_backruns"] = with_(T_, E_, B_, body=f"""
SELECT {KEY}, back_tx FROM back JOIN (SELECT pool AS p, max(block_number) AS last FROM tape GROUP BY pool) ON p = pool WHERE block_number < last""")
ORACLE["resume_dedup"] = with_(T_, body="""
, k AS (SELECT * FROM tape WHERE block_number > 236800 OR (block_number = 236800 AND log_index > 3))
SELECT pool, max(block_number) AS block_number, arg_max(log_index, block_number * 100000 + log_index) AS log_index, count(*) AS n_events FROM k GROUP BY pool""".replace("\n, k", ", k", 1))
ORACLE["state_reject_split"] = with_(T_, body="""
SELECT pool, count(*) FILTER (kind <> 'swap' OR log_index % 9 <> 0) AS n_sound, count(*) FILTER (kind = 'swap' AND log_index % 9 = 0) AS n_rejected FROM tape GROUP BY pool""")

ORACLE["first_event_block"] = with_(T_, body="""
SELECT pool, min(b) AS first_block FROM (
  SELECT pool, kind, block_number AS b, row_number() OVER (PARTITION BY pool, kind ORDER BY ts_unix, block_number, log_index) AS n FROM tape WHERE ts_unix >= 1704500000)
WHERE n = 1 GROUP BY pool""")
ORACLE["snapshot_lookup"] = with_(T_, body=f"""
SELECT pool, block_number, l_after, round(sqrt_before / {Q96}, 12) AS sqrt_p FROM (
  SELECT *, row_number() OVER (PARTITION BY pool ORDER BY block_number DESC) AS n FROM tape WHERE log_index = 1 AND block_number <= 236900) WHERE n = 1""")
ORACLE["time_window_scan"] = with_(T_, body=f"""
SELECT ts_unix, block_number, log_index, pool, kind, tx_hash, {rd("amount", 1, "CASE WHEN kind = 'burn' THEN -abs(amount) ELSE amount END")}
FROM tape WHERE ts_unix BETWEEN 1704400000 AND 1705400000 AND event_id > 100""")
ORACLE["raw_entities"] = with_(T_, body=f"""
SELECT block_number, log_index, ts_unix, tx_hash, CASE kind WHEN 'swap' THEN 'Swap' WHEN 'mint' THEN 'Mint' ELSE 'Burn' END AS kind, origin, CASE WHEN kind <> 'burn' THEN 's' END AS sender,
       CASE WHEN kind <> 'swap' THEN 'w' END AS owner, CASE WHEN kind = 'swap' THEN 'r' END AS recipient, CASE WHEN kind = 'swap' THEN q::VARCHAR END AS sqrt_event,
       CASE WHEN kind = 'swap' THEN q % 40 - 20 END::INT AS tick_event, CASE WHEN kind <> 'swap' THEN -10 END::INT AS tick_lower, CASE WHEN kind <> 'swap' THEN 10 END::INT AS tick_upper,
       CASE kind WHEN 'mint' THEN q * 7 WHEN 'burn' THEN -q * 7 END::BIGINT AS liquidity_delta, {rd("amount0", 5)}, {rd("amount1", 5)} FROM tape""")
ORACLE["log_files"] = with_(T_, body=" UNION ALL ".join(
    f"SELECT {n}::INT AS file, kind, count(*) AS n, {'count(CASE WHEN kind <> $$mint$$ THEN amount1 END)' if n == 2 else 'count(amount1)'} AS n_amount1, {rd('net0', 2, 'sum(amount0)')} FROM tape GROUP BY kind" for n in range(3)))
ORACLE["tidy_files"] = with_(T_, E_, J_, body="""
SELECT pool, count(*) AS n, 0::INT AS run, sum(n_victims)::BIGINT AS victims, 2 * count(*) AS n_saved, 2::BIGINT AS n_fees FROM jit GROUP BY pool""")
ORACLE["first_events"] = with_(T_, body="SELECT ts_unix, block_number, log_index, pool, kind FROM tape ORDER BY ts_unix, block_number, log_index, pool LIMIT 100")
ORACLE["batch_ranges"] = with_(T_, body="SELECT pool, kind, min(block_number) AS first_block, max(block_number) AS last_block, count(*) AS n_events FROM tape GROUP BY ALL")

GAPS_SQL = """
gaps AS (
  SELECT tx_hash, event_id, CASE event_id % 5 WHEN 4 THEN origin END AS own, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'None' WHEN 3 THEN 'nan' ELSE origin END AS origin,
         CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE gas_used END AS gu, gas_price AS gp, CASE WHEN event_id % 4 = 2 THEN NULL ELSE gas_price + 1 END AS ep,
         gas_used AS gu_r, event_id % 11 <> 0 AS known, origin AS origin_r FROM tape)
"""
ORACLE["origin_enrichment"] = with_(T_, GAPS_SQL, body="SELECT tx_hash, event_id, coalesce(own, CASE WHEN known THEN '0x' || origin_r END) AS origin FROM gaps")
ORACLE["gas_enrichment"] = with_(T_, GAPS_SQL, body=f"""
SELECT tx_hash, event_id, {rd("gas_used", 3, "CASE WHEN event_id % 4 <> 3 AND known THEN gu_r * 2 ELSE gu END")}, {rd("gas_price", 3, "CASE WHEN event_id % 4 <> 3 AND known THEN gp * 3 ELSE gp END")},
       {rd("effective_gas_price", 3, "CASE WHEN event_id % 4 <> 3 AND known THEN gp * 4 ELSE ep END")} FROM gaps""")
ORACLE["enrichment_worklist"] = with_(T_, body="SELECT tx_hash FROM tape WHERE event_id % 5 <> 4 AND event_id % 4 <> 3")
ORACLE["fill_rates"] = with_(T_, body="""
SELECT 'origin' AS attribute, count(*) AS total, count(*) FILTER (event_id % 5 = 4) AS filled, count(*) FILTER (event_id % 5 <> 4) AS missing FROM tape
UNION ALL SELECT 'gas', count(*), count(*) FILTER (event_id % 4 = 3), count(*) FILTER (event_id % 4 <> 3) FROM tape""")
ORACLE["exact_reserves"] = with_(T_, body="""
, z AS (SELECT *, (event_id % 90000 + 1)::HUGEINT * 18446744073709551616 + q::HUGEINT * 1000003 AS l, (event_id % 1000)::HUGEINT AS m, (1::HUGEINT << (event_id % 21)::INT) AS p FROM tape WHERE kind = 'swap' AND event_id % 13 <> 0)
SELECT pool, block_number, log_index, CASE WHEN m > 0 THEN ((l * p) // m)::VARCHAR END AS x, CASE WHEN m > 0 THEN ((l * m) // p)::VARCHAR END AS y FROM z""".replace("\n, z AS", ", z AS", 1))
ORACLE["slippage_worklist"] = with_(T_, body="SELECT DISTINCT lower(tx_hash) AS tx_hash FROM tape WHERE kind = 'swap' AND event_id % 50 <> 0")
ORACLE["swap_log_decode"] = with_(T_, body="""
SELECT pool, block_number, log_index, CASE WHEN event_id % 13 <> 0 THEN ((event_id % 90000 + 1)::HUGEINT * 18446744073709551616 + q::HUGEINT * 1000003)::VARCHAR END AS liquidity,
       CASE WHEN event_id % 13 <> 0 THEN (q % 40 - 20)::INT END AS tick FROM tape WHERE kind = 'swap'""")
ORACLE["liquidity_refill"] = with_(T_, body="""
SELECT pool, block_number, log_index, CASE WHEN kind = 'swap' THEN CASE WHEN log_index % 2 = 0 THEN (1000000000 + 1000 * (event_id % 7))::VARCHAR
       WHEN event_id % 13 <> 0 THEN ((event_id % 90000 + 1)::HUGEINT * 18446744073709551616 + q::HUGEINT * 1000003)::VARCHAR END END AS liquidity_after FROM tape""")
TOKEN = "'0x' || repeat('aa', 19) || lpad(lower(hex((event_id + {n}) % 200)), 2, '0')"
ORACLE["path_decode"] = with_(T_, body=f"""
SELECT event_id, tx_hash, CASE WHEN event_id % 5 <> 0 THEN concat_ws(',', {", ".join(TOKEN.format(n=n) for n in (1, 2, 3))}) END AS tokens,
       CASE WHEN event_id % 5 <> 0 THEN '500,3000' END AS fees FROM tape WHERE kind = 'swap'""")
ORACLE["slippage_tolerance"] = with_(T_, body=f"""
, n AS (SELECT *, CASE WHEN event_id % 10 >= 8 THEN 7 ELSE event_id % 8 END AS k, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 0 ELSE q + 3 END::DOUBLE AS expected FROM tape WHERE kind = 'swap')
SELECT '0x' || tx_hash AS tx_hash, CASE k WHEN 0 THEN 'exactInputSingle' WHEN 1 THEN 'exactOutputSingle' WHEN 2 THEN 'exactInput' WHEN 3 THEN 'exactOutput' WHEN 4 THEN 'exactOutputSingle'
         WHEN 5 THEN 'universalExactIn' WHEN 6 THEN 'universalExactOut' END AS kind,
       CASE WHEN k < 7 THEN {TOKEN.format(n=1)} END AS token_in, CASE WHEN k IN (0, 1, 4) THEN {TOKEN.format(n=2)} WHEN k < 7 THEN {TOKEN.format(n=3)} END AS token_out,
       CASE WHEN k IN (0, 1, 4) THEN 500 END AS fee, CASE WHEN k IN (0, 2, 5) THEN q::VARCHAR END AS amount_in, CASE WHEN k IN (1, 3, 4, 6) THEN q::VARCHAR END AS amount_out,
       CASE WHEN k < 7 THEN (q - 1)::VARCHAR END AS "limit", CASE WHEN k IN (2, 3, 5, 6) THEN '500,3000' END AS fees, expected,
       {rd("tolerance_bps", 8, "CASE WHEN expected > 0 AND k IN (0, 2, 5) THEN (1.0 - (q - 1)::DOUBLE / expected) * 1e4 WHEN expected > 0 AND k < 7 THEN ((q - 1)::DOUBLE / expected - 1.0) * 1e4 END")},
       CASE WHEN k = 7 THEN 'no supported call' WHEN expected IS NULL THEN 'no quote' WHEN expected <= 0 THEN 'bad quote' END AS error FROM n""".replace("\n, n AS", ", n AS", 1))

PARTY = """CASE (event_id + {n}) % 4 WHEN 2 THEN NULL ELSE '0x' || right('abababababababababababababababababababab'[1:40 - length(h)] || h, 40) END"""
ORACLE["entity_addresses"] = with_(T_, body=f"""
SELECT tx_hash, upper(kind[1]) || kind[2:] AS kind, {PARTY.format(n=0)} AS origin, CASE WHEN kind <> 'burn' THEN {PARTY.format(n=1)} END AS sender,
       CASE WHEN kind <> 'swap' THEN {PARTY.format(n=2)} END AS owner, CASE WHEN kind = 'swap' THEN {PARTY.format(n=3)} END AS recipient
FROM (SELECT *, lower(to_hex(event_id)) AS h FROM tape)""")
ORACLE["merged_summaries"] = with_(T_, body="""
SELECT kind AS dataset, count(*) AS n_values, true AS p50_near, true AS p90_near, true AS p99_near, true AS items_near FROM tape GROUP BY kind""")
ORACLE["landed_window"] = with_(T_, body="""
SELECT ts_unix, block_number, log_index, pool, kind, tx_hash FROM tape WHERE pool = 'p0' AND ts_unix BETWEEN 1704400000 AND 1705400000 AND event_id > 100""")
ORACLE["landed_refill"] = ORACLE["liquidity_refill"]
ORACLE["merged_log"] = with_(T_, body="""
SELECT row_number() OVER (ORDER BY ts_unix, block_number, log_index, pool) - 1 AS seq, ts_unix, block_number, log_index, pool, kind FROM tape""")
ORACLE["bucketed_enrichment"] = with_(T_, GAPS_SQL, body=f"""
SELECT tx_hash, event_id, coalesce(own, CASE WHEN known THEN '0x' || origin_r END) AS origin,
       {rd("gas_used", 3, "CASE WHEN event_id % 4 <> 3 AND known THEN gu_r * 2 ELSE gu END")}, {rd("gas_price", 3, "CASE WHEN event_id % 4 <> 3 AND known THEN gp * 3 ELSE gp END")},
       {rd("effective_gas_price", 3, "CASE WHEN event_id % 4 <> 3 AND known THEN gp * 4 ELSE ep END")} FROM gaps""")
ORACLE["wide_liquidity"] = with_(T_, body="""
SELECT pool, block_number, log_index,
       (('0x' || md5(event_id::VARCHAR)[1:16])::UBIGINT::UHUGEINT * 18446744073709551616::UHUGEINT + ('0x' || md5(event_id::VARCHAR)[17:32])::UBIGINT::UHUGEINT)::VARCHAR AS liquidity_text,
       CASE WHEN event_id % 3 = 0 THEN '-' ELSE '' END || ltrim(event_id || repeat('1', 40), '0') || lpad((event_id % 97)::VARCHAR, 2, '0') || '0000' AS units,
       CASE WHEN event_id % 3 = 0 THEN '-' ELSE '' END || ltrim(event_id || repeat('1', 40), '0') || lpad((event_id % 97)::VARCHAR, 2, '0')[1:1] AS cut
FROM tape WHERE kind = 'swap' AND event_id % 13 <> 0""")
ORACLE["short_paths"] = with_(T_, body=f"""
SELECT event_id, tx_hash, CASE event_id % 4 WHEN 1 THEN {TOKEN.format(n=1)} WHEN 2 THEN concat_ws(',', {TOKEN.format(n=1)}, {TOKEN.format(n=2)}) WHEN 3 THEN concat_ws(',', {", ".join(TOKEN.format(n=n) for n in (1, 2, 3))}) END AS tokens,
       CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN '500' WHEN 3 THEN '500,3000' END AS fees FROM tape WHERE kind = 'swap'""")
ORACLE["slippage_files"] = with_(T_, body=f"""
, n AS (SELECT *, CASE WHEN event_id % 10 >= 8 THEN 7 ELSE event_id % 8 END AS k, (q + 3)::DOUBLE AS expected FROM tape WHERE kind = 'swap')
SELECT '0x' || tx_hash AS tx_hash, CASE k WHEN 0 THEN 'exactInputSingle' WHEN 1 THEN 'exactOutputSingle' WHEN 2 THEN 'exactInput' WHEN 3 THEN 'exactOutput' WHEN 4 THEN 'exactOutputSingle'
         WHEN 5 THEN 'universalExactIn' WHEN 6 THEN 'universalExactOut' END AS kind, CASE WHEN k < 7 THEN (q - 1)::VARCHAR END AS "limit", expected,
       {rd("tolerance_bps", 8, "CASE WHEN k IN (0, 2, 5) THEN (1.0 - (q - 1)::DOUBLE / expected) * 1e4 WHEN k < 7 THEN ((q - 1)::DOUBLE / expected - 1.0) * 1e4 END")},
       CASE WHEN k = 7 THEN 'no supported call' END AS error, row_number() OVER (ORDER BY '0x' || tx_hash) <= 20 AS shown FROM n""".replace("\n, n AS", ", n AS", 1))

ALL = (T_, E_, B_, J_, S_, CLEAN_SQL, back_metrics("clean"), JIT_METRICS, sand_metrics(128))


def stats(source: str, name: str, sigma: str, profit: str, origin: str, pattern: str, flags: bool, whole: bool = False) -> str:
    rd = (lambda n, _, x: f"{x} AS {n}") if whole else globals()["rd"]
    q = lambda c, v: f"quantile_cont({c}, {v})"
    cols = [f"'{name}' AS dataset", "count(*) AS n_rows", f"count(DISTINCT nullif(trim({origin}), '')) AS n_unique_origins", f"count(DISTINCT {pattern}) AS n_patterns"]
    for n, c in (("sigma", sigma), ("profit", profit)):
        cols += [f"count({c}) AS {n}_n", rd(f"{n}_mean", 12, f"avg({c})"), *(rd(f"{n}_p{v}", 12, q(c, v / 100)) for v in (50, 90, 99))]
    for c in ("viable_sigma", "reverted", "near_target"):
        cols += [f"count({c}) AS {c}_n", rd(f"{c}_true_share", 9, f"avg({c}::INT)")] if flags else [f"NULL::BIGINT AS {c}_n", f"NULL::DOUBLE AS {c}_true_share"]
    return f"SELECT {', '.join(cols)} FROM {source}"


def summary_sql(whole: bool) -> str:
    return " UNION ALL ".join([
        stats("(SELECT *, 'Pure JIT' AS pt FROM jt)", "jit", "sigma_gross", "profit_total_per_x0", "origin", "pt", False, whole),
        stats("sw", "sandwich", "sigma_gross", "profit_per_x0", "origin", "pattern_type", False, whole),
        stats("bm", "backrun", "sigma_gross", "profit_obs_per_x0", "arb_origin", "reverse_label", True, whole),
    ])


ORACLE["summary_metrics"] = with_(*ALL, recursive=True, body=summary_sql(False))
TOLD = ", ".join(f"coalesce(printf('%.6g', {c}), '')" for c in ("sigma_p50", "sigma_p90", "profit_p50", "profit_p90"))
ORACLE["summary_lines"] = with_(*ALL, f"sm2 AS ({summary_sql(True)})", recursive=True, body=f"""
SELECT 1::INT AS line_no, '| Dataset | Rows | Unique origins | σ p50 | σ p90 | Profit p50 | Profit p90 |' AS line UNION ALL SELECT 2, '|---|---:|---:|---:|---:|---:|---:|'
UNION ALL SELECT CASE dataset WHEN 'jit' THEN 3 WHEN 'sandwich' THEN 4 ELSE 5 END, '| ' || concat_ws(' | ', dataset, n_rows::VARCHAR, n_unique_origins::VARCHAR, {TOLD}) || ' |' FROM sm2""")
COUNTS = """
cnt AS (
  SELECT 'jit' AS dataset, 'origin' AS kind, origin AS key, count(*) AS count FROM jit GROUP BY ALL
  UNION ALL SELECT 'sandwich', 'origin', origin, count(*) FROM sand GROUP BY ALL
  UNION ALL SELECT 'backrun', 'origin', arb_origin, count(*) FROM bm GROUP BY ALL
  UNION ALL SELECT 'sandwich', 'pattern', pattern_type, count(*) FROM sand GROUP BY ALL
  UNION ALL SELECT 'backrun', 'pattern', reverse_label, count(*) FROM bm GROUP BY ALL)
"""
ORACLE["top_origins"] = with_(*ALL, COUNTS, recursive=True, body="""
SELECT dataset, kind, key, count FROM (SELECT *, row_number() OVER (PARTITION BY dataset, kind ORDER BY count DESC, key) AS n FROM cnt) WHERE n <= 25""")
ORACLE["report_files"] = with_(*ALL, COUNTS, recursive=True, body="SELECT dataset, key, count FROM cnt WHERE kind = 'pattern'")
ORACLE["pattern_frequencies"] = with_(*ALL, COUNTS, recursive=True, body="SELECT dataset, kind, key, count FROM cnt WHERE kind = 'pattern'")
SERIES = """
ser0 AS (
  SELECT abs(sigma_gross) AS sigma, profit_total_per_x0 AS y, 'JIT' AS label, origin, false AS under_threshold FROM jt
  UNION ALL SELECT abs(sigma_gross), profit_per_x0, CASE WHEN is_jit THEN 'JIT-Sandwich' ELSE 'Classical sandwich' END, origin, abs(sigma_gross) < sigma_min_backrun FROM sw
  UNION ALL SELECT abs(sigma_gross), profit_obs_per_x0, 'Back-run Arbitrage', arb_origin, NOT viable_sigma FROM bm),
ser AS (SELECT * FROM ser0 WHERE sigma IS NOT NULL AND y IS NOT NULL)
"""
ORACLE["strategy_series"] = with_(*ALL, SERIES, recursive=True, body=f"SELECT {rds({'sigma': 13, 'y': 12})}, label, origin, under_threshold FROM ser")


LEGS = "abs({net}abs(CASE WHEN front_dir = 'x2y' THEN back_a1 ELSE back_a0 END / 10000.0){close} - abs(CASE WHEN front_dir = 'x2y' THEN front_a1 ELSE front_a0 END / 10000.0)) <= 5.0"
GROSS, NET = LEGS.format(net="", close=""), LEGS.format(net="(", close=f" / {r})")
ORACLE["strategy_series_by_origin"] = with_(*ALL, recursive=True, body=f"""
SELECT {rds({'sigma': 13, 'y': 12})}, label, origin, under_threshold FROM (
  SELECT sigma_gross AS sigma, profit_total_per_x0 AS y, 'JIT' AS label, origin, false AS under_threshold FROM jt
  UNION ALL SELECT sigma_gross, profit_per_x0, CASE WHEN is_jit THEN 'JIT-Sandwich' ELSE 'Classical sandwich' END, origin, abs(sigma_gross) < sigma_min_backrun FROM sw WHERE is_jit OR {GROSS}
  UNION ALL SELECT sigma_gross, profit_obs_per_x0, 'Back-run Arbitrage', arb_origin, NOT viable_sigma FROM bm) WHERE sigma IS NOT NULL AND y IS NOT NULL""")


def chosen(n_jit: int, n_other: int) -> str:
    return f"""
oc AS (SELECT label = 'JIT' AS j, origin AS key, count(*) AS count FROM ser GROUP BY ALL),
ch AS (SELECT DISTINCT key FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY count DESC, key) AS n FROM oc) WHERE n <= CASE WHEN j THEN {n_jit} ELSE {n_other} END)"""


ORACLE["highlighted_origins"] = with_(*ALL, SERIES, chosen(1, 3), recursive=True, body="""
SELECT * FROM (SELECT key, count, row_number() OVER (ORDER BY count DESC, key)::INT AS rank FROM (SELECT key, sum(count)::BIGINT AS count FROM oc WHERE key IN (SELECT key FROM ch) GROUP BY key))
WHERE rank <= 3""")
ORACLE["series_groups"] = with_(*ALL, SERIES, chosen(1, 2), recursive=True, body=f"""
SELECT CASE WHEN origin IN (SELECT key FROM ch) THEN origin ELSE 'other' END AS origin, label, under_threshold, count(*) AS n_points, {rd("max_sigma", 12, "max(sigma)")} FROM ser GROUP BY 1, 2, 3""")
ORACLE["series_summary"] = with_(*ALL, SERIES, recursive=True, body=f"""
SELECT label, count(y) AS n, {rd("median", 12, "median(y)")}, {rd("mean", 12, "avg(y)")}, {rd("p90", 12, "quantile_cont(y, 0.9)")} FROM ser GROUP BY label""")
ORACLE["sigma_ranges"] = with_(*ALL, SERIES, recursive=True, body=f"SELECT {rd('lowest', 12, 'min(y)')}, {rd('highest', 12, 'max(y)')}, {rd('largest_abs', 12, 'max(abs(y))')} FROM ser")
ORACLE["self_funded_sandwiches"] = with_(T_, E_, S_, recursive=True, body=f"""
SELECT {KEY}, pattern_type, false AS div_r FROM sand WHERE {GROSS} UNION ALL SELECT {KEY}, pattern_type, true FROM sand WHERE {NET}""")
IDENT = """
idr AS (
  SELECT CASE front_dir WHEN 'x2y' THEN 'x_to_y' ELSE 'y_to_x' END AS victim_dir, -CASE WHEN front_dir = 'x2y' THEN front_a1 ELSE front_a0 END AS q_fr,
         -CASE WHEN front_dir = 'x2y' THEN s_net_token1 ELSE s_net_token0 END AS v, attacker_liq_share AS alpha, -CASE WHEN front_dir = 'x2y' THEN back_a1 ELSE back_a0 END AS q_br_obs
  FROM sand WHERE is_jit),
idn AS (SELECT *, -(q_fr - alpha * v) AS q_br_hat FROM idr)
"""
ORACLE["backrun_identity_rows"] = with_(T_, E_, S_, IDENT, recursive=True, body=f"SELECT victim_dir, {rds({'q_fr': 5, 'v': 5, 'alpha': 12, 'q_br_obs': 5, 'q_br_hat': 5})} FROM idn")
FIT = {
    "corr_obs_hat": (7, "corr(q_br_obs, q_br_hat)"), "rmse": (4, "sqrt(avg((q_br_obs - q_br_hat) * (q_br_obs - q_br_hat)))"),
    "median_rel_error": (7, "median(CASE WHEN q_br_hat <> 0 THEN abs((q_br_obs - q_br_hat) / q_br_hat) END)"), "share_br_below_fr": (9, "avg((abs(q_br_obs) < abs(q_fr))::INT)"),
    "corr_av_gap": (7, "corr(alpha * v, abs(q_fr) - abs(q_br_obs))"), "intercept": (2, "regr_intercept(q_br_obs, q_br_hat)"), "slope": (6, "regr_slope(q_br_obs, q_br_hat)"),
}
FIT_SQL = f"""
SELECT victim_dir, grouping(victim_dir) = 1 AS overall, count(*) AS n, {", ".join(rd(n, d, x) for n, (d, x) in FIT.items())} FROM idn GROUP BY GROUPING SETS ((), (victim_dir))"""
ORACLE["backrun_identity_fit"] = with_(T_, E_, S_, IDENT, recursive=True, body=FIT_SQL)
IDENT_NET = IDENT.replace("back_a0 END AS q_br_obs", f"back_a0 END / {r} AS q_br_obs")
ORACLE["backrun_identity_fit_net"] = with_(T_, E_, S_, IDENT_NET, recursive=True, body=FIT_SQL)
ORACLE["backrun_identity_pairs"] = with_(T_, E_, S_, IDENT, recursive=True, body=f"""
SELECT victim_dir, {rd("front_size", 8, "abs(q_fr) / 1000.0")}, {rd("back_size", 8, "abs(q_br_obs) / 1000.0")}, abs(q_br_obs) < abs(q_fr) AS below FROM idn""")

SIZES_SQL = "sz1 AS (SELECT DISTINCT q, q / 1e6::DOUBLE AS sigma FROM tape WHERE kind = 'swap')"


def sweep_part(bps: float) -> str:
    fee, rate = bps / 1e4, 1.0 - bps / 1e4
    fl, rl, sq = lit(fee), lit(rate), lit(math.sqrt(rate))
    u, cap = f"(1.0 + {rl} * sigma)", cap_of("sigma", GAMMA, rl)
    return f"""
SELECT z.q, {fl} AS fee_fraction, {rd("pi_jit", 12, f"0.5 * sigma * ({fl} + {rl}) - {rl} * sigma / (2.0 + {rl} * sigma)")},
       {rd("pi_backrun", 12, f"CASE WHEN sigma < {lit(backrun_threshold(rate))} THEN 0 ELSE ({sq} * {u} - 1.0) * ({sq} * {u} - 1.0) / ({rl} * {u}) END")}, {rd("pi_sandwich", 11, "b.best")}
FROM sz1 z JOIN (
  SELECT q, max({profit_of("eps", "sigma", rl)}) AS best FROM (SELECT q, sigma, CASE WHEN j = 99 THEN {cap} ELSE j * ({cap} / 99.0::DOUBLE) END AS eps FROM sz1, range(100) t(j)) GROUP BY q) b ON b.q = z.q"""


ORACLE["strategy_sweep"] = with_(T_, SIZES_SQL, body=" UNION ALL ".join(sweep_part(b) for b in (1.0, 5.0, 30.0)))
R30 = lit(0.997)
ORACLE["epsilon_cap_sweep"] = with_(T_, SIZES_SQL, body=" UNION ALL ".join(
    f"SELECT q, {lit(g)} AS gamma, {rd('eps_max', 11, cap_of('sigma', g, R30))}, {rd('eps_max_jit', 11, cap_of('sigma', g, R30, '2.0::DOUBLE'))} FROM sz1" for g in (0.0, 0.005, 0.01, 0.05)))
ORACLE["threshold_guides"] = with_(T_, SIZES_SQL, body=" UNION ALL ".join(
    f"SELECT {lit(b)} AS fee_bps, {rd('sigma_min_backrun', 12, lit(backrun_threshold(1 - b / 1e4)))}, {rd('sandwich_onset', 12, lit(sandwich_onset(1 - b / 1e4)))},"
    f" count(*) FILTER (sigma >= {lit(backrun_threshold(1 - b / 1e4))}) AS n_backrun, count(*) FILTER (sigma >= {lit(sandwich_onset(1 - b / 1e4))}) AS n_sandwich FROM sz1"
    for b in (1.0, 5.0, 30.0)))


ONE = "1.0::DOUBLE"


def theta_sql(eps: str, alpha: str, rr: str) -> str:
    d = f"({ONE} + {rr} * {eps})"
    return f"({rr} / {d} * ({eps} - {alpha} * sigma / ({d} * ({ONE} + {alpha}) + {rr} * sigma)))"


def mixed_sql(eps: str, alpha: str, rr: str, th: str) -> str:
    t = f"(({ONE} + {rr} * {eps}) * ({ONE} + {alpha}) + {rr} * sigma)"
    return f"({t} * {t} * {rr} * {th} / (({ONE} + {alpha}) * (({ONE} + {alpha}) + {t} * {rr} * {th})) - {eps} + {alpha} * sigma / ({ONE} + {alpha}))"


def jit_sql(alpha: str, fee: str, rr: str) -> str:
    return f"({alpha} / ({ONE} + {alpha}) * sigma * ({fee} + {rr}) - {alpha} * {rr} * sigma / ({ONE} + {alpha} + {rr} * sigma))"


def surface_sql(eps: str, alpha: str) -> str:
    return mixed_sql(eps, alpha, R30, f"greatest(0.0::DOUBLE, {theta_sql(eps, alpha, R30)})")


def grid_sql(i: str, low: float, high: float, n: int) -> str:
    return f"({lit(low)} + {i} * {lit((high - low) / (n - 1))})"


EPS, ALPHA = grid_sql("e.i", 0.001, 0.99, 100), grid_sql("a.i", 0.001, 10.0, 100)
ORACLE["profit_surface"] = with_(T_, SIZES_SQL, body=f"""
SELECT count(*) AS cells, {rd("lowest", 10, "min(profit)")}, {rd("highest", 10, "max(profit)")}, {rd("largest_abs", 10, "max(abs(profit))")}
FROM (SELECT {surface_sql("eps", "alpha")} AS profit FROM (SELECT sigma, {EPS} AS eps, {ALPHA} AS alpha FROM sz1, range(100) e(i), range(100) a(i)))""")
EPS_FULL, ALPHA_FULL = grid_sql("e.i", 0.001, 0.99, 500), grid_sql("a.i", 0.001, 10.0, 500)
ORACLE["profit_surface_full"] = with_(T_, SIZES_SQL, body=f"""
SELECT count(*) AS cells, {rd("lowest", 10, "min(profit)")}, {rd("highest", 10, "max(profit)")}, {rd("largest_abs", 10, "max(abs(profit))")}
FROM (SELECT {surface_sql("eps", "alpha")} AS profit FROM (SELECT sigma, {EPS_FULL} AS eps, {ALPHA_FULL} AS alpha FROM sz1, range(500) e(i), range(500) a(i)))""")
ORACLE["profit_contour"] = with_(T_, SIZES_SQL, body=f"""
SELECT i_eps, count(*) AS n_cells, min(i_alpha) AS first_alpha
FROM (SELECT i_eps, i_alpha, {surface_sql("eps", "alpha")} AS p, {surface_sql("eps", "before")} AS b
      FROM (SELECT sigma, e.i AS i_eps, a.i AS i_alpha, {EPS} AS eps, {ALPHA} AS alpha, {grid_sql("(a.i - 1)", 0.001, 10.0, 100)} AS before FROM sz1, range(100) e(i), range(1, 100) a(i)))
WHERE b * p < 0 OR (p = 0 AND b <> 0) GROUP BY i_eps""")
A400 = {n: grid_sql(f"(a.i + {n})", 0.001, 10.0, 400) for n in (-1, 1)}
ORACLE["alpha_slope"] = with_(T_, SIZES_SQL, body=f"""
SELECT i_eps, i_alpha, {rd("mean_slope", 8, f"avg(({surface_sql('eps', 'a1')} - {surface_sql('eps', 'a0')}) / (a1 - a0))")}
FROM (SELECT sigma, e.i AS i_eps, a.i AS i_alpha, {grid_sql("e.i", 0.001, 0.02, 3)} AS eps, {A400[-1]} AS a0, {A400[1]} AS a1 FROM sz1, range(3) e(i), range(1, 399) a(i)) GROUP BY i_eps, i_alpha""")
F30 = lit(0.003)
CURVE = f"CASE WHEN {theta_sql('eps', ONE, R30)} > 0 THEN {mixed_sql('eps', ONE, R30, theta_sql('eps', ONE, R30))} ELSE {jit_sql(ONE, F30, R30)} END"
ORACLE["mixed_curve"] = with_(T_, SIZES_SQL, body=f"""
SELECT q, {rd("best", 10, "max(profit)")}, {rd("worst", 10, "min(profit)")}, count(*) FILTER (profit > 0) AS n_paying
FROM (SELECT q, {CURVE} AS profit FROM (SELECT q, sigma, {grid_sql("e.i", 0.0, 1.0, 500)} AS eps FROM sz1, range(500) e(i))) GROUP BY q""")


def optimum_sql(bps: float, n: int = 21, rounds: int = 6, alpha_max: float = 10.0) -> list[str]:
    """Common table expressions of one fee's grids, each around the best point of the one before; the last is named b<bps>."""
    rl, tag, out = lit(1.0 - bps / 1e4), f"{bps:g}", []
    last = f"{n - 1}.0::DOUBLE"

    def best(name: str, source: str) -> str:
        points = f"SELECT q, sigma, i.i AS i, j.i AS j, a0 + (a1 - a0) * (i.i / {last}) AS a, u0 + (u1 - u0) * (j.i / {last}) AS u FROM {source}, range({n}) i(i), range({n}) j(i)"
        b = f"(({ONE} + a) + {rl} * sigma)"
        e0 = f"({lit(2.0)} * (a * sigma) / ({b} + sqrt({b} * {b} + {lit(4.0)} * ({rl} * ({ONE} + a)) * (a * sigma))))"
        ends = f"SELECT *, {e0} AS e0, {cap_of('sigma', GAMMA, rl, f'({ONE} + a)')} AS e1 FROM ({points})"
        capped = f"SELECT *, e0 + (e1 - e0) * (u * u) AS e FROM ({ends})"
        profit = f"SELECT *, {mixed_sql('e', 'a', rl, theta_sql('e', 'a', rl))} AS p FROM ({capped}) WHERE e > 0 AND {theta_sql('e', 'a', rl)} > 1e-12::DOUBLE"
        return f"{name} AS (SELECT q, arg_max((p, e, a, u), (p, -i, -j)) AS b FROM ({profit}) GROUP BY q)"

    out = [f"w{tag}_0 AS (SELECT q, sigma, 0.0::DOUBLE AS a0, {lit(alpha_max)} AS a1, 0.0::DOUBLE AS u0, {ONE} AS u1 FROM sz1)", best(f"f{tag}_0", f"w{tag}_0")]
    for k in range(1, rounds):
        share = 2.0 / (n - 1) * (4.0 / (n - 1)) ** (k - 1)
        da, du = lit(alpha_max * share), lit(share)
        out.append(f"""w{tag}_{k} AS (
  SELECT z.q, sigma, greatest(coalesce(b[3], 0.0) - {da}, 0.0::DOUBLE) AS a0, least(coalesce(b[3], {lit(alpha_max)}) + {da}, {lit(alpha_max)}) AS a1,
         greatest(coalesce(b[4], 0.0) - {du}, 0.0::DOUBLE) AS u0, least(coalesce(b[4], 1.0) + {du}, {ONE}) AS u1 FROM sz1 z LEFT JOIN f{tag}_{k - 1} USING (q))""")
        out.append(best(f"f{tag}_{k}", f"w{tag}_{k}"))
    done = f"""b{tag} AS (
  SELECT {lit(bps)} AS fee_bps, z.q, sigma, b[2] AS eps_best, b[3] AS alpha_best, b[1] IS NOT NULL AS feasible,
         coalesce(b[1], {jit_sql(lit(alpha_max), lit(bps / 1e4), rl)}) AS pi_best FROM sz1 z LEFT JOIN f{tag}_{rounds - 1} USING (q))"""
    return [*out, done]


OPTIMA = [x for b in (1.0, 5.0, 30.0) for x in optimum_sql(b)]
BESTS = "(SELECT * FROM b1 UNION ALL SELECT * FROM b5 UNION ALL SELECT * FROM b30)"
ORACLE["mixed_strategy"] = with_(T_, SIZES_SQL, *OPTIMA, body=f"SELECT fee_bps, q, {rd('pi_best', 8)}, feasible FROM {BESTS}")
ORACLE["regime_transition"] = with_(T_, SIZES_SQL, *OPTIMA, body=f"SELECT fee_bps, q, {rds({'sigma': 9, 'eps_best': 6, 'alpha_best': 4, 'pi_best': 9})}, feasible FROM {BESTS}")
