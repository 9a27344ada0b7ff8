"""Economics of detected patterns: derived columns only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktape.functions import theory as T
from blocktape.functions.scalars import fee_bps, safe_div

NEAR_TARGET = 1e-2


def _rates(fee: float | None) -> tuple[float, float]:
    f = fee_bps(fee) / 10_000.0
    return f, 1.0 - f


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def sizes(df: DataFrame, r: float, x2y: Column) -> DataFrame:
    """p0 and the victim's size, gross and net of the fee, per token and in the token that goes in."""
    out = df.withColumns({"p0": safe_div(F.col("y0"), F.col("x0")), "sigma0_gross": safe_div(F.col("s_net_token0"), F.col("x0")), "sigma1_gross": safe_div(F.col("s_net_token1"), F.col("y0"))})
    out = out.withColumn("sigma_gross", F.when(x2y, F.col("sigma0_gross")).otherwise(F.col("sigma1_gross")))
    out = out.withColumns({f"sigma{n}_net": r * F.col(f"sigma{n}_gross") for n in ("", "0", "1") if n} | {"sigma_net": r * F.col("sigma_gross")})
    return out.withColumn("i_theory", F.when(x2y, T.impact_x2y(r, F.col("sigma_gross"))).otherwise(T.impact_y2x(r, F.col("sigma_gross"))))


def in_token0(native: Column, x2y: Column) -> Column:
    return F.when(x2y, native).otherwise(safe_div(native, F.col("p0")))


def backrun_metrics(df: DataFrame, fee: float | None = None) -> DataFrame:
    """Sizes, impact, thresholds, best and observed profit, flags and label of reverse back-runs.

    near_target compares with r p0 in both directions.  Unknown comparisons count as false, so a row
    without a size is subthreshold, one without measured impact has the wrong sign.
    """
    f, r = _rates(fee)
    x2y = F.col("victim_dir") == "x2y"
    out = sizes(df, r, x2y)
    base = F.when(x2y, F.col("x0")).otherwise(F.col("y0"))
    impact = safe_div(F.col("p_victim_post"), F.col("p_victim_pre")) - 1.0
    out = out.withColumns({
        "fee_fraction": F.lit(f), "r": F.lit(r), "i_measured": impact, "sigma_min_backrun": F.lit(T.backrun_threshold(r)),
        "br_pi_star_token0": in_token0(T.backrun_best(base, r, F.col("sigma_gross")), x2y),
        "profit_obs_token0": -F.col("back_a0") + safe_div(-F.col("back_a1"), F.col("p0")),
        "viable_sigma": _true(F.col("sigma_gross") >= T.backrun_threshold(r)),
        "reverted": _true(F.when(x2y, F.col("p_back_post") > F.col("p_victim_post")).otherwise(F.col("p_back_post") < F.col("p_victim_post"))),
        "near_target": _true(F.abs(F.col("p_back_post") - r * F.col("p0")) <= NEAR_TARGET * F.abs(F.col("p0"))),
        "mmax_jit_token0": F.when(x2y, f * F.col("s_net_token0")).otherwise(f * safe_div(F.col("s_net_token1"), F.col("p0"))),
    })
    sign_ok = _true(F.when(x2y, F.col("i_measured") < 0).otherwise(F.col("i_measured") > 0))
    label = F.when(~F.col("viable_sigma"), "subthreshold").when(~sign_ok, "wrong_sign").when(~F.col("reverted"), "no_reversion").otherwise("candidate")
    return out.withColumns({
        "reverse_label": label, "br_pi_star_per_x0": safe_div(F.col("br_pi_star_token0"), F.col("x0")),
        "profit_obs_per_x0": safe_div(F.col("profit_obs_token0"), F.col("x0")),
    })


def jit_metrics(df: DataFrame, fee: float | None = None) -> DataFrame:
    """Direction from the sign of the net flow, fee revenue by liquidity share, inventory change and their sum."""
    f, r = _rates(fee)
    out = df.withColumn("victim_dir", F.when(F.col("s_net_token0") >= 0, "x2y").otherwise("y2x"))
    x2y = F.col("victim_dir") == "x2y"
    out = sizes(out, r, x2y)
    share = F.col("attacker_liq_share")
    fees = F.when(x2y, f * F.col("s_net_token0") * share).otherwise(f * share * safe_div(F.col("s_net_token1"), F.col("p0")))
    held = (F.col("burn_amount0") - F.col("mint_amount0")) + safe_div(F.col("burn_amount1") - F.col("mint_amount1"), F.col("p0"))
    out = out.withColumns({"fee_fraction": F.lit(f), "r": F.lit(r), "profit_fee_token0": fees, "profit_il_token0": held})
    out = out.withColumn("profit_total_token0", F.col("profit_fee_token0") + F.col("profit_il_token0"))
    return out.withColumn("profit_total_per_x0", safe_div(F.col("profit_total_token0"), F.col("x0")))


def is_jit_row() -> Column:
    return _true(F.lower("pattern_type").contains("jit")) | (F.col("mint_tx").isNotNull() & F.col("burn_tx").isNotNull())


def alpha_of_share(share: Column) -> Column:
    s = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0 - 1e-12))
    return F.when(share.isNotNull(), s / (1.0 - s))


def sandwich_metrics(df: DataFrame, fee: float | None = None, gamma: float = 0.01, grid: int = 128) -> DataFrame:
    """Profit of the two legs, liquidity terms of just-in-time rows, and theory at the observed sizes."""
    f, r = _rates(fee)
    out = df.withColumn("victim_dir", F.col("front_dir"))
    x2y = F.col("victim_dir") == "x2y"
    out = sizes(out, r, x2y).withColumn("is_jit", is_jit_row())
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    pos = lambda c: F.greatest(c, F.lit(0.0))
    flow = lambda t: (pos(-zero(f"front_a{t}")) + pos(-zero(f"back_a{t}"))) - (pos(zero(f"front_a{t}")) + pos(zero(f"back_a{t}")))
    share = F.col("attacker_liq_share")
    native = f * F.when(x2y, F.col("s_net_token0")).otherwise(F.col("s_net_token1")) * share
    lp = (zero("burn_amount0") - zero("mint_amount0")) + safe_div(zero("burn_amount1") - zero("mint_amount1"), F.col("p0"))
    eps = F.when(x2y, safe_div(F.abs(zero("front_a0")), F.col("x0"))).otherwise(safe_div(F.abs(zero("front_a1")), F.col("y0")))
    base = F.when(x2y, F.col("x0")).otherwise(F.col("y0"))
    sigma = F.col("sigma_gross")
    out = out.withColumns({
        "fee_fraction": F.lit(f), "r": F.lit(r), "profit_token0_base": flow(0) + safe_div(flow(1), F.col("p0")),
        "jit_fee_token0": F.when(F.col("is_jit") & (share > 0), F.coalesce(in_token0(native, x2y), F.lit(0.0))).otherwise(0.0),
        "lp_token_delta_token0": F.when(F.col("is_jit"), lp).otherwise(0.0), "eps_gross": eps, "eps_net": r * eps,
        "i_measured": safe_div(F.col("p_victim_post"), F.col("p_victim_pre")) - 1.0, "sigma_min_backrun": F.lit(T.backrun_threshold(r)),
        "br_pi_star_token0": in_token0(T.backrun_best(base, r, sigma), x2y), "sand_pi_obs_token0": in_token0(base * T.sandwich_profit(eps, sigma, r), x2y),
        "eps_max_classic": T.eps_cap(sigma, gamma, r),
        "eps_max_jit": T.eps_cap_jit(sigma, gamma, r, alpha_of_share(share)), "gamma_used": F.lit(gamma),
        "sigma_star_br_vs_jit_phi0": F.lit(T.backrun_vs_jit(f, 0.0, r)).cast("double"),
    })
    out = out.withColumn("_best", T.sandwich_best(sigma, F.col("eps_max_classic"), r, grid))
    out = out.withColumns({
        "profit_token0": F.col("profit_token0_base") + F.col("jit_fee_token0") + F.col("lp_token_delta_token0"),
        "sand_pi_star_token0": in_token0(base * F.col("_best.profit"), x2y), "eps_star": F.col("_best.eps"),
        "eps_max": F.when(F.col("is_jit"), F.coalesce("eps_max_jit", "eps_max_classic")).otherwise(F.col("eps_max_classic")),
        "tx_sequence": F.array_compact(F.concat(F.array("front_tx", "mint_tx"), F.coalesce("victim_txs", F.array().cast("array<string>")), F.array("burn_tx", "back_tx"))),
    })
    per = {f"{a}_per_x0": safe_div(F.col(f"{a}_token0"), F.col("x0")) for a in ("profit", "br_pi_star", "sand_pi_obs")}
    return out.withColumns(per | {"sand_pi_star": safe_div(F.col("sand_pi_star_token0"), F.col("x0"))}).drop("_best")
