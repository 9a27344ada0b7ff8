import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blocktape.functions import scalars as S
from blocktape.functions import theory as T
from blocktape.plans import sweep


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_caps(spark):
    assert value(spark, T.eps_cap(F.lit(0.01), 0.0, 0.997)) == pytest.approx(0, abs=1e-12)
    assert value(spark, T.eps_cap(F.lit(0.01), 1.0, 0.997)) == math.inf
    assert value(spark, T.eps_cap(F.lit(None).cast("double"), 0.01, 0.997)) == 0.0
    assert value(spark, T.eps_cap_jit(F.lit(None).cast("double"), 0.01, 0.997, F.lit(1.0))) is None
    assert value(spark, T.eps_cap_jit(F.lit(0.01), 0.01, 0.997, F.lit(0.0))) == pytest.approx(value(spark, T.eps_cap(F.lit(0.01), 0.01, 0.997)))


def test_threshold_and_crossing():
    assert T.backrun_threshold(1 - 0.0005) == pytest.approx(0.00025, rel=1e-2)  # about half the fee
    f, r = 0.003, 0.997
    u = 1 + r * T.backrun_vs_jit(f, 0.0, r)
    assert (r - f) * u * u + (f - 2 * math.sqrt(r)) * u + 1 == pytest.approx(0, abs=1e-12)


def test_best_sandwich_is_the_first_grid_maximum(spark):
    r, sigma, gamma, n = 0.997, 0.02, 0.01, 128
    cap = value(spark, T.eps_cap(F.lit(sigma), gamma, r))

    def profit(e):
        t = 1 + r * e + r * sigma
        return r * r * e * t * t / ((1 + r * e) + r * r * e * t) - e

    grid = [cap if j == n - 1 else j * (cap / (n - 1)) for j in range(n)]
    got = value(spark, T.sandwich_best(F.lit(sigma), F.lit(cap), r, n))
    want = max(range(n), key=lambda j: (profit(grid[j]), -j))
    assert got.eps == pytest.approx(grid[want]) and got.profit == pytest.approx(profit(grid[want]))
    assert value(spark, T.sandwich_best(F.lit(sigma), F.lit(0.0), r, n)).eps == 0


def test_mixed_falls_back_to_liquidity_alone(spark):
    args = (F.lit(0.01), F.lit(1.0), F.lit(0.01))
    assert value(spark, T.rational_profit(F.lit(0.001), F.lit(1.0), F.lit(0.01), 0.003, 0.997)) == pytest.approx(value(spark, T.jit_profit(F.lit(0.01), 0.003, 0.997, F.lit(1.0))))
    assert value(spark, T.theta(*args, 0.997)) >= 0


def test_scalars(spark):
    assert value(spark, S.raw_units(F.lit("1.5"), 6)) == 1500000
    assert value(spark, S.raw_units(F.lit("-0.01"), 18)) == -(10**16)
    assert value(spark, S.raw_units(F.lit("x"), 6)) is None
    assert value(spark, S.to_unix(F.lit("0"))) == 0 and value(spark, S.to_unix(F.lit("1970-01-02T00:00:00Z"))) == 86400
    assert value(spark, S.to_number(F.lit("0xff"))) == 255.0 and value(spark, S.to_number(F.lit("nan"))) is None
    assert value(spark, S.virtual_x(F.lit(1.0), F.lit(S.Q96))) == 1.0
    assert value(spark, S.safe_div(F.lit(1.0), F.lit(0.0))) is None and value(spark, S.safe_div(F.lit(1e308), F.lit(1e-10))) is None
    assert value(spark, S.direction_label(F.lit(" 0->1 "))) == "x_to_y"
    assert S.fee_bps(0.003) == 30 and S.fee_bps(5) == 5 and S.fee_bps(None) == 5
    with pytest.raises(ValueError):
        S.fee_bps(-1)


def dense_profit(sigma, f, gamma, alpha, share):
    """Mixed profit, theta and cap over arrays of alpha and of shares of the cap, written apart from the column functions."""
    r = 1 - f
    s, scale = r * sigma, 1 + alpha
    cap = np.maximum(0, ((np.sqrt(s * s + 4 * (1 + s) * scale**2 / (1 - gamma)) - s) / (2 * scale) - 1) / r)
    eps = cap * share
    t = (1 + r * eps) * (1 + alpha) + r * sigma
    th = r / (1 + r * eps) * (eps - alpha * sigma / t)
    profit = t * t * r * th / ((1 + alpha) * (1 + alpha + t * r * th)) - eps + alpha * sigma / (1 + alpha)
    return np.where((eps > 0) & (th > 1e-12), profit, -np.inf)


def test_mixed_optimum_is_no_worse_than_a_dense_grid(spark):
    sizes = [1e-5, 1e-4, 1e-3, 3e-3, 0.01, 0.03, 0.1, 0.3, 1.0]
    keys = spark.createDataFrame([(i, fee, s) for i, (s, fee) in enumerate((s, fee) for s in sizes for fee in (0.0001, 0.003))], "k int, fee double, sigma double")
    rows = sweep.mixed_optimum(keys, ["k", "fee"], F.col("fee"), 0.01, 10.0).collect()
    assert len(rows) == keys.count()
    for row in rows:
        # dense where the best one lies as well: the funded alphas of large sizes end far below 10
        alpha = np.unique(np.concatenate([np.linspace(0, 10, 2001), np.linspace(0, 0.5, 2001)]))[:, None]
        best = dense_profit(row.sigma, row.fee, 0.01, alpha, np.linspace(0, 1, 401)[None, :]).max()
        assert row.mixed_best == pytest.approx(float(dense_profit(row.sigma, row.fee, 0.01, np.float64(row.alpha_best), 1.0 if row.eps_best == 0 else np.linspace(0, 1, 200001)).max()), abs=1e-9)
        assert row.mixed_best >= best - 1e-6 * abs(best) - 1e-12


def test_mixed_optimum_without_a_feasible_point_and_its_plan(spark):
    rows = spark.createDataFrame([(1, None), (2, -1.0), (3, 0.02)], "k int, sigma double")
    found = sweep.mixed_optimum(rows, ["k"], 0.003, 0.01, 10.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {r.k: r.mixed_best is None for r in found.collect()} == {1: True, 2: True, 3: False}
