"""Theory sweeps as grid jobs: parameter grids crossed with one another, formula columns, constrained maxima.

Grids are parameters of the job, not data: their sizes are known, and they are broadcast to the sizes, which are data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocktape.functions import theory as T

BOUNDS = ["_a0", "_a1", "_u0", "_u1"]  # of one round's window


def spread(sizes: DataFrame, *keys: str) -> DataFrame:
    """Few rows that each make many points, over all cores: by their own size they would share one task."""
    return sizes.repartition(max(8, sizes.sparkSession.sparkContext.defaultParallelism), *keys)


def grid(spark: SparkSession, name: str, low: float, high: float, n: int) -> DataFrame:
    """(i_name, name): n even points from low to high, both included."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias(f"i_{name}"), (F.lit(low) + F.col("id") * F.lit(step)).alias(name))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: plain projections would be merged and repeat them wherever they are read."""
    names = ", ".join(f"_k.{c}" for c in columns)
    once = df.withColumn("_k", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return once.select(*[c for c in df.columns if c not in columns], *names.split(", "))


def crossed(first: DataFrame, *others: DataFrame) -> DataFrame:
    first = spread(first)
    for g in others:
        first = first.crossJoin(F.broadcast(g))  # a grid of known size
    return first


def mixed_optimum(sigmas: DataFrame, keys: list[str], f: float | Column, gamma: float, alpha_max: float, n: int = 21, rounds: int = 6, floor: float = 1e-12) -> DataFrame:
    """(keys, sigma, eps_best, alpha_best, mixed_best): the largest mixed profit with eps up to its cap and a funded back-run.

    The fee f may be a column made of keys, so that one pass serves many fees; keys name a row.

    A grid of n x n points over alpha and the way of eps from the first funded one to the cap, so that the bound of
    funding, along which profits make a narrow ridge, lies along the grid; eps is squared along the way, for the best
    of small sizes lie close to that bound.  Then rounds of the same size, each around the last one's best point and
    4 / (n - 1) as wide: the last step of alpha is alpha_max * (4 / (n - 1)) ** (rounds - 1) / (n - 1) at most.
    All rounds share the partitioning by keys, and the points of a row are made and dropped inside a task: one
    exchange in all.  NULL where no point is feasible.
    """
    r, sigma = 1.0 - f, F.col("sigma")
    down = F.sequence(F.lit(n - 1), F.lit(0))  # max_by keeps the last of equals, here the first point

    def placed(df: DataFrame) -> DataFrame:
        """Adds _a, _u, _e and _p of the point (_i, _j)."""
        at = computed(df, **{c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (F.col(i) / float(n - 1)) for c, i in (("_a", "_i"), ("_u", "_j"))})
        low = T.funded_from(F.col("_a"), sigma, r)
        at = computed(at, _e=low + (T.eps_cap_jit(sigma, gamma, r, F.col("_a")) - low) * (F.col("_u") * F.col("_u")))
        at = computed(at, _th=T.theta(F.col("_e"), F.col("_a"), sigma, r, clip=False))
        ok = (F.col("_e") > 0) & (F.col("_th") > floor)
        return computed(at, _p=F.when(ok, T.mixed_profit(F.col("_e"), F.col("_a"), sigma, r, th=F.col("_th"))))

    def searched(df: DataFrame) -> DataFrame:
        """df with its best point; numbers only in the aggregate, so that a task holds a row of them for each size."""
        every = placed(df.withColumn("_i", F.explode(down)).withColumn("_j", F.explode(down)))
        best = every.groupBy(*keys, "sigma", *BOUNDS).agg(F.max_by(F.col("_i") * n + F.col("_j"), "_p").alias("_at"))
        return placed(best.withColumns({"_i": F.floor(F.col("_at") / n), "_j": F.col("_at") % n}))

    whole = {"_a0": F.lit(0.0), "_a1": F.lit(float(alpha_max)), "_u0": F.lit(0.0), "_u1": F.lit(1.0)}
    at = searched(spread(sigmas.select(*keys, "sigma"), *keys).withColumns(whole))
    for k in range(1, rounds):
        narrow = 2.0 / (n - 1) * (4.0 / (n - 1)) ** (k - 1)
        ends = {}
        for c, top in (("_a", float(alpha_max)), ("_u", 1.0)):
            ends[f"{c}0"] = F.greatest(F.coalesce(F.col(c), F.lit(0.0)) - top * narrow, F.lit(0.0))
            ends[f"{c}1"] = F.least(F.coalesce(F.col(c), F.lit(top)) + top * narrow, F.lit(top))
        at = searched(computed(at.select(*keys, "sigma", "_a", "_u"), **ends))
    return at.select(*keys, "sigma", F.col("_e").alias("eps_best"), F.col("_a").alias("alpha_best"), F.col("_p").alias("mixed_best"))


def strategies(df: DataFrame, keys: list[str], f: float, gamma: float, alpha: float = 1.0, grid_n: int = 100) -> DataFrame:
    """(keys, sigma, fee_fraction, pi_jit, pi_backrun, pi_sandwich): profits of just-in-time liquidity, back-run and best sandwich at each sigma."""
    r, sigma = 1.0 - f, F.col("sigma")
    points = spread(df, *keys).select(*keys, "sigma").withColumn("_cap", T.eps_cap(sigma, gamma, r)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(grid_n - 1))))
    eps = F.when(F.col("_j") == grid_n - 1, F.col("_cap")).otherwise(F.col("_j") * (F.col("_cap") / float(grid_n - 1)))
    best = points.withColumn("_e", eps).withColumn("_p", T.sandwich_profit(F.col("_e"), sigma, r)).groupBy(*keys, "sigma").agg(F.max("_p").alias("pi_sandwich"))
    return best.withColumns({"fee_fraction": F.lit(f), "pi_jit": T.jit_profit(sigma, f, r, F.lit(alpha)), "pi_backrun": T.backrun_profit(r, sigma)})


def eps_caps(df: DataFrame, gammas: list[float], r: float, alpha: float = 1.0) -> DataFrame:
    """eps caps at each sigma for several tolerances."""
    rows = F.array(*(F.struct(F.lit(float(g)).alias("gamma"), T.eps_cap(F.col("sigma"), g, r).alias("eps_max"), T.eps_cap_jit(F.col("sigma"), g, r, F.lit(alpha)).alias("eps_max_jit")) for g in gammas))
    return df.withColumn("_c", F.explode(rows)).select(*df.columns, "_c.*")


def profit_at(df: DataFrame, name: str, alpha: str, r: float) -> DataFrame:
    """df with the mixed profit at eps, sigma and the named added liquidity."""
    e, a, sigma = F.col("eps"), F.col(alpha), F.col("sigma")
    with_share = computed(df, _th=T.theta(e, a, sigma, r))
    return computed(with_share, **{name: T.mixed_profit(e, a, sigma, r, th=F.col("_th"))}).drop("_th")


def surface(sigmas: DataFrame, eps: DataFrame, alpha: DataFrame, r: float) -> DataFrame:
    """Mixed profit at every size over a grid of the other two parameters."""
    return profit_at(crossed(sigmas, eps, alpha), "profit", "alpha", r)


def surface_range(cube: DataFrame) -> DataFrame:
    return cube.agg(F.count(F.lit(1)).alias("cells"), F.min("profit").alias("lowest"), F.max("profit").alias("highest"), F.max(F.abs("profit")).alias("largest_abs"))


def neighbours(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """(i_alpha, alpha, before, after) of an even grid: neighbours come with each point, so that differences need no shuffle."""
    step = (high - low) / (n - 1)
    point = lambda i: F.lit(low) + i * F.lit(step)
    return spark.range(n).select(F.col("id").alias("i_alpha"), *(point(F.col("id") + k).alias(c) for c, k in (("alpha", 0), ("before", -1), ("after", 1))))


def zero_contour(sigmas: DataFrame, eps: DataFrame, alpha: DataFrame, r: float) -> DataFrame:
    """Cells whose profit has another sign than that of the cell before along alpha."""
    both = profit_at(profit_at(crossed(sigmas, eps, alpha.filter("i_alpha > 0")), "profit", "alpha", r), "_b", "before", r)
    return both.filter("_b * profit < 0 or (profit = 0 and _b <> 0)").drop("_b")


def slope_along_alpha(sigmas: DataFrame, eps: DataFrame, alpha: DataFrame, n: int, r: float) -> DataFrame:
    """Central difference of profit along the n points of alpha."""
    inner = crossed(sigmas, eps, alpha.filter((F.col("i_alpha") > 0) & (F.col("i_alpha") < n - 1)))
    both = profit_at(profit_at(inner, "_n", "after", r), "_b", "before", r)
    return both.withColumn("slope", (F.col("_n") - F.col("_b")) / (F.col("after") - F.col("before"))).drop("_n", "_b")


def rational_curve(sigmas: DataFrame, keys: list[str], low: float, high: float, n: int, alpha: float, f: float) -> DataFrame:
    """(keys, sigma, i_eps, eps, profit): the rational bundle's profit along front-runs."""
    step = (high - low) / (n - 1)
    at = spread(sigmas, *keys).select(*keys, "sigma", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i_eps")).withColumn("eps", F.lit(low) + F.col("i_eps") * F.lit(step))
    return computed(at, profit=T.rational_profit(F.col("eps"), F.lit(float(alpha)), F.col("sigma"), f, 1.0 - f))
