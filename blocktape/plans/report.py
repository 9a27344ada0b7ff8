"""Summary, ranking, series and validation tables over detected patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktape.functions.scalars import direction_label, finite, general, or_default, to_bool, to_float
from blocktape.sources.sinks import staged

QUANTILES = (0.1, 0.5, 0.9, 0.99)
LABELS = {"classical": "Classical sandwich", "jit-sandwich": "JIT-Sandwich"}


def quantiles(values: DataFrame, keys: list[str], levels: tuple[float, ...]) -> DataFrame:
    """(keys, q): linearly interpolated quantiles of column ``v`` per key, at each level; NULL values are left out.

    Equal values are counted first, then the distinct ones are sorted by ranges, and counts before each
    range give every value its ranks; only values at a wanted rank go on.  So a key may have more
    values than one task holds.
    """
    counts = values.filter("v is not null").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = staged(counts.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows"))
    by_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "_part", before.alias("_before"), F.sum("_rows").over(by_key).alias("_all"))  # a row for each range and key
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_upto", upto).join(parts, [*keys, "_part"]).withColumn("_last", F.col("_before") + F.col("_upto") - 1)
    low = [F.floor((F.col("_all") - 1) * q) for q in levels]
    high = [F.ceil((F.col("_all") - 1) * q) for q in levels]
    holds = lambda rank: (rank <= F.col("_last")) & (rank > F.col("_last") - F.col("_n"))
    wanted = placed.filter(reduce(lambda x, y: x | y, map(holds, low + high)))
    at = [F.max(F.when(holds(rank), F.col("v"))) for rank in low + high]
    found = wanted.groupBy(*keys).agg(F.max("_all").alias("_all"), F.array(*at).alias("_at"))

    def between(i: int, q: float) -> Column:
        share = (F.col("_all") - 1) * q - F.floor((F.col("_all") - 1) * q)
        a, b = F.col("_at")[i], F.col("_at")[i + len(levels)]
        return F.when(a == b, a).otherwise(a * (1.0 - share) + b * share)

    return found.select(*keys, F.array(*(between(i, q) for i, q in enumerate(levels))).alias("q"))


def summary(datasets: dict[str, tuple[DataFrame, str, str, str, str | None, tuple[str, ...]]]) -> DataFrame:
    """One row a dataset (frame, sigma, profit, origin, pattern, flags): counts, distinct keys, means, quantiles and true shares.

    Missing and infinite values are left out.  All quantiles come from one sort by ranges.
    """
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    rows, values = [], []
    for name, (df, sigma, profit, origin, pattern, flags) in datasets.items():
        out = df.withColumns({"_s": to_float(F.col(sigma)), "_p": to_float(F.col(profit))} | {f"_f{i}": to_bool(F.col(c)) for i, c in enumerate(flags)})
        rows.append(out.agg(
            F.lit(name).alias("dataset"), F.lit(sigma).alias("sigma_col"), F.lit(profit).alias("profit_col"),
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct(blank(origin)).alias("n_unique_origins"),
            (F.countDistinct(blank(pattern)) if pattern else F.lit(0).cast("long")).alias("n_patterns"),
            F.count("_s").alias("sigma_n"), F.avg("_s").alias("sigma_mean"), F.count("_p").alias("profit_n"), F.avg("_p").alias("profit_mean"),
            *(c for i, n in enumerate(flags) for c in (F.count(f"_f{i}").alias(f"{n}_n"), F.avg(F.col(f"_f{i}").cast("int")).alias(f"{n}_true_share"))),
        ))
        pair = F.array(F.struct(F.lit("sigma").alias("of"), F.col("_s").alias("v")), F.struct(F.lit("profit").alias("of"), F.col("_p").alias("v")))
        values.append(out.select(F.lit(name).alias("dataset"), F.explode(pair).alias("x")).select("dataset", "x.of", "x.v"))
    found = quantiles(combined(*values), ["dataset", "of"], QUANTILES)
    cells = {f"{of}_p{int(round(q * 100))}": F.max(F.when(F.col("of") == of, F.col("q")[i])) for of in ("sigma", "profit") for i, q in enumerate(QUANTILES) if q != 0.1}
    wide = found.groupBy("dataset").agg(*(c.alias(n) for n, c in cells.items()))
    return combined(*rows).join(wide, "dataset", "left")


def combined(*rows: DataFrame | None) -> DataFrame:
    """Rows of the datasets that exist, in one table."""
    out = None
    for r in rows:
        if r is not None:
            out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset")
    return out


KLL_K, HLL_BITS = 400, 14
RANK_ERROR, COUNT_ERROR = 0.012, 0.025  # three standard errors and more of these sizes


def sketched(df: DataFrame, dataset: Column, batch: Column, value: Column, item: Column) -> DataFrame:
    """(dataset, batch, quantiles, items): what a batch leaves for summaries over many of them, a few KB whatever its rows."""
    at = df.select(dataset.alias("dataset"), batch.alias("batch"), value.cast("double").alias("_v"), item.alias("_i"))
    return at.groupBy("dataset", "batch").agg(F.kll_sketch_agg_double("_v", KLL_K).alias("quantiles"), F.hll_sketch_agg("_i", HLL_BITS).alias("items"))


def merged_summary(sketches: DataFrame) -> DataFrame:
    """(dataset, n_values, p50, p90, p99, n_items) over all batches, none of which is read again.

    Quantiles are values whose rank is within RANK_ERROR of the asked one, n_items is within COUNT_ERROR of the number of
    distinct items; n_values is exact.
    """
    both = sketches.groupBy("dataset").agg(F.kll_merge_agg_double("quantiles", KLL_K).alias("_q"), F.hll_union_agg("items").alias("_i"))
    at = [F.kll_sketch_get_quantile_double("_q", F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 99)]
    return both.select("dataset", F.kll_sketch_get_n_double("_q").alias("n_values"), *at, F.hll_sketch_estimate("_i").alias("n_items"))


def frequencies(df: DataFrame, key: str, dataset: str, kind: str) -> DataFrame:
    """(dataset, kind, key, count) of trimmed, non-empty keys."""
    value = F.trim(F.col(key))
    return df.filter(value != "").groupBy(value.alias("key")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(dataset).alias("dataset"), F.lit(kind).alias("kind"), "key", "count")


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n largest per (dataset, kind); ties by key."""
    w = Window.partitionBy("dataset", "kind").orderBy(F.desc("count"), "key")
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


#: Titles of the summary table and its rule.
TITLES = ("Dataset", "Rows", "Unique origins", "σ p50", "σ p90", "Profit p50", "Profit p90")
RULE = "|---|---:|---:|---:|---:|---:|---:|"


def markdown(metrics: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(line_no, line) of a table of seven summary columns, datasets in the given order; missing numbers are blank."""
    spark = metrics.sparkSession
    cells = [F.col("dataset"), F.col("n_rows").cast("string"), F.col("n_unique_origins").cast("string"), *(general(F.col(c)) for c in ("sigma_p50", "sigma_p90", "profit_p50", "profit_p90"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c, F.lit("")) for c in cells)), F.lit(" |"))
    head = spark.createDataFrame([(1, f"| {' | '.join(TITLES)} |"), (2, RULE)], "line_no int, line string")
    return head.unionByName(metrics.select((F.array_position(F.array(*map(F.lit, order)), F.col("dataset")) + 2).cast("int").alias("line_no"), line.alias("line")))


def _series(df: DataFrame, sigma: Column, y: Column, label: str, origin: str, under: Column) -> DataFrame:
    name = F.col(origin) if origin in df.columns else F.lit("(unknown)")
    return df.select(finite(sigma).alias("sigma"), finite(y).alias("y"), F.lit(label).alias("label"), name.alias("origin"), under.alias("under_threshold")).na.drop()


def signed(c: str, absolute: bool) -> Column:
    v = F.col(c).try_cast("double")
    return F.abs(v) if absolute else v


def jit_series(df: DataFrame, absolute: bool = True) -> DataFrame:
    return _series(df, signed("sigma_gross", absolute), F.col("profit_total_per_x0"), "JIT", "origin", F.lit(False))


def sandwich_series(df: DataFrame, kind: str, absolute: bool = True) -> DataFrame:
    rows = df.filter(F.lower(F.trim("pattern_type")) == kind)
    return _series(rows, signed("sigma_gross", absolute), F.col("profit_per_x0"), LABELS[kind], "origin", F.abs(F.col("sigma_gross")) < F.col("sigma_min_backrun"))


def backrun_series(df: DataFrame, absolute: bool = True) -> DataFrame:
    return _series(df, signed("sigma_gross", absolute), F.col("profit_obs_per_x0"), "Back-run Arbitrage", "arb_origin", ~F.col("viable_sigma"))


def self_funded(df: DataFrame, back_div_r: bool = False) -> DataFrame:
    """Sandwiches whose legs move the same amount of the token that the victims get, within five base units."""
    x2y = F.col("front_dir") == "x2y"
    dec = F.when(x2y, or_default(df, ("token1_decimals", "dec1"), 18)).otherwise(or_default(df, ("token0_decimals", "dec0"), 6))
    unit = F.pow(F.lit(10.0), dec)
    side = lambda leg: F.when(x2y, F.abs(F.col(f"{leg}_a1"))).otherwise(F.abs(F.col(f"{leg}_a0")))
    back = side("back") / F.col("r") if back_div_r else side("back")
    return df.filter(F.abs(back / unit - side("front") / unit) <= 5.0 / unit)


def strategy_series(jit: DataFrame, sandwich: DataFrame, backrun: DataFrame, by_origin: bool = True, absolute: bool = True) -> DataFrame:
    """All four labelled series; with by_origin the classical one has self-funded rows only."""
    classical = self_funded(sandwich) if by_origin else sandwich
    return jit_series(jit, absolute).unionByName(sandwich_series(classical, "classical", absolute)).unionByName(sandwich_series(sandwich, "jit-sandwich", absolute)).unionByName(backrun_series(backrun, absolute))


def highlighted(series: DataFrame, n_jit: int, n_other: int, cap: int | None = None) -> DataFrame:
    """Distinct origins that are among the most frequent of either group, with their rank over all rows."""
    group = F.when(F.col("label") == "JIT", "jit").otherwise("other")
    counts = series.groupBy(group.alias("kind"), F.col("origin").alias("key")).agg(F.count(F.lit(1)).alias("count")).withColumn("dataset", F.lit("all"))
    chosen = top(counts.filter("kind = 'jit'"), n_jit).unionByName(top(counts.filter("kind = 'other'"), n_other)).select("key").distinct()
    total = counts.join(chosen, "key", "left_semi").groupBy("key").agg(F.sum("count").alias("count"))
    ranked = total.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "key")))  # n_jit + n_other rows at most
    return ranked.filter(F.col("rank") <= cap) if cap else ranked


def split_by_highlight(series: DataFrame, chosen: DataFrame) -> DataFrame:
    """(origin or `other`, label, under_threshold) groups with their number of points and largest sigma."""
    marked = series.join(F.broadcast(chosen.select(F.col("key").alias("origin"), F.lit(True).alias("_h"))), "origin", "left")
    name = F.when(F.col("_h"), F.col("origin")).otherwise("other")
    return marked.groupBy(name.alias("origin"), "label", "under_threshold").agg(F.count(F.lit(1)).alias("n_points"), F.max("sigma").alias("max_sigma"))


def series_summary(series: DataFrame) -> DataFrame:
    q = quantiles(series.select("label", F.col("y").alias("v")), ["label"], (0.5, 0.9))
    means = series.groupBy("label").agg(F.count("y").alias("n"), F.avg("y").alias("mean"))
    return means.join(q, "label", "left").select("label", "n", F.col("q")[0].alias("median"), "mean", F.col("q")[1].alias("p90"))


def identity_rows(sandwich: DataFrame, back_div_r: bool = False) -> DataFrame:
    """Observed and predicted back-run amounts in the victims' output token, for rows with added liquidity."""
    d = direction_label(F.coalesce(F.col("victim_dir"), F.col("front_dir")))
    out = lambda a0, a1: -F.when(d == "x_to_y", F.col(a1)).when(d == "y_to_x", F.col(a0))
    obs = out("back_a0", "back_a1") / F.col("r") if back_div_r else out("back_a0", "back_a1")
    rows = sandwich.filter(F.lower(F.trim("pattern_type")) == "jit-sandwich").select(
        d.alias("victim_dir"), out("front_a0", "front_a1").alias("q_fr"), out("s_net_token0", "s_net_token1").alias("v"), F.col("attacker_liq_share").alias("alpha"), obs.alias("q_br_obs")
    )
    rows = rows.withColumn("q_br_hat", -(F.col("q_fr") - F.col("alpha") * F.col("v")))
    return rows.na.drop().select("victim_dir", "q_fr", "v", "alpha", "q_br_obs", "q_br_hat")


def identity_fit(rows: DataFrame) -> DataFrame:
    """Fit statistics over all rows (victim_dir NULL, overall true) and by direction.  A constant prediction has no slope."""
    e = F.col("q_br_obs") - F.col("q_br_hat")
    gap = F.abs("q_fr") - F.abs("q_br_obs")
    base = rows.withColumns({"v": F.when(F.col("q_br_hat") != 0, F.abs(e / F.col("q_br_hat"))), "_e": e, "_gap": gap, "_av": F.col("alpha") * F.col("v")})
    each = base.withColumn("group", F.explode(F.array(F.lit("all"), F.col("victim_dir"))))  # two rows for one: all, and its direction
    fits = each.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.corr("q_br_obs", "q_br_hat").alias("corr_obs_hat"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg((F.abs("q_br_obs") < F.abs("q_fr")).cast("int")).alias("share_br_below_fr"), F.corr("_av", "_gap").alias("corr_av_gap"),
        F.regr_intercept("q_br_obs", "q_br_hat").alias("intercept"), F.regr_slope("q_br_obs", "q_br_hat").alias("slope"),
    )
    middle = quantiles(each.select("group", "v"), ["group"], (0.5,)).select("group", F.col("q")[0].alias("median_rel_error"))
    overall = F.col("group") == "all"
    return fits.join(middle, "group", "left").withColumns({"overall": overall, "victim_dir": F.when(~overall, F.col("group"))}).drop("group")


def identity_pairs(rows: DataFrame, unit: float = 1.0) -> DataFrame:
    """(victim_dir, front_size, back_size, below): what a scatter of front-runs against back-runs shows, in whole units."""
    front, back = F.abs("q_fr") / unit, F.abs("q_br_obs") / unit
    return rows.select("victim_dir", front.alias("front_size"), back.alias("back_size"), (back < front).alias("below"))


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"), F.max(F.abs(column)).alias("largest_abs"))


def threshold_guides(spark, fees_bps: list[float]) -> DataFrame:
    """Onset sizes of back-runs and of sandwiches per fee."""
    from blocktape.functions.theory import backrun_threshold, sandwich_onset

    rows = [(float(b), backrun_threshold(1 - b / 1e4), sandwich_onset(1 - b / 1e4)) for b in fees_bps]
    return spark.createDataFrame(rows, "fee_bps double, sigma_min_backrun double, sandwich_onset double")


