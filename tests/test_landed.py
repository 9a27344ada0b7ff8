"""Landed tables: what is read, how it is joined; wide numbers and ordered merges."""

import random

import pytest
from pyspark.sql import functions as F

from blocktape.functions import scalars, wide
from blocktape.operators import state
from blocktape.plans.queries import QUERIES
from blocktape.sources import landed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    scan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    while scan.children().size():
        scan = scan.children().head()
    return scan.metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def rows(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plans tell all filters
    return spark.range(4000).selectExpr("concat('p', id % 3) pool", "id div 3 block_number", "id * 10 ts_unix", "lpad(id, 6, '0') id", "if(id % 500 < 5, null, id) level")


def test_a_window_opens_few_files_and_filters_in_them(spark, rows, tmp_path):
    landed.land(rows, f"{tmp_path}/log", "ts_unix", 4000)
    table = landed.read_landed(spark, f"{tmp_path}/log", rows.schema)
    part = landed.window(table, "ts_unix", 4000, 9_000, 13_999, "p1", "001000")
    want = rows.filter("ts_unix between 9000 and 13999 and pool = 'p1' and id > '001000'")
    assert sorted(map(tuple, part.select(*rows.columns).collect())) == sorted(map(tuple, want.collect()))
    told = plan(part)
    assert "pool" in told.split("PartitionFilters: [")[1].split("]")[0] and "stretch" in told.split("PartitionFilters: [")[1].split("]")[0]
    assert all(f in told.split("PushedFilters: [")[1] for f in ("GreaterThanOrEqual(ts_unix,9000)", "LessThanOrEqual(ts_unix,13999)", "GreaterThan(id,001000)"))
    assert files_read(part) <= 2 < 30 <= files_read(table)
    landed.land(rows.filter("pool = 'p1'"), f"{tmp_path}/log", "ts_unix", 4000)  # landing again replaces what it brings
    assert landed.read_landed(spark, f"{tmp_path}/log", rows.schema).count() == 4000


def test_only_stretches_that_lack_something_are_opened(spark, rows, tmp_path, monkeypatch):
    landed.land(rows, f"{tmp_path}/log", "block_number", 100)
    table = landed.read_landed(spark, f"{tmp_path}/log", rows.schema)
    wanted = landed.wanted_stretches(rows, F.col("level").isNull(), 100)
    few = landed.of_stretches(table, wanted)
    keys = {(r.pool, r.stretch) for r in wanted.collect()}
    want = [r for r in rows.collect() if (r.pool, r.block_number // 100) in keys]
    assert "dynamicpruning" in plan(few) and sorted(r.id for r in few.collect()) == sorted(r.id for r in want) and 0 < len(want) < 4000
    monkeypatch.setattr(landed, "MOST_STRETCHES", 1)
    assert landed.of_stretches(table, wanted).count() == len(want)


def test_buckets_meet_without_an_exchange(spark, rows):
    events = landed.bucketed(rows.withColumn("tx", F.when(F.col("block_number") < 300, "hot").otherwise(F.concat(F.lit("t"), "block_number"))), "tx", 4)
    lookup = landed.bucketed(rows.selectExpr("concat('t', block_number) tx", "ts_unix from_ts").unionByName(spark.createDataFrame([("hot", 7)], "tx string, from_ts long")), "tx", 4)
    one = lookup.groupBy("tx").agg(F.min("from_ts").alias("from_ts"))
    want = {r.id: 7 if r.block_number < 300 else r.block_number * 30 for r in rows.collect()}
    for hot_rows in (10_000, 500):
        both = landed.join_buckets(events, one, "tx", hot_rows)
        assert {r.id: r.from_ts for r in both.collect()} == want
        assert "Exchange hashpartitioning" not in plan(both)
    with pytest.raises(ValueError):
        landed.MOST_HOT, most = 0, landed.MOST_HOT
        try:
            landed.join_buckets(events, one, "tx", 500)
        finally:
            landed.MOST_HOT = most


def test_wide_numbers(spark):
    g = random.Random(4)
    values = [0, 1, 10**9 - 1, 10**9, 2**128 - 1, 2**256 - 1, *(g.getrandbits(g.randint(1, 256)) for _ in range(60))]
    df = spark.createDataFrame([(f"{v:x}" if k % 2 else f"{v:064X}", str(v)) for k, v in enumerate(values)], "h string, want string")
    assert all(r.got == r.want for r in df.select(wide.decimal_text(F.col("h")).alias("got"), "want").collect())
    bad = spark.createDataFrame([("",), ("xyz",), (None,), ("1" * 65,)], "h string").select(wide.decimal_text(F.col("h")).alias("got"))
    assert all(r.got is None for r in bad.collect())


def test_units_of_any_length_and_strictly(spark):
    texts = ["1.5", "-0.01", "-0.0000001", "12345678901234567890123456789012345678901234567890.123456789", ".5", "5.", "+7", "0", "-0", "", ".", "1e5", "abc", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(scalars.raw_units_text(F.col("t"), 6)).collect()]
    assert got == ["1500000", "-10000", "0", "12345678901234567890123456789012345678901234567890123456", "500000", "5000000", "7000000", "0", "0", None, None, None, None, None]
    assert [r[0] for r in df.filter("t in ('1.5', '+7')").select(scalars.raw_units_text(F.col("t"), 1, strict=True)).collect()] == ["15", "70"]
    with pytest.raises(Exception, match="no whole number of units"):
        df.filter("t = '-0.01'").select(scalars.raw_units_text(F.col("t"), 1, strict=True)).collect()
    with pytest.raises(ValueError):
        scalars.raw_units_text(F.col("t"), -1)


def test_addresses(spark):
    a = "0xAbCdef0123456789abcdef0123456789ABCDEF01"
    df = spark.createDataFrame([(x,) for x in (a, f" {a.upper()} ", a[:-1], a[2:], "", None, "0x" + "g" * 40)], "a string")
    assert [r[0] for r in df.select(scalars.address(F.col("a"))).collect()] == [a.lower(), a.lower(), None, None, None, None, None]


def test_places_in_order(spark, rows):
    got = state.in_order(rows.repartition(5), "ts_unix").select("seq", "ts_unix").collect()
    assert sorted((r.seq, r.ts_unix) for r in got) == [(n, n * 10) for n in range(4000)]
    assert state.in_order(rows.limit(0), "ts_unix").count() == 0


def test_spans_make_no_folder_of_each_far_block(spark, tmp_path):
    df = spark.range(300).select(F.when(F.col("id") < 200, "far").otherwise("near").alias("pool"), F.when(F.col("id") < 200, F.col("id") * 100).otherwise(F.col("id") - 200).alias("block_number"), "id")
    spans = landed.spans(df, "block_number", 20, least_rows=50)
    by_pool = {r.pool: r.span for r in spans.collect()}
    assert by_pool["near"] == 60 and by_pool["far"] % 20 == 0 and by_pool["far"] >= 19901 // 4
    by_span = landed.with_span(df, spans, 20)
    landed.land(by_span, f"{tmp_path}/log", "block_number", F.col("span"))
    assert len(list((tmp_path / "log" / "pool=far").iterdir())) <= 5  # 200 of 20 blocks each
    table = landed.read_landed(spark, f"{tmp_path}/log", df.schema)
    few = landed.of_stretches(table, landed.wanted_stretches(by_span, F.col("id") == 7, F.col("span")))
    assert {7} <= {r.id for r in few.collect()} < set(range(200))


def test_text_of_128_bits(spark):
    numbers = [0, 9, 10**18 - 1, 10**18, 2**64 - 1, 2**64, 10**38 - 1, 10**38, 2**127, 2**128 - 1]
    df = spark.createDataFrame([(f"{n:032x}", str(n)) for n in numbers] + [("", None), ("0g", None), ("1" * 33, None), ("F", "15")], "d string, t string")
    assert df.filter(~wide.decimal_text_128(F.col("d")).eqNullSafe(F.col("t"))).count() == 0


def test_the_merged_log_sorts_what_is_written(spark, sf, monkeypatch):
    plans, staged = [], state.staged
    monkeypatch.setattr(state, "staged", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or staged(df))
    QUERIES["merged_log"](spark, sf)
    assert len(plans) == 1 and "Window" not in plans[0]
