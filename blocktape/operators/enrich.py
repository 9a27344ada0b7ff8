"""Fill missing attributes of events by joins on the transaction, and decode swap logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktape.functions.scalars import is_missing_number, is_missing_text
from blocktape.functions.wide import decimal_text_128

GAS = ["gas_used", "gas_price", "effective_gas_price"]


def worklist(events: DataFrame, missing: Column, lower: bool = False) -> DataFrame:
    """Distinct transactions whose attribute is missing."""
    key = F.lower("tx_hash") if lower else F.col("tx_hash")
    return events.filter(missing & ~is_missing_text(F.col("tx_hash"))).select(key.alias("tx_hash")).distinct()


def fill_origin(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """Missing origins from transactions(tx_hash, from_addr); others stay."""
    lookup = transactions.join(worklist(events, is_missing_text(F.col("origin"))), "tx_hash", "left_semi")
    lookup = lookup.groupBy("tx_hash").agg(F.min("from_addr").alias("from_addr"))
    own = F.when(~is_missing_text(F.col("origin")), F.col("origin"))
    return events.join(lookup, "tx_hash", "left").withColumn("origin", F.coalesce(own, "from_addr")).drop("from_addr")


def missing_gas() -> Column:
    test = F.lit(False)
    for c in GAS:
        test = test | is_missing_number(F.col(c))
    return test


def with_gas_columns(events: DataFrame) -> DataFrame:
    return events.withColumns({c: F.lit(None).cast("double") for c in GAS if c not in events.columns})


def fill_gas(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Rows that lack any of the three gas fields get all three from receipts, where there is one."""
    e = with_gas_columns(events)
    lookup = receipts.join(worklist(e, missing_gas()), "tx_hash", "left_semi").groupBy("tx_hash").agg(F.min(F.struct(*GAS)).alias("_g"))
    need = missing_gas() & F.col("_g").isNotNull()
    return e.join(lookup, "tx_hash", "left").withColumns({c: F.when(need, F.col(f"_g.{c}")).otherwise(F.col(c)) for c in GAS}).drop("_g")


def fill_rate(events: DataFrame, missing: Column) -> DataFrame:
    """total, filled and missing counts."""
    return events.agg(F.count(F.lit(1)).alias("total"), F.count_if(~missing).alias("filled"), F.count_if(missing).alias("missing"))


def batch_ranges(events: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest block and the number of events, per key."""
    return events.groupBy(*keys).agg(F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"), F.count(F.lit(1)).alias("n_events"))


def _part(word: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(word, at, n), 16, 10).cast("decimal(38,0)")


def unsigned_128(word: Column) -> Column:
    """Low 128 bits of a 64-digit word as DECIMAL(38,0); NULL above 10^38 - 1."""
    high, low = _part(word, 33, 16), _part(word, 49, 16)
    scaled = F.try_multiply(high, F.lit(str(1 << 64)).cast("decimal(20,0)"))
    return F.try_add(scaled.try_cast("decimal(38,0)"), low).try_cast("decimal(38,0)")


def decode_swap_logs(logs: DataFrame) -> DataFrame:
    """liquidity, liquidity_text and tick of the five 32-byte words in data; NULL where data is short or not hex.  The text holds all 128 bits, the decimal what 38 digits can."""
    digits = F.lower(F.regexp_replace("data", "^0[xX]", ""))
    sound = (F.length(digits) >= 320) & digits.rlike("^[0-9a-f]*$")
    word = lambda n: F.when(sound, F.substring(digits, 64 * n + 1, 64))
    tick = F.conv(F.substring(word(4), 59, 6), 16, 10).cast("int")
    text = decimal_text_128(F.substring(word(3), 33, 32))
    return logs.withColumns({"liquidity": unsigned_128(word(3)), "liquidity_text": text, "tick": F.when(tick >= 1 << 23, tick - (1 << 24)).otherwise(tick)})


def missing_ranges(events: DataFrame) -> DataFrame:
    """(pool, first_block, last_block) of the swaps that lack their liquidity."""
    lacking = events.filter((F.col("kind") == "swap") & F.col("liquidity_after").isNull())
    return lacking.groupBy("pool").agg(F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


def swap_liquidity(logs: DataFrame, topic: str, ranges: DataFrame) -> DataFrame:
    """(pool, block_number, log_index) -> liquidity of one topic's logs in each pool's range of blocks; the last write of a key wins."""
    rows = logs.filter(F.col("topic0") == topic).join(ranges, "pool")
    rows = rows.filter(F.col("block_number").between(F.col("first_block"), F.col("last_block"))).drop("first_block", "last_block")
    return decode_swap_logs(rows).groupBy("pool", "block_number", "log_index").agg(F.max_by("liquidity", "seq").alias("liquidity"))


def fill_liquidity(events: DataFrame, swap_logs: DataFrame) -> DataFrame:
    """liquidity_after of swaps from the logs' map where the event has none."""
    looked = events.join(swap_logs, ["pool", "block_number", "log_index"], "left")
    return looked.withColumn("liquidity_after", F.coalesce("liquidity_after", F.when(F.col("kind") == "swap", F.col("liquidity")))).drop("liquidity")
