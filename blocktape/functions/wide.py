"""Unsigned whole numbers of up to 256 bits in column expressions: hexadecimal digits in, decimal text out, no digit lost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 1_000_000_000  # a limb holds nine decimal digits, so a limb times 2^32 and a carry fit in a long
REST = 446_744_073_709_551_616  # of 2^64 by 10^18
LIMBS = 9  # 81 digits; 2^256 has 78


def limbs(digits: Column) -> Column:
    """Limbs of a number in hexadecimal digits, lowest first: 32 bits at a time are multiplied in."""
    padded = F.lpad(digits, 64, "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))

    def times(state: Column, limb: Column) -> Column:
        value = limb * F.lit(1 << 32) + state["carry"]
        return F.struct(F.concat(state["done"], F.array(value % LIMB)).alias("done"), F.call_function("div", value, F.lit(LIMB)).alias("carry"))

    start = lambda w: F.struct(F.array().cast("array<long>").alias("done"), w.alias("carry"))
    return F.aggregate(words, F.array_repeat(F.lit(0).cast("long"), LIMBS), lambda acc, w: F.aggregate(acc, start(w), times)["done"])


def decimal_text(digits: Column) -> Column:
    """Decimal text of a number in 1 to 64 hexadecimal digits of either case, without prefix; NULL for anything else."""
    text = F.array_join(F.reverse(F.transform(limbs(digits), lambda v: F.lpad(v.cast("string"), 9, "0"))), "")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,64}$"), F.regexp_replace(text, "^0+(?=.)", ""))


def decimal_text_128(digits: Column) -> Column:
    """The same for numbers in 32 hexadecimal digits or less: 2^64 is 18 * 10^18 + REST, so two decimals of 38 digits hold both halves of the text.  A few steps a row, all compiled."""
    padded = F.lpad(digits, 32, "0")
    half = lambda at: F.conv(F.substring(padded, at, 16), 16, 10).cast("decimal(20,0)")
    high, low = half(1), half(17)
    whole = lambda v, n: F.lit(str(v)).cast(f"decimal({n},0)")
    rest = high * whole(REST, 18) + low  # below 8.3 * 10^36
    upper = high * whole(18, 2) + F.call_function("div", rest, whole(10**18, 19))
    text = F.concat(upper.cast("string"), F.lpad((rest % whole(10**18, 19)).cast("decimal(18,0)").cast("string"), 18, "0"))
    return F.when(digits.rlike("^[0-9a-fA-F]{1,32}$"), F.regexp_replace(text, "^0+(?=.)", ""))
