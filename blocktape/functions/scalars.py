"""Column functions that normalize event values.  Missing is always NULL: NaN and infinities never get in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q96 = float(1 << 96)

#: Accepted spellings of a swap's direction.
X_TO_Y = ("x->y", "x_to_y", "x2y", "0->1", "0to1", "0-1", "01")
Y_TO_X = ("y->x", "y_to_x", "y2x", "1->0", "1to0", "1-0", "10")


def finite(c: Column) -> Column:
    """c, or NULL where it is NaN or infinite (NaN is above infinity here)."""
    return F.when(F.abs(c) < float("inf"), c)


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def to_number(c: Column) -> Column:
    """Double of decimal or 0x-hexadecimal text; NULL if neither.  Hex of any length, by 12-digit parts."""
    text = F.trim(c.cast("string"))
    digits = F.lpad(F.regexp_extract(F.lower(text), r"^0x([0-9a-f]{1,64})$", 1), 72, "0")
    value = F.lit(0.0)
    for i in range(6):
        value = value * float(16**12) + F.conv(F.substring(digits, 12 * i + 1, 12), 16, 10).cast("double")
    return F.when(F.lower(text).startswith("0x"), F.when(F.lower(text).rlike(r"^0x[0-9a-f]{1,64}$"), value)).otherwise(finite(try_double(text)))


def to_float(c: Column) -> Column:
    """Text to a finite double; blank, none, nan and inf give NULL."""
    return finite(try_double(F.trim(c.cast("string"))))


def to_bool(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)


def to_unix(c: Column) -> Column:
    """UNIX seconds of digits or ISO-8601 text (UTC where no zone is given)."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long")).otherwise(F.unix_timestamp(F.try_to_timestamp(text)))


def raw_units(c: Column, decimals: int) -> Column:
    """Decimal text times 10^decimals as an integer, cut towards zero; NULL if it is no number or too large."""
    exact = F.trim(c.cast("string")).try_cast("decimal(38,18)")
    text = F.regexp_extract(F.trim(c.cast("string")), r"^([+-]?)(\d*)\.?(\d*)$", 0)
    whole = F.regexp_extract(text, r"^[+-]?(\d*)", 1)
    part = F.substring(F.rpad(F.regexp_extract(text, r"\.(\d*)$", 1), decimals, "0"), 1, decimals) if decimals else F.lit("")
    value = F.concat(F.when(text.startswith("-"), "-").otherwise(""), whole, part).try_cast("decimal(38,0)")
    return F.when(exact.isNotNull() & (text != ""), value)


def raw_units_exact(c: Column, decimals: int) -> Column:
    """True where raw_units loses nothing."""
    rest = F.regexp_extract(F.trim(c.cast("string")), r"\.(\d*)$", 1)
    return F.regexp_replace(F.substring(rest, decimals + 1, 80), "0", "") == ""


def raw_units_text(c: Column, decimals: int, strict: bool = False) -> Column:
    """Decimal text times 10^decimals as the text of a whole number of any length, cut towards zero, or an error where strict and something is cut.

    NULL if it is no plain decimal number.
    """
    if decimals < 0:
        raise ValueError("decimals below 0")
    text = F.trim(c.cast("string"))
    sound = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    whole, part = F.regexp_extract(text, r"^[+-]?(\d*)", 1), F.regexp_extract(text, r"\.(\d*)$", 1)
    kept = F.substring(F.rpad(part, decimals, "0"), 1, decimals) if decimals else F.lit("")
    digits = F.regexp_replace(F.concat(whole, kept), "^0+(?=.)", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    value = F.when(text.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    if strict:
        value = F.when(raw_units_exact(c, decimals), value).otherwise(F.raise_error(F.concat(F.lit("no whole number of units: "), text)).cast("string"))
    return F.when(sound, value)


def address(c: Column) -> Column:
    """An address in its one spelling, lower case; NULL for anything that is none."""
    text = F.lower(F.trim(c))
    return F.when(text.rlike("^0x[0-9a-f]{40}$"), text)


def direction(a0: Column, a1: Column) -> Column:
    """x2y where the pool gains token 0 and loses token 1, y2x the other way round, else NULL."""
    return F.when((a0 > 0) & (a1 < 0), "x2y").when((a0 < 0) & (a1 > 0), "y2x")


def is_swap(kind: Column, a0: Column, a1: Column) -> Column:
    return F.coalesce((kind == "swap") | kind.startswith("swap_"), F.lit(False)) | direction(a0, a1).isNotNull()


def front_direction(a0: Column, a1: Column) -> Column:
    return F.coalesce(direction(a0, a1), F.when(a0 > 0, "x2y").otherwise("y2x"))


def opposite(d: Column) -> Column:
    return F.when(d == "x2y", "y2x").when(d == "y2x", "x2y")


def direction_label(c: Column) -> Column:
    pairs = [F.lit(x) for k, v in [*((s, "x_to_y") for s in X_TO_Y), *((s, "y_to_x") for s in Y_TO_X)] for x in (k, v)]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(c)))


def sqrt_price(q96: Column) -> Column:
    return q96 / Q96


def price(q96: Column) -> Column:
    return sqrt_price(q96) * sqrt_price(q96)


def virtual_x(liquidity: Column, q96: Column) -> Column:
    return F.when(sqrt_price(q96) > 0, liquidity / sqrt_price(q96))


def virtual_y(liquidity: Column, q96: Column) -> Column:
    return F.when(sqrt_price(q96) > 0, liquidity * sqrt_price(q96))


def safe_div(n: Column, d: Column) -> Column:
    return F.when(d != 0, finite(n / d))


def fee_bps(value: float | None) -> float:
    """Fee in basis points: below 1 it is a fraction; missing means 5; negative or not finite is refused."""
    if value is None:
        return 5.0
    if not 0 <= value < float("inf"):
        raise ValueError(f"not a fee: {value}")
    return value * 10_000 if value < 1 else float(value)


def fee_column(c: Column) -> Column:
    """The same for a column; refused fees are NULL."""
    fee = F.coalesce(c.cast("double"), F.lit(5.0))
    return F.when((fee >= 0) & (fee < float("inf")), F.when(fee < 1, fee * 10_000).otherwise(fee))


def is_missing_text(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin("", "none", "nan")


def is_missing_number(c: Column) -> Column:
    number = finite(try_double(c.cast("string")))
    return number.isNull() | (number == 0)


def or_default(df: DataFrame, names: tuple[str, ...], default) -> Column:
    """The first of the columns that df has, else the default."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def general(c: Column, digits: int = 6) -> Column:
    """A double as text of so many significant digits without trailing zeros, as C's %g; NULL if it is missing."""
    told = F.format_string(f"%.{digits - 1}e", c)
    power = F.substring_index(told, "e", -1).cast("int")
    bare = lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    fixed = F.lit(None).cast("string")
    for n in range(-4, digits):
        fixed = F.when(power == n, bare(F.format_string(f"%.{digits - 1 - n}f", c))).otherwise(fixed)
    wide = F.concat(bare(F.substring_index(told, "e", 1)), F.lit("e"), F.substring_index(told, "e", -1))
    return F.when(c == 0, "0").when(finite(c).isNotNull(), F.when((power >= -4) & (power < digits), fixed).otherwise(wide))
