"""Swap limits in router calldata and the slippage that they tolerate.

Offsets in calldata lead anywhere, so one small function reads a transaction's bytes; it runs on Arrow
batches.  Paths, tolerances and joins are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocktape.functions.scalars import is_missing_text, is_swap

#: Selectors of the router functions that are understood.
SELECTORS = {
    "exactInputSingle": "414bf389",
    "exactOutputSingle": "db3e2198",
    "exactInput": "c04b8d59",
    "exactOutput": "f28c0498",
    "multicall": "ac9650d8",
    "multicall_deadline": "5ae401dc",
    "execute": "24856bc3",
    "execute_deadline": "3593564c",
}
#: Addresses of the routers whose direct calls are understood, and of the one that runs commands.
ROUTERS = ("0xe592427a0aece92de3edee1f18e0157c05861564", "0x68b3465833fb72a70ecdf485e0e4c7bd8665fc45")
COMMAND_ROUTER = "0xef1c6e67703c7bd7107eed8303fbe6ec2554bf6b"
NAMES = {code: name for name, code in SELECTORS.items()}
GUARD = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("kind", "token_in", "token_out")), T.StructField("fee", T.IntegerType()),
    *(T.StructField(n, T.StringType()) for n in ("amount_in", "amount_out", "limit")),  # whole numbers of up to 256 bits
    T.StructField("path", T.ArrayType(T.StringType())), T.StructField("fees", T.ArrayType(T.IntegerType())),
])


def path_sound(path: Column) -> Column:
    return (F.length(path) >= 40) & ((F.length(path) - 40) % 46 == 0) & path.rlike("^[0-9a-f]*$")


def path_tokens(path: Column) -> Column:
    """Addresses of a path, in hex, of one or more 20-byte tokens with 3-byte fees between them; NULL if it is malformed."""
    hops = ((F.length(path) - 40) / 46).cast("int")
    return F.when(path_sound(path), F.transform(F.sequence(F.lit(0), hops), lambda i: F.concat(F.lit("0x"), F.substring(path, i * 46 + 1, F.lit(40)))))


def path_fees(path: Column) -> Column:
    hops = ((F.length(path) - 40) / 46).cast("int")
    return F.when(path_sound(path), F.transform(F.slice(F.sequence(F.lit(0), hops), 1, hops), lambda i: F.conv(F.substring(path, i * 46 + 41, F.lit(6)), 16, 10).cast("int")))


class Short(ValueError):
    """The data ends before what it announces."""


def taken(data: bytes, start: int, length: int) -> bytes:
    if start + length > len(data):
        raise Short
    return data[start : start + length]


def word(data: bytes, at: int) -> int:
    return int.from_bytes(taken(data, at, 32), "big")


def tail(data: bytes, base: int, at: int) -> bytes:
    """The bytes whose offset from base stands at `at`: a length, then so many bytes."""
    start = base + word(data, at)
    return taken(data, start + 32, word(data, start))


def byte_strings(data: bytes, at: int) -> list[bytes]:
    """A bytes[] whose offset stands at `at`."""
    base = word(data, at)
    return [tail(data, base + 32, base + 32 + 32 * i) for i in range(word(data, base))]


def route(path: bytes) -> tuple[list[str], list[int]]:
    if len(path) < 20 or (len(path) - 20) % 23:
        raise Short
    return ["0x" + path[i : i + 20].hex() for i in range(0, len(path), 23)], [int.from_bytes(path[i : i + 3], "big") for i in range(20, len(path), 23)]


def guard(kind: str, exact_in: bool, ends: tuple[str | None, str | None], fee: int | None, amount: int, limit: int, path: bytes | None = None) -> dict:
    tokens, fees = route(path) if path is not None else (None, None)
    given = {"amount_in": str(amount), "amount_out": None} if exact_in else {"amount_in": None, "amount_out": str(amount)}
    return {"kind": kind, "token_in": ends[0], "token_out": ends[1], "fee": fee, "limit": str(limit), "path": tokens, "fees": fees} | given


def direct_call(data: bytes) -> dict | None:
    """Guard of a call of one of the four swap functions, else None."""
    name, body = NAMES.get(data[:4].hex()), data[4:]
    if name in ("exactInputSingle", "exactOutputSingle"):
        token = lambda n: "0x" + taken(body, 32 * n + 12, 20).hex()
        return guard(name, name == "exactInputSingle", (token(0), token(1)), word(body, 64), word(body, 160), word(body, 192))
    if name in ("exactInput", "exactOutput"):
        base = word(body, 0)
        return guard(name, name == "exactInput", (None, None), None, word(body, base + 96), word(body, base + 128), tail(body, base, base))
    return None


def attempt(of, data: bytes) -> dict | None:
    try:
        return of(data)
    except Short:
        return None


def command_call(data: bytes) -> dict | None:
    """Guard of the first exact-in (0) or exact-out (1) command whose input can be read."""
    body = data[4:]
    commands, inputs = tail(body, 0, 0), byte_strings(body, 32)
    for code, x in zip(commands, inputs):
        if code & 0x1F <= 1:
            exact_in = code & 0x1F == 0
            kind = "universalExactIn" if exact_in else "universalExactOut"
            if found := attempt(lambda d, k=kind, e=exact_in: guard(k, e, (None, None), None, word(d, 32), word(d, 64), tail(d, 0, 96)), x):
                return found
    return None


def router_call(data: bytes) -> dict | None:
    name = NAMES.get(data[:4].hex())
    if name in ("multicall", "multicall_deadline"):
        calls = byte_strings(data[4:], 0 if name == "multicall" else 32)
        return next((g for c in calls if (g := attempt(direct_call, c))), None)
    return direct_call(data)


def calldata_guard(text: str | None, to: str | None) -> dict | None:
    """Guard in a transaction's hexadecimal calldata to a known router; None where there is no supported call or the data is cut short."""
    to = (to or "").strip().lower()
    try:
        data = bytes.fromhex((text or "").strip().lower().removeprefix("0x"))
    except ValueError:
        return None
    if to == COMMAND_ROUTER and NAMES.get(data[:4].hex()) in ("execute", "execute_deadline"):
        return attempt(command_call, data)
    return attempt(router_call, data) if to in ROUTERS else None


@F.pandas_udf(GUARD)
def swap_guard(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for inputs, receivers in batches:
        found = [calldata_guard(x, to) or {} for x, to in zip(inputs, receivers, strict=True)]
        yield pd.DataFrame({n: pd.Series([g.get(n) for g in found], dtype=object) for n in GUARD.names})


def tolerance_bps(guard: Column, expected: Column) -> Column:
    """Slippage that the limit allows against the expected amount, in basis points; NULL without a positive one."""
    limit = guard["limit"].cast("double")
    used = F.when(guard["amount_in"].isNotNull(), (1.0 - limit / expected) * 1e4).otherwise((limit / expected - 1.0) * 1e4)
    return F.when((expected > 0) & guard["kind"].isNotNull(), used)


def worklist(events: DataFrame) -> DataFrame:
    """(tx_hash) of the swaps, each once in lower case: the transactions to look up."""
    swaps = events.filter(is_swap(F.lower("kind"), F.col("amount0"), F.col("amount1")) & ~is_missing_text(F.col("tx_hash")))
    return swaps.select(F.lower(F.trim("tx_hash")).alias("tx_hash")).distinct()


def slippage(transactions: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per distinct transaction: guard fields, expected amount, tolerance, and why there is none.

    ``transactions``: tx_hash, to, input; ``quotes``: tx_hash, expected.  The ends of a path, as it is encoded,
    outrank the named tokens; so an exact output by path shows the token got first.
    """
    tx = F.lower(F.trim("tx_hash"))
    key = F.when(tx.startswith("0x"), tx).otherwise(F.concat(F.lit("0x"), tx))
    rows = transactions.select(key.alias("tx_hash"), "to", "input").groupBy("tx_hash").agg(F.min("input").alias("input"), F.min_by("to", "input").alias("to"))
    rows = rows.withColumn("g", swap_guard(F.col("input"), F.col("to")))
    asked = quotes.select(F.lower("tx_hash").alias("tx_hash"), F.col("expected").cast("double").alias("expected")).groupBy("tx_hash").agg(F.max("expected").alias("expected"))
    out = rows.join(asked, "tx_hash", "left").withColumn("tolerance_bps", tolerance_bps(F.col("g"), F.col("expected")))
    error = F.when(F.col("input").isNull(), "no transaction").when(F.col("g.kind").isNull(), "no supported call").when(F.col("expected").isNull(), "no quote").when(F.col("expected") <= 0, "bad quote")
    ends = [F.coalesce(F.element_at("g.path", at), F.col(f"g.{n}")).alias(n) for n, at in (("token_in", 1), ("token_out", -1))]
    fields = [F.col(f"g.{f}").alias(f) for f in ("kind", "fee", "amount_in", "amount_out", "limit", "path", "fees")]
    return out.select("tx_hash", *fields, *ends, "expected", "tolerance_bps", error.alias("error"))
