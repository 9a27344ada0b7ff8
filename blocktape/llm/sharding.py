"""Sharding by weighted rendezvous hashing (operator 10), with DataFrame functions only.

Every shard draws a score from the record's key and its own number; the best score wins.  A new shard
changes only the records that it wins, so the number of moved records is the new shard's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktape.llm.common import fresh, written

SLOT_ROWS = 50_000  # rows in one piece of a shard whose slots one task numbers


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard 0 .. len(weights)-1 with the smallest -ln(u) / weight; a weight of 0 never wins.

    u is a number in (0, 1) that hashes the key with the shard.  A null key hashes as a text of its own.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    unit = lambda s: (F.shiftrightunsigned(F.xxhash64(text, F.lit(s)), 11).cast("double") + 0.5) / float(1 << 53)
    draws = [F.struct((-F.log(unit(s)) / w).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights) if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["s"]


def shard_records(
    docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``weights`` has the weight of each shard; ``grown`` those of a later layout, whose shard goes into
    grown_shard.  Law `key`: the id and the layout alone decide.  size is the text's UTF-8 bytes plus 1
    (null: 1).  slot counts a shard's rows from 0 without a gap: shards are cut into pieces by the row's
    hash, pieces are numbered apart, and the counts before each piece are added; so neither a shard nor
    a much repeated id has to fit in one task.  Rows with a null id share one shard.  Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = fresh(docs, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = rows.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        (rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = written(placed)
    pieces = max(1, placed.count() // (len(weights) * SLOT_ROWS) * 2)
    placed = placed.withColumn("_piece", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(pieces).cast("long")))
    counts = placed.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "_piece", F.coalesce(before, F.lit(0)).cast("long").alias("_start"))
    number = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("doc_id", "_row"))
    return placed.withColumn("_at", number).join(starts, ["shard", "_piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"),
        (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"), F.col("grown_shard").cast("int"),
    )
