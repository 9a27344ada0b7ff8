"""Exact de-duplication by two-pass Bloom filtering (operator 7), with DataFrame functions only.

Pass one sets, for every text hash, two bits and keeps those bits that two or more rows set.  Pass two
sends to the shuffle only the rows whose two bits are both kept: possibly repeated ones, all truly
repeated ones among them.  The others pass straight through as groups of one.  With more rows than one
bit set of bounded size tells apart, hashes are dealt into ranges that have a bit set each: all sets come from
one job, and rows are tested range by range, so the filter grows with the rows while what is broadcast at once does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktape.llm.common import ascii_lower, bit_of, bitmaps, fresh, keep_marked, written, written_parts

MAX_BITS = 1 << 27  # 16 MB broadcast at most, whatever the input
BITS_PER_ROW = 16


def bits_for(rows: int, per_row: int = BITS_PER_ROW, most: int = MAX_BITS) -> int:
    """A power of two near per_row bits a row, within [2^15, most]."""
    return min(most, max(1 << 15, 1 << max(0, rows * per_row - 1).bit_length()))


def text_hash(text_col: str = "text") -> Column:
    return F.sha2(ascii_lower(F.col(text_col).cast("string")).cast("binary"), 256)


def marked_twice(hashed: DataFrame, bits: int) -> DataFrame:
    """The bit set of every range: bits that two or more rows of it set."""
    both = F.explode(F.array(*(bit_of(F.col("text_sha256"), bits, seed) for seed in (0, 1)))).alias("slot")
    return bitmaps(hashed.select("_range", both).groupBy("_range", "slot").count().filter("count > 1"), "slot", "_range")


def with_test(hashed: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """hashed with __bt_maybe: whether both bits of the row's hash are set."""
    first, second = (bit_of(F.col("text_sha256"), bits, seed) for seed in (0, 1))
    tested = keep_marked(keep_marked(hashed, first, marks, into="__bt_maybe"), second, marks, into="__bt_too")
    return tested.withColumn("__bt_maybe", F.col("__bt_maybe") & F.col("__bt_too")).drop("__bt_too")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is an empty text.  The row with the
    largest id stays; of rows that repeat that id one stays.  Null ids rank below all others.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    rows = fresh(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"),
        text_hash().alias("text_sha256"),
        F.monotonically_increasing_id().alias("_row"),
    )
    n = docs.count()
    ranges = max(1, -(-n * BITS_PER_ROW // max_bits))
    bits = bits_for(-(-n // ranges), most=max_bits)
    rows = rows.withColumn("_range", F.pmod(F.xxhash64("text_sha256", F.lit(3)), F.lit(ranges)).cast("int"))
    # there are as many files as tasks, and in each the rows of a range are together: reading one skips the others
    hashed = written(rows.sortWithinPartitions("_range") if ranges > 1 else rows)
    marks = written(marked_twice(hashed, bits))
    of = lambda df, r: df.filter(F.col("_range") == r).drop("_range")
    if ranges > 1:
        tested = written_parts(with_test(of(hashed, r), of(marks, r), bits) for r in range(ranges))
    else:
        tested = with_test(hashed.drop("_range"), marks.drop("_range"), bits)
    maybe = F.col("__bt_maybe")

    single = tested.filter(~maybe).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    repeated = tested.filter(maybe).select("doc_id", "text_sha256", "_row")
    groups = repeated.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "_row")).alias("__bt_keep"), F.count(F.lit(1)).alias("group_size")
    )
    groups = written(groups)  # then both sides of the join are plain exchanges, of which Spark can split a large group
    joined = repeated.join(groups, "text_sha256").select(
        "doc_id",
        F.col("__bt_keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("__bt_keep._row") == F.col("_row")).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(joined)


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps; whole rows that repeat are one.

    Only rows that go are shuffled, and those few that the bit test cannot tell from them.
    """
    found = exact_dedup(docs, id_col, text_col, max_bits)
    drops = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__bt_id"), F.col("text_sha256").alias("__bt_of"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__bt_again"))
    drops = written(drops.distinct())
    bits = bits_for(drops.count(), most=max_bits)
    marks = written(bitmaps(drops.select(bit_of(F.col("__bt_id"), bits, 2).alias("slot")).distinct(), "slot"))
    tested = keep_marked(docs, bit_of(F.col(f"`{id_col}`").cast("long"), bits, 2), marks, into="__bt_maybe")
    alone = tested.filter("not __bt_maybe").drop("__bt_maybe")
    rows = tested.filter("__bt_maybe").drop("__bt_maybe").withColumn("__bt_sha", text_hash(text_col))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__bt_id")) & (F.col("__bt_sha") == F.col("__bt_of"))
    rows = rows.join(drops.hint("merge"), same, "left")  # what goes grows with the input: never broadcast
    rows = rows.filter("__bt_again is null or __bt_again")
    once = rows.filter("__bt_again is not null").dropDuplicates(["__bt_id", "__bt_sha"])  # repeated rows of a document that stays
    rest = rows.filter("__bt_again is null").unionByName(once)
    return alone.unionByName(rest.drop("__bt_sha", "__bt_id", "__bt_of", "__bt_again"))
