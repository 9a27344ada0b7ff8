"""Merkle manifest of a table by bitmap-rank indexing (operator 12).

Each row is a leaf; the rows of one group ascend by id under a root of their own, and these roots, ordered by group,
lie under the manifest's root.  A leaf's place is its rank: 64 ids make a word of a bitmap, words without
a row are left out, and a directory of popcounts, 512 words to a part, 512 parts to one above and so on, has the rows
before each word.  A rank is one lookup and one bit count, so no group is sorted or numbered in one task.
Places then key arrays of 1024 slots, which tasks reduce by ten levels at once, until each group is one node;
siblings are handed down the same arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktape.llm.common import in_arrow, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PART = 9  # bits of a level of the directory
LEVELS = 10  # of the tree in one array of slots


def field_text(value: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row: of its values, in this order."""
    return F.sha2(F.concat(*map(field_text, values)).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path: `l` or `r` and the digest for a sibling to the left or right, `-` for none."""
    other = lambda step: F.substring(step, 2, 64)
    both = lambda node, step: F.when(step.startswith("l"), F.concat(other(step), node)).otherwise(F.concat(node, other(step)))
    return F.aggregate(path, leaf, lambda node, step: F.sha2(both(node, step).cast("binary"), 256))


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.substring(step, 2, 64)), "").cast("binary"), 256)


def before(rows: Column, *part: str) -> Column:
    """The sum of rows over what stands before in a part, in the order of ids; a part has 2 * 2^PART rows at most."""
    order = Window.partitionBy(*part).orderBy("has", "w").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(rows).over(order), F.lit(0).cast("long"))


def directory(words: DataFrame) -> DataFrame:
    """words (g, has, w, n, ...) with ``before``: the rows of the group in earlier words."""
    low, high = words.agg(F.min("w"), F.max("w")).first()
    above = [words]
    while low is not None and (high >> PART * (len(above) - 1)) - (low >> PART * (len(above) - 1)) >= 1 << PART:
        above.append(written(above[-1].withColumn("w", F.shiftright("w", PART)).groupBy("g", "has", "w").agg(F.sum("n").alias("n"))))
    known = above[-1].withColumn("before", before(F.col("n"), "g"))
    for level in reversed(above[:-1]):
        known = written(known.select("g", "has", F.col("w").alias("up"), F.col("before").alias("_base")))
        inner = level.withColumn("up", F.shiftright("w", PART)).withColumn("before", before(F.col("n"), "g", "has", "up"))
        known = inner.hint("merge").join(known, ["g", "has", "up"]).withColumn("before", F.col("before") + F.col("_base")).drop("up", "_base")
    return written(known)


def ranked(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``pos``, words): rows (g, keys...) get their place in g by the first key, null first; ties by the next one, and so on; the last has none."""
    key, *more = keys
    at = rows.withColumn("has", F.col(key).isNotNull()).withColumn("_key", F.coalesce(key, F.lit(0).cast("long")))
    at = at.withColumn("w", F.shiftright("_key", 6)).withColumn("bit", F.col("_key").bitwiseAND(63).cast("int"))
    words = written(at.groupBy("g", "has", "w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count(F.lit(1)).alias("n")))
    known = directory(words)
    found = at.hint("merge").join(known.select("g", "has", "w", "bits", "n", "before"), ["g", "has", "w"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    placed = found.withColumn("pos", F.col("before") + below)
    tied = F.col("n") > F.bit_count("bits")
    if not more or not known.filter(tied).limit(1).count():
        return placed.select(*rows.columns, "pos"), known
    # ids that repeat: rows of earlier bits of the word are counted, and rows of one id are ranked among themselves by the next key
    many = found.filter(tied)
    bits = many.groupBy("g", "has", "w", "bit").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("g", "has", "w").orderBy("bit").rowsBetween(Window.unboundedPreceding, -1)
    bits = written(bits.withColumn("_in", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long"))).drop("n"))
    many = many.hint("merge").join(bits, ["g", "has", "w", "bit"])
    start, outer = f"_start{len(keys)}", f"_g{len(keys)}"
    many = many.withColumn(start, F.col("before") + F.col("_in")).withColumn(outer, F.col("g")).withColumn("g", F.to_json(F.struct("g", "has", "w", "bit")))
    inner, _ = ranked(many.select(*rows.columns, start, outer), more)
    inner = inner.withColumn("pos", F.col("pos") + F.col(start)).withColumn("g", F.col(outer)).select(*rows.columns, "pos")
    return placed.filter(~tied).select(*rows.columns, "pos").unionByName(inner), known


def node_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes: list[str], total: int) -> list[list[str]]:
    """The levels over the nodes of one array, of ``total`` in their group; the last level is one node."""
    levels = [nodes]
    while total > 1 and len(levels) <= LEVELS:
        last = levels[-1]
        levels.append([node_of(*last[i : i + 2]) for i in range(0, len(last), 2)])
        total = (total + 1) // 2
    return levels


def path_of(levels: list[list[str]], i: int) -> list[str]:
    steps = []
    for level in levels[:-1]:
        j = i ^ 1
        steps.append("-" if j >= len(level) else ("l" if j < i else "r") + level[j])
        i >>= 1
    return steps


def arrays(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """(g, block, total, items): the slot arrays of rows (g, pos, node, ...); total is the number of rows of g."""
    inner = [c for c in rows.columns if c not in ("g", "pos")]
    at = rows.withColumn("block", F.shiftright("pos", LEVELS)).withColumn("slot", F.col("pos").bitwiseAND((1 << LEVELS) - 1).cast("int"))
    grouped = at.groupBy("g", "block").agg(F.collect_list(F.struct("slot", *inner)).alias("items"))
    return written(grouped.join(totals, "g").select("g", "block", "total", "items"))


def in_slots(items: pa.ListScalar) -> pa.StructArray:
    own = items.values
    return own.take(pa.array(np.argsort(own.field("slot").to_numpy(), kind="stable")))


def reduced(blocks: DataFrame) -> DataFrame:
    """(g, pos, node): the node over each array, at the array's number."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [tree(in_slots(items).field("node").to_pylist(), total)[-1][0] for items, total in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.string())], names=["g", "pos", "node"])

    return in_arrow(blocks.select("g", "block", "total", F.expr("transform(items, i -> struct(i.slot, i.node))").alias("items")), top, "g string, pos long, node string")


def reduce_up(rows: DataFrame, totals: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((g, node) of each group's root, the arrays of each pass) of rows (g, pos, node, ...) with the rows of each group (g, total)."""
    most, passes = totals.agg(F.max("total")).first()[0] or 0, []
    while True:
        passes.append(arrays(rows, totals))
        rows, totals = written(reduced(passes[-1])), totals.withColumn("total", F.ceil(F.col("total") / (1 << LEVELS)))
        most = -(-most >> LEVELS) if most > 1 else most
        most = max(most, 1)
        if most == 1:
            return rows.select("g", "node"), passes


def expanded(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """One row per slot, with g, pos, its other columns and ``path``: its siblings in the array, then those of above (g, block, path)."""
    kinds = {f.name: f.dataType for f in blocks.schema["items"].dataType.elementType.fields}
    inner = [c for c in kinds if c != "slot"]
    schema = ", ".join(["g string", "pos long", *(f"`{c}` {kinds[c].simpleString()}" for c in inner), "path array<string>"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, block, total, items, up in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                own = in_slots(items)
                levels = tree(own.field("node").to_pylist(), total)
                paths = [path_of(levels, i) + up for i in range(len(own))]
                pos = [(block << LEVELS) + i for i in range(len(own))]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.string()), pa.array(pos, pa.int64()), *(own.field(c) for c in inner), pa.array(paths, pa.list_(pa.string()))], names=["g", "pos", *inner, "path"])

    return in_arrow(blocks.hint("merge").join(above, ["g", "block"]).select("g", "block", "total", "items", "path"), spread, schema)


def hand_down(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the first pass with their whole path; above (g, path) has what follows each group's root."""
    known = above.select("g", F.lit(0).cast("long").alias("block"), "path")
    for blocks in reversed(passes[1:]):
        known = written(expanded(blocks, known).select("g", F.col("pos").alias("block"), "path"))
    return expanded(passes[0], known)


def numbered(groups: DataFrame) -> DataFrame:
    """(name, pos): groups (name) in order, numbered from 0, by ranges."""
    at = written(groups.repartitionByRange("name").withColumn("part", F.spark_partition_id()))
    parts = at.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # as many as ranges
    start = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(start), F.lit(0).cast("long"))).select("part", "start")
    return at.join(parts, "part").select("name", (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1).alias("pos"))


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id_col, leaf, subroot, root, path, and the columns of ``carry``, computed from the row.

    A leaf is the digest of the row's fields.  Per value of group_col leaves ascend by id, null first; while
    several nodes remain, every two that follow one another become their digest, a last one alone its own;
    what remains is the subroot.  Subroots, ordered by group (null first, then bytewise), likewise give the
    root.  ``path`` lists a leaf's siblings up to the root, as `fold` takes them.  Rows of a group that share an
    id are ordered by their digest; those of equal digests are the same leaf at several places.  Other
    columns are ignored, a missing one is a ValueError.  An empty table gives an empty result.
    """
    if missing := [c for c in (*fields, group_col, id_col) if c not in docs.columns]:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(docs.columns)}")
    carry = carry or {}
    of = {c: F.col(f"`{c}`") for c in (*fields, group_col, id_col)}
    group = F.coalesce(F.concat(F.lit("1"), of[group_col].cast("string")), F.lit("0"))  # null first
    rows = docs.select(
        group.alias("g"), of[id_col].cast("long").alias("_id"), leaf_of([of[c] for c in fields]).alias("node"), F.monotonically_increasing_id().alias("_row"), F.struct(F.lit(0).alias("_"), *(v.alias(k) for k, v in carry.items())).alias("_carry")
    )
    rows = written(rows).withColumn("_digest", F.conv(F.substring("node", 1, 15), 16, 10).cast("long"))
    placed, words = ranked(rows, ["_id", "_digest", "_row"])
    totals = written(words.groupBy("g").agg(F.sum("n").alias("total")))
    subroots, passes = reduce_up(placed.select("g", "pos", "node", "_id", "_carry"), totals)
    subroots = written(subroots)
    names = numbered(subroots.select(F.col("g").alias("name")))
    tops = names.join(subroots.withColumnRenamed("g", "name"), "name").select(F.lit("").alias("g"), "pos", "node", "name")
    roots, top_passes = reduce_up(tops, tops.groupBy("g").agg(F.count(F.lit(1)).alias("total")))
    over = written(hand_down(top_passes, roots.select("g", F.array().cast("array<string>").alias("path"))).select(F.col("name").alias("g"), "path", F.col("node").alias("subroot")))
    over = written(over.crossJoin(F.broadcast(roots.select(F.col("node").alias("root")))))  # one row
    leaves = hand_down(passes, over.select("g", "path"))
    out = leaves.join(over.select("g", "subroot", "root"), "g")
    return out.select(F.col("_id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", *(F.col(f"_carry.{k}").alias(k) for k in carry))
