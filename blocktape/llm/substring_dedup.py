"""Removal of long passages that repeat across documents, by level-wise doubling (operator 13).

A passage repeats if its 50 words also start in a document with a smaller id.  Windows of 13 words come first,
and only those that two documents have are extended to 26 words; where these repeat too, the windows of 50
words around them are compared, and those that an earlier document has are removed.  At the first length a
window is sent only from places that its content chooses, the smallest hash among 38 windows that follow
one another: all documents with the same 50 words choose the same place in them, so no repeat is missed, and
a twentieth of the words is shuffled.  Documents of equal words are settled first, by one hash each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktape.llm.common import bit_of, bitmaps, fresh, in_arrow, keep_marked, written
from blocktape.llm.exact_dedup import bits_for
from blocktape.llm.ngram_join import marked, slices

WORDS = 50
MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY = hashlib.sha256(b"").hexdigest()
ANCHORS = pa.list_(pa.struct([("h", pa.int64()), ("l", pa.int64()), ("r", pa.int64())]))


def split_words(text: str | None) -> list[bytes]:
    """The words, which end at ASCII white space only."""
    return (text or "").encode().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    code = (first ^ (first >> np.uint64(29))) * MIX + second
    return (code ^ (code >> np.uint64(32))) * MIX


def windows(w: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of so many words."""
    n = len(w) - length + 1
    code = np.full(max(n, 0), length, np.uint64)
    for j in range(length if n > 0 else 0):
        code = joined(code, w[j : j + n])
    return code


def doubled(short: np.ndarray, step: int) -> np.ndarray:
    """Hashes of windows that two short ones make up, the second ``step`` words after the first."""
    return joined(short[: len(short) - step], short[step:]) if len(short) > step else short[:0]


def sliding(f: Callable, x: np.ndarray, n: int) -> np.ndarray:
    """f over every n values that follow one another, in log n steps."""
    k = 1
    while 2 * k <= n:
        x, k = f(x[:-k], x[k:]), 2 * k
    return f(x[: -(n - k)], x[n - k :]) if k < n else x


def chosen(h: np.ndarray, n: int) -> np.ndarray:
    """Places of the smallest hash of any n that follow one another; all places of equal ones."""
    pad = np.zeros(n - 1, np.uint64)
    highest = sliding(np.maximum, np.concatenate([pad, sliding(np.minimum, h, n), pad]), n)
    return np.flatnonzero(h == highest)


def anchors(w: np.ndarray, words: int) -> np.ndarray:
    """Distinct rows (short, to the left, to the right) of a document: windows of a quarter, rounded up, at chosen places and those of twice that length that end or begin with them; 0 where the document ends before."""
    if len(w) < words:
        return np.zeros((0, 3), np.uint64)
    quarter = -(-words // 4)
    short = windows(w, quarter)
    at = chosen(short, words - quarter + 1)
    twice = np.concatenate([np.zeros(quarter, np.uint64), doubled(short, quarter), np.zeros(quarter, np.uint64)])  # by start, moved by a quarter
    return np.unique(np.stack([short[at], twice[at], twice[at + quarter]], axis=1), axis=0)


def starts_near(w: np.ndarray, repeated: np.ndarray, words: int) -> np.ndarray:
    """Starts of the windows of so many words that contain a window of twice a quarter whose hash is in ``repeated``."""
    twice = 2 * -(-words // 4)
    size = min(twice, words)
    found = np.flatnonzero(np.isin(doubled(windows(w, twice // 2), size - twice // 2), repeated))
    steps = np.zeros(len(w) + 2, np.int64)
    np.add.at(steps, np.maximum(found - (words - size), 0), 1)
    np.add.at(steps, found + 1, -1)
    return np.flatnonzero(np.cumsum(steps)[: max(len(w) - words + 1, 0)] > 0)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_words, sha, sig, anchors) of every row; sig is the start of sha and names a text beside its id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sha, sig, found = [], [], [], []
            for text in batch.column(1):
                own = split_words(text.as_py())
                digest = hashlib.sha256(b" ".join(own)).digest()
                n.append(len(own))
                sha.append(digest)
                sig.append(int.from_bytes(digest[:8], "little", signed=True))
                found.append(anchors(hashes(own), words).view(np.int64))
            rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(ANCHORS.value_type))
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(sig, pa.int64()), pa.ListArray.from_arrays(ends, structs)], names=["doc_id", "n_words", "sha", "sig", "anchors"]
            )

    return in_arrow(docs, make, "doc_id long, n_words long, sha binary, sig long, anchors array<struct<h:long,l:long,r:long>>")


def in_two(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that rows of two ids have, each with the smallest id."""
    return rows.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")


def flagged_copies(base: DataFrame, copied: DataFrame) -> DataFrame:
    """base with ``copy``: whether a smaller id has the same words.  Only rows whose words may repeat are shuffled."""
    bits = bits_for(copied.count())
    marks = written(bitmaps(copied.select(bit_of(F.col("sha"), bits, 0).alias("slot")).distinct(), "slot"))
    tested = keep_marked(base, bit_of(F.col("sha"), bits, 0), marks, into="maybe")
    both = tested.filter("maybe").join(copied, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")
    return tested.filter("not maybe").withColumn("copy", F.lit(False)).unionByName(both).drop("maybe")


def repeated_windows(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, sig, starts): windows of so many words that a smaller id also has, for the rows (doc_id, sig, anchors) of distinct texts."""
    short = rows.filter("doc_id is not null").select("doc_id", "sig", F.explode("anchors").alias("a")).select("doc_id", "sig", "a.*")
    longer = marked(short, "h", written(in_two(short, "h").select("h")))
    longer = written(longer.select("doc_id", "sig", F.explode(F.array("l", "r")).alias("h")).filter("h <> 0"))
    kept = marked(longer, "h", written(in_two(longer, "h").select("h")))
    kept = written(kept.groupBy("doc_id", "sig").agg(F.collect_set("h").alias("repeated")))
    texts = marked(docs, "doc_id", kept.select("doc_id").distinct()).join(kept.hint("merge"), "doc_id")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: list[list] = [[], [], [], [], []]
            for doc, sig, text, repeated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                own = split_words(text.as_py())
                if int.from_bytes(hashlib.sha256(b" ".join(own)).digest()[:8], "little", signed=True) != sig:
                    continue  # another text of this id
                w, places = hashes(own), {}
                for j in starts_near(w, repeated.values.to_numpy().view(np.uint64), words).tolist():
                    places.setdefault(xxhash.xxh3_128_digest(w[j : j + words].tobytes()), []).append(j)
                for column, values in zip(out, ([k[:8] for k in places], [k[8:] for k in places], [doc] * len(places), [sig] * len(places), places.values()), strict=True):
                    column.extend(values)
            ints = [pa.array(np.frombuffer(b"".join(c), np.int64)) for c in out[:2]]
            yield pa.RecordBatch.from_arrays([*ints, pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.int32()))], names=["h", "g", "doc_id", "sig", "starts"])

    full = written(in_arrow(texts.select("doc_id", "sig", "text", "repeated"), whole, "h long, g long, doc_id long, sig long, starts array<int>"))
    hits = full.hint("merge").join(written(in_two(full, "h", "g")), ["h", "g"]).filter("doc_id > first")
    return hits.groupBy("doc_id", "sig").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def cut(docs: DataFrame, starts: DataFrame, words: int) -> DataFrame:
    """(doc_id, sig, n_removed, kept_sha256, spans) of the documents with removed windows."""
    texts = marked(docs, "doc_id", starts.select("doc_id").distinct()).join(starts.hint("merge"), "doc_id")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, sig, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                own = split_words(text.as_py())
                if int.from_bytes(hashlib.sha256(b" ".join(own)).digest()[:8], "little", signed=True) != sig:
                    continue
                begun = np.unique(at.values.to_numpy())
                new = np.concatenate([[True], begun[1:] > begun[:-1] + words])  # windows that touch are one span
                first = begun[new]
                last = begun[np.concatenate([new[1:], [True]])] + words
                kept, at_word = [], 0
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    kept += own[at_word:a]
                    at_word = b
                kept += own[at_word:]
                for column, v in zip(out, (doc, sig, len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(first, last, strict=True)]), strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["doc_id", "sig", "n_removed", "kept_sha256", "spans"])

    return in_arrow(texts.select("doc_id", "sig", "text", "starts"), remove, "doc_id long, sig long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def substring_dedup(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, spans.

    A word goes if a window of ``words`` words that covers it also starts in a document with a smaller id;
    windows are judged on the input.  ``spans`` lists what goes as word places, end exclusive, and kept_sha256
    is of the other words, joined by one space.  Null and empty texts have no word.  A null id is smaller
    than none and none is smaller than it, so such a row keeps all its words.  Rows that share an id do
    not remove from each other, and rows that repeat get the same result.  Other columns are ignored; an empty table
    gives an empty result.
    """
    if words < 4:
        raise ValueError("windows of fewer than four words")
    docs = fresh(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base = written(sketched(docs, words))
    copied = written(in_two(base.filter(F.col("n_words") >= words), "sha"))
    flagged = flagged_copies(base, copied)
    starts = written(repeated_windows(docs, flagged.filter("not copy").select("doc_id", "sig", "anchors"), words))
    changed = written(cut(docs, starts, words)).dropDuplicates(["doc_id", "sig"])
    none, some = F.array().cast("array<struct<start:long,end:long>>"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    plain = flagged_copies(base.drop("anchors"), copied)
    out = plain.join(changed.hint("merge"), ["doc_id", "sig"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(F.col("copy"), some).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
