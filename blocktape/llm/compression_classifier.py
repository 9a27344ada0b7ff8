"""Quality by compression (operator 4): zstandard dictionaries of good and of bad text.

A text is compressed block by block with either dictionary.  The difference of the two sizes, divided by
the text's own size, is larger the more the text resembles the good one; a logistic curve fitted on other
labelled rows turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktape.llm.common import fresh, in_arrow

BLOCK = 2048  # bytes compressed at once: a dictionary helps most at the start
DICTIONARY = 112_640  # bytes of each dictionary
LEVEL = 3
FIT_ROWS = 1500  # labelled rows of each class that are fetched at most; one half makes the dictionaries
FIT_CHARS = 16_384  # characters of each that are used, from a place that its id decides
CLIP = 0.15  # differences beyond this say no more


def blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scorer(self):
        good, bad = compressor(self.good), compressor(self.bad)
        return lambda text: float(1 / (1 + np.exp(-(self.slope * difference(text, good, bad) + self.intercept))))


def compressor(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress


def difference(text: str, good, bad) -> float:
    """(size with the bad dictionary - size with the good one) / own size, within CLIP; 0 for an empty text."""
    parts = blocks(text)
    if not parts:
        return 0.0
    gap = sum(len(bad(p)) - len(good(p)) for p in parts)
    return max(-CLIP, min(CLIP, gap / sum(map(len, parts))))


def dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on two or three blocks of each text, spread evenly; the texts' own end where there is too little to train on."""
    parts = [b for t in texts for b in blocks(t)[:: max(1, len(blocks(t)) // 2)]]
    whole = b"".join(parts)
    if len(whole) >= 4 * DICTIONARY:
        try:
            return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
        except zstandard.ZstdError:
            pass  # e.g. all parts alike
    return whole[-DICTIONARY:] or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's steps on the weighted log-loss with a slight ridge."""
    features = np.stack([x / CLIP, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        slope = features.T @ (weight * (y - p)) - 1e-3 * beta
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / CLIP), float(beta[1])


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled rows of each class that are not held out, FIT_CHARS characters of each.

    The rows with the smallest hashes of their ids are taken, so the choice does not depend on layout.
    The classes' shares over all such labels are counted exactly and enter the curve as weights.  With
    one class or none the score is that class's share (0.5 without labels).
    """
    marked = fresh(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    shares = {int(r[0]): int(r[1]) for r in marked.groupBy("quality").agg(F.countDistinct("doc_id")).collect()}
    chosen = None
    for q in (0, 1):
        top = marked.filter(F.col("quality") == q).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = top if chosen is None else chosen.unionByName(top)
    size = F.char_length("text")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(size - FIT_CHARS + 1, F.lit(1))).cast("int") + 1
    taken = (
        fresh(docs, "doc_id", "text").filter("text is not null")
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * rows ids
        .select("doc_id", "quality", F.substring(F.col("text"), start, F.lit(FIT_CHARS)).alias("text"))
        .groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # of repeated ids, one row
    )
    sample = sorted(taken.collect(), key=lambda r: (r.doc_id, r.quality))
    texts = {q: [r.text for r in sample if r.quality == q] for q in (0, 1)}
    good, bad = (dictionary(texts[q][::2]) for q in (1, 0))
    total = sum(shares.values())
    if not texts[0] or not texts[1]:
        share = min(max(shares.get(1, 0) / total if total else 0.5, 0.01), 0.99)
        return QualityModel(good, bad, 0.0, float(np.log(share / (1 - share))))
    sizes = compressor(good), compressor(bad)
    rest = {q: texts[q][1::2] or texts[q] for q in (0, 1)}
    x = np.array([difference(t, *sizes) for q in (0, 1) for t in rest[q]])
    y = np.array([float(q) for q in (0, 1) for _ in rest[q]])
    weight = np.where(y == 1, shares[1] / len(rest[1]), shares[0] / len(rest[0])) * len(y) / total
    return QualityModel(good, bad, *logistic(x, y, weight))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= threshold).

    Whole texts are scored; null is an empty text, whose difference is 0.  A null id is not held out.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = fresh(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string")
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = [score(value.as_py() or "") for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return in_arrow(rows, scored, SCHEMA)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold.

    Null and empty texts have the score of a difference of 0, null ids change nothing, repeated rows are
    decided alike, and an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py() or "") >= threshold for t in batch.column(at)], pa.bool_()))

    return in_arrow(docs, good, docs.schema)
