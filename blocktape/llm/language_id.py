"""Language identification by a small byte convolutional network (operator 5), trained and applied in numpy.

Bytes fold into 64 classes.  Filters of several widths slide over fixed-length windows, the largest
response of each is kept, and a softmax layer reads them.  A text's prediction is the mean over all of
its windows.  For use, filters become look-up tables over two or three neighbouring classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktape.llm.common import fresh, in_arrow

WINDOW = 256  # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
PAD = 63
FIT_ROWS = 500  # labelled rows of each language that are fetched at most
FIT_CHARS = 2048  # characters of each that are used, from a place that its id decides
EPOCHS = 6
BLOCK = 512  # windows that are scored together
LETTER = regex.compile(r"\p{L}")


def byte_classes() -> np.ndarray:
    """Class of each byte: letters without case, digits, white space, other ASCII, lead bytes, continuation bytes."""
    c = np.full(256, 28, np.uint8)
    c[48:58] = 26
    c[[9, 10, 11, 12, 13, 32]] = 27
    for i in range(26):
        c[65 + i] = c[97 + i] = i
    c[0x80:0xC0] = 29 + (np.arange(64) & 31)  # capitals of two-byte letters lie 32 before the small ones
    c[0xC0:0xC6] = 61
    c[0xC6:] = 62
    return c


CLASSES = byte_classes()


def windows(text: str) -> np.ndarray:
    """Class numbers of the text's bytes as rows of WINDOW; the last row is padded."""
    data = CLASSES[np.frombuffer(text.encode(), np.uint8)]
    rows = max(1, -(-len(data) // WINDOW))
    out = np.full(rows * WINDOW, PAD, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, WINDOW)


@dataclass
class ByteNetwork:
    languages: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 64, FILTERS)
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> dict:
        """Filter responses for each pair of neighbours (first two and last two of width 4) and each triple."""
        f = self.filters
        two = (f[2][0][:, None] + f[2][1][None]).reshape(4096, -1)
        three = (f[3][0][:, None, None] + f[3][1][None, :, None] + f[3][2][None, None]).reshape(64**3, -1)
        front, back = ((f[4][j][:, None] + f[4][j + 1][None]).reshape(4096, -1) for j in (0, 2))
        return {"2": two, "3": three, "4": front, "5": back}

    def probabilities(self, rows: np.ndarray, t: dict) -> np.ndarray:
        x = rows.astype(np.int32)
        pair = x[:, :-1] * 64 + x[:, 1:]
        triple = pair[:, :-1] * 64 + x[:, 2:]
        best = [
            t["2"][pair].max(axis=1),
            t["3"][triple].max(axis=1),
            (t["4"][pair[:, :-2]] + t["5"][pair[:, 2:]]).max(axis=1),
        ]
        pooled = np.concatenate([np.maximum(b + self.bias[w], 0) for b, w in zip(best, WIDTHS, strict=True)], axis=1)
        return softmax(pooled @ self.dense + self.dense_bias)

    def predict(self, texts: list[str], t: dict) -> list[tuple[str, float]]:
        """(language, mean probability); `und` and 0.0 for a text without a letter."""
        keep = [i for i, text in enumerate(texts) if text and LETTER.search(text)]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not keep or not self.languages:
            return out
        each = [windows(texts[i]) for i in keep]
        rows = np.concatenate(each)
        p = np.concatenate([self.probabilities(rows[a : a + BLOCK], t) for a in range(0, len(rows), BLOCK)])
        ends = np.cumsum([len(e) for e in each])
        mean = np.add.reduceat(p, np.r_[0, ends[:-1]], axis=0) / np.array([len(e) for e in each])[:, None]
        for i, m in zip(keep, mean, strict=True):
            out[i] = (self.languages[int(m.argmax())], float(min(m.max(), 1.0)))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> ByteNetwork:
    """Adam on the log-loss of single windows; gradients flow to the place of each filter's largest response."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    each = [windows(t) for t in texts]
    x = np.concatenate(each) if each else np.zeros((0, WINDOW), np.uint8)
    y = np.repeat([names.index(v) for v in languages], [len(e) for e in each]).astype(int)
    params = {f"f{w}": rng.normal(0, 0.3, (w, 64, FILTERS)) for w in WIDTHS} | {f"b{w}": np.zeros(FILTERS) for w in WIDTHS}
    params |= {"d": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, max(1, len(names)))), "e": np.zeros(max(1, len(names)))}
    mean, var = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    step = 0
    for _ in range(epochs if len(names) > 1 else 0):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            rows, step, grads, pooled, place = x[at].astype(np.int64), step + 1, {}, [], {}
            for w in WIDTHS:
                span = WINDOW - w + 1
                response = sum(params[f"f{w}"][j][rows[:, j : j + span]] for j in range(w))
                place[w] = response.argmax(axis=1)
                pooled.append(np.take_along_axis(response, place[w][:, None], axis=1)[:, 0] + params[f"b{w}"])
            raw = np.concatenate(pooled, axis=1)
            h = np.maximum(raw, 0)
            gap = softmax(h @ params["d"] + params["e"])
            gap[np.arange(len(at)), y[at]] -= 1
            gap /= len(at)
            grads["d"], grads["e"] = h.T @ gap, gap.sum(axis=0)
            back = (gap @ params["d"].T) * (raw > 0)
            for n, w in enumerate(WIDTHS):
                g = back[:, n * FILTERS : (n + 1) * FILTERS]
                grads[f"b{w}"] = g.sum(axis=0)
                grads[f"f{w}"] = np.zeros_like(params[f"f{w}"])
                for j in range(w):
                    np.add.at(grads[f"f{w}"][j], (np.take_along_axis(rows, place[w] + j, axis=1), np.arange(FILTERS)[None]), g)
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                var[k] += 0.001 * (g * g - var[k])
                params[k] -= 0.01 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    as32 = {k: v.astype(np.float32) for k, v in params.items()}
    return ByteNetwork(names, {w: as32[f"f{w}"] for w in WIDTHS}, {w: as32[f"b{w}"] for w in WIDTHS}, as32["d"], as32["e"])


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2


def fit_languages(docs: DataFrame, rows: int = FIT_ROWS) -> ByteNetwork:
    """Train on at most ``rows`` rows of each language that are not held out, FIT_CHARS characters of each.

    The rows with the smallest hashes of their ids are taken; languages come from the data, all of them.
    Null languages and texts are not learnt from.
    """
    rows_in = fresh(docs, "doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null")
    rows_in = rows_in.filter(~held_out(F.col("doc_id")))
    size = F.char_length("text")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(size - FIT_CHARS + 1, F.lit(1))).cast("int") + 1
    part = F.substring(F.col("text"), start, F.lit(FIT_CHARS)).alias("text")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows_in.select("doc_id", "lang").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= rows).select("doc_id", "lang").distinct()
    sample = rows_in.join(F.broadcast(chosen), ["doc_id", "lang"])  # at most ``rows`` ids of each language
    sample = sample.select("doc_id", "lang", part).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    sample = sorted((r for r in sample if LETTER.search(r.text)), key=lambda r: (r.doc_id, r.lang))
    return train([r.text for r in sample], [r.lang for r in sample])


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict_languages(docs: DataFrame, model: ByteNetwork) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Whole texts are read.  A null text, or one without a letter, is `und` with score 0; so is any text
    when there was nothing to learn from.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = fresh(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string")
    )

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, 64):
                found += model.predict([v or "" for v in batch.column(2).slice(a, 64).to_pylist()], tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return in_arrow(rows, predicted, SCHEMA)
