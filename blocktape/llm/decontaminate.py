"""Benchmark decontamination by the q-gram lemma (operator 8).

An item of m bytes within k edits shares at least m - q + 1 - k q grams with the matching part of a text,
and all of them lie on k + 1 neighbouring diagonals (place in the text less place in the item).  Shared
grams are counted in overlapping bands of 2 (k + 1) diagonals; bands that reach the bound are kept,
neighbours as one region, and verified by an alignment restricted to their diagonals.  Items too short for
the bound are searched with shorter grams, and where these give no bound either, aligned without a filter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktape.llm.common import fresh, in_arrow

Q = 12  # bytes of a gram
SHORT_Q = 8  # of items that Q gives no bound for
RATE = 0.05  # edits allowed for each byte of an item
ITEM_BYTES = 4 << 20  # item text that one pass over the documents holds; more items take more passes
FILTER_BITS = 20
PAIRS = 1 << 20  # pairs of places that are held at once
NEAR = 1024  # diagonals between regions of a text that are aligned together
PIECE = 1 << 18  # places of a text in one convolution


def normal(text: str | None) -> bytes:
    """Lower case, and single spaces for runs of white space."""
    return " ".join((text or "").lower().split()).encode()


def gram_codes(data: bytes, q: int = Q) -> np.ndarray:
    """A 64-bit code of the q bytes at each place, 8 <= q <= 16."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = lambda o: np.ndarray((n,), "<u8", data, o, (1,))
    code = at(0) * np.uint64(0x9E3779B97F4A7C15)
    code ^= (at(q - 8) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(7)
    code *= np.uint64(0x9E3779B97F4A7C15)
    return code


def edit_budget(m: int, rate: float) -> int:
    """Edits that an item of m bytes may have; shorter ones than Q must occur literally."""
    return int(rate * m) if m >= Q else 0


def bounded(m: int, k: int, q: int) -> bool:
    """Whether k edits leave one gram of an item's m - q + 1."""
    return m - q + 1 - k * q >= 1


EDIT = 1 << 40  # one edit in a cell of an alignment; below it lies EDIT - 1 less the start, so that later starts win


def aligned(item: bytes, text: bytes, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, edits) of the best alignments, within k edits, of the whole item with the part of text before each end.

    Diagonal = place in text - place in item; only paths on diagonals low .. high count.  Of equally good
    alignments the one that starts last is taken.
    """
    width, far = high - low + 1, (k + 1) * EDIT
    column = low + np.arange(width)  # places in text before row 0
    letters = np.full(width + len(item), 256, np.uint16)  # 256: outside the text
    a, b = max(low, 0), min(high + len(item), len(text))
    if a < b:
        letters[a - low : b - low] = np.frombuffer(text, np.uint8, b - a, a)
    row = np.where((column >= 0) & (column <= len(text)), EDIT - 1 - column, far)
    steps = np.arange(width) * EDIT
    for i, c in enumerate(item):
        step = row + EDIT * (letters[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + EDIT)  # an item letter without partner
        row = np.minimum(np.minimum.accumulate(step - steps) + steps, far)  # text letters without partner
        row[max(0, len(text) - i - low) :] = far  # past the end of the text
        if row.min() >= far:
            break
    at = np.flatnonzero(row < far)
    return EDIT - 1 - row[at] % EDIT, column[at] + len(item), row[at] // EDIT


def apart(starts: np.ndarray, ends: np.ndarray, edits: np.ndarray) -> list[tuple[int, int, int]]:
    """Places (start, end, edits) that do not overlap: those with the fewest edits first, of these the first ones."""
    taken: list[tuple[int, int, int]] = []
    for level in np.unique(edits):
        at = np.flatnonzero(edits == level)
        s, e, n = starts[at], ends[at], 0
        shortest = max(1, int((e - s).min()))
        while n < len(at):
            i = bisect_right(taken, (int(s[n]), 1 << 62, 0))
            hit = next((t for t in taken[max(0, i - 1) : i + 1] if t[0] < e[n] and s[n] < t[1]), None)
            if hit is None:
                hit = (int(s[n]), int(e[n]), int(level))
                taken.insert(i, hit)
            # what ends before this overlaps the place just taken or met
            n = max(n + 1, int(np.searchsorted(e, hit[1] + shortest)))
    return taken


class ItemIndex:
    """Grams of the items, and the search of one text for all of them."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE, q: int = Q):
        budget = lambda d: edit_budget(len(d), rate)
        items = [(i, data) for i, data in items if data]
        below = [(i, d) for i, d in items if budget(d) and not bounded(len(d), budget(d), q)]
        self.below = ItemIndex(below, rate, SHORT_Q) if below and q > SHORT_Q else None
        self.direct = below if self.below is None else []  # aligned without a filter
        self.q, self.items = q, [(i, d) for i, d in items if not budget(d) or bounded(len(d), budget(d), q)]
        self.budget = [budget(d) for _, d in self.items]
        self.rate, self.short = rate, [n for n, (_, d) in enumerate(self.items) if len(d) < q]
        codes = [gram_codes(d, q) for _, d in self.items]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        self.codes, number, times = np.unique(flat, return_inverse=True, return_counts=True)
        ends = np.cumsum([len(c) for c in codes])
        self.grams = np.split(number, ends[:-1]) if codes else []  # number of the gram at each place of each item
        # of any k q + 1 places of an item one is shared, so those with the rarest grams lead to it
        lead = [np.unique(g[np.argsort(times[g], kind="stable")[: k * q + 1]]) for g, k in zip(self.grams, self.budget, strict=True)]
        owner = np.repeat(np.arange(len(lead)), [len(x) for x in lead])
        order = np.argsort(np.concatenate(lead), kind="stable") if lead else np.zeros(0, int)
        self.lead = owner[order]
        self.first = np.searchsorted(np.concatenate(lead)[order], np.arange(len(self.codes) + 1)) if lead else np.zeros(1, int)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.codes >> np.uint64(64 - FILTER_BITS)] = True

    def regions(self, item: int, seen: np.ndarray, bounds: np.ndarray, places: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """(lowest, highest) diagonal of the neighbouring bands of a text that reach the lemma's bound for one item.

        ``places`` are the text's places of the grams ``seen``, between ``bounds``.  Pairs of places are
        counted in pieces of bounded size; those of a gram that is frequent in both are counted by convolution.
        """
        grams, width = self.grams[item], self.budget[item] + 1
        low = -(-len(grams) // width) * width  # diagonals from -low on
        tally = np.zeros((length + low) // width + 2, np.int64)  # hits on each stretch of ``width`` diagonals
        at = np.minimum(np.searchsorted(seen, grams), len(seen) - 1)
        own = np.flatnonzero(seen[at] == grams)
        at, sizes = at[own], (bounds[1:] - bounds[:-1])[at[own]]
        pairs = np.bincount(at, sizes, len(seen))[at]
        for gram in np.unique(at[pairs > PAIRS]):
            where, mine = places[bounds[gram] : bounds[gram + 1]], own[at == gram]
            for a in range(0, length, PIECE):
                part = where[np.searchsorted(where, a) : np.searchsorted(where, a + PIECE)] - a
                if len(part):
                    n = 1 << (PIECE + len(grams)).bit_length()
                    sides = (np.fft.rfft(np.bincount(x, minlength=n)) for x in (part, len(grams) - mine))
                    counts = np.rint(np.fft.irfft(next(sides) * next(sides), n)).astype(np.int64)
                    there = np.flatnonzero(counts)
                    np.add.at(tally, (there + a - len(grams) + low) // width, counts[there])
        light = np.flatnonzero(pairs <= PAIRS)
        for part in np.split(light, np.searchsorted(np.cumsum(sizes[light]), np.arange(PAIRS, sizes[light].sum(), PAIRS))):
            if not len(part):
                continue
            n = sizes[part]
            index = np.repeat(bounds[at[part]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            tally += np.bincount((places[index] - np.repeat(own[part], n) + low) // width, minlength=len(tally))
        # a band is two stretches, so every k + 1 neighbouring diagonals lie in one
        bands = np.flatnonzero(tally[:-1] + tally[1:] >= len(grams) - self.budget[item] * self.q)
        near = 1 if len(bands) < 16 else 1 + NEAR // width  # aligning many regions costs more than aligning what lies between them
        for run in np.split(bands, np.flatnonzero(np.diff(bands) > near) + 1):
            if len(run):
                yield int(run[0]) * width - low, int(run[-1] + 2) * width - low - 1

    def places(self, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(item number, starts, ends, edits) of alignments within the item's budget."""
        codes = gram_codes(text, self.q)
        at = np.flatnonzero(self.filter[codes >> np.uint64(64 - FILTER_BITS)])
        if not len(at) or not len(self.codes):
            return
        n = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        true = self.codes[n] == codes[at]
        at, n = at[true], n[true]
        if not len(at):
            return
        order = np.argsort(n, kind="stable")
        seen, bounds = np.unique(n[order], return_index=True)
        bounds, places = np.append(bounds, len(n)), at[order]
        times = self.first[seen + 1] - self.first[seen]
        index = np.repeat(self.first[seen] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        for item in np.unique(self.lead[index]):
            data, k = self.items[item][1], self.budget[item]
            for low, high in self.regions(item, seen, bounds, places, len(codes)):
                exact = text.find(data, max(0, low), max(0, high) + len(data)) if high - low < 3 * (k + 1) else -1
                if exact >= 0:  # nothing else has room in so few diagonals
                    yield int(item), np.array([exact]), np.array([exact + len(data)]), np.array([0])
                else:
                    yield int(item), *aligned(data, text, low, high, k)

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of the places where an item lies within its budget, best first where they overlap."""
        found: dict[int, list] = {}
        for item, *hit in self.places(text):
            found.setdefault(item, []).append(hit)
        out = [(n, *hit) for n, hits in found.items() for hit in apart(*map(np.concatenate, zip(*hits, strict=True)))]
        for n in self.short:
            if (exact := text.find(self.items[n][1])) >= 0:
                out.append((n, exact, exact + len(self.items[n][1]), 0))
        placed = [(self.items[n][0], a, b, e) for n, a, b, e in sorted(out)]
        for i, data in self.direct:
            hits = aligned(data, text, -len(data), len(text), edit_budget(len(data), self.rate))
            placed += [(i, *hit) for hit in apart(*hits)]
        return placed + (self.below.search(text) if self.below else [])


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about ``most`` bytes of text, so that what a pass holds is bounded."""
    rows = fresh(items, item_id=id_col, text=text_col).filter("length(trim(text)) > 0")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // most)
    for n in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n) if blocks > 1 else rows
        yield [(r.item_id, normal(r.text)) for r in part.select("item_id", "text").toLocalIterator()]


MATCHES = "doc_id long, item_id long, match_start long, match_end long, edits int, item_length int"


def find_contamination(
    docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block: int = ITEM_BYTES,
) -> DataFrame:
    """One row per place of a document that holds an item: doc_id, item_id, match_start, match_end, edits, item_length.

    A place holds an item when it is within rate * length edits of the whole item, both in lower case
    with single spaces; items of fewer than 12 bytes must occur literally.  Places are bytes of that
    form.  Whole texts are searched; null and empty texts and items match nothing.  Repeated rows give
    repeated results.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = fresh(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    names = [c.split()[0] for c in MATCHES.split(", ")]
    types = [pa.int64()] * 4 + [pa.int32()] * 2
    out = None
    for part in item_blocks(items, item_id_col, item_text_col, block):
        size = {i: len(d) for i, d in part}

        def found(batches: Iterator[pa.RecordBatch], part=part, size=size) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(part, rate)
            for batch in batches:
                hits = []
                for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                    hits += [(doc.as_py(), i, a, b, e, size[i]) for i, a, b, e in index.search(normal(text.as_py()))]
                columns = list(zip(*hits, strict=True)) if hits else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        more = in_arrow(rows, found, MATCHES)
        out = more if out is None else out.unionByName(more)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCHES)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block: int = ITEM_BYTES,
) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; null and empty texts stay."""
    at = docs.columns.index(text_col)
    for part in item_blocks(items, item_id_col, item_text_col, block):

        def clean(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(part, rate)
            for batch in batches:
                yield batch.filter(pa.array([not index.search(normal(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = in_arrow(docs, clean, docs.schema)
    return docs
