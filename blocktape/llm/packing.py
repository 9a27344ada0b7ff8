"""Vector bin packing of training sequences (operator 3) under limits on tokens, segments and loss-bearing tokens.

Bins have a residual in each dimension; an example goes to the open bin whose residual has the largest dot
product with the example's demand, both as shares of the limits, among bins where it fits.  Examples that
may be cut fill what is left of a bin before a new one is opened.  Each task packs its own rows as they
stream past and holds a bounded number of open bins, with the ids of no more than the pieces in them.

Documents (`pack_documents`) bear loss on every token and may have as many segments as tokens, so that tiny
ones leave no padding; conversations (`pack_examples`) have all three limits.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktape.llm.common import fresh, in_arrow
from blocktape.llm.token_counts import SPLIT, byte_letters

OPEN_BINS = 32  # bins that a task holds open
OUT_ROWS = 4096  # rows of one output batch, about
TASK_BITS = 36  # a task's sequences are numbered below 2^36
WORDS_AT_ONCE = 20_000  # words that are encoded, or put in their places, together
LONG_RUN = 1000  # the faster library's matcher has a stack, which long runs of white space fill
#: Fixed value: a space at the start or before the end or white space, which the library may join with it.
ODD_SPACE = r"\A | (?:[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 2048
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


@dataclass
class Bin:
    tokens: int = 0
    loss: int = 0
    pieces: list = field(default_factory=list)  # (payload, start, length, loss)


class VectorPacker:
    """Places examples one by one; ``closed`` gets each full bin's pieces."""

    def __init__(self, limits: Limits, closed: Callable[[list], None], open_bins: int = OPEN_BINS):
        self.limits, self.closed, self.most, self.bins = limits, closed, open_bins, []

    def gain(self, b: Bin, tokens: int, loss: int) -> float:
        """Dot product of demand and residual, as shares of the limits."""
        m = self.limits
        return (
            tokens * (m.tokens - b.tokens) / m.tokens**2
            + (m.segments - len(b.pieces)) / m.segments**2
            + loss * (m.loss - b.loss) / m.loss**2
        )

    def best(self, tokens: int, loss: int) -> Bin | None:
        m = self.limits
        fits = [b for b in self.bins if b.tokens + tokens <= m.tokens and b.loss + loss <= m.loss and len(b.pieces) < m.segments]
        return max(fits, key=lambda b: self.gain(b, tokens, loss), default=None)

    def add(self, b: Bin, payload, start: int, tokens: int, loss: int) -> None:
        b.pieces.append((payload, start, tokens, loss))
        b.tokens += tokens
        b.loss += loss
        m = self.limits
        if b.tokens == m.tokens or b.loss == m.loss or len(b.pieces) == m.segments:
            self.close(b)

    def close(self, b: Bin) -> None:
        if b in self.bins:
            self.bins.remove(b)
        self.closed(b.pieces)

    def place(self, payload, tokens: int, loss: int) -> None:
        """A whole example; one beyond a limit has a sequence of its own, so that none is lost."""
        if tokens > self.limits.tokens or loss > self.limits.loss:
            self.closed([(payload, 0, tokens, loss)])
            return
        b = self.best(tokens, loss)
        if b is None:
            if len(self.bins) >= self.most:
                self.close(max(self.bins, key=lambda x: (x.tokens, x.loss)))
            b = Bin()
            self.bins.append(b)
        self.add(b, payload, 0, tokens, loss)

    def place_cut(self, part: Callable[[int, int], object], tokens: int) -> None:
        """An example of which every token bears loss, and which may be cut anywhere: part(start, length) is a piece's payload."""
        cap, start = min(self.limits.tokens, self.limits.loss), 0
        while tokens - start >= cap:
            self.closed([(part(start, cap), start, cap, cap)])
            start += cap
        while start < tokens:
            rest = tokens - start
            b = self.best(rest, rest)
            if b is None and len(self.bins) >= self.most:  # no room for the whole rest: fill the bin with the least room
                b = max(self.bins, key=lambda x: x.tokens)
                rest = min(rest, cap - b.tokens)
            elif b is None:
                b = Bin()
                self.bins.append(b)
            self.add(b, part(start, rest), start, rest, rest)
            start += rest

    def finish(self, cut: bool) -> None:
        """Close all bins.  With cut, their pieces fill bins to the brim, and the last ones are powers of two."""
        rest, self.bins = sorted(self.bins, key=lambda b: -b.tokens), []
        if not cut:
            for b in rest:
                self.closed(b.pieces)
            return
        cap, queue = min(self.limits.tokens, self.limits.loss), [p for b in rest for p in b.pieces]
        left = sum(p[2] for p in queue)
        while queue:
            room = cap if left >= cap else 1 << (left.bit_length() - 1)
            out: list = []
            while room and queue and len(out) < self.limits.segments:
                payload, start, length, _ = queue.pop()
                take = min(room, length)
                out.append((payload, start, take, take))
                if take < length:
                    queue.append((payload, start + take, length - take, length - take))
                room, left = room - take, left - take
            self.closed(out)


def after_spaces(words: pa.Array) -> str:
    """All words in one text, each with a space before it."""
    return " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", words.type))[0].as_py()


class TokenIds:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    Texts of a batch are cut before single spaces, which the library never joins with what is before them;
    each distinct word of the batch is encoded once and its ids are put where it stands.  The same
    vocabulary gives the same ids in two libraries; the faster one encodes Latin letters, the file's own
    library all others, long runs of white space and all texts that hold a special string.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        number = {letter: b for b, letter in enumerate(byte_letters())}
        ranks = {bytes(map(number.__getitem__, t)): i for t, i in self.library.get_vocab().items() if t not in self.specials}
        self.fast = tiktoken.Encoding("texts", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)  # tokens that start with a space
        self.spaced[[i for t, i in ranks.items() if t[0] == ord(" ")]] = True
        self.foreign, self.run = re.compile("[^\0-\u024f]").search, re.compile(r"\s\s{%d}" % (LONG_RUN - 1)).search

    def is_quick(self, text: str) -> bool:
        return (text.isascii() or not self.foreign(text)) and not self.run(text)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def quick(self, text: str) -> np.ndarray:
        return np.frombuffer(array("I", self.fast(text)), "<u4")

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text without special strings."""
        return self.quick(text) if self.is_quick(text) else self.whole(text)

    def runs(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of all words, each with a space before it, then where each word's ids start in these and how many they are."""
        ids, start, count, total = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0

        def learn(where: np.ndarray, text: str, encode: Callable[[str], np.ndarray]) -> None:
            nonlocal total
            ids.append(encode(text))
            begins = np.flatnonzero(self.spaced[ids[-1]])  # a word has no other token that starts with a space
            start[where], count[where] = total + begins, np.diff(begins, append=len(ids[-1]))
            total += len(ids[-1])

        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            where, text = np.arange(at, at + len(part)), after_spaces(part)
            if self.is_quick(text):
                learn(where, text, self.quick)
                continue
            latin = np.array([self.is_quick(w) for w in part.to_pylist()])
            for some, encode in ((latin, self.quick), (~latin, self.whole)):
                if some.any():
                    learn(where[some], after_spaces(part.filter(pa.array(some))), encode)
        return ids, start, count

    def by_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, of which none has an odd space or a special string."""
        split = pc.split_pattern(texts, " ")
        words, bounds = split.values, np.asarray(split.offsets)
        follows = np.ones(len(words), bool)  # words with a space before them
        follows[bounds[:-1]] = False
        coded = words.filter(pa.array(follows)).dictionary_encode()
        ids, start, count = self.runs(coded.dictionary)
        firsts = [self.plain(w) for w in words.filter(pa.array(~follows)).to_pylist()]
        sizes = np.array([len(x) for x in firsts], np.int64)
        start = np.concatenate([start, count.sum() + np.cumsum(sizes) - sizes])
        count = np.concatenate([count, sizes])
        flat = np.concatenate([*ids, *firsts, np.zeros(0, "<u4")])
        which = np.empty(len(words), np.int64)
        which[follows] = np.asarray(coded.indices)
        which[~follows] = len(coded.dictionary) + np.arange(len(firsts))
        ends = np.concatenate([[0], np.cumsum(count[which])])
        out = np.empty(ends[-1], "<u4")
        for at in range(0, len(which), WORDS_AT_ONCE):
            part, place = which[at : at + WORDS_AT_ONCE], ends[at : at + WORDS_AT_ONCE + 1]
            out[place[0] : place[-1]] = flat[np.repeat(start[part] - place[:-1], count[part]) + np.arange(place[0], place[-1])]
        marks = ends[bounds].tolist()
        return [out[a:b].tobytes() for a, b in pairwise(marks)]

    def of(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a batch; a null text has none."""
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= np.asarray(pc.match_substring(texts, s))
        apart = special | np.asarray(pc.match_substring_regex(texts, ODD_SPACE))
        out = iter(self.by_words(texts.filter(pa.array(~apart))))
        alone = zip(texts.filter(pa.array(apart)).to_pylist(), special[apart].tolist(), strict=True)
        odd = (self.whole(text) if held else self.plain(text) for text, held in alone)
        return [next(odd).tobytes() if a else next(out) for a in apart.tolist()]


def id_bytes(path: str) -> Callable[[str], bytes]:
    """A function from a text to its token ids as little-endian unsigned 32-bit integers."""
    ids = TokenIds(path)
    return lambda text: ids.of(pa.array([text], pa.string()))[0]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's token ids and then ``end_id``; every one of these ids lies in one piece, and
    the pieces of a sequence follow one another from offset 0.  Null and empty texts are one id.  All
    sequences are full but for each task's last few, whose lengths are powers of two (a smaller limit on
    segments than the default one can close some before).  Repeated ids are packed apart.  Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = fresh(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    kind = pa.schema([(n.split()[0], pa.int64()) for n in PIECES.split(", ")])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId() << TASK_BITS, []

        def closed(pieces: list) -> None:
            nonlocal number
            offset = 0
            for (doc, total, ids, at), start, length, _ in pieces:  # ids of the piece as it was placed, from ``at`` on
                out.append((doc, start, length, zlib.crc32(ids[4 * (start - at) : 4 * (start - at + length)]), total, number, offset))
                offset += length
            number += 1

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kind)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kind)
            out.clear()
            return batch

        encoder, packer, last = None, VectorPacker(limits, closed), end_id.to_bytes(4, "little")
        for batch in batches:
            encoder = encoder or TokenIds(tokenizer)
            for key, ids in zip(batch.column(0).to_pylist(), encoder.of(batch.column(1)), strict=True):
                ids += last
                total = len(ids) // 4
                packer.place_cut(lambda start, n, ids=ids, key=key, total=total: (key, total, ids[4 * start : 4 * (start + n)], start), total)
                if len(out) >= OUT_ROWS:
                    yield told()
            yield told()
        packer.finish(cut=True)
        yield told()

    return in_arrow(rows, packed, PIECES)


def pack_examples(examples: DataFrame, limits: Limits, id_col: str, tokens_col: str, loss_col: str) -> DataFrame:
    """Whole examples of instruction data: one row per example with sequence_id, offset and segment.

    An example with more tokens or loss-bearing tokens than a limit gets a sequence of its own.  Null
    counts are 0.  Other columns are dropped; an empty table gives an empty result.
    """
    rows = fresh(examples, _id=id_col, _tokens=tokens_col, _loss=loss_col).select(
        F.col("_id").cast("long"), *(F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)) for c in ("_tokens", "_loss"))
    )
    names = [id_col, tokens_col, loss_col, "sequence_id", "offset", "segment"]
    kind = pa.schema([(n, pa.int64()) for n in names])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId() << TASK_BITS, []

        def closed(pieces: list) -> None:
            nonlocal number
            offset = 0
            for segment, (key, _, tokens, loss) in enumerate(pieces):
                out.append((key, tokens, loss, number, offset, segment))
                offset += tokens
            number += 1

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kind)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kind)
            out.clear()
            return batch

        packer = VectorPacker(limits, closed)
        for batch in batches:
            for key, tokens, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                packer.place(key, tokens, loss)
            yield told()
        packer.finish(cut=False)
        yield told()

    return in_arrow(rows, packed, ", ".join(f"`{n}` long" for n in names))
