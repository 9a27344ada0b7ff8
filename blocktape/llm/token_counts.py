"""Token counts by heap-and-linked-list byte-pair merging (operator 6).

A word's bytes are its first symbols, linked in order.  A heap holds the adjacent pairs that may merge;
the lowest rank is popped, its two symbols become one, and the pairs beside it are pushed.  The count is
the first symbols less the merges; no token is ever looked up in the vocabulary.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktape.llm.common import fresh, in_arrow

#: Fixed value: how the byte-level vocabulary's library splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 100_000  # words of which a worker remembers what it found, in each of two generations
COUNT_WORDS = 300_000  # the same where that is a number only
CACHE_CHARS = 64  # longer ones are not remembered, so that the memory is bounded in bytes too


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next free one from 256 up."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class PairRanks:
    """Ranks of pairs of symbols; a symbol is a byte, or 256 plus the rank of the merge that made it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        number = {letter: b for b, letter in enumerate(byte_letters())}
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[number[left] << 32 | number[right]] = rank
            number.setdefault(left + right, 256 + rank)
        self.bytes_ranks = [self.ranks.get((i >> 8) << 32 | i & 255, -1) for i in range(1 << 16)]
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]

    def count(self, data: bytes) -> int:
        """Symbols that are left of data once no pair of neighbours can merge."""
        n = len(data)
        if n < 2:
            return n
        get, symbols = self.ranks.get, list(data)
        heap = [r * n + i for i, pair in enumerate(zip(data, data[1:])) if (r := self.bytes_ranks[pair[0] << 8 | pair[1]]) >= 0]
        if len(heap) < 2:
            return n - len(heap) if not heap or n == 2 else self._merge(n, symbols, heap, get)
        heapq.heapify(heap)
        return self._merge(n, symbols, heap, get)

    @staticmethod
    def _merge(n: int, symbols: list[int], heap: list[int], get: Callable) -> int:
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(-2)  # past the end: merges with nothing
        left = n
        while heap:
            entry = pop(heap)
            i = entry % n
            rank, j, own = entry // n, after[i], symbols[i]
            if own < 0 or get(own << 32 | symbols[j]) != rank:
                continue  # one of the two has merged meanwhile
            symbols[i] = own = 256 + rank
            symbols[j] = -1
            left -= 1
            after[i] = k = after[j] if j < n else n
            if k < n:
                before[k] = i
                if (r := get(own << 32 | symbols[k])) is not None:
                    push(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := get(symbols[h] << 32 | own)) is not None:
                push(heap, r * n + h)
        return left


class Remembered(dict):
    """What a function gives for a text, remembered for a bounded number of texts in two generations.

    When the young generation is full it becomes the old one, and what is asked for again moves back.
    """

    def __init__(self, of: Callable[[str], object], most: int = CACHE_WORDS):
        super().__init__()
        self.of, self.most, self.old = of, most, {}

    def __missing__(self, text: str):
        if len(text) > CACHE_CHARS:
            return self.of(text)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(text, self)
        if value is self:
            value = self.of(text)
        self[text] = value
        return value


def words_of(of: Callable[[str], object], most: int = CACHE_WORDS) -> Remembered:
    """Remembers what ``of`` gives for a word: a text between two spaces, with the space before it.

    Splitting there never cuts what the library would join, unless a word is empty or starts with white
    space; for these it gives None.
    """
    return Remembered(lambda word: None if not word or word[0].isspace() else of(" " + word), most)


def text_counter(path: str) -> Callable[[str], int]:
    """A function that counts the tokens of a text; special strings in it count one each, as in the library."""
    pairs, split = PairRanks(path), regex.compile(SPLIT).findall
    specials = regex.compile("|".join(map(regex.escape, pairs.special))) if pairs.special else None

    pieces = Remembered(lambda piece: pairs.count(piece.encode()), COUNT_WORDS)

    def plain(text: str) -> int:
        return sum(map(pieces.__getitem__, split(text)))

    words = words_of(plain, COUNT_WORDS)

    def ordinary(text: str) -> int:
        first, *rest = text.split(" ")
        counts = list(map(words.__getitem__, rest))
        if not first or None in counts:
            return plain(text)
        return plain(first) + sum(counts)

    def count(text: str) -> int:
        if specials is None or not any(s in text for s in pairs.special):
            return ordinary(text) if text else 0
        parts = specials.split(text)
        return sum(ordinary(p) for p in parts if p) + len(parts) - 1

    return count


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a byte-level vocabulary in the .json format.  Null and empty texts have
    no token.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = fresh(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or text_counter(tokenizer)
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return in_arrow(rows, counted, SCHEMA)


def with_token_counts(df: DataFrame, tokenizer: str, into: str, text_col: str = "text") -> DataFrame:
    """df with the number of tokens of a text column in column ``into``; null and empty texts have none."""
    at = df.columns.index(text_col)
    schema = df.drop(into).withColumn(into, F.lit(0).cast("long")).schema
    kept = [n for n, c in enumerate(df.columns) if c != into]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or text_counter(tokenizer)
            tokens = pa.array([count(t.as_py() or "") for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), tokens], names=schema.names)

    return in_arrow(df, counted, schema)
