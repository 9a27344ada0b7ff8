"""Grouping of spelling variants by asymmetric q-chunks (operator 11).

Of two words that differ by one inserted, deleted or replaced code point, the shorter is cut into two
disjoint chunks: the edit lies in one of them and the other is preserved, at the start of the longer word
or shifted by their difference in length, which is one at most.  So the shorter word contributes its chunks and
the longer one the grams that can meet them, and both are joined by equality.  What a chunk leaves open is
cut again: each word starts with its quarters, a row per quarter that may hold the edit, keyed by all that
is outside of it.  Keys under which too many words meet are cut in half again and again, down to one code
point, where all that meet are near; so families of words with long common parts cost their size and not
its square.  Every pair is verified on whole words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktape.llm.common import ascii_lower, fresh, written

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
PARTS = 4  # places of the edit that a word starts with
WORK = 16  # candidate pairs per row of a key from which it is cut further


def words_of(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word) for every maximal run of letters of min_length or more code points in whole texts, A-Z in lower case; null texts have none."""
    rows = fresh(docs, doc_id=id_col, text=text_col)
    runs = F.regexp_extract_all(ascii_lower(F.col("text").cast("string")), F.lit(f"({LETTERS}{{{min_length},}})"))
    return rows.select("doc_id", F.explode(runs).alias("word"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; a frequent word is summed up before the shuffle."""
    counts = words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count)


def keyed(rows: DataFrame) -> DataFrame:
    """rows of (word, n, d, a, b) with the key of all that lies outside places a to b of the shorter word; d is 1 where the word is the longer one."""
    before, after = F.col("word").substr(F.lit(1), F.col("a")), F.col("word").substr(F.col("b") + F.col("d") + 1, F.char_length("word"))
    return rows.withColumn("key", F.xxhash64(F.char_length("word") - F.col("d"), "a", "b", before, after))


def places(vocab: DataFrame) -> DataFrame:
    """Rows of every word: its chunks, and its grams for words that are one code point shorter."""
    length = F.char_length("word")
    cut = lambda d, i: F.floor((length - d) * i / PARTS).cast("int")
    spans = [F.struct(F.lit(d).alias("d"), cut(d, i).alias("a"), cut(d, i + 1).alias("b")) for d in (0, 1) for i in range(PARTS)]
    return vocab.select("word", "n", F.explode(F.array(*spans)).alias("p")).select("word", "n", "p.*").filter("a < b")


def halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    both = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    return rows.select("word", "n", "d", F.explode(both).alias("p")).select("word", "n", "d", "p.*")


def met_rows(vocab: DataFrame, work: int) -> DataFrame:
    """(key, word, n, d, a): rows whose key has partners, cut until a key has about ``work`` pairs a row at most or one code point is open."""
    rows, done = places(vocab), None
    while True:
        at = keyed(rows)
        per = at.groupBy("key").agg(F.sum(1 - F.col("d")).alias("s"), F.sum("d").alias("t"), F.max(F.col("b") - F.col("a")).alias("open"))
        pairs = F.col("s") * (F.col("s") - 1) / 2 + F.col("s") * F.col("t")
        per = written(per.filter(pairs > 0).select("key", ((pairs > work * (F.col("s") + F.col("t"))) & (F.col("open") > 1)).alias("hot")))
        at = written(at.join(per, "key"))
        closed = at.filter("not hot").select("key", "word", "n", "d", "a")
        done = closed if done is None else done.unionByName(closed)
        rows = at.filter("hot").select("word", "n", "d", "a", "b")
        if not rows.limit(1).count():
            return done
        rows = halves(rows)


def near_words(vocab: DataFrame, work: int = WORK) -> DataFrame:
    """(word, n, other, n_other): all pairs of distinct words of vocab (word, n) that differ by one code point, each once, the shorter or smaller one first."""
    rows = met_rows(vocab, work)
    short = rows.filter("d = 0").select("key", "word", "n", "a")
    long = rows.select("key", "d", F.col("word").alias("other"), F.col("n").alias("n_other"))
    # a code point may be inserted at several places to the same effect: the first of them counts
    again = F.col("word").substr(F.col("a") + 1, F.char_length("word")) == F.col("other").substr(F.col("a") + 2, F.char_length("other"))
    once = F.when(F.col("d") == 0, F.col("word") < F.col("other")).otherwise((F.col("a") == 0) | ~again)
    met = short.hint("merge").join(long, "key").filter(once)
    return met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "n_other")


def roots_of(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root): from word, forms (word, form) are followed to the last; no chain is longer than ``hops``.  Each round doubles the steps."""
    known = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(hops, 1))))):
        step = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        known = written(known.hint("merge").join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return known


def spelling_groups(vocab: DataFrame, ratio: int = RATIO, work: int = WORK) -> DataFrame:
    """One row per word of vocab (word, n): word, form, root, n, n_near, form_n.

    Words are near that differ by exactly one inserted, deleted or replaced code point.  A word's form is its
    near word of largest n, of equal ones the smallest in code-point order, if that n is ratio times the
    word's or more, else null; root is the last form that forms lead to, the word itself without one; n_near counts
    near words.  Rows that repeat a word add up; null words and other columns are ignored; an empty table
    gives an empty result.  ``ratio`` of two or more, so that no chain of forms returns.
    """
    if ratio < 2:
        raise ValueError("ratio below two")
    vocab = written(fresh(vocab, "word", "n").filter("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    most, least = vocab.agg(F.max("n"), F.min("n")).first()
    pairs = written(near_words(vocab, work))
    both = pairs.select("word", "other", "n_other").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("n_other")))
    best = F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = written(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best))
    found = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    has: Column = F.col("form_n") >= ratio * F.col("n")
    found = written(found.select("word", "n", "n_near", F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    hops = int(math.log(max(most or 1, 1) / max(least or 1, 1), ratio)) + 1
    roots = roots_of(found.filter("form is not null"), hops)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
