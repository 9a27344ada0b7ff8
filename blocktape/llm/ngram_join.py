"""N-gram Jaccard self-join by grouped prefix filtering (operator 1).

Every document becomes the set of its five-word shingles, each by a 64-bit hash of its words.  Under one
order of all shingles two sets of Jaccard similarity t or more share a shingle in their prefixes, the first
floor((1 - t) n) + 1 shingles of each.  Documents with the same prefix and the same size form one group;
groups that share prefix shingles are filtered by size, by the place of the first shared shingle and by the
number shared, and the pairs that are left are expanded to their members and verified on the whole sets.

The order puts frequent shingles last, by a count sketch of all shingles of all documents; the sketch has
a fixed size, and errors in it change the work only, never the result.  Rounds of star links come first:
each group is verified against one group of another component, the one that most of its prefix points to.
A shingle points to the group that has it earliest: of near copies the one with the fewest edits, to which
most others link.  What the rounds connect needs no more verification, and a shingle's rows outside its
largest component are all that is paired, so that a group of near copies costs its size and not its square.
Members of one group meet by the shingles that follow their common prefix.  Before texts are joined, a parity
bitmap of each set gives a lower bound of how many shingles differ, which ends pairs that cannot reach t.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktape.llm.common import bit_of, bitmaps, fresh, in_arrow, keep_marked, written
from blocktape.llm.components import connected_components
from blocktape.llm.exact_dedup import bits_for

WORDS = 5
PERCENT = 80  # similarity in percent
SKETCH_BITS = 21  # 2^21 counters, 8 MB
CHUNK = 1 << 12  # counters in one row
STAR_ROUNDS = 4  # at most; they end when pairing all that is open costs less than the index has rows
PARITY_BITS = 1024  # of the bitmap of each set
HOT_PART = 1000  # groups of one shingle that meet in one part of a join
MIX = np.uint64(0x9E3779B97F4A7C15)
DONE = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words; A-Z in lower case, words end at ASCII white space only."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, an empty one none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    code = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        code = code * MIX + w[j : len(w) - n + 1 + j]
        code ^= code >> np.uint64(29)
    code *= DONE
    code ^= code >> np.uint64(31)
    return np.unique(code)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """n - ceil(t n) + 1: a set that shares none of its first so many shingles cannot reach t."""
    return n - -(-percent * n // 100) + 1 if n else 0


def parity(s: np.ndarray) -> np.ndarray:
    """A bit per residue of the shingles' hashes: set if an odd number of them has it.  Two sets differ by as many shingles at least as their bitmaps do by bits."""
    odd = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def sketch(docs: DataFrame, words: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all shingles of all documents, hashed into 2^bits counters; 4 * 2^bits bytes on the driver."""
    chunks = (1 << bits) // CHUNK
    shift = np.uint64(64 - bits)
    names, types = ["chunk", "places", "counts"], [pa.int32(), pa.binary(), pa.binary()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(1 << bits, np.uint32), [], 0
        for batch in slices(batches):
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), words) >> shift)
                n += len(held[-1])
            if n > 1 << 20:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        rows: list[tuple] = []
        for c, part in enumerate(total.reshape(chunks, CHUNK)):
            at = np.flatnonzero(part)
            if len(at) > CHUNK // 2:
                rows.append((c, b"", part.tobytes()))
            elif len(at):  # a small input sets few counters: only these are sent
                rows.append((c, at.astype(np.uint16).tobytes(), part[at].tobytes()))
        for a in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[a : a + 64], strict=True), types, strict=True)], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, places, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                sums = total.setdefault(chunk, np.zeros(CHUNK, np.uint64))
                at = np.frombuffer(places.as_py(), np.uint16)
                sums[at if len(at) else slice(None)] += np.frombuffer(counts.as_py(), np.uint32)
        full = [np.minimum(v, np.uint64(2**32 - 1)).astype(np.uint32).tobytes() for v in total.values()]  # a counter stays at its largest value
        yield pa.RecordBatch.from_arrays([pa.array(list(total), types[0]), pa.array([b""] * len(total), types[1]), pa.array(full, types[2])], names=names)

    kind = "chunk int, places binary, counts binary"
    out = np.zeros((chunks, CHUNK), np.uint32)
    for row in in_arrow(docs.select("text"), count, kind).repartition(16, "chunk").mapInArrow(add, kind).collect():
        out[row.chunk] = np.frombuffer(bytes(row.counts), np.uint32)
    return out.reshape(-1)


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, n, set_sig, prefix_sig, prefix, parity): size, hashes of the set and of prefix and size, prefix shingles, bitmap."""
    shift = np.uint64(64 - (len(counts).bit_length() - 1))
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                p = prefix_length(len(s), percent)
                # s is sorted, so a stable sort by count orders by (count, hash)
                first = s[np.argsort(order[s >> shift], kind="stable")[:p]]
                for column, v in zip(rows, (len(s), xxhash.xxh3_128_digest(s.tobytes()), xxhash.xxh3_128_digest(first.tobytes() + len(s).to_bytes(8, "little")), first.view(np.int64), parity(s)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()), *(pa.array(r, pa.list_(pa.int64())) for r in rows[3:])],
                names=["doc_id", "n", "set_sig", "prefix_sig", "prefix", "parity"],
            )

    return in_arrow(docs.select("doc_id", "text"), cut, "doc_id long, n long, set_sig binary, prefix_sig binary, prefix array<long>, parity array<long>")


def next_shingles(texts: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(id, token): of each text (id, text) the shingles after its prefix of which sets of one group that link share one.

    Two sets of size n and of one prefix share o shingles or more, o - p of them past the prefix; so
    they share one of the first n - o + 1 there.
    """
    shift = np.uint64(64 - (len(counts).bit_length() - 1))
    sent = texts.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in slices(batches):
            ids, tokens = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), words)
                n, p = len(s), prefix_length(len(s), percent)
                o = -(-2 * percent * n // (100 + percent))
                after = s[np.argsort(order[s >> shift], kind="stable")[p : p + n - o + 1]]
                tokens.append(after.view(np.int64))
                ids.append(np.full(len(after), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in (ids, tokens)], names=["id", "token"])

    return in_arrow(texts.select("id", "text"), cut, "id long, token long")


def marked(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key may be among ``ids`` (one column of the same name): a bitmap of bounded size tests them in the scan.

    With more ids than such a bitmap tells apart it is a join on the key.
    """
    n = ids.count()
    bits = bits_for(n)
    if 4 * n > bits:
        return df.join(ids.hint("merge"), key, "left_semi")
    return keep_marked(df, bit_of(F.col(key), bits, 0), written(bitmaps(ids.select(bit_of(F.col(key), bits, 0).alias("slot")), "slot")))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents in ids (id), and of a few others that the bit test lets pass."""
    return marked(docs.select(F.col("doc_id").alias("id"), "text"), "id", ids)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets reach the similarity.

    Texts are joined rather than sets, which are twice as large.  Pairs grow with the input, so they are
    never broadcast.
    """
    one = pairs.hint("merge").join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a")
    both = one.hint("merge").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            keep = []
            for key, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                s = shingle_set(x.as_py(), words)
                if (key, hash(y.as_py())) != last:  # rows of one b follow one another
                    last, t = (key, hash(y.as_py())), shingle_set(y.as_py(), words)
                union = np.concatenate([s, t])
                union.sort()
                same = int((union[1:] == union[:-1]).sum())
                keep.append(100 * same >= percent * (len(union) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return in_arrow(both.select("a", "b", "ta", "tb"), test, "a long, b long")


def size_fits(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def needed(x: Column, y: Column, percent: int) -> Column:
    """Shingles that sets of these sizes must share: ceil(t (x + y) / (1 + t))."""
    return F.ceil(percent * (x + y) / (100 + percent))


def least_shared(x: str, y: str, percent: int) -> Column:
    """Prefix shingles that two sets of these sizes must share: what is needed less what can lie past the prefixes.

    Past the end of the prefix that ends first in the order, at most that set's remaining n - prefix
    shingles can be shared, and up to there both prefixes are complete.
    """
    past = lambda n: F.ceil(percent * F.col(n) / 100) - 1
    return F.greatest(needed(F.col(x), F.col(y), percent) - F.greatest(past(x), past(y)), F.lit(1))


def may_reach(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose bitmaps do not rule the similarity out."""
    side = lambda c: members.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.filter(differ <= F.col("na") + F.col("nb") - 2 * needed(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()


def group_members(docs: DataFrame, split: DataFrame, counts: np.ndarray, words: int, percent: int, part: int = HOT_PART) -> DataFrame:
    """Pairs (a, b) of classes of one group but of different components, from split (cls, gid, comp), that share one of the shingles that follow their prefix.

    A shingle's rows outside its largest component meet its rows of other components, in parts where it is hot.
    """
    texts = texts_of(docs, split.select(F.col("cls").alias("id")).distinct())
    at = next_shingles(texts, counts, words, percent).withColumnRenamed("id", "cls").hint("merge").join(split.select("cls", "gid", "comp"), "cls")
    at = written(at.distinct())
    sides = at.groupBy("gid", "token", "comp").agg(F.count(F.lit(1)).alias("rows"))
    sides = sides.groupBy("gid", "token").agg(F.max(F.struct("rows", "comp")).alias("top"), F.sum("rows").alias("all"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    sides = written(sides.select("gid", "token", F.col("top.comp").alias("big"), F.ceil(F.col("all") / part).cast("int").alias("_parts")))
    at = at.hint("merge").join(sides, ["gid", "token"])
    left = at.filter("comp <> big").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("gid", "token", "_salt", F.col("cls").alias("x"), F.col("comp").alias("cx"))
    right = at.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.col("_parts")).cast("int")).select("gid", "token", "_salt", "big", F.col("cls").alias("y"), F.col("comp").alias("cy"))
    met = left.hint("merge").join(right, ["gid", "token", "_salt"]).filter("cx <> cy and (cy = big or x < y)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def indexed(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple:
    """(docs, table, linked, members, index, counts): texts by id, all rows' sets, those that may link, classes with their groups, shared prefix shingles, the sketch."""
    docs = fresh(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    counts = sketch(docs, words)
    table = written(prefixes(docs, counts, words, percent))
    linked = table.filter("n > 0 and doc_id is not null")

    # equal sets are one class, named by its smallest id; classes with one prefix and size are one group
    classes = linked.groupBy("set_sig").agg(F.min("doc_id").alias("cls"), F.first("n").alias("n"), F.first("prefix_sig").alias("prefix_sig"), F.first("parity").alias("parity"))
    groups = classes.groupBy("prefix_sig").agg(F.min("cls").alias("gid"))
    members = written(classes.join(groups, "prefix_sig").select("cls", "gid", "n", "set_sig", "parity"))

    heads = members.filter("cls = gid").select(F.col("gid").alias("doc_id"))
    index = marked(linked, "doc_id", heads).select(F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("gid"), "n")
    shared = written(index.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("token"))
    # only rows whose shingle may be shared go to the join; those of documents that are no heads, which the bits let pass, end here
    index = written(marked(index, "token", shared))  # tested in the scan, before any exchange
    index = index.join(shared, "token", "left_semi").join(heads.withColumnRenamed("doc_id", "gid"), "gid", "left_semi")
    index = written(index.select("token", "gid", "n", "pos"))
    earliest = index.groupBy("token").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("rel"), F.col("gid").alias("center"), F.col("n").alias("m"))).alias("e"))
    index = written(index.join(earliest.select("token", "e.center", "e.m"), "token"))
    return docs, table, linked, members, index, counts


def classes_of(linked: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, cls) of the rows, (a, b) between the classes of ids that occur with several sets)."""
    of = linked.select("doc_id", "set_sig").join(members.select("set_sig", "cls"), "set_sig").select("doc_id", "cls")
    several = of.groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("_last")).filter("b <> _last").select("doc_id", "b")
    return of, of.join(several.hint("merge"), "doc_id").select(F.col("cls").alias("a"), "b").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents link when 100 |A and B| >= percent |A or B| over their sets of shingles; component_id is the
    smallest doc_id that links reach, the document's own included.  Null and empty texts have no shingle
    and no link.  Rows that share an id count as one document per distinct set and all get the id's
    smallest component.  Null ids take part in no link.  Other columns are ignored; an empty table gives
    an empty result.
    """
    docs, table, linked, members, index, counts = indexed(docs, words, percent, id_col, text_col)
    of, again = classes_of(linked, members)
    known, rows = star_links(docs, members, index, words, percent)
    split = known.join(known.groupBy("gid").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low <> _high").select("gid"), "gid")
    within = group_members(docs, written(split), counts, words, percent)
    pairs = written(may_reach(open_pairs(linked, known, rows, percent).unionByName(within), members, percent))
    texts = written(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    more = verified(pairs, texts, words, percent)
    last = connected_components(stars(known).unionByName(more).unionByName(again)).withColumnRenamed("id", "cls")
    found = of.join(last.hint("merge"), "cls", "left").select("doc_id", F.coalesce("component", "cls").alias("component_id"))
    smallest = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return table.select("doc_id", F.col("n").alias("n_shingles")).join(smallest, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def near_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, membership) of all links, those inside a component included.

    ``links`` has each linked pair of classes once, as a < b; a class is all documents of one set and is
    named by its smallest id.  ``membership`` has one row per input row: doc_id, n_shingles, cls (null without
    a shingle or id) and n_links, the number of other documents that the row's links with.  Ids must be
    distinct: ValueError otherwise.  The work grows with the number of candidate pairs.
    """
    docs, table, linked, members, index, counts = indexed(docs, words, percent, id_col, text_col)
    if linked.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        raise ValueError("ids occur more than once")
    inside = members.select("gid", "cls")
    groups = group_pairs(index, percent)
    across = groups.join(inside.withColumnsRenamed({"gid": "ga", "cls": "x"}), "ga").join(inside.withColumnsRenamed({"gid": "gb", "cls": "y"}), "gb")
    within = group_members(docs, written(inside.withColumn("comp", F.col("cls"))), counts, words, percent)
    pairs = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within)
    pairs = written(may_reach(pairs, members, percent))
    texts = written(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    links = written(verified(pairs, texts, words, percent))
    of = linked.join(members.select("set_sig", "cls"), "set_sig").select("doc_id", "cls")
    sizes = of.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    partners = both.join(sizes.withColumnsRenamed({"cls": "other", "size": "_n"}), "other").groupBy("cls").agg(F.sum("_n").alias("_n"))
    counted = sizes.join(partners, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("_n", F.lit(0))).alias("n_links"))
    membership = table.select("doc_id", F.col("n").alias("n_shingles")).join(of.join(counted, "cls"), "doc_id", "left")
    return links, membership.select("doc_id", "n_shingles", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def group_pairs(index: DataFrame, percent: int, part: int = HOT_PART) -> DataFrame:
    """(ga, gb), ga < gb: groups that may link by size, first shared place and prefix shingles shared; a hot shingle's rows meet in parts."""
    at = index.select("token", "gid", "n", "pos")
    parts = index.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    at = at.join(parts, "token")
    left = at.withColumn("_salt", F.pmod(F.xxhash64("gid"), F.col("_parts")).cast("int")).drop("_parts").withColumnsRenamed({"gid": "ga", "n": "na", "pos": "pa"})
    right = at.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").withColumnsRenamed({"gid": "gb", "n": "nb", "pos": "pb"})
    met = left.join(right, ["token", "_salt"]).filter(F.col("ga") < F.col("gb")).filter(size_fits("na", "nb", percent))
    need = needed(F.col("na"), F.col("nb"), percent)
    early = (F.col("pa") + need <= F.col("na")) & (F.col("pb") + need <= F.col("nb"))
    met = met.groupBy("ga", "gb", "na", "nb").agg(F.count(F.lit(1)).alias("_shared"), F.bool_or(early).alias("_early"))
    return met.filter(F.col("_early") & (F.col("_shared") >= least_shared("na", "nb", percent))).select("ga", "gb")


def stars(known: DataFrame) -> DataFrame:
    """(a, b): each class of a component to its smallest one, which is all that further links need of it."""
    return known.filter("cls <> comp").select(F.col("cls").alias("a"), F.col("comp").alias("b"))


def components_of(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cls, gid, n, comp) of every class under the links found so far."""
    found = connected_components(edges).withColumnsRenamed({"id": "cls", "component": "comp"})
    return members.select("cls", "gid", "n").join(found, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def star_links(docs: DataFrame, members: DataFrame, index: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(known, rows): the components that verified links of classes to one other a round make, and what they leave open.

    In the first round a class goes to its group's head, and a head to the center that most of its prefix
    points to.  In later ones a group of an open shingle goes to the earliest group of another component.
    """
    inside = members.filter("cls <> gid").select(F.col("cls").alias("a"), F.col("gid").alias("b"))
    known, tried, n_index = None, None, index.count()
    for n in range(STAR_ROUNDS):
        asked = index.filter("gid <> center").select("gid", "n", "center", "m") if n == 0 else other_centers(rows)
        votes = asked.filter(size_fits("n", "m", percent)).groupBy("gid", "n", "center", "m").agg(F.count(F.lit(1)).alias("votes"))
        votes = votes.filter(2 * F.col("votes") >= least_shared("n", "m", percent))
        votes = votes if tried is None else votes.join(tried, ["gid", "center"], "left_anti")
        best = written(votes.groupBy("gid").agg(F.max_by("center", F.struct(F.col("votes"), -F.col("center"))).alias("center")))
        pairs = best.select(F.col("gid").alias("a"), F.col("center").alias("b"))
        pairs = written(pairs.unionByName(inside)) if n == 0 else pairs
        texts = written(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        found = written(verified(pairs, texts, words, percent))
        tried = best if tried is None else tried.unionByName(best)
        known = written(components_of(members, found if known is None else stars(known).unionByName(found)))
        rows = open_rows(index, known, percent)
        left = rows.groupBy("token").agg(F.count(F.lit(1)).alias("all"), F.first("largest").alias("largest")).agg(F.sum((F.col("all") - F.col("largest")) * F.col("all"))).first()[0]
        if (left or 0) <= n_index or not found.limit(1).count():
            break
    return known, rows


def open_rows(index: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(token, gid, n, pos, comp, big, largest): shingles of several components, each with its largest one and that one's rows.

    The first shared shingle lies so early in both sets that all needed ones can follow; partners have
    t n shingles at least.  Later places are left out.
    """
    at = index.select("token", "gid", "n", "pos").join(known.select("gid", "comp").distinct(), "gid")
    sides = at.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
    sides = sides.groupBy("token").agg(F.max(F.struct("rows", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.min("least").alias("least")).filter("comps > 1")
    smallest = F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100))
    at = at.join(sides.select("token", "least", F.col("top.comp").alias("big")), "token").filter(F.col("pos") <= F.col("n") - needed(F.col("n"), smallest, percent))
    at = at.select("token", "gid", "n", "pos", "comp", "big")
    inside = at.filter("comp = big").groupBy("token").agg(F.count(F.lit(1)).alias("largest"))
    return written(at.join(inside, "token", "left").na.fill(0, ["largest"]))


def other_centers(rows: DataFrame) -> DataFrame:
    """(gid, n, center, m): for each row of an open shingle the earliest group of another component."""
    earliest = F.min(F.struct((F.col("pos") / F.col("n")).alias("rel"), F.col("gid").alias("center"), F.col("n").alias("m"), "comp"))
    per = written(rows.groupBy("token", "comp").agg(earliest.alias("e")))
    one = per.groupBy("token").agg(F.min("e").alias("one"))
    two = one.join(per.filter("e is not null"), "token").filter("comp <> one.comp").groupBy("token").agg(F.first("one").alias("one"), F.min("e").alias("two"))
    other = F.when(F.col("comp") != F.col("one.comp"), F.col("one")).otherwise(F.col("two"))
    return rows.join(two, "token").withColumn("o", other).select("gid", "n", "o.center", "o.m")


def open_pairs(linked: DataFrame, known: DataFrame, rows: DataFrame, percent: int, part: int = HOT_PART) -> DataFrame:
    """All pairs (a, b) of classes of different groups and components that may still link by shared prefixes.

    A shingle's rows outside its largest component meet all its rows of other components; those of a hot
    shingle in parts.  Groups met are filtered by the prefix shingles that they share and then expanded.
    """
    parts = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    at = rows.drop("largest").join(parts, "token")
    left = at.filter("comp <> big").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    left = left.select("token", "_salt", *(F.col(c).alias(v) for c, v in (("gid", "ga"), ("n", "na"), ("pos", "pa"), ("comp", "ca"))))
    right = at.withColumn("_salt", F.pmod(F.xxhash64("gid"), F.col("_parts")).cast("int"))
    right = right.select("token", "_salt", "big", *(F.col(c).alias(v) for c, v in (("gid", "gb"), ("n", "nb"), ("pos", "pb"), ("comp", "cb"))))
    need = needed(F.col("na"), F.col("nb"), percent)
    early = (F.col("pa") + need <= F.col("na")) & (F.col("pb") + need <= F.col("nb"))
    once = (F.col("cb") == F.col("big")) | (F.col("ga") < F.col("gb"))
    on = [left[c] == right[c] for c in ("token", "_salt")] + [F.col("ca") != F.col("cb"), F.col("ga") != F.col("gb"), once, early, size_fits("na", "nb", percent)]
    of = lambda x, y: F.struct(*(F.col(f"{c}{v}").alias(f"{c}{w}") for v, w in ((x, "a"), (y, "b")) for c in "gnc"))
    both = left.hint("merge").join(right, on).select(F.when(F.col("ga") < F.col("gb"), of("a", "b")).otherwise(of("b", "a")).alias("m"))
    met = written(both.select("m.*").distinct())
    heads = met.select(F.explode(F.array("ga", "gb")).alias("doc_id")).distinct()
    prefix = written(marked(linked.select("doc_id", "prefix"), "doc_id", heads))
    side = lambda g, p: prefix.select(F.col("doc_id").alias(g), F.col("prefix").alias(p))
    groups = met.select("ga", "na", "gb", "nb").distinct().hint("merge").join(side("ga", "_x"), "ga").hint("merge").join(side("gb", "_y"), "gb")
    groups = groups.filter(F.size(F.array_intersect("_x", "_y")) >= least_shared("na", "nb", percent)).select("ga", "gb").distinct()
    met = met.join(groups, ["ga", "gb"]).select("ga", "ca", "gb", "cb")
    side = lambda g, c, x: known.select(F.col("gid").alias(g), F.col("comp").alias(c), F.col("cls").alias(x))
    pairs = met.join(side("ga", "ca", "a"), ["ga", "ca"]).join(side("gb", "cb", "b"), ["gb", "cb"])
    return pairs.select("a", "b").distinct()


def keep_one_near_copy(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of its component; null ids stay.

    Only rows whose id may be among those that go are shuffled.
    """
    found = near_duplicates(docs, words, percent, id_col, text_col)
    gone = written(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__bt_gone")).distinct())
    bits = bits_for(gone.count())
    marks = written(bitmaps(gone.select(bit_of(F.col("__bt_gone"), bits, 0).alias("slot")), "slot"))
    tested = keep_marked(docs, bit_of(F.col(f"`{id_col}`").cast("long"), bits, 0), marks, into="__bt_maybe")
    maybe = tested.filter("__bt_maybe").drop("__bt_maybe")
    maybe = maybe.join(gone, maybe[id_col].cast("long") == gone["__bt_gone"], "left_anti")
    return tested.filter("not __bt_maybe").drop("__bt_maybe").unionByName(maybe)
