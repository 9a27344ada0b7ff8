"""Operators 11 to 13 and the pairs of operator 1, against brute force on small tables with nulls, ties, repeats, clashing columns and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blocktape.llm import decontaminate, exact_dedup, language_id, merkle, ngram_join, queries, spelling, substring_dedup

rng = random.Random(11)
BASE = [f"word{i}" for i in range(200)]


# --- spelling ------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups(vocab, ratio=10):
    found = {w: [o for o in vocab if near(w, o)] for w in vocab}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-vocab[o], o), default=None)
        form[w] = best if best is not None and vocab[best] >= ratio * vocab[w] else None
    out = {}
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, vocab[w], len(found[w]), vocab[form[w]] if form[w] else None)
    return out


def as_groups(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_groups(spark):
    vocab = {"product" + a + b + c: rng.choice([2, 3, 40, 500]) for a in "abcd" for b in "abcdef" for c in "abcd"}  # one long common part
    vocab |= {"mississippi": 400, "missisippi": 40, "missssippi": 40, "misisippi": 3, "aaaaaaa": 900, "aaaaaaaa": 90, "aaaaaaaaa": 9, "áaaaaaa": 5, "x" * 3000: 30, "x" * 3001: 2, "a": 100, "ab": 2, "b": 3}
    rows = [(w, n, "clash") for w, n in vocab.items()] + [(None, 4, "clash"), ("mississippi", 0, "clash")]
    df = spark.createDataFrame(rows, "word string, n long, form string")
    assert as_groups(spelling.spelling_groups(df)) == groups(vocab)
    assert as_groups(spelling.spelling_groups(df, work=1)) == groups(vocab)
    few = spelling.near_words(df.filter("word like 'product%'"), work=1)
    assert few.count() == few.distinct().count() == sum(near(a, b) for a in vocab for b in vocab if a.startswith("product") and b.startswith("product")) // 2
    assert spelling.spelling_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(df, ratio=1)


def test_words_with_planted_typos(spark):
    docs = [(i, " ".join(rng.choice(["Straßenbahn", "ÉCOLEécole", "ordinary", "Ordinary,", "x-factory", "short", "señales"]) for _ in range(60)) + " \U0001f600longword") for i in range(40)]
    docs += [(None, "ordinary ordinary"), (90, None), (91, ""), (91, "ordinary")]
    want = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            want[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    got = spelling.count_words(queries.with_planted_typos(spelling.words_of(df)))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


# --- manifest ------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def text_of(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def built(nodes):
    """(root, path of each node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            paths[k].append("-" if j >= len(nodes) else ("l" if j < i else "r") + nodes[j])
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return (nodes or [None])[0], paths


def manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, digest(*map(text_of, r))))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: built([leaf for *_, leaf in sorted(by[g])]) for g in langs}
    root, tops = built([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        out += [(i if known else None, leaf, trees[g][0], root, path + top) for (known, i, leaf), path in zip(sorted(by[g]), trees[g][1])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [10, 2])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i * 37 % 1009 - 300, f"s{i % 3}", "de", i, f"text é {i}") for i in range(90)]
    rows += [(7, "s", None, None, None), (None, None, None, 3, ""), (None, None, None, 3, ""), (5, "s", "", 1, "x" * 100_000)]
    rows += [(-(1 << 63), "s", "en", 1, "low"), ((1 << 63) - 1, "s", "en", 1, "high"), (64, "s", "en", 2, "a"), (65, "s", "en", 2, "b"), (127, "s", "en", 2, "c")]
    rows += [(66, "same", "en", 9, "again")] * 5 + [(66, "other", "en", 9, str(k)) for k in range(3)] + [(3, "s", "fr", 1, "alone")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, path string").repartition(3)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.path) for r in merkle.merkle_manifest(df).collect()]
    assert sorted(got, key=repr) == manifest(rows)
    if levels == 10:
        assert merkle.merkle_manifest(df.limit(0)).count() == 0
        with pytest.raises(ValueError):
            merkle.merkle_manifest(df.drop("source"))


def test_directory_of_far_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART", 2)
    ids = sorted({rng.randrange(-(1 << 40), 1 << 40) >> rng.randrange(40) for _ in range(150)})
    df = spark.createDataFrame([("g", i) for i in ids], "g string, k long").repartition(4)
    placed, words = merkle.ranked(df, ["k"])
    assert [r.k for r in placed.orderBy("pos").collect()] == ids and [r.pos for r in placed.orderBy("pos").collect()] == list(range(len(ids)))
    assert words.agg({"n": "sum"}).first()[0] == len(ids)


# --- repeated passages ---------------------------------------------------------------------------------------


def cut(rows, words):
    seen = defaultdict(lambda: None)
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - words + 1):
            key = tuple(w[k : k + words])
            if i is not None and (seen[key] is None or i < seen[key]):
                seen[key] = i
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - words + 1) if i is not None and seen[tuple(w[k : k + words])] < i for j in range(words)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def passages():
    fill = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared, other = fill(60), fill(50)
    rows = [(1, fill(30) + shared + fill(30)), (2, shared[:50] + fill(20) + other), (3, fill(10) + shared[5:54] + fill(5)), (4, other + shared + other), (5, shared), (6, shared), (6, shared + ["end"])]
    rows += [(7, ["a"] * 3000), (8, ["a"] * 70 + fill(3) + ["a"] * 49), (9, ["a", "b"] * 60), (10, ["b"] + ["a", "b"] * 40), (11, fill(49)), (12, BASE), (13, BASE[:49]), (14, BASE[1:51]), (14, BASE[1:51])]
    rows += [(15, BASE[100:150] + BASE[:50]), (16, fill(4000) + shared + fill(4000) + shared[:51]), (17, [x.upper() for x in shared]), (18, [f"{x} " for x in shared])]
    out = [(i, rng.choice([" ", "  ", "\n", "\t \x0b"]).join(w)) for i, w in rows]
    return [*out, (None, " ".join(shared)), (None, " ".join(shared)), (19, None), (20, ""), (21, " \n ")]


@pytest.mark.parametrize("words", [50, 7])
def test_repeated_passages(spark, words):
    rows = passages()
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_words int").repartition(4)
    found = substring_dedup.substring_dedup(df, words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr) == cut(rows, words)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)
    if words == 50:
        assert substring_dedup.substring_dedup(df.limit(0)).count() == 0
        with pytest.raises(ValueError):
            substring_dedup.substring_dedup(df, 3)
        with pytest.raises(ValueError):
            substring_dedup.substring_dedup(df.drop("text"))


def test_every_window_has_a_chosen_place():
    for words in (4, 5, 6, 7, 13, 50):
        quarter = -(-words // 4)
        h = np.random.default_rng(words).integers(0, 40, 3000).astype(np.uint64)
        at = set(substring_dedup.chosen(h, words - quarter + 1).tolist())
        assert all(any(k in at for k in range(i, i + words - quarter + 1)) for i in range(len(h) - words + quarter))


# --- pairs of operator 1 -------------------------------------------------------------------------------------

PHRASES = [[f"p{k}x{j}" for j in range(12)] for k in range(30)]
GAP = ["gap"] * 5


def phrased(n, header, seed):
    g = random.Random(seed)
    out = []
    for i in range(n):
        own = [w for k in sorted(g.sample(range(30), 15)) for w in PHRASES[k] + GAP]
        out.append((i, " ".join(([f"h{j}" for j in range(70)] if header else [f"u{i}x{j}" for j in range(8)]) + own)))
    common = [(n + k, " ".join(w for p in random.Random(k).sample(PHRASES, 30) for w in p + GAP)) for k in range(2 * n if header else 0)]
    return out + common  # with the common ones the header is the rarest of a text


@pytest.mark.parametrize("header", [True, False])
def test_pairs_to_verify_stay_near_linear(spark, monkeypatch, header):
    told = []
    real = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: told.append(pairs.count()) or real(pairs, *a))
    counts = []
    for n in (60, 120):
        told.clear()
        rows = phrased(n, header, n)
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        sets = {i: set(ngram_join.shingle_set(t).tolist()) for i, t in rows}
        label = {i: i for i in sets}
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        for _ in sets:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        assert got == label
        counts.append(sum(told))
    assert counts[1] <= 3 * counts[0] + 50 and counts[1] <= 6 * 120 * 3, counts


# --- short items of operator 8 -------------------------------------------------------------------------------


@pytest.mark.parametrize("rate", [0.05, 0.15])
def test_items_of_any_length_within_their_budget(spark, rate):
    g, letters = random.Random(8), "abcdefgh"
    items = [(m, "".join(g.choice(letters) for _ in range(m))) for m in (*range(8, 30), 40, 61)]
    made = []
    for m, item in items:
        for n in range(6):
            y = list(item)
            for _ in range(n % 3 + (n > 3)):
                p = g.randrange(len(y))
                y[p : p + g.randint(0, 1)] = g.choice(["z", "zz", "", "y"])
            made.append((m * 10 + n, "Before " + "".join(y) + " after"))
    want = set()
    for i, t in made:
        for k, x in items:
            row = [0] * (len(t) + 1)
            for c in x:
                now = [row[0] + 1]
                for j, d in enumerate(t.lower()):
                    now.append(min(row[j] + (c != d), row[j + 1] + 1, now[j] + 1))
                row = now
            if min(row) <= (int(rate * len(x)) if len(x) >= 12 else 0):
                want.add((i, k, min(row)))
    found = decontaminate.find_contamination(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rate)
    best = {}
    for r in found.collect():
        best[r.doc_id, r.item_id] = min(r.edits, best.get((r.doc_id, r.item_id), 99))
    assert {(*k, e) for k, e in best.items()} == want


# --- ranges of operator 7 ------------------------------------------------------------------------------------


def test_many_ranges_take_few_files_and_jobs(spark, monkeypatch):
    texts = [f"Text {rng.randrange(60_000)}" for _ in range(100_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    files, real = [], exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda x: files.append(len(real(x).inputFiles())) or real(x))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranges", "ranges")
    found = exact_dedup.exact_dedup(df, max_bits=1 << 15)  # 49 ranges
    jobs = len(tracker.getJobIdsForGroup("ranges"))
    spark.sparkContext.setJobGroup("rest", "rest")
    kept, sizes = {}, Counter(t.lower() for t in texts)
    for i, t in enumerate(texts):
        kept[t.lower()] = i
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found.select("doc_id", "keep_id", "group_size").collect()} == {(i, kept[t.lower()], sizes[t.lower()]) for i, t in enumerate(texts)}
    assert max(files) <= 4 and jobs <= 49 * 4 + 40, (files, jobs)


# --- operator 5 over its whole table -------------------------------------------------------------------------


def test_languages_of_the_whole_table_by_plain_filters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("n_chars", "score")
    model = language_id.fit_languages(docs)
    got = {r.doc_id: r for r in language_id.predict_languages(docs, model).collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        assert got[doc].held_out == (zlib.crc32(str(doc).encode()) % 4 == 2)
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        data = language_id.CLASSES[np.frombuffer(text.encode(), np.uint8)]
        rows = np.full((-(-len(data) // language_id.WINDOW), language_id.WINDOW), language_id.PAD, np.uint8)
        rows.reshape(-1)[: len(data)] = data
        pooled = []
        for w in language_id.WIDTHS:
            span = language_id.WINDOW - w + 1
            pooled.append(np.maximum(sum(model.filters[w][j][rows[:, j : j + span]] for j in range(w)).max(axis=1) + model.bias[w], 0))
        z = np.concatenate(pooled, axis=1) @ model.dense + model.dense_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        mean = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
        assert abs(got[doc].score - mean.max()) < 1e-3 and mean[model.languages.index(got[doc].lang_pred)] > mean.max() - 1e-3
