"""Every stage of the pipeline against a brute-force version on its own input."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from blocktape.llm import compression_classifier as quality
from blocktape.llm import decontaminate as leaks
from blocktape.llm import ngram_join as near


def test_stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = [r.asDict() for r in out.collect()]
        have = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept = {r["doc_id"] for r in rows}
        if name == "exact_dedup":
            groups = {}
            for i, t in have.items():
                groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t), []).append(i)
            assert kept == {max(g) for g in groups.values()}
        if name == "near_duplicates":
            sets = {i: set(near.shingle_set(t).tolist()) for i, t in have.items()}
            label = {i: i for i in sets}
            for _ in range(4):
                for a in sets:
                    for b in sets:
                        if a < b and 100 * len(sets[a] & sets[b]) >= 80 * max(1, len(sets[a] | sets[b])):
                            label[a] = label[b] = min(label[a], label[b])
            assert kept == set(label.values())
        if name == "quality":
            model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            score = model.scorer()
            assert kept == {i for i, t in have.items() if score(t or "") >= 0.3}
        if name == "decontamination":
            items = [leaks.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            texts = {i: leaks.normal(t) for i, t in have.items()}
            # the rows that go are those that hold an item within a twentieth of its bytes, by the whole table of distances
            assert kept == {i for i in have if not any(within(x, texts[i]) for x in items if x)}
        seen.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    library, covered = Tokenizer.from_file(corpus_pipeline.TOKENIZER), {}
    for p in corpus_pipeline.STAGES[4][1](spark, docs, sf).collect():
        covered.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32))
    assert set(covered) == kept and seen[0] > 100
    for r in rows:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc in sorted(covered[r["doc_id"]]):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)


def within(item: bytes, text: bytes) -> bool:
    """Of k + 1 pieces of an item one is in any text within k edits, so only texts with a piece are compared."""
    k = len(item) // 20 if len(item) >= 12 else 0
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return any(item[a:b] in text for a, b in zip(cuts, cuts[1:])) and best_edits(item, text) <= k


def best_edits(item: bytes, text: bytes) -> int:
    """Fewest edits between the whole item and any part of the text, over the whole table of places."""
    letters, row = np.frombuffer(text, np.uint8), np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(item):
        now = np.concatenate([[i + 1], np.minimum(row[:-1] + (letters != c), row[1:] + 1)])
        row = np.minimum.accumulate(now - steps) + steps
    return int(row.min())
