"""From raw documents to packed sequences: the stages of a training corpus.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blocktape.llm.common import table, written
from blocktape.llm.compression_classifier import fit_quality, keep_good
from blocktape.llm.decontaminate import drop_contaminated
from blocktape.llm.exact_dedup import keep_one_copy
from blocktape.llm.ngram_join import keep_one_near_copy
from blocktape.llm.packing import pack_documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_copy(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_near_copy(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, TOKENIZER)


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("near_duplicates", near_copies), ("decontamination", decontaminate), ("packing", pack)]

#: No SQL gives the first stage's scores or the last one's token ids; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs)
    return docs
