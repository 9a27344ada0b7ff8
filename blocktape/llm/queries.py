"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocktape.llm.common import table, written
from blocktape.llm.compression_classifier import fit_quality, score_quality
from blocktape.llm.decontaminate import find_contamination
from blocktape.llm.exact_dedup import exact_dedup
from blocktape.llm.language_id import fit_languages, predict_languages
from blocktape.llm.merkle import FIELDS, fold, leaf_of, merkle_manifest, siblings_digest
from blocktape.llm.ngram_join import near_duplicates
from blocktape.llm.oracle import OP11_SQL, OP12_SQL, OP13_SQL
from blocktape.llm.packing import Limits, pack_documents, pack_examples
from blocktape.llm.secrets import scan_secrets
from blocktape.llm.sharding import shard_records
from blocktape.llm.spelling import count_words, spelling_groups, words_of
from blocktape.llm.substring_dedup import substring_dedup
from blocktape.llm.token_counts import count_tokens, with_token_counts
from blocktape.llm.url_filter import filter_urls

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 16


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """The pages with the time of fetching that the query derives from page_id: within the year 2024."""
    second = F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7919, F.lit(366 * 86_400))
    return pages.select("page_id", "url", F.timestamp_seconds(second).alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list derived from the pages: hosts, domains and prefixes that appear, listed and unlisted on dates that their hash decides."""
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    section = F.concat(host, F.regexp_extract("url", r"://[^/]+(/[a-z]+/)", 1))
    seen = pages.select(
        F.explode(
            F.array(
                F.struct(F.lit("host").alias("kind"), host.alias("value")),
                F.struct(F.lit("domain").alias("kind"), F.regexp_replace(host, r"^[a-z]+\.(?=[a-z]+\.example)", "").alias("value")),
                F.struct(F.lit("prefix").alias("kind"), section.alias("value")),
                F.struct(F.lit("prefix").alias("kind"), F.regexp_extract("url", r"://([^/]+/[a-z]{2})", 1).alias("value")),  # ends inside a segment
            )
        ).alias("e")
    ).select("e.*").filter("value <> ''").distinct()
    part = lambda at: F.conv(F.substring(F.md5("value"), at, 4), 16, 10).cast("long")
    seen = seen.filter(part(1) % 3 == 0)
    day = lambda d: F.timestamp_seconds(F.lit(1_704_067_200) + d * 86_400)
    first = part(5) % 200
    dates = F.array(
        F.struct(F.when(part(13) % 4 == 0, "allow").otherwise("block").alias("action"), day(first).alias("listed_at")),
        F.struct(F.lit("remove").alias("action"), day(first + 40 + part(9) % 60).alias("listed_at")),
        F.struct(F.lit("block").alias("action"), day(first + 130 + part(9) % 60).alias("listed_at")),
    )
    return seen.select("kind", "value", F.explode(dates).alias("d")).select("kind", "value", "d.action", "d.listed_at")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(captures(pages), dated_entries(pages)).withColumn("fetched_at", F.unix_timestamp("fetched_at"))


OP2_SQL = r"""
WITH c AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % (366 * 86400) AS fetched_at, regexp_extract(url, '://([^/]+)', 1) AS host,
         regexp_extract(url, '://[^/]+([^?#]*)', 1) AS path
  FROM pages),
seen AS (
  SELECT 'host' AS kind, host AS value FROM c
  UNION SELECT 'domain', regexp_extract(host, '([a-z]+\.example\..*)$', 1) FROM c
  UNION SELECT 'prefix', host || regexp_extract(url, '://[^/]+(/[a-z]+/)', 1) FROM c
  UNION SELECT 'prefix', regexp_extract(url, '://([^/]+/[a-z]{2})', 1) FROM c),
h AS (SELECT kind, value, md5(value) AS m FROM seen WHERE value <> ''),
n AS (
  SELECT kind, value, ('0x' || substr(m, 1, 4))::INT AS p1, ('0x' || substr(m, 5, 4))::INT % 200 AS f,
         ('0x' || substr(m, 9, 4))::INT % 60 AS g, ('0x' || substr(m, 13, 4))::INT % 4 AS k
  FROM h),
l AS (SELECT * FROM n WHERE p1 % 3 = 0),
v AS (
  SELECT kind, value, CASE WHEN k = 0 THEN 'allow' ELSE 'block' END AS action, f AS d0, f + 40 + g AS d1 FROM l
  UNION ALL SELECT kind, value, 'block', f + 130 + g, NULL FROM l),
hit AS (
  SELECT c.page_id, v.kind, v.value, v.action,
         row_number() OVER (PARTITION BY c.page_id ORDER BY CASE v.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(v.value) DESC) AS r
  FROM c JOIN v ON c.fetched_at >= 1704067200 + v.d0 * 86400 AND (v.d1 IS NULL OR c.fetched_at < 1704067200 + v.d1 * 86400)
    AND ((v.kind = 'host' AND c.host = v.value)
      OR (v.kind = 'domain' AND (c.host = v.value OR ends_with(c.host, '.' || v.value)))
      OR (v.kind = 'prefix' AND starts_with(c.host || c.path, v.value))))
SELECT c.page_id, c.url, c.fetched_at, c.host, hit.kind AS rule_kind, hit.value AS rule_value, hit.action,
       coalesce(hit.action, 'allow') = 'allow' AS allowed
FROM c LEFT JOIN hit ON c.page_id = hit.page_id AND hit.r = 1
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under all three limits of operator 3; only what assistants say bears loss.

    Conversations are summed up before they are packed; none is cut, so one beyond a limit has a sequence of its own.
    """
    turns = with_token_counts(table(spark, sf_dir, "conversations").select("conv_id", "role", "text"), TOKENIZER, "n")
    loss = F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("loss_tokens")
    sums = turns.groupBy("conv_id").agg(F.sum("n").alias("tokens"), loss)
    return pack_examples(sums, Limits(tokens=2048, segments=16, loss=1024), "conv_id", "tokens", "loss_tokens")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def with_planted_typos(runs: DataFrame) -> DataFrame:
    """Words (doc_id, word) with one code point deleted where the checksum of id and word says so."""
    code = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = F.pmod("code", F.char_length("word").cast("long")).cast("int")
    cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.char_length("word")))
    return runs.withColumn("code", code).select(F.when(F.col("code") % 31 == 0, cut).otherwise(F.col("word")).alias("word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(written(count_words(with_planted_typos(words_of(table(spark, sf_dir, "documents"))))))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what each proof gives for a row of which some are tampered with: one more character is claimed."""
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    claimed = leaf_of([F.when(changed, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = merkle_manifest(docs, carry={"claimed": F.when(changed, claimed)})
    found = rows.withColumn("folded_root", fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(list_slice(words, i, i + 4)) AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 2))) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
bi AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION SELECT bi.b, reach.seen FROM reach JOIN bi ON bi.a = reach.id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.seen) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.id = w.doc_id GROUP BY ALL
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ngram_join, op2_url_filter, op3_packing, op4_quality, op5_language, op6_token_counts, op7_exact_dedup, op8_decontamination, op9_secrets, op10_sharding, op11_spelling, op12_merkle, op13_substring_dedup]
    return {f.__name__: f for f in own} | {"conversation_packing": conversation_packing, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_url_filter": OP2_SQL, "op7_exact_dedup": OP7_SQL, "op11_spelling": OP11_SQL, "op12_merkle": OP12_SQL, "op13_substring_dedup": OP13_SQL}
