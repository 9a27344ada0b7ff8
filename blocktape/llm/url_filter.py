"""URL filter by a temporal list join (operator 2).

Dated list entries become validity intervals, and an as-of join evaluates every capture against the
entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktape.llm.common import fresh

SALT = 16  # parts of the captures of one key and stretch, so that a busy host is no single group
BUCKET_S = 30 * 86_400  # seconds of one stretch of time by which captures and intervals meet
RANK = {"domain": 1, "host": 1 << 10, "prefix": 1 << 20}  # a rule of a later kind outranks all before; longer ones outrank shorter


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and final dot; empty where there is none."""
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r"\.?(:\d*)?$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def open_lengths(entries: DataFrame) -> list[int]:
    """Lengths, each once, of what follows the last slash in prefix entries that do not end in one; the longest entry bounds them."""
    tail = F.length(F.substring_index("value", "/", -1))
    return sorted(r[0] for r in entries.filter("kind = 'prefix'").select(tail).distinct().collect() if r[0])


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (kind, value) that could match: the host, it and each parent domain of two labels or more, and prefixes of host and path.

    Prefixes end at each slash, and as many characters behind a slash (or the start) as ``lengths`` names.
    """
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    steps = F.split(F.concat(host, F.when(path == "", "/").otherwise(path)), "/")
    closed = F.transform(
        F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/"))
    )
    prefixes = closed
    if lengths:
        starts = F.arrays_zip(F.concat(F.array(F.lit("")), closed).alias("start"), steps.alias("step"))
        tails = F.array(*(F.lit(n) for n in lengths))
        opened = F.transform(
            starts, lambda s: F.transform(F.filter(tails, lambda n: n <= F.length(s["step"])), lambda n: F.concat(s["start"], F.substring(s["step"], F.lit(1), n)))
        )
        prefixes = F.concat(closed, F.flatten(opened))
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.array_distinct(F.concat(of("host", F.array(host)), of("domain", parents), of("prefix", prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, action, valid_from, valid_to) from dated entries (kind, value, action, listed_at).

    An entry holds from its date until the next entry of the same kind and value, whatever that says; the
    last has no end (null).  Of entries of one date, block outranks allow, and allow outranks remove.  A
    `remove` only ends what came before.  Entries with a null in any column say nothing.
    """
    dated = fresh(entries, "kind", "value", "action", "listed_at").na.drop()
    rank = F.when(F.col("action") == "block", 3).when(F.col("action") == "allow", 2).otherwise(1)
    one = dated.groupBy("kind", "value", F.col("listed_at").alias("valid_from")).agg(F.max_by("action", rank).alias("action"))
    following = F.lead("valid_from").over(Window.partitionBy("kind", "value").orderBy("valid_from"))
    return one.withColumn("valid_to", following).filter("action in ('block', 'allow')")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id, url, time, host, rule_kind, rule_value, action, allowed.

    The most specific active entry decides (prefix, then host, then domain; the longer value first); with
    none the capture is allowed and the rule is null.  A prefix matches wherever host and path (without
    query) start with it, also inside a segment; an empty path is '/'.  Equal captures are decided once.  A capture whose
    url or time is null, or whose url has no host, matches nothing and is allowed.  Entries of another
    kind or action than host, domain, prefix and block, allow, remove match nothing; values are compared as
    they are, so hosts must be listed in lower case.  Other columns are
    ignored; an empty list allows all, an empty table gives an empty result.
    """
    rows = fresh(captures, _id=id_col, _url=url_col, _at=at_col)
    rows = rows.select("_id", F.col("_url").cast("string"), F.col("_at").cast("timestamp"))
    seconds = lambda c: F.unix_micros(c) / 1_000_000
    bucket = lambda c: F.floor(seconds(c) / BUCKET_S).cast("long")
    asked = rows.select("_url", "_at").na.drop().distinct().withColumn("_host", host_of(F.col("_url"))).filter("_host <> ''")
    asked = asked.select("_url", "_at", F.explode(keys_of(F.col("_host"), path_of(F.col("_url")), open_lengths(entries))).alias("k"))
    asked = asked.select("_url", "_at", "k.kind", "k.value", bucket(F.col("_at")).alias("_bucket"), F.pmod(F.xxhash64("_url", "_at"), F.lit(SALT)).cast("int").alias("_part"))
    horizon = rows.agg(F.max("_at")).first()[0]
    held = intervals(entries).withColumn("_end", F.least(F.coalesce("valid_to", F.lit(horizon)), F.lit(horizon)))
    held = held.filter("valid_from <= _end").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(F.col("_end"))))).drop("_end")
    held = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    match = asked.join(held, ["kind", "value", "_bucket", "_part"]).filter("_at >= valid_from and (valid_to is null or _at < valid_to)")
    weight = F.length("value")
    for kind, least in RANK.items():
        weight = weight + F.when(F.col("kind") == kind, least).otherwise(0)
    winner = match.groupBy("_url", "_at").agg(F.max_by(F.struct("kind", "value", "action"), F.struct(weight, F.col("value"))).alias("w"))
    return rows.join(winner, ["_url", "_at"], "left").select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_at").alias(at_col), host_of(F.col("_url")).alias("host"),
        F.col("w.kind").alias("rule_kind"), F.col("w.value").alias("rule_value"), F.col("w.action").alias("action"),
        (F.coalesce(F.col("w.action"), F.lit("allow")) == "allow").alias("allowed"),
    )
