"""Operator 5: URL filters by expressions, short hash prefixes and full digests.

Each URL expands into expressions, one for every suffix of its host at label borders and every
prefix of its path of a length that some rule has. Expressions meet rules in an equi-join on a short
prefix of their digest; the full digest confirms a hit, and the longest rule wins. The rules' side is
broadcast only if a sum shows that it has at most `most_broadcast` bytes; a larger one is joined by
shuffle, with salted expressions, as a few (`com/`) occur in a third of all URLs. Hits shrink to one
row for each distinct key before the one shuffle that follows, and repeated rows come out as often
as they went in.

A null URL or one without `://` has an empty host and path, no rule, and the default verdict. If two
rules of equal length fit, that of the longer host wins, then a block. Rows with null ids are kept. Very long URLs
expand only into as many expressions as the rules' longest host and distinct path lengths allow; an empty table gives
an empty result; columns other than the id and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest's prefix.
PREFIX = 8
SALTS = 64


def url_host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rules: (`host/path`, `allow` or `block`)."""
    return spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", v) for r, v in rules], "rule_host string, rule_path string, rule_verdict string")


def judge(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow", most_broadcast: int = 32 << 20) -> DataFrame:
    """Each row's id, host, path, rule (null: none fits) and verdict. rules: rule_host, rule_path, rule_verdict."""
    own = rules.filter(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull()).groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    row_bytes = F.octet_length("rule_host") + F.octet_length("rule_path") + F.octet_length("rule_verdict") + 256  # digests and row headers
    size = own.agg(F.coalesce(F.sum(row_bytes), F.lit(0)), F.max(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path"))).first()
    most_labels, lengths = size[1] or 1, sorted(size[2])  # bounded by the longest host and path that a rule has
    keyed = own.select(F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"), "rule_host", "rule_path", "rule_verdict").withColumn("short", F.substring("rule_digest", 1, PREFIX))
    rows = urls.select(F.col(id_column), F.col(url_column).alias("url")).select(F.col(id_column), url_host(F.coalesce("url", F.lit(""))).alias("host"), url_path(F.coalesce("url", F.lit(""))).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    )
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\n", h, p))))
    # The first entry, which no rule has, keeps the row and counts it.
    expressions = rows.select(id_column, "host", "path", F.posexplode(F.concat(F.array(F.lit("")), pairs)).alias("n", "expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    if size[0] <= most_broadcast:
        met = expressions.join(F.broadcast(keyed), "short", "left")
    else:
        salted = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path", id_column), F.lit(SALTS)))
        met = salted.join(keyed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["short", "salt"], "left")
    rule = F.concat("rule_host", "rule_path")
    hit = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length(rule).alias("size"), F.length("rule_host").alias("host_size"), "rule_verdict", rule.alias("rule")))
    # Expressions of one row are in one task, so partial aggregation leaves one row for each key before the shuffle.
    best = met.groupBy(id_column, "host", "path").agg(F.max(hit).alias("best"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("rows"))
    out = best.select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("copy"))
    return out.drop("copy")
