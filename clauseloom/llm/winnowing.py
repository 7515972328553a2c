"""Operator 11: benchmark decontamination by winnowing, in DataFrame functions only.

A text's words get hashes, runs of `gram` words get hashes of those, and of each `span` consecutive words the
smallest such hash is kept: the fingerprint of that window. Equal windows have equal fingerprints, so every
shared run of `span` words or more is met (`gram` + window of grams - 1 = span). Fingerprints of documents meet
those of the benchmark; a hit is then extended to its whole window, compared word by word, and hit windows that
overlap or touch grow together into spans. An item of fewer than `span` words is one window of its own length,
with fingerprints of that length.

Documents are never shuffled: their fingerprints meet the benchmark's inside the scan, as the benchmark is sent
to the executors in parts of at most PART_BYTES, one pass for each part (one part up to some 200,000 windows).
Only hits are shuffled, by document. A window that many documents hold is looked up where it stands, so it makes
no hot key; a window of many items lists them in rows of bounded length.

Null and empty texts have no words and no hits. Repeated rows are judged alike, each for itself. Items with a null
id mark words but are not listed. An empty benchmark hits nothing; columns that are not named are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import stored
from clauseloom.llm.substring import row_ids

#: What is between words: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of windows and items that are broadcast at once, before Spark's own overhead.
PART_BYTES = 16 << 20
#: About so many items in one row of a window.
ITEMS_PER_ROW = 4096


def words_of(text: Column) -> Column:
    """A text's words, in the case they stand in. Null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def fingerprint(hashes: Column, start: Column, span: int, gram: int) -> Column:
    """The least hash of the runs of `gram` words in the window of `span` words at `start` (from 0)."""
    k = min(gram, span)
    runs = [F.xxhash64(*(F.get(hashes, start + (i + j)) for j in range(k))) for i in range(span - k + 1)]
    return F.least(*runs) if len(runs) > 1 else runs[0]


def window_text(span: int) -> Column:
    """The window at `start` (from 0) of `words`, in lower case. Never null, so no join filters on it before fingerprints have met."""
    return F.coalesce(lowered(F.array_join(F.slice("words", F.col("start") + 1, F.lit(span)), " ")), F.lit(""))


def windows(texts: DataFrame, span: int, gram: int, keep: list[str]) -> DataFrame:
    """keep, words, start and fingerprint (print) of each window of texts (keep, words).

    Words are hashed once by a text; from there on all is generated code, a row for each window. The outer form of the
    generator: the plain one would have the words computed again in a filter before it.
    """
    own = texts.select(*keep, "words", F.transform("words", lambda x: F.xxhash64(lowered(x))).alias("hashes"))
    each = own.select(*keep, "words", "hashes", F.posexplode_outer("hashes").alias("start", "hash"))
    return each.filter(F.col("start") <= F.size("hashes") - span).select(*keep, "words", "start", fingerprint(F.col("hashes"), F.col("start"), span, gram).alias("print"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 5, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row for each row of docs: the id, n_words, spans (array of start and end in words, end exclusive) and items (sorted ids as strings)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).withColumn("span", F.least(F.size("words"), F.lit(span))).filter("span > 0")
    lengths = sorted(r.span for r in items.select("span").distinct().collect())  # at most `span` of them
    texts = docs.select(*row_ids(id_column, text_column), words_of(F.col(text_column)).alias("words"))
    rows_of_items = max(1, math.ceil(items.count() / ITEMS_PER_ROW))
    found = []
    for n in lengths:
        of_items = windows(items.filter(F.col("span") == n), n, gram, ["item"]).select("print", window_text(n).alias("window"), "item")
        salt = F.pmod(F.xxhash64("item"), F.lit(rows_of_items))
        known = stored(of_items.groupBy("print", "window", salt.alias("salt")).agg(F.collect_set("item").alias("items")).drop("salt"), "benchmark")
        size = known.agg(F.sum(F.octet_length("window") + 16 + 16 * F.size("items"))).first()[0]
        parts = max(1, math.ceil(size / part_bytes))
        for part in range(parts):
            own = known.filter(F.pmod("print", F.lit(parts)) == part)
            prints = F.broadcast(own.select("print").distinct())
            meets = windows(texts, n, gram, ["rid", "rid2"]).join(prints, "print", "left_semi").select("rid", "rid2", "start", window_text(n).alias("window"))
            whole = meets.join(F.broadcast(own.select("window", "items")), "window")
            found.append(whole.select("rid", "rid2", "start", (F.col("start") + n).alias("end"), "items"))
    empty = spark.createDataFrame([], "rid bigint, rid2 bigint, start int, end int, items array<string>")
    hits = stored(reduce(DataFrame.unionByName, found, empty), "hits")

    key = ["rid", "rid2"]
    in_order = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select(*key, "start", "end").withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    islands = opened.withColumn("island", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = islands.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    listed = hits.select(*key, F.explode("items").alias("item")).distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    own = docs.select(id_column, *row_ids(id_column, text_column), F.size(words_of(F.col(text_column))).cast("bigint").alias("n_words"))
    out = own.join(spans.join(listed, key, "left"), key, "left")
    return out.select(id_column, "n_words", *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("spans", "array<struct<start:int,end:int>>"), ("items", "array<string>"))))
