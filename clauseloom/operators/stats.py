"""Counts, comparisons and reports over runs, reviews and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_counts(reviews: DataFrame) -> DataFrame:
    """One row: chunks, and those that a reviewer flagged."""
    return reviews.agg(F.count("*").alias("chunks"), F.count_if("has_pii").alias("flagged"))


def new_share(by_page: DataFrame) -> DataFrame:
    """(doc_id, new_terms, repeated_terms, new_ratio): 0 where a document has no terms."""
    new, old = F.sum("new_terms"), F.sum("repeated_terms")
    return by_page.groupBy("doc_id").agg(new.alias("new_terms"), old.alias("repeated_terms"), F.when(new + old > 0, new / (new + old)).otherwise(0.0).alias("new_ratio"))


def approaches(routed: DataFrame, review_minutes: float, pattern_minutes: float) -> DataFrame:
    """One row: minutes with all pages reviewed, with routing, time saved, speed-up and percent fewer reviews."""
    n, reviewed = F.count("*"), F.count_if("to_review")
    out = routed.agg(n.alias("pages"), reviewed.alias("review_pages"), (n * review_minutes).alias("minutes_all"), (reviewed * review_minutes + (n - reviewed) * pattern_minutes).alias("minutes_routed"))
    some = F.col("pages") > 0
    return out.select(
        "*", (F.col("minutes_all") - F.col("minutes_routed")).alias("minutes_saved"), F.when(F.col("minutes_routed") > 0, F.col("minutes_all") / F.col("minutes_routed")).alias("speed_up"),
        F.when(some, 100.0 * (F.col("pages") - F.col("review_pages")) / F.col("pages")).alias("percent_fewer"),
    )


def goal_counts(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy(F.coalesce("goal", F.lit("Unknown")).alias("goal")).agg(F.count("*").alias("n"))


def batch_timing(runs: DataFrame) -> DataFrame:
    """runs (name, seconds, ok): mean over all, least and most, successes and failures."""
    return runs.agg(F.avg(F.coalesce("seconds", F.lit(0.0))).alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def extrapolated(runs: DataFrame, chunks: int = 39) -> DataFrame:
    """Each run's minutes for a document of so many chunks."""
    return runs.select("name", (F.col("seconds") * chunks / 60).alias("minutes"))


def text_sizes(docs: DataFrame, chunk: int = 1000) -> DataFrame:
    """(doc_id, sentences, words, characters, chunks)."""
    pieces = F.filter(F.split("text", "[.!?]+"), lambda s: F.trim(s) != "")
    ws = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")
    return docs.select("doc_id", F.size(pieces).cast("bigint").alias("sentences"), F.size(ws).cast("bigint").alias("words"), F.length("text").cast("bigint").alias("characters"), F.ceil(F.length("text") / chunk).alias("chunks"))


def mapped_chunks(mapping: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of a mapping with their chunks; entries whose chunk is missing are left out."""
    return mapping.join(chunks, keys)


def changed_words(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, old_word, new_word): words that differ at the same place, up to the shorter text's end. old, new: keys and text."""

    def split(c: str) -> Column:
        return F.filter(F.split(c, r"[^A-Za-z]+"), lambda w: w != "")

    both = old.select(*keys, split("text").alias("a")).join(new.select(*keys, split("text").alias("b")), keys)
    pairs = F.filter(F.transform(F.arrays_zip("a", "b"), lambda x, i: F.struct((i + 1).alias("place"), x["a"].alias("old_word"), x["b"].alias("new_word"))), lambda x: x["old_word"] != x["new_word"])
    return both.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def paired(before: DataFrame, after: DataFrame, key: str = "sample") -> DataFrame:
    """Samples that have both versions."""
    return before.withColumnRenamed("text", "before").join(after.withColumnRenamed("text", "after"), key)


def winner(ai: Column, code: Column) -> Column:
    a, b = F.coalesce(ai, F.lit(0)), F.coalesce(code, F.lit(0))
    return F.when(a > b, "AI").when(b > a, "CODE").otherwise("AGREE")


def pass_through_scores(facts: DataFrame, scores: str = "ai_scores") -> DataFrame:
    """(doc_id, category, final_score) of the nine circumstantial categories from a map of a reviewer's scores; a missing one is 0."""
    rows = F.array(*(F.struct(F.lit(f"c{k}").alias("category"), F.coalesce(F.try_element_at(scores, F.lit(f"c{k}")), F.lit(0)).alias("final_score")) for k in range(1, 10)))
    return facts.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")


def with_priority(sections: DataFrame, priorities: DataFrame) -> DataFrame:
    """sections with the priority (P1 to P4) that a lookup table (section, priority) gives them, P4 by default."""
    return sections.join(priorities, "section", "left").withColumn("priority", F.coalesce("priority", F.lit("P4")))


def reverse_order(changes: DataFrame) -> DataFrame:
    """changes (doc_id, para_no) with `turn`: from the last paragraph up, so that insertions do not move what is still to come."""
    return changes.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("para_no"), F.desc("edit_seq"))))
