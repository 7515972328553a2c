"""Comparison of versions: paired paragraphs, change types, phrase matrices, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_type(old: Column, new: Column) -> Column:
    """ADDED, DELETED, SAME, or by what changed. The shares of the old length."""
    return (
        F.when(old.isNull(), "ADDED").when(new.isNull(), "DELETED").when(old == new, "SAME").when(new.contains("XXXX") & ~old.contains("XXXX"), "REDACTION")
        .when(F.length(new) < F.length(old) * 0.8, "MAJOR_DELETION").when(F.length(new) > F.length(old) * 1.2, "MAJOR_ADDITION")
        .when(F.lower(old) != F.lower(new), "TEXT_MODIFICATION").otherwise("FORMATTING_CHANGE")
    )


def length_verdict(old: Column, new: Column) -> Column:
    return F.when(F.length(new) < F.length(old), "SHORTENED").when(F.length(new) > F.length(old), "LENGTHENED").otherwise("SAME")


def weight_verdict(old: Column, new: Column) -> Column:
    """As length_verdict, for changes that count: SIGNIFICANT from a fifth of the length on."""
    return F.when(F.length(new) < F.length(old) * 0.8, "SIGNIFICANT SHORTENING").when(F.length(new) > F.length(old) * 1.2, "SIGNIFICANT LENGTHENING").otherwise("MINOR MODIFICATION")


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and new (keys, text), paired by position; the longer side's rest is DELETED or ADDED."""
    both = old.withColumnRenamed("text", "old_text").join(new.withColumnRenamed("text", "new_text"), keys, "full_outer")
    return both.withColumn("change", change_type(F.col("old_text"), F.col("new_text"))).withColumn("length_change", length_verdict(F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit(""))))


def distribution(changes: DataFrame) -> DataFrame:
    n = changes.groupBy("change").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def phrase_matrix(texts: DataFrame, phrases: list[str], key: str) -> DataFrame:
    """For each text and phrase, whether the text holds it, whatever the case. Phrases are a short list in the plan itself."""
    rows = F.array(*(F.struct(F.lit(p).alias("phrase"), F.contains(F.lower("text"), F.lit(p.lower())).alias("present")) for p in phrases))
    return texts.select(key, F.explode(rows).alias("x")).select(key, "x.phrase", "x.present")


def version_matrix(original: DataFrame, candidate: DataFrame, accepted: DataFrame, phrases: list[str], key: str) -> DataFrame:
    """For each text's key and phrase, whether each version (key, text) holds it, whatever the case, and whether candidate and accepted agree.

    A version that is missing holds nothing.
    """
    both = original.select(key, F.col("text").alias("o")).join(candidate.select(key, F.col("text").alias("c")), key, "full_outer").join(accepted.select(key, F.col("text").alias("a")), key, "full_outer")

    def held(version: str, phrase: str) -> Column:
        return F.coalesce(F.contains(F.lower(version), F.lit(phrase.lower())), F.lit(False))

    rows = F.array(*(F.struct(F.lit(p).alias("phrase"), held("o", p).alias("in_original"), held("c", p).alias("in_candidate"), held("a", p).alias("in_accepted"), (held("c", p) == held("a", p)).alias("agree")) for p in phrases))
    return both.select(key, F.explode(rows).alias("x")).select(key, "x.*")
