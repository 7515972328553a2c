"""Sinks: chunks with their mapping, and reports as markdown text."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, partition: str | None = None) -> None:
    """The chunks, by `partition` (a column of few values) if given, and one mapping entry a document."""
    chunks.write.mode("overwrite").partitionBy(*([partition] if partition else [])).parquet(f"{path}/chunks")
    entries = F.array_sort(F.collect_list(F.struct("chunk_order", "hash_id", "char_count", "start_char", "end_char")))
    chunks.groupBy("doc_id").agg(F.to_json(F.struct(F.count("*").alias("total_chunks"), F.sum("char_count").alias("total_chars"), entries.alias("chunks"))).alias("mapping")).write.mode("overwrite").parquet(f"{path}/mapping")


def score_report(applied: DataFrame) -> DataFrame:
    """(doc_id, report): one markdown table a document."""
    row = F.format_string("| %s | %d | %d |", "category", "final_score", "band")
    rows = F.array_sort(F.collect_list(F.struct("band", "category", row.alias("row"))))
    return applied.groupBy("doc_id").agg(F.concat(F.format_string("# Document %d\n\nTotal: %d\n\n| category | score | band |\n| --- | --- | --- |\n", "doc_id", F.max("total")), F.array_join(F.transform(rows, lambda r: r["row"]), "\n")).alias("report"))


def redaction_summary(text: Column, found: Column) -> Column:
    """A redacted text with a trailer that counts its findings."""
    return F.concat(text, F.format_string("\n\n--- SUMMARY ---\nTotal redactions: %d\n", F.size(found)))


def analysis_json(applied: DataFrame) -> DataFrame:
    """(doc_id, analysis): a document's total and categories as one JSON object, in the order of the report."""
    rows = F.array_sort(F.collect_list(F.struct("band", "category", "final_score")))
    return applied.groupBy("doc_id").agg(F.to_json(F.struct(F.max("total").alias("total"), rows.alias("categories"))).alias("analysis"))


def write_final(df: DataFrame, path: str) -> None:
    """The last step's output in place of an earlier run's; there are no temporary files to clear."""
    df.write.mode("overwrite").parquet(path)


def logged(df: DataFrame, step: str, path: str) -> DataFrame:
    """df, stored at path, with a row (step, rows, seconds) added to the run log beside it.

    Rows are counted while they are written, so nothing is read a second time.
    """
    seen = Observation(step)
    start = time.monotonic()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{step}")
    took = time.monotonic() - start
    df.sparkSession.createDataFrame([(step, seen.get["rows"], took)], "step string, rows bigint, seconds double").coalesce(1).write.mode("append").parquet(f"{path}/run_log")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{step}")
