"""Readers: whole text files, DOCX by its XML, term lists, model replies."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text): UTF-8 with bad bytes dropped, marker files skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [bytes(b).decode("utf-8", "ignore") for b in pdf["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).filter(~F.col("path").contains("Zone.Identifier"))
    return files.select("path", "content").mapInPandas(run, "path string, text string")


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, para_no, text, error) of paragraphs that are not blank; a file that can't be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, b in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(bytes(b))).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
                    continue
                texts = ["".join(t.text or "" for t in para.iter(f"{SPACE}t")) for para in root.iter(f"{SPACE}p")]
                rows += [(p, k, t, None) for k, t in enumerate((t for t in texts if t.strip()), 1)]
            yield pd.DataFrame(rows, columns=["path", "para_no", "text", "error"]).astype({"para_no": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, para_no int, text string, error string")


def docx_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error): all paragraphs of a file, joined by a space."""
    rows = F.array_sort(F.collect_list(F.struct("para_no", "text")))
    return docx_paragraphs(spark, path).groupBy("path").agg(F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"), F.max("error").alias("error"))


def unprocessed(files: DataFrame, marks: tuple[str, ...] = ("_REDACTED", "_FORMATTED", "mapping")) -> DataFrame:
    """files (path, ...) whose names hold none of the marks of outputs, in the order of their paths."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(~name.rlike("|".join(marks))).orderBy("path")


def configuration(spark: SparkSession, path: str) -> dict:
    """A client's JSON configuration or template file as a driver-side dict: one small file, read through Spark."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def rule_switches(spark: SparkSession, config: dict) -> DataFrame:
    """(category, enabled) from a configuration's rules: a switch, or an object with one; on by default."""
    rows = [(k, bool(v.get("enabled", True) if isinstance(v, dict) else v)) for k, v in config.get("rules", {}).items()]
    return spark.createDataFrame(rows, "category string, enabled boolean")


def mapping_entries(spark: SparkSession, path: str) -> DataFrame:
    """The chunk entries of mapping files, with original_file."""
    return spark.read.json(path, multiLine=True).select("original_file", F.explode("chunks").alias("c")).select("original_file", "c.*")


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """(term): stripped, lower case, without blanks and # comments, distinct."""
    term = F.lower(F.trim("value"))
    return spark.read.text(path).select(term.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def reply_json(reply: Column, schema: str) -> Column:
    """A model's reply as a struct: fences stripped, control characters as blanks, numbers without leading zeros, from the first [ or { on; null if it is broken."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)```.*$", "")
    fixed = F.regexp_replace(F.regexp_replace(bare, r"[\x00-\x1F]", " "), r'("line_number":\s*)0+(\d)', "$1$2")
    return F.from_json(F.regexp_extract(fixed, r"(?s)([\[{].*[\]}])", 1), schema)


def county_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term): what stands before the colon, lower case, distinct; the first line of the file is its header."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return lines.filter((F.col("line_no") > 0) & F.col("line").contains(":")).select(F.lower(F.trim(F.split("line", ":")[0])).alias("term")).distinct()


def section_lines(docs: DataFrame, marker: str) -> DataFrame:
    """(doc_id, line_no, line): lines that are not blank from the second after the first line with the marker on."""
    lines = F.split("text", "\r?\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(marker))), True)
    rows = docs.select("doc_id", at.alias("at"), F.posexplode(lines).alias("k", "line")).filter((F.col("at") > 0) & (F.col("k") > F.col("at")))
    return rows.filter(F.trim("line") != "").select("doc_id", (F.col("k") + 1).alias("line_no"), F.trim("line").alias("line"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) from lines tagged `LINE 012: text`; other lines are left out."""
    tagged = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^LINE \d{1,9}: ?[^\n]*"), F.lit(0))).alias("l"))
    return tagged.select("doc_id", F.regexp_extract("l", r"^LINE (\d+)", 1).cast("int").alias("line_no"), F.rtrim(F.regexp_extract("l", r"^LINE \d+: ?(.*)", 1)).alias("line"))


def summary_terms(docs: DataFrame, label: str = "Non-whitelisted words:") -> DataFrame:
    """(doc_id, term): the distinct, comma-separated terms after the label on each line that has it."""
    line = docs.select("doc_id", F.explode(F.split("text", "\r?\n")).alias("line")).filter(F.col("line").contains(label))
    terms = line.select("doc_id", F.explode(F.split(F.substring_index(F.substring_index("line", label, 2), label, -1), ",")).alias("term"))
    return terms.select("doc_id", F.trim("term").alias("term")).filter("term <> ''").distinct()
