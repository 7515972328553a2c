"""Splitters, packers, reassembly and page selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.text import garbage, let, plain_words


def keyed_hash(*parts: str) -> Column:
    """A repeatable 12-digit id in place of a random one."""
    return F.substring(F.md5(F.concat_ws("|", *(F.col(p).cast("string") for p in parts))), 1, 12)


def char_chunks(docs: DataFrame, size: int = 1000) -> DataFrame:
    """chunk_order (from 1), content, start_char (1-based), end_char (inclusive). An empty text has no chunk.

    The text is cut once, in one pass: a substring for each chunk would count characters from the start each time.
    """
    parts = docs.select("doc_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("parts"))
    out = parts.select("doc_id", F.posexplode_outer("parts").alias("n", "content")).filter("content is not null")
    out = out.select("doc_id", (F.col("n") + 1).alias("chunk_order"), "content", (F.col("n") * size + 1).alias("start_char"))
    out = out.withColumn("char_count", F.length("content")).withColumn("end_char", F.col("start_char") + F.col("char_count") - 1)
    return out.withColumn("hash_id", keyed_hash("doc_id", "chunk_order"))


def word_chunks(docs: DataFrame, size: int = 1000) -> DataFrame:
    """chunk_order, content, word_count, start_word (1-based), end_word (inclusive); size 500 gives pages.

    A text is cut once, and its words do not go along with each of its chunks.
    """

    def chunk(ws: Column, at: Column) -> Column:
        part = F.slice(ws, at, F.lit(size))
        return F.struct(F.array_join(part, " ").alias("content"), F.least(F.lit(size), F.size(ws) - at + 1).alias("word_count"))

    chunks = let(plain_words(F.col("text")), lambda ws: F.when(F.size(ws) > 0, F.transform(F.sequence(F.lit(1), F.size(ws), F.lit(size)), lambda at: chunk(ws, at))))
    out = docs.select("doc_id", F.posexplode_outer(chunks).alias("n", "c")).filter("n is not null")
    start = F.col("n") * size + 1
    return out.select("doc_id", (F.col("n") + 1).alias("chunk_order"), "c.content", "c.word_count", start.alias("start_word"), (start + F.col("c.word_count") - 1).alias("end_word"))


def reassemble(chunks: DataFrame, joiner: str = "", order: str = "chunk_order") -> DataFrame:
    """Content in order, joined. Reviewed content must have replaced the original before."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "content")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), joiner).alias("text"))


def mapping(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.sum("char_count").alias("total_chars"), F.max("end_char").cast("bigint").alias("last_char"))


def select_pages(pages: DataFrame, flagged: Column) -> DataFrame:
    """The first, the last and the flagged pages of each document, garbage never being flagged."""
    last = F.max("chunk_order").over(Window.partitionBy("doc_id"))
    return pages.withColumn("flagged", flagged & ~garbage(F.col("content"))).withColumn("last", last).filter((F.col("chunk_order") == 1) | (F.col("chunk_order") == F.col("last")) | F.col("flagged")).drop("last")


def sentence_pieces(docs: DataFrame) -> DataFrame:
    """doc_id, n (pieces of the text), sent_idx (from 0), sentence (trimmed).

    Pieces are cut once a text and numbered by the outer generator: the plain one would cut them again in a filter.
    """
    cut = docs.select("doc_id", F.split("text", "[.!?]+").alias("pieces"))
    rows = cut.select("doc_id", F.size("pieces").alias("n"), F.posexplode_outer("pieces").alias("sent_idx", "raw"))
    return rows.select("doc_id", "n", "sent_idx", F.trim("raw").alias("sentence"))


def at_risk(risky: Column) -> Column:
    return (F.length("sentence") >= 20) & ((F.col("sent_idx") < 10) | (F.col("sent_idx") >= F.col("n") - 5) | risky)


def risk_sentences(docs: DataFrame, risky: Column) -> DataFrame:
    """Sentences of 20 characters or more that are among the first 10 or last 5 pieces, or risky."""
    return sentence_pieces(docs).filter(at_risk(risky)).select("doc_id", "sent_idx", "sentence")


def flagged_sentences(docs: DataFrame, allow: DataFrame | int) -> DataFrame:
    """As risk_sentences, where a sentence is risky that has a word of over two letters off the allow-list (term).

    A text's words meet the list, and its sentences the words that are left, row by row: sentences are not shuffled.
    allow: as of terms.allow_list_redacted.
    """
    from clauseloom.operators import terms

    own = docs.select("doc_id", "text")
    both = terms.with_rare(own, allow, markers=False) if isinstance(allow, int) else terms.with_flagged(own, allow, markers=False)
    cut = both.select("doc_id", F.arrays_zip(F.split("text", "[.!?]+").alias("raw"), terms.holds_flagged("text", "flagged").alias("hit")).alias("pieces"))
    rows = cut.select("doc_id", F.size("pieces").alias("n"), F.posexplode_outer("pieces").alias("sent_idx", "p"))
    return rows.select("doc_id", "n", "sent_idx", F.trim("p.raw").alias("sentence"), "p.hit").filter(at_risk(F.col("hit"))).select("doc_id", "sent_idx", "sentence")


def pack_sections(sections: DataFrame, most_words: int = 300) -> DataFrame:
    """Greedy, order-preserving packing of sentences; a longer one has a chunk of its own. chunk_no, content, word_count.

    The fold keeps only where chunks start; contents are joined once from there.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sent_idx", "sentence", F.size(plain_words(F.col("sentence"))).alias("n"))))
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(s, x):
        opens = (s["at"] == 0) | ((s["n"] > 0) & (s["n"] + x["n"] > most_words))
        return F.struct(F.when(opens, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"), (s["at"] + 1).alias("at"), F.when(opens, x["n"]).otherwise(s["n"] + x["n"]).alias("n"))

    def chunk(starts: Column, at: Column, i: Column) -> Column:
        own = F.slice("all", at + 1, F.coalesce(F.get(starts, i + 1), F.size("all")) - at)
        content = F.array_join(F.transform(own, lambda x: x["sentence"]), " ")
        return F.struct(content.alias("content"), F.aggregate(own, F.lit(0), lambda n, x: n + x["n"]).alias("word_count"))

    grouped = sections.groupBy("doc_id").agg(ordered.alias("all"))
    chunks = let(F.aggregate("all", start, step, lambda s: s["starts"]), lambda starts: F.transform(starts, lambda at, i: chunk(starts, at, i)))
    packed = grouped.select("doc_id", chunks.alias("chunks")).select("doc_id", F.posexplode_outer("chunks").alias("i", "c")).filter("c is not null")
    return packed.select("doc_id", (F.col("i") + 1).alias("chunk_no"), "c.content", "c.word_count")


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def paragraphs(numbered: DataFrame) -> DataFrame:
    """Consecutive lines that are not blank, joined by a space: gaps and islands."""
    blank = F.trim("line") == ""
    island = F.sum(F.when(blank, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    kept = numbered.withColumn("island", island).filter(~blank)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("l")))), lambda x: x["l"]), " ")
    out = kept.groupBy("doc_id", "island").agg(text.alias("paragraph"), F.min("line_no").alias("first_line"))
    return out.withColumn("paragraph_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line"))).select("doc_id", "paragraph_number", "paragraph")


def numbered(all_lines: DataFrame) -> DataFrame:
    """`LINE 001: text` for lines that are not blank; blank ones count."""
    return all_lines.filter(F.trim("line") != "").select("doc_id", "line_no", F.format_string("LINE %03d: %s", "line_no", "line").alias("tagged"))


def clauses(all_lines: DataFrame, most: int = 3) -> DataFrame:
    """A clause starts at `1.`, at a line of capitals, or when the current one has more than `most` paragraphs.

    Between two lines that start a clause by their form, every (most + 1)-th line starts one: windows, no fold.
    """
    own = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = all_lines.filter(F.trim("line") != "").select("doc_id", "line_no", F.trim("line").alias("l"))
    formed = F.col("l").rlike(r"^\d+\.") | F.col("l").rlike(r"^[A-Z][A-Z\s]{10,}")
    part = kept.withColumn("part", F.sum(formed.cast("int")).over(own))
    place = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("line_no"))
    numbered_ = part.withColumn("opens", ((place - 1) % (most + 1) == 0).cast("int")).withColumn("clause_number", F.sum("opens").over(own).cast("int"))
    ls = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "l"))), lambda x: x["l"])
    out = numbered_.groupBy("doc_id", "clause_number").agg(ls.alias("ls"))
    first = F.slice(plain_words(F.regexp_replace(F.col("ls")[0], r"^\d+\.?\s*", "")), 1, 4)
    return out.select("doc_id", "clause_number", F.coalesce(F.nullif(F.array_join(first, " "), F.lit("")), F.lit("Untitled Clause")).alias("title"), F.array_join("ls", "\n").alias("text"))


def line_objects(all_lines: DataFrame) -> DataFrame:
    """doc_id, position, line_number (from 1 over lines that are not blank; null for blank ones), line."""
    full = (F.trim("line") != "").cast("int")
    n = F.sum(full).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return all_lines.select("doc_id", F.col("line_no").alias("position"), F.when(full == 1, n).cast("int").alias("line_number"), "line")
