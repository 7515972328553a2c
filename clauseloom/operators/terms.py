"""Redaction by found strings and by lists of terms, applying learned terms, and words by kind: all native."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from clauseloom.functions.patterns import in_java
from clauseloom.operators.rare import WORD, rare_words
from clauseloom.operators.text import plain_words, random_artifact, words

# Endings that mark a company's name where no reviewer says so.
COMPANY_ENDINGS = ["LLC", "Inc", "Corp", "Corporation", "Company", "Ltd", "LP", "LLP", "Partners", "Holdings", "Group", "Trust"]
# Words of saved pages that are no findings (lower case; the mixed-case ones of codes never match and are left out).
PAGE_WORDS = ["charset", "mhtml", "multipart", "boundary", "content", "type", "location", "transfer", "encoding", "quoted", "printable", "webkit", "chrome", "extension", "font", "face", "src", "url", "format", "woff", "weight", "style", "normal", "italic", "family", "optimist", "wikibuy", "iconfont", "assets", "chatgpt", "cid", "htm", "https", "www", "com", "archives", "edgar", "data", "utm", "source", "snapshot", "subject", "exhibit", "mime", "version", "related", "multipartboundary"]
# Kinds of company terms.
TERM_KINDS = {
    "entity": ["company", "companies", "corp", "corporation", "incorporated", "inc", "limited", "ltd", "llc", "liability", "partnership", "co", "firm", "business"],
    "descriptor": ["industries", "services", "systems", "technologies", "development", "construction", "management", "consulting", "solutions"],
    "geographic": ["north", "south", "east", "west", "central", "national", "international", "global", "american", "united", "states"],
}
#: A text's words, markers and what is between them; joined, they are the text again.
PIECES = r"\[[A-Z_]+\]|[A-Za-z]+|[^A-Za-z\[]+|\["
#: Of these, those that are replaced or protected.
WORD_OR_MARKER, SENTENCE_ENDS = re.compile(r"\[[A-Z_]+\]|[A-Za-z]+"), re.compile("[.!?]+")


def matched_strings_redacted(text: Column, library: list[tuple[str, str]], marker: str = "[REDACT]", flags: str = "(?i)") -> Column:
    """Every occurrence of each string that a pattern matches in the original text, wherever it stands; in order of patterns, then of matches."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(in_java(p, flags)), F.lit(0)) for _, p in library)))
    return F.aggregate(F.array_distinct(found), text, lambda t, m: F.replace(t, m, F.lit(marker)))


def words_redacted(text: Column, flagged: Column, marker: str = "[REDACTED]") -> Column:
    """text with the flagged words (an array, case-sensitive) replaced; words of markers that are there already stay.

    A set of the flagged words and one pass over the text, so time grows with the two together.
    """

    @F.arrow_udf(StringType())
    def replaced(texts: pa.Array, listed: pa.Array) -> pa.Array:
        def one(t: str | None, own: list[str] | None) -> str | None:
            if t is None or own is None:
                return None
            words = set(own)
            return WORD_OR_MARKER.sub(lambda m: marker if m[0] in words else m[0], t) if words else t

        return pa.array([one(t.as_py(), own.as_py()) for t, own in zip(texts, listed, strict=True)], pa.string())

    return replaced(text, flagged)


@F.arrow_udf(ArrayType(BooleanType()))
def holds_flagged(texts: pa.Array, listed: pa.Array) -> pa.Array:
    """For each piece between the ends of a text's sentences, whether it has a flagged word (an array, case-sensitive)."""

    def one(t: str | None, own: list[str] | None) -> list[bool] | None:
        if t is None:
            return None
        words = set(own or ())
        return [not words.isdisjoint(WORD.findall(s)) for s in SENTENCE_ENDS.split(t)]

    return pa.array([one(t.as_py(), own.as_py()) for t, own in zip(texts, listed, strict=True)], pa.list_(pa.bool_()))


def text_key(text: Column) -> tuple[Column, Column]:
    """k1 and k2: 128 bits of a text, never null."""
    return F.xxhash64(text, text.isNull()).alias("k1"), F.xxhash64(F.lit(1), text, text.isNull()).alias("k2")


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumns(dict(zip(("k1", "k2"), text_key(F.col(text)), strict=True)))


def _with_words(docs: DataFrame, off: DataFrame) -> DataFrame:
    """keyed docs with `flagged`, the sorted words of off (k1, k2, word)."""
    listed = off.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("word")).alias("flagged"))
    return docs.join(listed, ["k1", "k2"], "left").withColumn("flagged", F.coalesce("flagged", F.array().cast("array<string>"))).drop("k1", "k2")


def with_flagged(docs: DataFrame, allow: DataFrame, text: str = "text", markers: bool = True) -> DataFrame:
    """docs with `flagged`: the text's distinct words of more than two letters whose lower case is not in allow (term), sorted.

    Which words are flagged depends on the text alone, so texts meet their words by a digest of the text: rows whose ids are
    null or come twice get theirs too. No row is lost, and none keeps a flagged word. Without markers, words inside of
    `[NAME]` and the like are words as any other.
    """
    own = keyed(docs, text)
    bare = F.regexp_replace(text, r"\[[A-Z_]+\]", " ") if markers else F.col(text)
    once = own.select("k1", "k2", F.explode(F.array_distinct(words(bare))).alias("word")).filter(F.length("word") > 2)
    return _with_words(own, once.withColumn("term", F.lower("word")).join(allow.select("term"), "term", "left_anti"))


def with_rare(docs: DataFrame, least: int = 5, text: str = "text", markers: bool = True) -> DataFrame:
    """with_flagged by the allow-list of all words that `least` documents or more have, in one pass over the words.

    A word off that list has few documents, so it comes with all of them from the pass that counts; the list is not made.
    """
    own = keyed(docs, text)
    return _with_words(own, rare_words(own.select("doc_id", "k1", "k2", text), least, text, markers).select("k1", "k2", "word"))


def flagged_words(docs: DataFrame, allow: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, flagged): each text's distinct words of more than two letters whose lower case is not in allow (term).

    Words are made distinct before the join, so a text sends each once; the array is bounded by its vocabulary.
    """
    own = docs.select(*keys, F.explode(F.array_distinct(words(F.regexp_replace(text, r"\[[A-Z_]+\]", " ")))).alias("word")).filter(F.length("word") > 2)
    off = own.withColumn("term", F.lower("word")).join(allow.select("term"), "term", "left_anti")
    return off.groupBy(*keys).agg(F.sort_array(F.collect_set("word")).alias("flagged"))


def allow_list_redacted(docs: DataFrame, allow: DataFrame | int, keys: tuple[str, ...] = ("doc_id",), text: str = "text", marker: str = "[REDACTED]") -> DataFrame:
    """(keys, redacted, flagged): every word off the allow-list replaced, all occurrences, whatever the keys hold.

    allow: a table (term), or a number of documents: then it is the words that so many documents have (doc_id is a key).
    """
    own = docs.select(*keys, *([text] if text not in keys else []))
    both = with_rare(own, allow, text) if isinstance(allow, int) else with_flagged(own, allow, text)
    return both.select(*keys, words_redacted(F.col(text), F.col("flagged"), marker).alias("redacted"), "flagged")


def findings_report(found: DataFrame, flagged: DataFrame, most: int = 10, most_words: int = 20) -> DataFrame:
    """(doc_id, findings, words): the first findings (doc_id, pattern_no, at, found) of each document, and its first flagged words.

    Rows beyond the first are dropped by a window before they are collected.
    """
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pattern_no", "at"))).filter(F.col("n") <= most)
    listed = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "found"))), lambda x: x["found"]).alias("findings"))
    return listed.join(flagged.select("doc_id", F.slice("flagged", 1, most_words).alias("words")), "doc_id", "full_outer")


def findings_at(docs: DataFrame, library: list[tuple[str, str]], flags: str = "(?i)") -> DataFrame:
    """(doc_id, pattern_no, label, at, found): at is the match's number among its pattern's in the text."""
    per = F.array(*(F.struct(F.lit(k).alias("pattern_no"), F.lit(label).alias("label"), F.regexp_extract_all("text", F.lit(in_java(p, flags)), F.lit(0)).alias("all")) for k, (label, p) in enumerate(library)))
    return docs.select("doc_id", F.explode(per).alias("p")).select("doc_id", "p.pattern_no", "p.label", F.posexplode("p.all").alias("at", "found"))


def counted_placeholders(text: Column, library: list[tuple[str, str]], stop_terms: list[str], flags: str = "") -> Column:
    """A struct of text and found: matches in the original text, in order of patterns, each replaced at its first place left by `[LABEL_n]`.

    Matches that hold a stop term are passed over and not counted.
    """

    def labelled(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(in_java(pattern, flags)), F.lit(0)), lambda m: F.struct(F.lit(label).alias("label"), m.alias("m")))

    all_ = F.flatten(F.array(*(labelled(label, p) for label, p in library)))
    kept = F.filter(all_, lambda x: ~F.exists(F.array(*map(F.lit, stop_terms)), lambda s: F.contains(F.lower(x["m"]), s)))
    rows = F.transform(kept, lambda x, i: F.struct(F.concat(F.lit("["), x["label"], F.lit("_"), (i + 1).cast("string"), F.lit("]")).alias("placeholder"), x["m"].alias("original")))

    def step(t: Column, x: Column) -> Column:
        at = F.instr(t, x["original"])
        return F.when(at > 0, F.overlay(t, x["placeholder"], at, F.length(x["original"]))).otherwise(t)

    return F.struct(F.aggregate(rows, text, step).alias("text"), rows.alias("found"))


def listed_terms_redacted(text: Column, terms: list[str], least: int, known: tuple[str, ...] = (), marker: str = "[REDACTED]") -> Column:
    """A struct of text and n: whole words or phrases of a short list, in any case, of `least` characters or more, without the known ones."""
    own = sorted({t for t in terms if len(t) >= least and t.lower() not in {k.lower() for k in known}}, key=lambda t: (-len(t), t))
    if not own:
        return F.struct(text.alias("text"), F.lit(0).alias("n"))
    pattern = r"(?i)\b(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in own) + r")\b"
    return F.struct(F.regexp_replace(text, pattern, marker).alias("text"), F.regexp_count(text, F.lit(pattern)).alias("n"))


def company_names(text: Column, endings: list[str] = COMPANY_ENDINGS) -> Column:
    """The distinct names of one or two capitalised words before a company's ending: the rule where no reviewer is asked."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:[A-Z][a-z]+ ){1,2}(?:" + "|".join(endings) + r")\b"), F.lit(0))))


def learned_terms_applied(pages: DataFrame, allow: DataFrame | int, routed: DataFrame) -> DataFrame:
    """(doc_id, page, redacted, to_review): pages routed away from review lose the flagged words, all of which earlier documents taught.

    pages: doc_id, page, content; routed: doc_id, page, to_review by flagged words. Pages to review stay as they are.
    allow: as of allow_list_redacted.
    """
    own = pages.select("doc_id", "page", "content")
    out = (with_rare(own, allow, "content") if isinstance(allow, int) else with_flagged(own, allow, "content")).alias("o")
    known = routed.groupBy("doc_id", "page").agg(F.max("to_review").alias("to_review")).alias("r")
    both = out.join(known, F.col("o.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("o.page").eqNullSafe(F.col("r.page")), "left")
    judged = both.select("o.doc_id", "o.page", "content", "flagged", F.coalesce("r.to_review", F.lit(False)).alias("to_review"))
    lost = F.when(F.col("to_review"), F.array().cast("array<string>")).otherwise(F.col("flagged"))
    return judged.select("doc_id", "page", words_redacted(F.col("content"), lost).alias("redacted"), "to_review")


def selective_content(text: Column, flagged: Column, opening: int = 200, closing: int = 100, sentences: int = 5) -> Column:
    """The first words, the last words (of longer texts), and the first sentences with a flagged word, each under its heading."""
    ws = plain_words(text)
    both = F.arrays_zip(F.split(text, "[.!?]+").alias("s"), holds_flagged(text, flagged).alias("hit"))
    parts = F.transform(F.filter(both, lambda x: x["hit"]), lambda x: x["s"])
    last = F.when(F.size(ws) > closing, F.concat(F.lit("CLOSING:\n"), F.array_join(F.slice(ws, F.size(ws) - closing + 1, closing), " ")))
    first = F.when(F.size(ws) > 0, F.concat(F.lit("OPENING:\n"), F.array_join(F.slice(ws, 1, opening), " ")))
    some = F.when(F.size(parts) > 0, F.concat(F.lit("FLAGGED:\n"), F.array_join(F.transform(F.slice(parts, 1, sentences), lambda s: F.trim(s)), "\n")))
    return F.concat_ws("\n\n", first, last, some)


def telling_words(tokens: DataFrame, allow: DataFrame, page_words: list[str] = PAGE_WORDS) -> DataFrame:
    """(word): distinct words off the allow-list of over two letters that are neither words of saved pages nor codes, sorted in any case."""
    own = tokens.select("word").distinct().filter((F.length("word") > 2) & ~F.lower("word").isin(page_words) & ~random_artifact(F.col("word")))
    return own.withColumn("term", F.lower("word")).join(allow.select("term"), "term", "left_anti").select("word").orderBy(F.lower("word"), "word")


def term_kind(term: Column, kinds: dict[str, list[str]] = TERM_KINDS) -> Column:
    """The first kind whose list holds the lower-cased term, or `other`; the lists are the caller's to change."""
    out = F.when(F.lit(False), "other")
    for kind, listed in kinds.items():
        out = out.when(F.lower(term).isin(listed), kind)
    return out.otherwise("other")


def first_change_in(paragraphs: DataFrame, changes: DataFrame) -> DataFrame:
    """paragraphs (doc_id, para_no, text) with the least edit_seq of the document's changes whose `find` they hold, null if none."""
    met = paragraphs.join(changes.select("doc_id", "edit_seq", "find"), "doc_id").filter((F.col("find") != "") & F.contains("text", "find"))
    return paragraphs.join(met.groupBy("doc_id", "para_no").agg(F.min("edit_seq").alias("edit_seq")), ["doc_id", "para_no"], "left")
