"""Pattern findings, redaction folds, normalisation, tokens and word classes: all native column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.patterns import GARBAGE_MARKERS, LIBRARY_A, NEEDED, NEVER, in_java


def sought(text: Column, pattern: str, flags: str) -> Column:
    """The pattern to run over a text: one that matches nothing where the text lacks what every match holds."""
    whole = F.lit(in_java(pattern, flags))
    return F.when(text.rlike(flags + NEEDED[pattern]), whole).otherwise(NEVER) if flags == "(?i)" and pattern in NEEDED else whole


def findings(docs: DataFrame, library: list[tuple[str, str]] = LIBRARY_A, keep: tuple[str, ...] = ("doc_id",), flags: str = "(?i)") -> DataFrame:
    """One row for each match of each pattern in the original text: pattern_no, label, found."""
    per = F.array(*(F.struct(F.lit(k).alias("pattern_no"), F.lit(label).alias("label"), F.regexp_extract_all("text", sought(F.col("text"), p, flags), F.lit(0)).alias("all")) for k, (label, p) in enumerate(library)))
    return docs.select(*keep, F.explode(per).alias("p")).select(*keep, "p.pattern_no", "p.label", F.explode("p.all").alias("found"))


def unguarded(found: DataFrame, stop_terms: list[str]) -> DataFrame:
    """Findings whose match holds none of the terms, in any case."""
    return found.filter(~reduce(lambda a, b: a | b, (F.contains(F.lower("found"), F.lit(s)) for s in stop_terms)))


def pattern_count(text: Column, library: list[tuple[str, str]], flags: str = "(?i)") -> Column:
    return reduce(lambda a, b: a + b, (F.regexp_count(text, sought(text, p, flags)) for _, p in library)).cast("bigint")


def redacted(text: Column, library: list[tuple[str, str]], marker: str = "[REDACTED]", flags: str = "(?i)") -> Column:
    """Each pattern in order over the already redacted text; marker `[LABEL]` puts each pattern's own label in."""
    plain = re.fullmatch(r"\[\w+\]", marker) is not None  # such a marker adds nothing that a pattern needs, so the original text tells
    pattern = lambda p: sought(text, p, flags) if plain else F.lit(in_java(p, flags))
    return reduce(lambda t, p: F.regexp_replace(t, pattern(p[1]), F.lit(f"[{p[0]}]" if marker == "[LABEL]" else marker)), library, text)


def any_pattern(text: Column, library: list[tuple[str, str]], flags: str = "(?i)") -> Column:
    def held(p: str) -> Column:
        whole = text.rlike(in_java(p, flags))
        return text.rlike(flags + NEEDED[p]) & whole if flags == "(?i)" and p in NEEDED else whole

    return reduce(lambda a, b: a | b, (held(p) for _, p in library))


def followed_up(text: Column) -> Column:
    """A marker's title, insurer or company word goes too."""
    return F.regexp_replace(text, r"(?i)\[REDACT\] (Title|Insurance|Company)", "[REDACT] [REDACT]")


def let(value: Column, body) -> Column:
    """body of the value, which is computed once for each row: an expression that a lambda names would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Letters a to z only; every other character separates (all dialects agree on that)."""
    return F.filter(F.split(text, "[^A-Za-z]+"), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Split at white space of any kind, as Python does."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def tokens(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return docs.select(*keep, F.posexplode(words(F.col("text"))).alias("pos", "word"))


def not_allowed(tokens: DataFrame, allow: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Tokens of more than two letters whose lower case is not in allow (term). An empty list is an error unless allowed."""
    out = tokens.withColumn("term", F.lower("word")).filter(F.length("word") > 2).join(allow.select("term"), "term", "left_anti")
    if allow_empty:
        return out
    # The check is part of the same query: one row, which raises where the list holds nothing.
    some = allow.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.raise_error(F.lit("the allow-list is empty"))).otherwise(F.col("n")).alias("listed"))
    return out.join(F.broadcast(some), F.col("listed") > 0).drop("listed")


def html_to_text(html: Column) -> Column:
    """Soft breaks joined, tags and entities to spaces, white space squeezed (not trimmed)."""
    joined = F.regexp_replace(html, "=\r?\n", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "<[^>]+>", " "), "&[a-zA-Z0-9#]+;", " "), r"\s+", " ")


#: Lines that begin a binary part: the first as written, the others in any case.
BINARY = "Content-Transfer-Encoding: base64"
BINARY_MARKERS = ("content-type: image", "content-type: application", "content-type: font", "webkit-", "chrome-extension")


def text_parts(mhtml: Column) -> Column:
    """A saved page without its binary parts, as mime_lines does it: of each part, the lines before its first marker."""
    parts = F.split(F.concat(mhtml, F.lit("\n")), rf"(?md)^------(?![^\n]*{BINARY})[^\n]*Boundary[^\n]*\n")

    def kept(part: Column) -> Column:
        lines = F.split(part, r"(?<=\n)")
        marked = F.transform(lines, lambda x: x.contains(BINARY) | reduce(lambda a, b: a | b, (F.lower(x).contains(m) for m in BINARY_MARKERS)))
        first = F.array_position(marked, True).cast("int")
        return F.when(first > 0, F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0)))).otherwise(lines)

    return F.regexp_replace(F.array_join(F.flatten(F.transform(parts, kept)), ""), r"\n\z", "")


def unquoted(text: Column) -> Column:
    """Quoted-printable soft breaks joined, then each `=HH` (upper case) as the Latin-1 sign."""
    pieces = F.split(F.regexp_replace(text, "=\r?\n", ""), "(?==[0-9A-F]{2})")
    sign = lambda x: F.concat(F.decode(F.unhex(F.substring(x, 2, 2)), "ISO-8859-1"), F.substr(x, F.lit(4)))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^=[0-9A-F]{2}"), sign(x)).otherwise(x)), "")


def mhtml_to_text(mhtml: Column) -> Column:
    """Binary parts dropped, quoted-printable decoded, tags and entities to spaces, white space of any kind squeezed."""
    bare = F.regexp_replace(F.regexp_replace(unquoted(text_parts(mhtml)), "<[^>]+>", " "), "&[a-zA-Z0-9#]+;", " ")
    return F.regexp_replace(bare, r"(?U)[\s\x1C-\x1F]+", " ")


def mime_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines (key, line_no, line) without binary MIME parts: a running state by window, from events on marker lines."""
    from pyspark.sql import Window

    low, line = F.lower("line"), F.col("line")
    event = F.when(line.contains(BINARY), "skip").when(line.startswith("------") & line.contains("Boundary"), "keep")
    event = event.when(reduce(lambda a, b: a | b, (low.contains(m) for m in BINARY_MARKERS)), "skip")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("event", event).withColumn("state", F.last("event", ignorenulls=True).over(w)).filter(F.col("event").isNull() & (F.coalesce("state", F.lit("keep")) != "skip")).drop("event", "state")


def garbage(text: Column) -> Column:
    """Whether a page holds a long base64 run, markup, or over ten words of which most are long and not all letters."""
    low = F.lower(text)
    ws = words(low)
    strange = (F.size(ws) > 10) & (F.size(F.filter(ws, lambda w: (F.length(w) > 8) & ~w.rlike("^[a-z]+$"))) > 0.5 * F.size(ws))
    return strange |  text.rlike("[A-Za-z0-9+/]{50,}") | reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in GARBAGE_MARKERS))


def vowels(word: Column) -> Column:
    return F.length(F.regexp_replace(F.lower(word), "[^aeiou]", ""))


def random_artifact(word: Column) -> Column:
    """Whether a word looks like a code rather than language."""
    n, v = F.length(word), vowels(word)
    # Shapes of codes, and below the shares of vowels that words have.
    shapes = ("^[A-Z]{2,4}[a-z]{1,4}[A-Z]*$", "^[A-Z]{2,}[a-z]{1,2}$", "^[a-z]+[A-Z]+[a-z]*$", "^[A-Z]+[a-z]+[A-Z]+", "[0-9]", "^[a-z]{1,3}[A-Z]{1,3}[a-z]*$", "^[bcdfghjklmnpqrstvwxyz]{4,}$", "^[a-z]{2}[A-Z][a-z]{2}$")
    by_shape = reduce(lambda a, b: a | b, (word.rlike(s) for s in shapes))
    return (n < 3) | (n > 15) | by_shape | (word.rlike("^[A-Z]{4,}$") & (n <= 6)) | ((n > 4) & (v == 0)) | ((n > 6) & ((n - v) / n > 0.8))


def regular_word(word: Column) -> Column:
    low = F.lower(word)
    return (
        F.length(word).between(3, 20) & ~word.rlike("[0-9]") & ~((word == F.upper(word)) & (F.length(word) > 3)) & ~low.rlike("[qxz]{2,}|[bcdfghjklmnpqrstvwxyz]{5,}")
        & (F.size(F.array_distinct(F.split(low, ""))) >= 3) & low.rlike("[aeiou]") & ~low.rlike("^(css|mhtml|http|www)")
    )


def word_category(word: Column, common: Column | None = None) -> Column:
    """First match of: common (a word of the list, as a table `term` to be joined as `common`), proper noun, abbreviation, technical, possible PII."""
    listed = F.lit(False) if common is None else common
    return F.when(listed, "common").when(word.rlike("^[A-Z][a-z]+$") & (F.length(word) > 3), "proper_noun").when(word.rlike("^[A-Z]{2,}$"), "abbreviation").when(word.rlike("^[a-z]+[A-Z]") | word.contains("Co") | word.contains("LLC"), "technical").otherwise("possible_pii")


def with_reasonable(text: Column) -> Column:
    """`attorney's fees` becomes `reasonable attorney's fees`, unless it already is."""
    return F.regexp_replace(text, r"(?i)(?<!reasonable )(attorney'?s'? fees)", "reasonable $1")
