"""Formatting of texts and of reviewers' replies: native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.operators.text import plain_words

# What quoted-printable leaves of quotes and blanks, and what stands for it.
LEFTOVERS = [("=93", '"'), ("=94", '"'), ("=20", " "), ("=92", "'"), ("&nbsp;", " ")]
# Phrases that are set in bold.
BOLD = [r"(THIS AGREEMENT OF SALE AND PURCHASE \([^)]+\))", r"(\([^)]*Seller[^)]*\))", r"(\([^)]*Buyer[^)]*\))", r"(\([^)]*Agreement[^)]*\))", r"(\([^)]*Effective Date[^)]*\))"]
# How lines of talk begin.
TALK = ["I ", "The ", "Here ", "Based ", "Looking "]


def cleaned(text: Column) -> Column:
    """A saved page's body as paragraphs: from `<html` (else from `AGREEMENT`) on, leftovers mended, tags to breaks or nothing.

    White space is squeezed before paragraphs are made, so only tags make breaks.
    """
    html, title = F.instr(text, "<html"), F.instr(text, "AGREEMENT")
    start = F.when(html > 0, html).when(title > 0, title).otherwise(1)
    out = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), LEFTOVERS, F.substr(text, start))
    for pattern, new in ((r"[\s\x0B]+", " "), ("<p[^>]*>", "\n\n"), ("</p>", ""), ("<br[^>]*>", "\n"), ("<[^>]+>", ""), (r"\n\s*\n\s*\n+", "\n\n")):
        out = F.regexp_replace(out, pattern, new)
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def emboldened(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, "<b>$1</b>"), BOLD, text)


def paragraph_style(text: Column, title: str = "AGREEMENT OF SALE AND PURCHASE") -> Column:
    return F.when(F.contains(text, F.lit("EXHIBIT")) & (F.length(text) < 50), "exhibit").when(F.contains(text, F.lit(title)) & (F.length(text) < 100), "title").otherwise("normal")


def rejoined(text: Column) -> Column:
    """A phrase that a page break cut is one line again."""
    return F.regexp_replace(text, r"(protective order)\s*[\r\n]+\s*(or other remedy)", "$1 $2")


def prompt_head(text: Column, characters: int) -> Column:
    return F.left(text, F.lit(characters))


def prompt_words(text: Column, most: int) -> Column:
    """The first words of a text, joined by a blank."""
    return F.array_join(F.slice(plain_words(text), 1, most), " ")


def blank_line_paragraphs(text: Column, most: int | None = None) -> Column:
    """Paragraphs between blank lines; `most` keeps a page's worth, as a rendering does."""
    parts = F.split(text, "\n\n")
    return parts if most is None else F.slice(parts, 1, most)


def reply_names(reply: Column, over: int = 3, under: int = 100) -> Column:
    """A reply's lines that are names: no talk, no bullets, of more than `over` and fewer than `under` characters."""
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~reduce(lambda a, b: a | b, (F.startswith(x, F.lit(t)) for t in TALK)))
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[-•*]\s*", "")), lambda x: (F.length(x) > over) & (F.length(x) < under))


def reply_variations(reply: Column, under: int = 50) -> Column:
    return F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("I ")) & (F.length(x) < under))


def reply_body(reply: Column) -> Column:
    """A reply without blank lines and lines of explanation; the reply itself if nothing else is in it."""
    lines = F.filter(F.split(reply, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("Return")) & ~F.startswith(x, F.lit("Here")))
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.trim(x)), "\n")).otherwise(reply)
