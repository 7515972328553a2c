"""Reversible redaction: spans chosen on the original text, one rewrite, a vault of rows, and a native restore."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions.batches import pieces
from clauseloom.functions.patterns import COMPANY_SUFFIX, LIBRARY_B
from clauseloom.operators.rare import few_terms
from clauseloom.operators.terms import keyed, text_key
from clauseloom.operators.text import words

# Endings of company names: of corporate forms, and descriptive.
CORPORATE = ["llc", "inc", "corp", "corporation", "company", "lp", "llp", "limited", "ltd"]
DESCRIPTIVE = ["center", "centre", "clinic", "lab", "laboratory", "foundation", "trust", "fund", "enterprises", "holdings", "services", "solutions", "properties", "realty", "management", "consulting", "international", "associates", "group"]
ENDING = re.compile(r"\b(?:" + "|".join(sorted(CORPORATE + DESCRIPTIVE, key=len, reverse=True)) + r")\b\.?", re.IGNORECASE)
OPENER = re.compile(r".*(?:,|\bWHEREAS\b|\band\b|\bbetween\b)\s*", re.DOTALL | re.IGNORECASE)
#: Letters beyond a to z that a search in any case takes for one of them, and these.
FOLDED, PLAIN_LETTERS = "\u212a\u017f\u0131\u0130", "ksii"


def shortest(strings: list[str]) -> list[str]:
    """Those that hold none of the others: a text that holds any string holds one of these."""
    return [s for s in strings if not any(o != s and o in s for o in strings)]


#: What every match of a pattern holds (one of some strings, a digit), so texts that lack it need no search.
ENDINGS = frozenset(CORPORATE + DESCRIPTIVE)
STEMS = shortest(CORPORATE + DESCRIPTIVE)
HELD = {"EMAIL": ["@"], "COMPANY": shortest([s.replace(r"\.?", "").replace("\\", "") for s in COMPANY_SUFFIX.removeprefix("(?:").removesuffix(")").split("|")])}
DIGIT = re.compile(r"\d")
PATTERNS = [(label, re.compile(p), HELD.get(label), r"\d" in p) for label, p in LIBRARY_B]
FOUND = "array<struct<seq:int,hex_id:string,type:string,original:string,placeholder:string>>"


def entities(text: str) -> list[str]:
    """Names of two words or more, up to 80 characters, that end in a company word, in the text before the first numbered line."""
    low = text.lower()
    if not any(c in text for c in FOLDED) and (not any(s in low for s in STEMS) or ENDINGS.isdisjoint(re.findall("[a-z]+", low))):
        return []
    head = re.split(r"(?m)^\s*\d+[.)]\s", text, maxsplit=1)[0]
    out = []
    for m in ENDING.finditer(head):
        end = m.end()
        more = re.match(r",\s*(?:" + "|".join(CORPORATE) + r")\b\.?", head[end:], re.IGNORECASE)
        end += more.end() if more and m[0].lower().rstrip(".") in DESCRIPTIVE else 0
        start = head[: m.start()]
        if m[0].lower().rstrip(".") in CORPORATE:
            start = re.sub(r",\s*$", "", start)
        opener = OPENER.match(start)
        name = head[opener.end() if opener else 0 : end].strip()
        if len(name.split()) >= 2 and len(name) <= 80:
            out.append(name)
    return list(dict.fromkeys(out))


class Listed:
    """The words of a list (a to z, in lower case) by those of a text that are not on it."""

    def __init__(self, unlisted: list[str]):
        self.unlisted = frozenset(unlisted)

    def __contains__(self, word: str) -> bool:
        return word.isascii() and word.isalpha() and word not in self.unlisted


def redact(doc_id: str, text: str, allow: frozenset[str] | Listed) -> tuple[str, list[tuple]]:
    """Spans by pass (entities, patterns in order, sweep of found terms), then start; overlaps go to the earlier pass."""
    taken = bytearray(len(text))
    spans: list[tuple[int, int, str]] = []

    def claim(start: int, end: int, kind: str) -> None:
        if start < end and not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            spans.append((start, end, kind))

    names = sorted(entities(text), key=len, reverse=True)
    if names:
        for m in re.finditer("|".join(map(re.escape, names)), text, re.IGNORECASE):
            claim(*m.span(), "COMPANY")
    digits = DIGIT.search(text) is not None
    for label, p, held, digit in PATTERNS:
        if digit and not digits or held and not any(s in text for s in held):
            continue
        for m in p.finditer(text):
            if label == "PERSON" and all(w.lower() in allow for w in m[0].split()):
                continue
            claim(*m.span(), label)
    terms: dict[str, str] = {}
    for start, end, kind in spans:
        whole = text[start:end]
        terms.setdefault(whole, kind)
        if kind == "COMPANY":
            for part in re.split(r" and | & |, ", " ".join(whole.split())):
                if len(part.split()) >= 2:
                    terms.setdefault(part, kind)
        if kind in ("COMPANY", "PERSON"):
            for w in re.findall(r"(?!\d)[^\W_][\w'’-]*", whole):
                if len(w) > 2 and w[0].isupper() and w.lower() not in allow:
                    terms.setdefault(w, kind)
    # One pass for all terms, the longest first, with any white space for white space.
    order = sorted(terms, key=lambda t: (-len(t), t))
    if order:
        kinds = {" ".join(t.lower().split()): terms[t] for t in reversed(order)}
        sweep = "|".join(r"\s+".join(map(re.escape, t.split())) for t in order)
        for m in re.finditer(rf"(?<!\w)(?:{sweep})(?!\w)", text, re.IGNORECASE):
            claim(*m.span(), kinds.get(" ".join(m[0].lower().split()), "PERSON"))
    out, rows, at = [], [], 0
    for seq, (start, end, kind) in enumerate(sorted(spans), 1):
        hex_id = hashlib.sha256(f"{doc_id}|{seq}".encode()).hexdigest()[:8]
        mark = f"[{kind}:{hex_id}.{seq}]"
        out += [text[at:start], mark]
        rows.append((seq, hex_id, kind, text[start:end], mark))
        at = end
    return "".join(out) + text[at:], rows


def with_allowed(docs: DataFrame, allow: DataFrame) -> DataFrame:
    """docs with `allowed`: the text's words, in lower case, that allow (term) lists. The list may be of any size: it is joined, not sent to tasks."""
    keyed = docs.withColumns(dict(zip(("k1", "k2"), text_key(F.col("text")), strict=True)))
    tokens = F.concat(words(F.col("text")), F.regexp_extract_all("text", F.lit(r"(?U)[\p{L}][\w'’-]*"), F.lit(0)), F.split("text", r"(?U)\s+"))
    own = keyed.select("k1", "k2", F.explode(F.array_distinct(F.transform(tokens, lambda w: F.lower(w)))).alias("term")).distinct()
    listed = own.join(allow.select("term").distinct(), "term").groupBy("k1", "k2").agg(F.collect_set("term").alias("allowed"))
    return keyed.join(listed, ["k1", "k2"], "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>"))).drop("k1", "k2")


def with_unlisted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """docs with `unlisted`, the text's words, in lower case, that fewer than `least` documents (doc_id) have; and the list of the others (term).

    Rare words come with all their documents from the pass that counts, so neither frequent words nor the list meet the
    texts. A search in any case also meets a word by letters of FOLDED: as a to z, such words are looked up, but not counted.
    """
    own, key = keyed(docs), F.struct("k1", "k2")
    told = own.select("doc_id", key.alias("key"), few_terms(least, 2)("text", "doc_id").alias("terms"))
    found = told.select("doc_id", "key", F.explode("terms").alias("term"))
    runs = F.filter(F.regexp_extract_all("text", F.lit(f"[A-Za-z{FOLDED}]+"), F.lit(0)), lambda w: w.rlike(f"[{FOLDED}]"))
    met = own.filter(F.col("text").rlike(f"[{FOLDED}]")).select(key.alias("key"), F.explode(runs).alias("w"))
    # No run is empty; but as a plan can't tell, the filter below keeps the key in both parts of the answer, which so share one pass and one shuffle.
    odd = met.select(F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.when(F.length("w") > 0, F.col("key")).alias("key"), F.lower(F.translate("w", FOLDED, PLAIN_LETTERS)).alias("term"))
    n = F.size(F.collect_set("doc_id").over(Window.partitionBy("term")))
    counted = found.unionByName(odd).filter("term is not null").withColumn("n", n).filter("key is not null")
    few = counted.filter(F.col("n") < least).groupBy("key.k1", "key.k2").agg(F.collect_set("term").alias("unlisted"))
    return own.join(few, ["k1", "k2"], "left").drop("k1", "k2"), counted.filter(F.col("n") >= least).select("term").distinct()


def vault(docs: DataFrame, allow: DataFrame | frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, text, redacted, found). Names of listed words only (allow: a table with `term`, or a small set) are no persons.

    The spans of one text depend on one another, so this is an Arrow-backed kernel by row.
    """
    own = docs.select("doc_id", "text")
    if isinstance(allow, DataFrame):
        return vaulted(with_allowed(own, allow), "allowed", frozenset)
    return vaulted(own.withColumn("allowed", F.lit(None).cast("array<string>")), "allowed", lambda _, fixed=frozenset(allow): fixed)


def vault_by_documents(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """vault() over the list of all words of a to z that `least` documents have, and that list (term)."""
    own, listed = with_unlisted(docs.select("doc_id", "text"), least)
    return vaulted(own, "unlisted", Listed), listed


def vaulted(own: DataFrame, words: str, as_list: Callable) -> DataFrame:
    """(doc_id, text, redacted, found) of own (doc_id, text, words); as_list makes a text's words its allow-list."""
    names = ("seq", "hex_id", "type", "original", "placeholder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, texts, keys, told = (batch.column(i) for i in range(4))
            made = [redact(k, t or "", as_list(w or ())) for k, t, w in zip(keys.to_pylist(), texts.to_pylist(), told.to_pylist(), strict=True)]
            found = pa.array([[dict(zip(names, r, strict=True)) for r in m[1]] for m in made], pa.list_(pa.struct([("seq", pa.int32()), *((n, pa.string()) for n in names[1:])])))
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array([m[0] for m in made], pa.string()), found], names=["doc_id", "text", "redacted", "found"])

    kind = dict(own.dtypes)["doc_id"]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))
    return own.select("doc_id", "text", key.alias("key"), words).mapInArrow(run, f"doc_id {kind}, text string, redacted string, found {FOUND}")


def restored(text: Column, found: Column) -> Column:
    """Placeholders back to originals, in one pass: the text is cut at its marks, each of which carries its number in the vault."""
    pieces = F.split(text, r"(?=\[[A-Z]+:[0-9a-f]{8}\.\d+\])")

    def back(x: Column) -> Column:
        mark = F.regexp_extract(x, r"^(\[[A-Z]+:[0-9a-f]{8}\.\d+\])", 1)
        row = F.try_element_at(found, F.nullif(F.regexp_extract(x, r"^\[[A-Z]+:[0-9a-f]{8}\.(\d{1,9})\]", 1).try_cast("int"), F.lit(0)))
        return F.when((mark != "") & (row["placeholder"] == mark), F.concat(row["original"], F.substr(x, F.length(mark) + 1))).otherwise(x)

    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.transform(pieces, back), ""))
