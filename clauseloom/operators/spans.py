"""Where patterns and listed terms match: offsets by native expressions, and term lists of any size by an automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions.patterns import LIBRARY_A
from clauseloom.operators.text import let, sought

#: Bytes of terms that one automaton is built of; longer lists are searched in parts, one after another.
PART_BYTES = 8 << 20
SPAN = "array<struct<start:int,end:int,term:string>>"


def located(docs: DataFrame, library: list[tuple[str, str]] = LIBRARY_A, keep: tuple[str, ...] = ("doc_id",), flags: str = "(?i)") -> DataFrame:
    """One row for each match of each pattern in the original text: keep, pattern_no, label, start (from 0), end (exclusive), found.

    Offsets count characters. What a split leaves between matches and the matches themselves alternate, so a match starts after
    the lengths of both so far: a running sum by text and pattern. Only narrow rows of matches are shuffled.
    """

    def matches(k: int, label: str, pattern: str):
        p = sought(F.col("text"), pattern, flags)
        gaps = F.transform(F.split("text", p), lambda x: F.length(x))
        every = let(F.regexp_extract_all("text", p, F.lit(0)), lambda all_: F.when(F.size(all_) > 0, F.zip_with(F.slice(gaps, F.lit(1), F.size(all_)), all_, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))))
        return F.struct(F.lit(k).alias("pattern_no"), F.lit(label).alias("label"), every.alias("all"))

    per = F.filter(F.array(*(matches(k, label, p) for k, (label, p) in enumerate(library))), lambda x: x["all"].isNotNull())
    own = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), per.alias("_per"))
    by_pattern = own.select(*keep, "_row", F.explode_outer("_per").alias("_p")).filter("_p is not null")
    rows = by_pattern.select(*keep, "_row", "_p.pattern_no", "_p.label", F.posexplode_outer("_p.all").alias("_k", "_m"))
    so_far = Window.partitionBy("_row", "pattern_no").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("_m.gap") + F.length("_m.found")).over(so_far).cast("int")
    return rows.select(*keep, "pattern_no", "label", (end - F.length("_m.found")).alias("start"), end.alias("end"), F.col("_m.found").alias("found"))


def lowered(text: str) -> str:
    """Lower case of the same length: the few letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Terms:
    """An automaton over lower-case terms; matches are whole words or phrases."""

    def __init__(self, terms: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for t in terms:
            self.automaton.add_word(t, t)
        self.some = bool(terms)
        if self.some:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """All matches, overlapping ones too."""
        if not self.some:
            return []
        low, out, n = lowered(text), [], len(text)
        for last, t in self.automaton.iter(low):
            start, end = last + 1 - len(t), last + 1
            if (start == 0 or not (is_word(low[start - 1]) and is_word(t[0]))) and (end == n or not (is_word(low[end]) and is_word(t[-1]))):
                out.append((start, end, t))
        return out


def leftmost_longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Matches that don't overlap: from the left, of those at one place the longest."""
    out, at = [], 0
    for start, end, t in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out.append((start, end, t))
            at = end
    return out


#: One automaton for each part of a list in a Python worker.
_built: dict[int, Terms] = {}


def automaton(shared: Broadcast) -> Terms:
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared.value)
    if key not in _built:
        _built.clear()
        _built[key] = Terms(shared.value)
    return _built[key]


def listed_redacted(docs: DataFrame, terms: DataFrame, least: int = 1, marker: str = "[REDACTED]", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with `redacted` and `spans`: whole words or phrases of terms (term) of `least` characters or more, in any case, replaced.

    Matches are chosen from the left, the longest first. The list may be of any size: it goes to the executors in parts of
    at most part_bytes, by a hash, each of which adds its matches to a text's; the last one rewrites. Texts are not
    shuffled. A null text stays null; an empty list replaces nothing.
    """
    spark = docs.sparkSession
    own = terms.select(F.lower("term").alias("term")).filter(F.length("term") >= least).distinct()
    parts = max(1, -(-(own.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // part_bytes))
    names = docs.columns

    def search(shared: Broadcast, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared)
            for batch in batches:
                at = {n: i for i, n in enumerate(batch.schema.names)}
                texts, before = batch.column(at[text]).to_pylist(), batch.column(at["spans"]).to_pylist()
                spans, redacted = [], []
                for t, had in zip(texts, before, strict=True):
                    found = [(x["start"], x["end"], x["term"]) for x in had] + machine.find(t or "")
                    if last:
                        found = leftmost_longest(found)
                        cut, place = [], 0
                        for start, end, _ in found:
                            cut += [t[place:start], marker]
                            place = end
                        redacted.append(None if t is None else "".join(cut) + t[place:])
                    spans.append([{"start": a, "end": b, "term": x} for a, b, x in found])
                cols = [batch.column(at[n]) for n in names] + [pa.array(redacted, pa.string()) if last else batch.column(at["redacted"]), pa.array(spans, batch.schema.field(at["spans"]).type)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "redacted", "spans"])

        return run

    out = docs.withColumns({"redacted": F.lit(None).cast("string"), "spans": F.array().cast(SPAN)})
    for part in range(parts):
        # One part of the list, of bounded bytes, is read by the driver at a time.
        listed = [r.term for r in own.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).toLocalIterator()]
        out = out.mapInArrow(search(spark.sparkContext.broadcast(listed), part == parts - 1), out.schema)
    return out
