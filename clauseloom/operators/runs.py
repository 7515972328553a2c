"""Replacing strings in paragraphs that are made of runs, each with a style of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.spans import Terms


def chosen(text: str, found: list[tuple[int, int, str]], turn: dict[str, int]) -> list[tuple[int, int, str]]:
    """Of all matches those of the first changes, and from the left; a match that meets an earlier choice is left out."""
    taken, out = bytearray(len(text)), []
    for start, end, original in sorted(found, key=lambda x: (turn[x[2]], x[0])):
        if 1 not in taken[start:end]:
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, original))
    return sorted(out)


def rewritten(runs: list[str], spans: list[tuple[int, int, str]], new: dict[str, str]) -> list[str]:
    """The runs' texts after the spans of their joined text: a span's new text stands in the run where it starts; the rest of it is cut."""
    out, at, k = [], 0, 0
    for run in runs:
        end, place, parts = at + len(run), at, []
        while k < len(spans) and spans[k][0] < end:
            a, b, original = spans[k]
            if a >= at:
                parts += [run[place - at : a - at], new[original]]
            place = min(b, end)
            if b > end:  # it goes on in the next run
                break
            k += 1
        out.append("".join([*parts, run[place - at :]]))
        at = end
    return out


class Exact(Terms):
    """Matches of strings as they stand, inside words too."""

    def find(self, text: str) -> list[tuple[int, int, str]]:
        return [(last + 1 - len(t), last + 1, t) for last, t in self.automaton.iter(text)] if self.some else []


def apply_to_runs(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """runs (doc_id, para_no, run_no, text, style) after changes (doc_id, seq, original, placeholder): rows, order and styles stay.

    Every occurrence of an original in a paragraph's joined text is replaced, also where it spans runs: the run in which it
    starts gets the placeholder and the following ones lose their part. Earlier changes take their places first. A document's
    runs and changes meet in one task; paragraphs without a change pass through as they are. Empty originals do nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    names = ["doc_id", "para_no", "run_no", "text", "style"]

    def work(mine: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = mine.select(names)
        rows = rows.take(pc.sort_indices(rows, [("para_no", "ascending"), ("run_no", "ascending")]))
        listed = sorted((r for r in wanted.to_pylist() if r["original"]), key=lambda r: r["seq"])
        new, turn = {}, {}
        for r in listed:
            if r["original"] not in new:
                new[r["original"]], turn[r["original"]] = r["placeholder"] or "", len(turn)
        machine, texts = Exact(list(new)), rows.column("text").to_pylist()
        # One search over the document; the paragraphs that it meets are searched by themselves.
        ends = np.cumsum(np.fromiter((len(t or "") for t in texts), dtype=np.int64, count=len(texts)))
        met = machine.find("".join(t or "" for t in texts))
        if not met:
            return rows
        paras = rows.column("para_no").to_pylist()
        starts = np.array([k for k in range(len(paras)) if k == 0 or paras[k] != paras[k - 1]])
        at_run = np.searchsorted(ends, np.array([start for start, _, _ in met]), side="right")
        for p in np.unique(np.searchsorted(starts, at_run, side="right") - 1).tolist():
            at, end = int(starts[p]), int(starts[p + 1]) if p + 1 < len(starts) else len(texts)
            own = [t or "" for t in texts[at:end]]
            whole = "".join(own)
            spans = chosen(whole, machine.find(whole), turn)
            if spans:
                texts[at:end] = rewritten(own, spans, new)
        return rows.set_column(names.index("text"), rows.schema.field("text"), pa.array(texts, rows.schema.field("text").type))

    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    return runs.select(*names).groupBy("doc_id").cogroup(changes.select("doc_id", "seq", "original", "placeholder").groupBy("doc_id")).applyInArrow(work, schema)


def runs_of(paragraphs: DataFrame, size: int) -> DataFrame:
    """paragraphs (doc_id, para_no, text) cut into runs of `size` characters: doc_id, para_no, run_no (from 1), text, style (null)."""
    parts = paragraphs.select("doc_id", "para_no", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("parts"))
    rows = parts.select("doc_id", "para_no", F.posexplode_outer("parts").alias("k", "text")).filter("text is not null")
    return rows.select("doc_id", "para_no", (F.col("k") + 1).alias("run_no"), "text", F.lit(None).cast("string").alias("style"))
