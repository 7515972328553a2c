"""The JSON array in a model's reply, also where the reply is cut off or there is other text around it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZEROS = re.compile(r"(:\s*-?)0+(?=\d)")
CONTROL = re.compile(r"[\x00-\x1f]")
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def mended(element: str) -> str:
    """Control characters as blanks; numbers without leading zeros, outside strings only."""
    out, at = [], 0
    for m in STRING.finditer(element):
        out += [ZEROS.sub(r"\1", element[at : m.start()]), m[0]]
        at = m.end()
    return CONTROL.sub(" ", "".join([*out, ZEROS.sub(r"\1", element[at:])]))


def elements(text: str, start: int) -> tuple[list[str], int]:
    """The whole objects of the array that opens at start, and where it ends: a cut-off last object is left out."""
    out, depth, begun, quoted, i = [], 0, None, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            if depth == 2 and c == "{":
                begun = i
        elif c in "]}":
            depth -= 1
            if depth == 1 and c == "}" and begun is not None:
                out.append(text[begun : i + 1])
                begun = None
            if depth <= 0:
                return out, i + 1
        i += 1
    return out, len(text)


def parsed(text: str, start: int) -> list[str]:
    out = []
    for e in elements(text, start)[0]:
        try:
            out.append(json.dumps(json.loads(mended(e)), ensure_ascii=False))
        except ValueError:
            continue
    return out


def array_of(reply: str) -> list[str]:
    """The objects of a reply's array, each as mended JSON.

    Fenced parts come first, in order, then the reply outside them; in each the arrays are tried where they open, and the first
    that holds a whole, readable object is it. So brackets in prose, an empty fence and a repeated fence line are passed over.
    """
    inside, outside, fenced = [], [], False
    for line in reply.split("\n"):
        if line.strip().startswith("```"):
            if fenced and line.strip() == "```":
                fenced = False
            elif not fenced or inside[-1]:
                inside.append([])
                fenced = True
            continue
        (inside[-1] if fenced else outside).append(line)
    for part in [*inside, outside]:
        text = "\n".join(part)
        at = text.find("[")
        while at >= 0:
            if found := parsed(text, at):
                return found
            at = text.find("[", at + 1)
    return []


def recommendations(replies: DataFrame, schema: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, seq (from 1) and the fields of schema for each object of a reply's array; a reply without one gives no rows."""
    kinds = {f.name: f.dataType.simpleString() for f in replies.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            items = [array_of(t or "") for t in batch.column(at[text]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[k]) for k in keep), pa.array(items, pa.list_(pa.string()))], names=[*keep, "items"])

    found = replies.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", items array<string>")
    rows = found.select(*keep, F.posexplode_outer("items").alias("k", "item")).filter("item is not null")
    return rows.select(*keep, (F.col("k") + 1).alias("seq"), F.from_json("item", f"struct<{schema}>").alias("r")).select(*keep, "seq", "r.*")
