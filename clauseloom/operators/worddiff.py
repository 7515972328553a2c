"""The least word-level edit script of two versions, in linear space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.batches import pieces

RUNS = "array<struct<kind:string,words:array<string>>>"


def common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """For each head of b the length of its longest common subsequence with a, by bit-parallel rows over b."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        m = where.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def kept(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence: halves of a meet where both halves' lengths add up to the most."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        if i_end - i == 1:
            at = next((k for k in range(j, j_end) if b[k] == a[i]), None)
            out += [(i, at)] if at is not None else []
            continue
        middle = (i + i_end) // 2
        ahead = common_lengths(a[i:middle], b[j:j_end])
        back = common_lengths(a[middle:i_end][::-1], b[j:j_end][::-1])[::-1]
        cut = j + int(np.argmax(ahead + back))
        todo += [(i, middle, j, cut), (middle, i_end, cut, j_end)]
    return sorted(out)


def script(old: list[str], new: list[str]) -> list[tuple[str, list[str]]]:
    """Runs of words that both have (` `), only old has (`-`) and only new has (`+`), in order; as many words kept as can be."""
    both = set(old) & set(new)
    number: dict[str, int] = {}
    # Words of one side only cannot be kept: they are taken out before and come back in their places.
    a, b = ([i for i, w in enumerate(ws) if w in both] for ws in (old, new))
    pairs = kept(*([number.setdefault(ws[i], len(number)) for i in at] for ws, at in ((old, a), (new, b))))
    out: list[tuple[str, list[str]]] = []

    def put(kind: str, ws: list[str]) -> None:
        if ws and out and out[-1][0] == kind:
            out[-1][1].extend(ws)
        elif ws:
            out.append((kind, list(ws)))

    i = j = 0
    for x, y in [*((a[x], b[y]) for x, y in pairs), (len(old), len(new))]:
        put("-", old[i:x])
        put("+", new[j:y])
        put(" ", old[x : x + 1])
        i, j = x + 1, y + 1
    return out


def word_diff(pairs: DataFrame, old: str = "old_text", new: str = "new_text") -> DataFrame:
    """pairs with `runs`: structs of kind (` `, `-`, `+`) and words, whose ` ` and `-` words are the old version's and whose ` ` and `+` words the new one's.

    The script keeps the most words that any script keeps. Words are what white space of any kind parts; a null version has none.
    """
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            made = [script((a or "").split(), (b or "").split()) for a, b in zip(cols[old].to_pylist(), cols[new].to_pylist(), strict=True)]
            runs = pa.array([[{"kind": k, "words": ws} for k, ws in m] for m in made], pa.list_(pa.struct([("kind", pa.string()), ("words", pa.list_(pa.string()))])))
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in names), runs], names=[*names, "runs"])

    return pairs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + f", runs {RUNS}")


def side(runs: Column, kind: str) -> Column:
    """The words of one version, `-` for the old and `+` for the new, joined by a blank."""
    return F.array_join(F.flatten(F.transform(F.filter(runs, lambda r: r["kind"].isin(" ", kind)), lambda r: r["words"])), " ")


def unified(runs: Column, context: int = 3) -> Column:
    """Lines of a unified view: changed words with `-` or `+` before them, and up to `context` kept words around each change; `...` for words left out."""

    def shown(r: Column, i: Column) -> Column:
        marked = F.transform(r["words"], lambda w: F.concat(r["kind"], w))
        n, last = F.size(marked), F.size(runs) - 1
        head, tail = F.when(i == 0, 0).otherwise(context), F.when(i == last, 0).otherwise(context)
        cut = F.concat(F.slice(marked, F.lit(1), head), F.array(F.lit("...")), F.slice(marked, n - tail + 1, tail))
        return F.when((r["kind"] == " ") & (n > head + tail), cut).otherwise(marked)

    return F.when(F.size(F.filter(runs, lambda r: r["kind"] != " ")) > 0, F.flatten(F.transform(runs, shown))).otherwise(F.array().cast("array<string>"))
