"""Operator 8: repeated long passages, by a compacted de Bruijn graph of word windows.

Windows of `window` consecutive words are the edges of a de Bruijn graph over texts. Each text's
path is cut where the least-hashed `anchor`-word sequence of its windows changes, so equal windows
always fall to pieces with equal anchors; a piece is a nonbranching run of edges, known by its anchor and a
hash of all its words, and compacts some twenty windows to one row. Joins on anchors and pieces then find
the graph's repeated parts: a piece that recurs whole is judged as one; only where one anchor has pieces of
different words (the path branches nearby) are windows told apart one by one (by the anchor and two hashes),
once for each distinct piece rather than for each occurrence. Source coordinates (text, first word, windows)
lead from repeated pieces back to words: those at the first source are read and digested, and words are removed
elsewhere only if theirs have that digest too.

A word is removed if it lies in a window that also starts in a text with a smaller id; a null id is
larger than all others (and ties with the largest bigint). Ids must be integers. Null, empty and white-space
texts have no words; texts shorter than a window lose nothing; very long texts are read whole. Rows with equal
ids do not remove from each other. All rows come back, repeated ones too; an empty table gives an empty
result. Other columns are not read; `carry` brings them along, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import column, discard, map_slices, mixed, spread_join, stored, texts_of

LAST = (1 << 63) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Distinct words whose hashes a worker keeps.
MOST_WORDS = 200_000


class WordHashes(dict):
    """The 64-bit hash of a word (bytes)."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 8)
        if len(word) <= 40:
            self[word] = h
        return h


@functools.cache
def word_hashes() -> WordHashes:
    return WordHashes()


def split_words(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ in UTF-8: bytes.split() cuts at just these characters."""
    return text.encode().split()


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' word hashes in one array, and where each text starts (one more entry than texts)."""
    known = word_hashes()
    if len(known) > MOST_WORDS:
        known.clear()
    words = [split_words(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    return np.fromiter((h for ws in words for h in map(known.__getitem__, ws)), dtype=np.uint64, count=int(starts[-1])), starts


class Sums:
    """Hashes of any run of words from prefix sums, modulo 2^64."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        power = np.full(n + 1, BASE)
        power[0] = 1
        self.back = np.full(n + 1, INVERSE)
        self.back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * power[:n], dtype=np.uint64)))

    def runs(self, start: np.ndarray, size) -> np.ndarray:
        size = np.asarray(size)
        return mixed((self.sums[start + size] - self.sums[start]) * self.back[start] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """For each start of a run of `width` values, the first place of its smallest."""
    at, span = np.arange(len(values)), 1

    def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while 2 * span <= width:
        at = smaller(at[: len(at) - span], at[span:])
        span *= 2
    if width > span:
        at = smaller(at[: len(at) - (width - span)], at[width - span :])
    return at


def pieces(hashes: np.ndarray, starts: np.ndarray, window: int, anchor: int):
    """Of all texts at once: for each piece its text, first window (word index in the text), windows, anchor and content hashes."""
    none = np.zeros(0, dtype=np.int64)
    n = len(hashes) - window + 1
    if n <= 0:
        return none, none, none, none, none
    sums = Sums(hashes)
    marks = sums.runs(np.arange(len(hashes) - anchor + 1), anchor)
    place = least(marks, window - anchor + 1)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = text[:n] == text[window - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (text[1:n] != text[: n - 1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none, none
    edge = np.concatenate((np.flatnonzero(new | ~inside), [n]))
    last = edge[np.searchsorted(edge, first, side="right")]
    size = last - first
    return text[first], first - starts[text[first]], size, marks[place[first]].view(np.int64), sums.runs(first, size + window - 1).view(np.int64)


def row_ids(id_column: str, text_column: str) -> tuple[Column, Column]:
    """rid and rid2: 128 bits that tell rows apart by id and text; equal rows share them."""
    id_, text = F.col(id_column), F.col(text_column)
    return F.xxhash64(id_, text, text.isNull()).alias("rid"), F.xxhash64(F.lit(1), text, id_, id_.isNull()).alias("rid2")


def find_pieces(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            text, start, size, mark, content = pieces(*hashed(texts_of(batch)), window, anchor)
            rows = pa.array(text, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(mark, pa.int64()), pa.array(content, pa.int64()), *(column(batch, c).take(rows) for c in ("rid", "rid2", "doc")), pa.array(start, pa.int32()), pa.array(size, pa.int32())],
                names=["mark", "content", "rid", "rid2", "doc", "start", "windows"],
            )

        return work

    return map_slices(docs.select("rid", "rid2", "doc", "text"), kernel, "mark bigint, content bigint, rid bigint, rid2 bigint, doc bigint, start int, windows int")


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def find_windows(wanted: DataFrame, window: int) -> DataFrame:
    """For each piece that a text is wanted for, a row with the digest of its words (index -1), and if it branches one for each window.

    wanted: text, parts (mark, content, branches, start, windows, first).
    """

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            texts = texts_of(batch)
            hashes, starts = hashed(texts)
            parts = column(batch, "parts")
            flat = parts.flatten()
            start, size = (np.asarray(flat.field(k), dtype=np.int64) for k in ("start", "windows"))
            if not len(start):
                return None
            text = np.repeat(np.arange(batch.num_rows), np.asarray(parts.value_lengths()))
            digests, words, last = [], [], -1
            for t, s, n in zip(text.tolist(), start.tolist(), size.tolist(), strict=True):
                if t != last:
                    words, last = split_words(texts[t]), t
                digests.append(digest(words[s : s + n + window - 1]))
            open_ = np.flatnonzero(np.asarray(flat.field("branches").to_numpy(zero_copy_only=False), dtype=bool))
            index = np.concatenate([np.arange(k) for k in size[open_]] or [np.zeros(0, np.int64)])
            owner = np.repeat(open_, size[open_])
            at = np.repeat((starts[text] + start)[open_], size[open_]) + index
            found = [Sums(h).runs(at, window).view(np.int64) for h in (hashes, mixed(hashes))]
            none = np.zeros(len(start), np.int64)
            every = pa.array(np.concatenate((np.arange(len(start)), owner)))
            return pa.RecordBatch.from_arrays(
                [*(flat.field(k).take(every) for k in ("mark", "content", "first")), pa.array(np.concatenate((none - 1, index)), pa.int32()), *(pa.array(np.concatenate((none, f))) for f in found), pa.array([*digests, *[None] * len(owner)], pa.binary())],
                names=["mark", "content", "first", "index", "word_window", "check", "digest"],
            )

        return work

    return map_slices(wanted, kernel, "mark bigint, content bigint, first bigint, index int, word_window bigint, check bigint, digest binary")


def cut_words(joined: DataFrame, window: int, through: list[str]) -> DataFrame:
    """Applies the spans (start, windows, digest of their words, some: indexes of the windows, null for all) to texts."""

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, removed, kept = [], [], []
            for text, spans in zip(texts_of(batch), column(batch, "spans").to_pylist(), strict=True):
                words = split_words(text)
                total.append(len(words))
                if spans:
                    hit = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in spans:
                        if digest(words[s["start"] : s["start"] + s["windows"] + window - 1]) != bytes(s["digest"]):
                            continue  # other words of the same hash
                        at = s["start"] + (np.arange(s["windows"]) if s["some"] is None else np.array(s["some"], dtype=np.int64))
                        hit[at] = 1
                    starts = np.flatnonzero(hit)
                    cover = np.zeros(len(words) + window + 1, dtype=np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + window, -1)
                    gone = np.cumsum(cover)[: len(words)] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            return pa.RecordBatch.from_arrays([*(column(batch, c) for c in through), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*through, "n_words", "n_removed", "kept"])

        return work

    kinds = dict(joined.dtypes)
    return map_slices(joined, kernel, ", ".join(f"`{c}` {kinds[c]}" for c in through) + ", n_words bigint, n_removed bigint, kept string")


def remove_repeats(df: DataFrame, window: int = 50, anchor: int = 8, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """Each row's rid, rid2, id, n_words, n_removed and kept (the words kept, joined by one space).

    carry: the whole row too, as the struct `row`.
    """
    kind = dict(df.dtypes)[id_column]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_column}: ids must be integers, not {kind}")
    docs = df.select(*row_ids(id_column, text_column), F.coalesce(F.col(id_column).cast("bigint"), F.lit(LAST)).alias("doc"), F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = stored(find_pieces(docs, window, anchor), "pieces")
    # Anchors of more than one text; each is judged by its pieces.
    marks = found.groupBy("mark").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), (F.min("content") != F.max("content")).alias("branches"), F.count("*").alias("n"))
    repeated = stored(marks.filter("low < high").select("mark", "branches", "n"), "marks")
    places = stored(spread_join(found, repeated, ["mark"], "n"), "places")
    discard(found, repeated)
    distinct = places.groupBy("mark", "content", "branches").agg(F.min(F.struct("doc", "rid", "rid2", "start", "windows")).alias("source"), F.max("doc").alias("last"), F.count("*").alias("n"))
    distinct = stored(distinct.filter("branches or source.doc < last"), "distinct")
    # Words of one source of each distinct piece: their digest, and the windows of branching anchors.
    parts = distinct.select("source.rid", "source.rid2", F.struct("mark", "content", "branches", F.col("source.start").alias("start"), F.col("source.windows").alias("windows"), F.col("source.doc").alias("first")).alias("part"))
    wanted = parts.groupBy("rid", "rid2").agg(F.collect_list("part").alias("parts"))  # at most as many as the text has windows
    sources = docs.select("rid", "rid2", "text").join(wanted.hint("merge"), ["rid", "rid2"]).dropDuplicates(["rid", "rid2"]).select("text", "parts")
    windows = stored(find_windows(sources, window), "windows")
    each = windows.filter("index >= 0")
    same = ["mark", "word_window", "check"]
    lowest = each.groupBy(*same).agg(F.min("first").alias("low"), F.max("first").alias("high")).filter("low < high").select(*same, "low")
    lower = each.join(lowest.hint("merge"), same).filter("low < first").groupBy("mark", "content").agg(F.sort_array(F.collect_set("index")).alias("some"))
    # A piece goes whole where its first source is another text, else by its windows that occur earlier elsewhere.
    sized = windows.filter("index < 0").select("mark", "content", "first", "digest").join(distinct.select("mark", "content", "n"), ["mark", "content"])
    judged = stored(sized.join(lower, ["mark", "content"], "left"), "judged")
    discard(distinct, windows)
    hits = spread_join(places, judged, ["mark", "content"], "n").filter("doc > first or some is not null")
    hits = hits.select("rid", "rid2", F.struct("start", "windows", "digest", F.when(F.col("doc") > F.col("first"), F.lit(None)).otherwise(F.col("some")).alias("some")).alias("span"))
    spans = hits.groupBy("rid", "rid2").agg(F.collect_set("span").alias("spans")).hint("merge")
    through = ["rid", "rid2", id_column, *["row"] * carry]
    if carry:
        docs = df.select(*row_ids(id_column, text_column), F.col(id_column), F.struct(*df.columns).alias("row"))
        text = F.coalesce(F.col(f"row.{text_column}"), F.lit("")).alias("text")
        joined = docs.join(spans, ["rid", "rid2"], "left").select(*through, text, "spans")
    else:
        joined = docs.select("rid", "rid2", id_column, "text").join(spans, ["rid", "rid2"], "left")
    return cut_words(joined, window, through)
