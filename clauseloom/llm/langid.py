"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters, with a blank for everything else; their 1- to 3-grams are hashed
into buckets. Training counts buckets for each language over a bounded sample of labelled rows, on the
executors, and sums them; the smoothed log-probability matrix is broadcast (its size depends on
buckets and languages only). Scoring is sparse and in batches: the rows of the matrix for all n-grams
of a slice of texts are gathered and summed by text in numpy.

Null texts and texts without letters get `und` and score 0. With no labelled row every text does.
Ties go to the language that sorts first. Very long texts are scored whole. Repeated rows are all kept, an empty
table gives an empty result, and other columns are neither read nor carried.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import code_points, column, map_slices, texts_of

BUCKETS = 1 << 15
BLANK = 32
#: Around each text, so that no n-gram holds letters of two.
BEFORE, AFTER = " ", "  "


@functools.cache
def letters() -> np.ndarray:
    """Each code point as a lower-case letter, or BLANK."""
    out = np.full(0x110000, BLANK, dtype=np.uint32)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    for m in regex.finditer(r"\p{L}", every):
        out[m.start()] = ord(m[0].lower()[0])
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all n-grams (one row for each order; BUCKETS: none), where texts start, which have letters."""
    points, starts = code_points([BEFORE + t + AFTER for t in texts])
    s = letters()[points].astype(np.uint64)
    some = s != BLANK
    has = np.add.reduceat(some, starts[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    one, two = np.roll(s, -1), np.roll(s, -2)
    live = some | np.roll(some, -1)
    out = np.empty((3, len(s)), dtype=np.int32)
    h = s * np.uint64(0x9E3779B97F4A7C15)
    for k, more in enumerate((None, one, two)):
        if more is not None:
            h = (h ^ (more + np.uint64(k))) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
        out[k] = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49)).astype(np.int32)
        out[k][~(some if k == 0 else live)] = BUCKETS
    return out, starts, has


@dataclass
class LanguageModel:
    langs: list[str]
    #: (BUCKETS + 1, languages); the last row, of no n-gram, is 0.
    log_probs: np.ndarray
    priors: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        found, starts, has = grams(texts)
        total = np.tile(self.priors, (len(texts), 1))
        for row in found:
            total += np.add.reduceat(self.log_probs[row], starts[:-1], axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, share, 0.0)


def train(labelled: DataFrame, max_docs: int = 20_000, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """Fits on a sample of labelled rows of about max_docs at most (all, if fewer), chosen by a hash of the id."""
    rows = labelled.filter(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    n = rows.count()
    share = min(1.0, max_docs / max(n, 1))
    sample = rows.filter(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            langs = column(batch, lang_column).to_pylist()
            found, starts, _ = grams(texts_of(batch, text_column))
            out = []
            for lang in sorted(set(langs)):
                mine = np.repeat(np.array([x == lang for x in langs]), np.diff(starts))
                n = np.bincount(found[:, mine].ravel(), minlength=BUCKETS + 1)[:BUCKETS]
                at = np.flatnonzero(n)
                out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out and sum(x.num_rows for x in out) else None

        return work

    counted = map_slices(sample.select(text_column, lang_column), kernel, "lang string, bucket int, n bigint", text_column)
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows for a language
    docs = {r[0]: r[1] for r in sample.groupBy(lang_column).count().collect()}
    langs = sorted(x for x in docs if x in set(sums["lang"]))
    counts = np.zeros((BUCKETS, len(langs)))
    for k, lang in enumerate(langs):
        mine = sums[sums["lang"] == lang]
        counts[mine["bucket"].to_numpy(), k] = mine["n"].to_numpy()
    counts += 0.5
    log_probs = np.zeros((BUCKETS + 1, len(langs)), dtype=np.float32)
    log_probs[:BUCKETS] = np.log(counts / counts.sum(axis=0))
    priors = np.log(np.array([docs[x] for x in langs], dtype=np.float64) / max(1, sum(docs[x] for x in langs)))
    return LanguageModel(langs, log_probs, priors)


def identify(df: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id, lang_pred and score (the posterior probability)."""
    kind = dict(df.dtypes)[id_column]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = shared.value.score(texts_of(batch, text_column))
            return pa.RecordBatch.from_arrays([column(batch, id_column), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_column, "lang_pred", "score"])

        return work

    return map_slices(df.select(id_column, text_column), kernel, f"`{id_column}` {kind}, lang_pred string, score double", text_column)
