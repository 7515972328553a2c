"""Words that few documents have: a combiner on the map side, then one shuffle of what may still be rare."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WORD, MARKED = re.compile("[A-Za-z]+"), re.compile(r"\[[A-Z_]+\]")
#: Terms that a task keeps in memory before it starts anew, rows of one Arrow batch, and texts that are Python strings at once.
MOST_TERMS, BATCH, TEXTS = 200_000, 50_000, 256


class Few:
    """Which words of one text after another may still be rare: once `least` documents had a term, it is passed over. Memory is bounded by `most` terms."""

    def __init__(self, least: int, shortest: int, most: int):
        self.least, self.shortest, self.most = least, shortest, most
        self.seen: dict[str, set] = {}
        self.done: set[str] = set()  # spellings of terms that have enough documents

    def of(self, text: str, doc) -> list[tuple[str, list[str]]]:
        """The text's terms with their spellings."""
        seen, forms, out = self.seen, {}, []
        for w in set(WORD.findall(text)) - self.done:
            if len(w) >= self.shortest:
                if (term := w.lower()) in forms:
                    forms[term].append(w)
                else:
                    forms[term] = [w]
        for term, spelled in forms.items():
            if (ids := seen.get(term)) is None:
                seen[term] = ids = set()
            if len(ids) >= self.least:
                self.done.update(spelled)
                continue
            if doc is not None:
                ids.add(doc)
            out.append((term, spelled))
        if len(seen) > self.most:
            seen.clear()
            self.done.clear()
        return out


def few_terms(least: int = 5, shortest: int = 1):
    """A function of a text and its doc_id: the text's terms as of occurrences(), in one array."""
    most = MOST_TERMS

    @F.arrow_udf(ArrayType(StringType()))
    def told(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        few = Few(least, shortest, most)

        def part(texts: pa.Array, docs: pa.Array) -> pa.Array:
            return pa.array([None if t is None else [term for term, _ in few.of(t, doc)] for t, doc in zip(texts.to_pylist(), docs.to_pylist(), strict=True)], pa.list_(pa.string()))

        for texts, docs in batches:
            yield pa.concat_arrays([part(texts.slice(at, TEXTS), docs.slice(at, TEXTS)) for at in range(0, max(1, len(texts)), TEXTS)])

    return told.asNondeterministic()  # what it tells depends on the texts before, so it must not be run twice


def occurrences(docs: DataFrame, least: int = 5, text: str = "text", shortest: int = 1, markers: bool = True) -> DataFrame:
    """docs without their text, with term (a word's lower case) and words (its spellings; with markers, those outside of `[NAME]` and the like).

    A row for each text and term, but once a task has met a term in `least` documents (doc_id) it leaves the rest out. So a
    term of fewer documents has all its rows, one of `least` or more has that many documents in them, and frequent words
    are not shuffled. Only terms of `shortest` letters or more.
    """
    keep = [c for c in docs.columns if c != text]
    types, most = {f.name: f.dataType.simpleString() for f in docs.schema}, MOST_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = Few(least, shortest, most)

        for batch in batches:
            own = pa.table({c: batch.column(i) for i, c in enumerate(batch.schema.names)})
            for at in range(0, own.num_rows, TEXTS):
                part = own.slice(at, TEXTS)
                rows, terms, words = [], [], []

                def out():
                    table = part.select(keep).take(pa.array(rows, pa.int64()))
                    for name, values, kind in (("term", terms, pa.string()), ("words", words, pa.list_(pa.string()))):
                        table = table.append_column(name, pa.array(values, kind))
                    rows.clear(), terms.clear(), words.clear()
                    return table.to_batches()

                for row, (t, doc) in enumerate(zip(part.column(text).to_pylist(), part.column("doc_id").to_pylist(), strict=True)):
                    if t is None:
                        continue
                    bare = set(WORD.findall(MARKED.sub(" ", t))) if markers and "[" in t else None
                    for term, spelled in few.of(t, doc):
                        rows.append(row)
                        terms.append(term)
                        words.append(spelled if bare is None else [w for w in spelled if w in bare])
                    if len(rows) > BATCH:
                        yield from out()
                if rows:
                    yield from out()

    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", term string, words array<string>")


def common_terms(docs: DataFrame, least: int = 5) -> DataFrame:
    """(term): the lower case of all words that `least` documents or more have."""
    own = occurrences(docs.select("doc_id", "text"), least).select("term", "doc_id")
    return own.groupBy("term").agg(F.count_distinct("doc_id").alias("n")).filter(F.col("n") >= least).select("term")


def rare_words(docs: DataFrame, least: int = 5, text: str = "text", markers: bool = True) -> DataFrame:
    """docs without their text, with term and word: each word of more than two letters (with markers, outside of them) whose lower case fewer than `least` documents have.

    Words inside markers count for the number of documents. A term's rows meet in a window: few of a frequent one are left.
    first_doc is the least doc_id of the documents that have such a word of the term.
    """
    own = Window.partitionBy("term")
    found = occurrences(docs, least, text, 3, markers).withColumn("_n", F.size(F.collect_set("doc_id").over(own)))
    few = found.withColumn("first_doc", F.min(F.when(F.size("words") > 0, F.col("doc_id"))).over(own)).filter(F.col("_n") < least).drop("_n")
    return few.withColumn("word", F.explode("words")).drop("words")


def routed(words: DataFrame) -> DataFrame:
    """(doc_id, page, to_review) of rare_words: as route.route_across, from the first documents that they bring along."""
    return words.groupBy("doc_id", "page").agg(F.max(F.col("doc_id") == F.col("first_doc")).alias("to_review"))
