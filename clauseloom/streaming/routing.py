"""Learn-then-apply routing over documents as they arrive: the set of known terms is state that outlives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clauseloom.operators.text import words


def first_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (doc_id, page, term) those of each term's least document, each page once: a hot term sends few rows."""
    least: dict[str, tuple[int, set[int]]] = {}
    for batch in batches:
        for doc, page, term in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            known = least.get(term)
            if known is None or doc < known[0]:
                least[term] = (doc, {page})
            elif doc == known[0]:
                known[1].add(page)
    rows = [(doc, sorted(pages), term) for term, (doc, pages) in least.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.string()), strict=True)], names=["doc_id", "pages", "term"])


def learn(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The pages that a term sends to review: those of the first document that brings it, if it is not known yet."""
    rows = pd.concat(list(parts))
    if not state.exists:
        first = int(rows["doc_id"].min())
        state.update((first,))
        pages = sorted({int(p) for ps in rows.loc[rows["doc_id"] == first, "pages"] for p in ps})
        yield pd.DataFrame({"doc_id": [first] * len(pages), "page": pages})


def route_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, size: int = 500, files: int = 100, archive: str | None = None) -> StreamingQuery:
    """Writes (doc_id, page) of pages that need review, as Parquet documents (doc_id, text) arrive below source.

    A page of `size` words needs review if it has a term that no document before has: none of an earlier trigger, and none of
    less id in the same one. A document that arrives late, with a less id than others before, is judged by what is known then.
    State is one number for each term. Documents without an id are passed over. A page may be written once for each of its terms.
    Processed files move to `archive` if given.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    docs = reader.parquet(source).filter("doc_id is not null")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(words(F.col("text"))).alias("at", "word")).select("doc_id", (F.floor(F.col("at") / size) + 1).alias("page"), F.lower("word").alias("term"))
    least = rows.mapInArrow(first_in_batch, "doc_id bigint, pages array<bigint>, term string")
    new = least.groupBy("term").applyInPandasWithState(learn, "doc_id bigint, page bigint", "first bigint", "append", GroupStateTimeout.NoTimeout)
    return new.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def routed(pages: DataFrame, sink: DataFrame) -> DataFrame:
    """pages (doc_id, page) with to_review, from what route_stream wrote."""
    return pages.join(sink.distinct().withColumn("to_review", F.lit(True)), ["doc_id", "page"], "left").withColumn("to_review", F.coalesce("to_review", F.lit(False)))
