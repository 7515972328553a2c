"""Operator 13: point-in-time feature join by a sweep line with a lazy heap.

Versions of a key are usable from `start` (the later of event and arrival) until before `expiry`; of those usable at
a query's time the latest event wins, then the earliest arrival, then the largest id. Time is whole seconds.

Each key's time is cut into chunks. A version comes into every chunk that its interval meets, at the chunk's first
second if it was carried in. A chunk's rows come in order of time, versions before queries; versions enter a heap
ordered by who wins, and before each query expired versions are discarded from the top only.

Cells (a key in CELL seconds) that hold more than 1/`share` of all rows are cut into shorter chunks in proportion, so
no chunk has much more than that share. There are at most `share` such cells; their list alone is broadcast.
Queries of the same key and time are asked once; versions that differ in the id only are one, the largest. Rows are
dealt by key and chunk and sorted there by Spark; a task holds the versions that are active in one chunk. A version
is copied lifetime over chunk times, so lifetimes should be of a cell's order; longer ones stay right but cost more.

Versions with a null key, time or id, or that expire before they start, are never usable; queries with a null key or
time have no winner.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import stored

#: Seconds of a cell, a power of two.
CELL = 1024


def sweep(rows: Iterator[pa.RecordBatch], payload: list[str]) -> Iterator[pa.RecordBatch]:
    """Answers of one task's rows, which come by key, chunk, time, and versions (kind 0) before queries (kind 1)."""
    names = ["key", "chunk", "at", "kind", "event", "arrival", "expiry", "id", *payload]
    now, heap = None, []
    for batch in rows:
        out = []
        for key, chunk, at, kind, event, arrival, expiry, id_, *rest in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
            if (key, chunk) != now:
                now, heap = (key, chunk), []
            if kind == 0:
                heapq.heappush(heap, (-event, arrival, -id_, expiry, rest))
                continue
            while heap and heap[0][3] <= at:
                heapq.heappop(heap)
            if heap:
                event, _, id_, _, rest = heap[0]
                out.append((key, at, -id_, -event, *rest))
        if out:
            kinds = [batch.schema.field(n).type for n in ("key", "at", "id", "event", *payload)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "at", "id", "event", *payload])


def winners(versions: DataFrame, queries: DataFrame, payload: list[str], share: int = 400) -> DataFrame:
    """key, at, id, event and payload of the winner for each distinct (key, at) of queries that has one.

    versions: key, event, arrival, expiry, id and payload columns of plain types; queries: key, at. Times and ids are long.
    """
    start = F.greatest("event", "arrival")
    order = F.struct(*(F.struct(F.col(c).isNotNull(), c) for c in ("id", *payload)))  # the largest id, then the largest payload
    usable = versions.filter("key is not null and id is not null and event is not null and arrival is not null").filter(start < F.col("expiry")).withColumn("start", start)
    one = usable.groupBy("key", "event", "arrival", "expiry", "start").agg(F.max_by(F.struct("id", *payload), order).alias("w")).select("key", "event", "arrival", "expiry", "start", "w.*")
    own = stored(one, "versions")
    asked = stored(queries.filter("key is not null and at is not null").select("key", "at").distinct(), "queries")
    cell = lambda t: F.floor(F.col(t) / CELL)
    sizes = stored(own.select("key", cell("start").alias("cell")).unionByName(asked.select("key", cell("at").alias("cell"))).groupBy("key", "cell").agg(F.count("*").alias("n")), "cells")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # At most `share` cells can hold more than total / share rows each.
    cuts = F.least(F.lit(CELL), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") * share / F.lit(max(total, 1))))).cast("int"))
    large = F.broadcast(sizes.filter(F.col("n") * share > total).select("key", "cell", (F.lit(CELL) / cuts).cast("bigint").alias("width")))

    def cut(df: DataFrame) -> DataFrame:
        return df.join(large, ["key", "cell"], "left").withColumn("width", F.coalesce("width", F.lit(CELL).cast("bigint")))

    spread = own.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("expiry") - 1) / CELL))))
    first, last = F.greatest("start", F.col("cell") * CELL), F.least(F.col("expiry") - 1, F.col("cell") * CELL + CELL - 1)
    into = cut(spread).withColumn("chunk", F.explode(F.sequence(F.floor(first / F.col("width")), F.floor(last / F.col("width"))))).withColumn("chunk", F.col("chunk") * F.col("width"))
    kinds = {c: own.schema[c].dataType for c in ("event", "arrival", "expiry", "id", *payload)}
    left = into.select("key", "chunk", F.greatest("start", "chunk").alias("at"), F.lit(0).alias("kind"), *kinds)
    right = cut(asked.withColumn("cell", cell("at"))).select("key", (F.floor(F.col("at") / F.col("width")) * F.col("width")).alias("chunk"), "at", F.lit(1).alias("kind"), *(F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()))
    rows = left.unionByName(right).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "at", "kind")
    schema = f"key {own.schema['key'].dataType.simpleString()}, at bigint, id bigint, event bigint" + "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in payload)
    return rows.mapInArrow(lambda batches: sweep(batches, payload), schema)


def point_in_time(queries: DataFrame, versions: DataFrame, payload: list[str], share: int = 400) -> DataFrame:
    """All rows and columns of queries (key, at and others) with version_id, event and payload of the winner, null without one."""
    found = winners(versions, queries, payload, share).select("key", "at", F.col("id").alias("version_id"), "event", *payload)
    return queries.join(found, ["key", "at"], "left")
