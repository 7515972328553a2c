"""The external reviewer, as an injectable function of a batch of texts, with a deterministic default and isolated failures."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from clauseloom.functions.patterns import LIBRARY_B

RULES = [re.compile(p) for _, p in LIBRARY_B]


def rule_reviewer(text: str) -> str:
    """`FOUND` and what was found, or `CLEAR`."""
    found = [m[0] for p in RULES for m in [p.search(text)] if m]
    return "FOUND: " + "; ".join(found) if found else "CLEAR"


def review(chunks: DataFrame, reviewer: Callable[[str], str] = rule_reviewer) -> DataFrame:
    """(doc_id, chunk_order, has_pii, review, error). A call that fails leaves has_pii false and says why. Ids may be of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, errors = [], []
            for text in batch.column(2).to_pylist():
                try:
                    replies.append(reviewer(text or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one text's failure is a value
                    replies.append("")
                    errors.append(str(e))
            found = pa.array([r.upper().startswith("FOUND") for r in replies], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "chunk_order", "has_pii", "review", "error"])

    own = chunks.select("doc_id", "chunk_order", "content")
    kinds = dict(own.dtypes)
    return own.mapInArrow(run, f"doc_id {kinds['doc_id']}, chunk_order {kinds['chunk_order']}, has_pii boolean, review string, error string")
