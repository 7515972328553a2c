"""The redaction and chunking steps over a stream of files (an extension: the steps are the batch ones)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseloom.functions.patterns import PLAIN
from clauseloom.operators.split import char_chunks
from clauseloom.operators.text import redacted


def redact_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, archive: str | None = None) -> StreamingQuery:
    """Redacts and chunks Parquet documents as files arrive; processed files move to `archive` if given."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    docs = reader.parquet(source).withColumn("text", redacted(F.col("text"), PLAIN))
    return char_chunks(docs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
