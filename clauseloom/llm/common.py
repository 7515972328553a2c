"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; one longer text is worked on alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only on a single machine (a local master, as in tests) a temporary folder stands in where it is unset.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Removes a query's shuffle files when it ends, rather than when the driver's collector meets them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends at files that every executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    except Exception:
        delete(spark, path)
        raise
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote. Only for tables that nothing still to be computed reads."""
    for df in tables:
        delete(df.sparkSession, df._stored_at)


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], n: str, most: int = 1000) -> DataFrame:
    """many (stored) with few, which has one row for each key and in `n` the number of its rows in many.

    At most `most` keys can have more than that part of many's rows: their rows of few are broadcast, so no task gets all
    rows of a hot key. All other keys meet by shuffle.
    """
    total = many.count()
    hot, cold = few.filter(F.col(n) * most > total).drop(n), few.filter(F.col(n) * most <= total).drop(n)
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys)
    return many.join(F.broadcast(hot), keys).unionByName(rest)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in pieces of at most `most` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(np.asarray(size, dtype=np.int64))
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        before, start = int(ends[stop - 1]), stop


def give_back() -> None:
    """Returns freed memory to the system, as a worker lives on between tasks of different operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_slices(
    df: DataFrame, kernel: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, text: str = "text"
) -> DataFrame:
    """df through a kernel that is made once for each task and applied to slices of its Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for piece in slices(batch, text):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out
        del work
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The batch's texts; null is the empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def fold_of(id_column: str, parts: int):
    """crc32 of the id's decimal text, modulo parts: the fold that contracts name."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and where each text starts (one more entry than texts)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
