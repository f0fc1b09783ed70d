"""Helpers shared by the operators: sizes, Arrow batches of text, bounded blocks."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that one numpy pass looks at, in bytes; a longer document is a pass of its own.
PASS_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, counted over all rows by one aggregate."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).head()[0] or 0


def parts_for(n_bytes: int, target: int, least: int = 1) -> int:
    """How many parts of ``target`` bytes hold ``n_bytes``."""
    return max(least, math.ceil(n_bytes / target))


def cores(df: DataFrame) -> int:
    return max(2, df.sparkSession.sparkContext.defaultParallelism)


def text_slices(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes each, at least one row."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def append_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    work: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """``df`` with computed columns; an input column of the same name is replaced.

    ``work`` is called once per task and returns a function from a batch of at most about
    :data:`PASS_BYTES` of text to the new columns.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in batches:
            for start, stop in text_slices(batch.column(text)):
                part = batch.slice(start, stop - start)
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays(columns + compute(part), names=names)

    return df.mapInArrow(run, T.StructType(kept + fields))


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T.DataType.fromDDL(kind))


def share(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcast a value of bounded size; the function returned gives it back in a task.

    Pickled by value, so that executors need not have this package installed.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def crc_mod(column: str, n: int):
    """crc32 of an id as text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(n)
