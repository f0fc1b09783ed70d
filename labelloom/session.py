"""Session helpers: Spark settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest pool of demonstrations, in bytes, that is turned into one prompt or one file.
POOL_BYTES = 16 << 20
# Most that is sent to every task in the closure of a function, in bytes.
CLOSURE_BYTES = 32 << 20
# Settings of long jobs that store much (see `lean`).
LEAN = {
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
# Tables stored in the innermost `short_lived` block, None outside.
_short_lived: ContextVar[list[str] | None] = ContextVar("short_lived", default=None)


def get_session(app_name: str = "labelloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for (AQE, skew joins, UTC, Arrow)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, which a cluster names.

    Where it is unset, as in tests, it is a folder below the SQL warehouse.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/labelloom-runs"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def new_run_dir(spark: SparkSession, name: str = "run") -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, and readable after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store_table(df: DataFrame, path: str | None = None, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (pruned, splittable).

    Without a ``path`` it is deleted at the end of the :func:`short_lived` block it was stored in, if any.
    """
    spark = df.sparkSession
    if path is None:
        path = new_run_dir(spark, "table")
        if _short_lived.get() is not None:
            _short_lived.get().append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table of our own that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary_table(df: DataFrame, group_bytes: int | None = None) -> Iterator[DataFrame]:
    """``df`` stored, and deleted at the end. ``group_bytes`` bounds what a scan of wide rows holds at a time."""
    path = new_run_dir(df.sparkSession, "table")
    try:
        if group_bytes is not None:
            df.write.option("parquet.block.size", str(group_bytes)).parquet(path)
            yield df.sparkSession.read.schema(df.schema).parquet(path)
        else:
            yield store_table(df, path)
    finally:
        delete_table(df.sparkSession, path)


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within, without a path of their own, are deleted at the end.

    What is to be read later must be written to a path of its own within.
    """
    paths: list[str] = []
    token = _short_lived.set(paths)
    try:
        yield
    finally:
        _short_lived.reset(token)
        for path in paths:
            delete_table(spark, path)


@contextmanager
def lasting() -> Iterator[None]:
    """Tables that are stored within stay, also in a :func:`short_lived` block: for functions that callers pass in."""
    token = _short_lived.set(None)
    try:
        yield
    finally:
        _short_lived.reset(token)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Within, actions run with these settings of the session, which are read when a plan runs."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Within, actions send Python batches of about ``n_bytes``, one row at least, in place of 64 MB.

    A batch is held by the executor, whose buffers are doubled and copied as they fill, and by the
    Python worker, for every core. The setting is read when a plan runs, so the action must be within.
    """
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(n_bytes)}):
        yield


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within, tables are packed closer, an action's shuffle files go when it ends, and Python gets batches of 8 MB."""
    with settings(spark, LEAN):
        yield


def small_side(df: DataFrame) -> DataFrame:
    """``df`` stored, for the lookup side of a join: Spark knows its bytes, and broadcasts or shuffles by them."""
    return store_table(df)


def check_pool(df: DataFrame, limit: int = POOL_BYTES) -> DataFrame:
    """``df`` unchanged; an error if its strings are too large to be gathered into one row."""
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.sum(sum(strings, F.lit(16)))).first()[0] or 0
    if size > limit:
        raise ValueError(f"a pool of demonstrations holds at most {limit} bytes, this one {size}")
    return df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly per-row work, if the input comes in fewer splits than cores.

    For scans and what is computed row by row on them: counting the splits of a plan with a
    shuffle would run that shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
