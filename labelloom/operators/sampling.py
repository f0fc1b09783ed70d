"""Per-class sampling, top-k and ordering, exact at any class size.

No operator here brings a whole class into one task. Exact quotas are found from a histogram
of hashed order keys; top-k is taken per slice first; dense positions come from counts per
partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.hashing import order_key
from labelloom.session import cut_lineage, small_side

# 4,096 cells of the order key per class: a task's partial counts stay well below its rows, and the
# one cell to be ranked holds a 4,096th of its class.
HISTOGRAM_DIGITS = 3


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def mark_quota(
    df: DataFrame,
    label: str,
    row_id: str,
    seed: int,
    quota: Callable[[Column], Column],
    flag: str = "within",
) -> DataFrame:
    """Flag, in each class, the ``quota(class size)`` rows that come first in seeded random order.

    Rows without a class are left out here, and so by all that is drawn per class.

    1. Count rows per class and per cell of the order key (partial sums before the shuffle).
    2. Running totals over the cells give the one cell per class where the quota is reached.
    3. Rank only that cell's rows; the key at the quota is the class's cut.
    4. One pass over ``df`` compares each row's key with its class's cut: no shuffle of ``df``.
    """
    df = df.where(F.col(label).isNotNull())
    keyed = df.select(label, F.col(row_id), order_key(seed, F.col(row_id)).alias("_key"))
    cell = F.substring("_key", 1, HISTOGRAM_DIGITS)
    cells = keyed.groupBy(label, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(label)
    edge = (
        cells.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_quota", quota(F.sum("_n").over(whole)).cast("long"))
        .where((F.col("_quota") > F.col("_upto") - F.col("_n")) & (F.col("_quota") <= F.col("_upto")))
        .select(label, "_cell", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    edge = small_side(edge)
    in_edge = keyed.withColumn("_cell", cell).join(edge, [label, "_cell"])
    rank = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_key", row_id))
    cut = (
        in_edge.withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_need"))
        .select(label, F.col("_key").alias("_cut"))
    )
    marked = df.join(small_side(cut), label, "left")
    within = order_key(seed, F.col(row_id)) <= F.col("_cut")
    return marked.withColumn(flag, F.coalesce(within, F.lit(False))).drop("_cut")


def cap_per_class(df: DataFrame, max_samples: int | None, label: str = "label", row_id: str = "id", seed: int = 42) -> DataFrame:
    """At most ``max_samples`` rows of each class, drawn without replacement (``None``: all rows that have a class)."""
    if max_samples is None:
        return df.where(F.col(label).isNotNull())
    marked = mark_quota(df, label, row_id, seed, lambda n: F.least(n, F.lit(max_samples)))
    return marked.where("within").drop("within")


def random_per_class(df: DataFrame, k: int, label: str = "label", row_id: str = "id", seed: int = 42) -> DataFrame:
    """``k`` random rows of each class without replacement; classes up to ``k`` are kept whole."""
    return cap_per_class(df, k, label, row_id, seed)


def stratified_split(
    df: DataFrame, test_size: float = 0.2, label: str = "label", row_id: str = "id", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) with ``round(test_size · n)`` validation rows in each class."""
    marked = mark_quota(
        df, label, row_id, seed, lambda n: F.floor(n * F.lit(float(test_size)) + F.lit(0.5)), flag="validation"
    )
    return marked.where(~F.col("validation")).drop("validation"), marked.where("validation").drop("validation")


def top_k_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int, slices: int = 64) -> DataFrame:
    """First ``k`` rows of each group in ``order``; pass narrow rows (keys, score, id).

    Each input partition belongs to one slice, so Spark trims it to ``k`` rows per group before
    the shuffle, every slice keeps ``k`` of its own, and the last step ranks ``slices · k`` rows.
    """
    sliced = df.withColumn("_slice", F.spark_partition_id() % F.lit(slices))
    first = Window.partitionBy(group, "_slice").orderBy(*order)
    last = Window.partitionBy(group).orderBy(*order)
    kept = sliced.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k).drop("_rank", "_slice")
    return kept.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def most_confident_per_class(
    df: DataFrame, k: int, score: str = "confidence", label: str = "label", row_id: str = "id"
) -> DataFrame:
    """``k`` rows of each class with the highest probability of their own label, as (id, label, score, rank)."""
    narrow = df.where(F.col(label).isNotNull()).select(label, row_id, score)
    return top_k_per_group(narrow, label, [F.col(score).desc(), F.col(row_id)], k)


def dense_position(df: DataFrame, row_id: str, name: str = "position", partitions: int | None = None) -> DataFrame:
    """``(row_id, position)`` with 0-based positions in id order.

    Ids are range-sorted and stored once, which fixes the layout; a position is the number of
    rows in earlier partitions plus the place within the own one. Only ids are moved.
    """
    ids = df.select(row_id)
    ranged = ids.repartitionByRange(partitions, row_id) if partitions else ids.repartitionByRange(row_id)
    stored = cut_lineage(ranged.sortWithinPartitions(row_id))
    placed = stored.select(
        row_id,
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )
    # One row per partition; the running total is over that many rows.
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(small_side(offsets), "_part").select(row_id, (F.col("_before") + F.col("_place")).alias(name))


def seeded_shuffle(df: DataFrame, seed: int = 42, row_id: str = "id") -> DataFrame:
    """All rows in seeded random order (range-partitioned sort on the hashed key)."""
    return df.orderBy(order_key(seed, F.col(row_id)), F.col(row_id))


def restore_order(df: DataFrame, row_id: str = "id") -> DataFrame:
    return df.orderBy(row_id)


def head(df: DataFrame, n: int, row_id: str = "id") -> DataFrame:
    """The first ``n`` rows in id order (each task keeps ``n``, one task merges them)."""
    return df.orderBy(row_id).limit(n)
