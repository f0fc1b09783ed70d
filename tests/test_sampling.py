import hashlib

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from labelloom.operators import sampling as S
from labelloom.operators.joins import fan_out_join, without_keys


@pytest.fixture(scope="module")
def rows(spark):
    """One class holds most of the rows."""
    label = F.when(F.col("id") % 10 < 7, F.lit("big")).when(F.col("id") % 10 < 9, F.lit("mid")).otherwise(F.lit("tiny"))
    return spark.range(0, 3000, 1, 5).select("id", label.alias("label"), F.concat(F.lit("t"), F.col("id")).alias("text"))


def order(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def first_in_order(rows, seed, quota):
    classes = {}
    for r in rows.collect():
        classes.setdefault(r["label"], []).append(r["id"])
    return {i for ids in classes.values() for i in sorted(ids, key=lambda i: order(seed, i))[: quota(len(ids))]}


@pytest.mark.parametrize("k", [1, 17, 400, 5000])
def test_cap_is_exact_and_ignores_partitioning(rows, k):
    expected = first_in_order(rows, 42, lambda n: min(n, k))
    for parts in (1, 7):
        got = S.cap_per_class(rows.repartition(parts), k)
        assert {r["id"] for r in got.select("id").collect()} == expected
    assert got.columns == ["id", "label", "text"] or set(got.columns) == {"id", "label", "text"}


def test_cap_without_limit_keeps_all(rows):
    assert S.cap_per_class(rows, None).count() == rows.count()


def test_split_is_stratified_and_complete(rows):
    train, validation = S.stratified_split(rows, 0.2, seed=3)
    held = {r["id"] for r in validation.collect()}
    assert held == first_in_order(rows, 3, lambda n: int(0.2 * n + 0.5))
    assert {r["id"] for r in train.collect()} == set(range(3000)) - held


def test_top_k_breaks_ties_by_id(spark):
    rows = spark.range(0, 2000, 1, 9).select(
        "id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("label"), F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.1).alias("confidence")
    )
    got = S.most_confident_per_class(rows, 4)
    assert [(r["label"], r["rank"], r["id"]) for r in got.orderBy("label", "rank").collect()] == [
        ("x", 1, 0), ("x", 2, 15), ("x", 3, 30), ("x", 4, 45), ("y", 1, 5), ("y", 2, 10), ("y", 3, 20), ("y", 4, 25),
    ]


def test_positions_are_dense_and_ordered(spark):
    ids = spark.range(0, 5000, 1, 11).select((F.col("id") * 7919 % 100003).alias("id"))
    got = S.dense_position(ids.repartition(13), "id", partitions=4).collect()
    expected = {i: n for n, i in enumerate(sorted(i * 7919 % 100003 for i in range(5000)))}
    assert {r["id"]: r["position"] for r in got} == expected


def test_shuffle_and_head(rows):
    got = [r["id"] for r in S.seeded_shuffle(rows, 5).select("id").collect()]
    assert got == sorted(range(3000), key=lambda i: order(5, i))
    assert [r["id"] for r in S.head(rows, 3).collect()] == [0, 1, 2]
    assert [r["id"] for r in S.restore_order(rows.repartition(7)).limit(2).collect()] == [0, 1]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [10, 10**6])
def test_fan_out_join_equals_plain_join(spark, how, limit):
    left = spark.range(1000).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(0, 45).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert as_set(fan_out_join(left, right, "k", "id", how, rows_per_task=limit)) == as_set(left.join(right, "k", how))


def test_without_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    right = spark.createDataFrame([("a", 1)], "k string, x int")
    assert [r["id"] for r in without_keys(left, right, "k").collect()] == [3]
