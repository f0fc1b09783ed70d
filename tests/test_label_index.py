import itertools
import random

import pytest
from pyspark.sql import functions as F

from labelloom.functions.replies import match_label
from labelloom.operators.label_index import LONGEST_LABEL, deletions, match_labels


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(raw, labels, most):
    """``labels`` in order of position."""
    if raw is None:
        return None
    clean = raw.lower().strip()
    for x in labels:
        if x.lower() == clean:
            return x
    d, i = min(((edits(clean, x.lower()), i) for i, x in enumerate(labels)), default=(99, 0))
    return labels[i] if d <= most and d <= len(labels[i]) / 2 else raw


def matched(spark, raws, labels, most=2, **names):
    rows = spark.createDataFrame(list(enumerate(raws)), "id long, raw_label string").repartition(5)
    table = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, position int")
    got = match_labels(rows, table, most_edits=most, **names)
    assert got.columns == ["id", "raw_label", "matched_label"]
    return {r["id"]: r["matched_label"] for r in got.collect()}


def test_deletions(spark):
    row = spark.range(1).select(deletions(F.lit("abca"), 2).alias("d"), deletions(F.lit(""), 2).alias("e"), deletions(F.lit("é"), 3).alias("f")).first()
    expected = {"".join(c) for n in (2, 3, 4) for c in itertools.combinations("abca", n)}
    assert len(row["d"]) == len(set(row["d"])) and set(row["d"]) == expected
    assert row["e"] == [""] and sorted(row["f"]) == ["", "é"]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_equals_brute_force(spark, most):
    rng = random.Random(5)
    labels = ["".join(rng.choice("abAé ") for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(120)]
    raws = ["".join(rng.choice("abBé ") for _ in range(rng.randint(0, 10))) for _ in range(400)]
    raws += [x.upper() for x in labels[:20]] + [f"  {x}\n" for x in labels[:20]] + [None, "", "a" * 5000] + ["bad"] * 50
    assert matched(spark, raws, labels, most) == {i: brute(x, labels, most) for i, x in enumerate(raws)}


def test_agrees_with_a_short_list(spark):
    labels = ["english", "french", "german", "spanish"]
    raws = ["English", "englsh", "frnch ", "gemran", "klingon", "spansh", "", "e"]
    rows = spark.createDataFrame(list(enumerate(raws)), "id long, raw_label string")
    expected = {r["id"]: r["m"] for r in rows.select("id", match_label(F.col("raw_label"), labels).alias("m")).collect()}
    assert matched(spark, raws, labels) == expected


def test_ten_thousand_labels(spark):
    rng = random.Random(6)
    labels = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(10)) for _ in range(10_000)})
    raws = [x[:3] + x[4:] for x in labels[::50]] + [x[:5] + "zz" + x[7:] for x in labels[1::50]]
    got = matched(spark, raws, labels)
    clean = {x for x in raws if sum(edits(x, y) <= 2 for y in labels if x[:2] == y[:2]) == 1}
    assert len(clean) > 300
    asked = labels[::50] + labels[1::50]
    assert all(got[i] == asked[i] for i, x in enumerate(raws) if x in clean)


def test_odd_tables(spark):
    assert matched(spark, ["a", None], []) == {0: "a", 1: None}
    assert matched(spark, [], ["a"]) == {}
    table = spark.createDataFrame([("Ab", 3), ("aB", 1), (None, 0), ("aB", 7)], "label string, position int")
    rows = spark.createDataFrame([(1, "AB", "kept", "old"), (1, "AB", "kept", "old")], "id long, raw_label string, name string, matched_label string")
    got = match_labels(rows, table).collect()
    assert [tuple(r) for r in got] == [(1, "AB", "kept", "aB")] * 2
    with pytest.raises(ValueError):
        matched(spark, ["a"], ["x" * (LONGEST_LABEL + 1)])
