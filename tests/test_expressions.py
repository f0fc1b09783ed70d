import math

import pytest
from pyspark.sql import functions as F

from labelloom.functions import vectors as V
from labelloom.functions.hashing import beta_draw, cache_key, uniform
from labelloom.functions.labels import decode_label, encode_label, one_hot
from labelloom.functions.text import float_text, head_tokens, row_as_text, strip, tokens


def test_floats_print_as_shortest_repr(spark):
    values = [1e7, 123456789.125, 1e15, 1.5e16, 1e16, 0.0001, 0.00012345, 1e-5, 1.25e-7, -2.5e9, 12.0, 0.5, 0.001,
              -0.00075, 1e100, 1e-100, 9999999999999998.0, float("inf"), float("-inf"), float("nan"), 0.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {r["i"]: r["t"] for r in rows.select("i", float_text(F.col("x")).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [repr(v) for v in values]


def test_row_text_skips_empty_values(spark):
    rows = spark.createDataFrame(
        [(1, "a", 2.5, True, None), (2, "", float("nan"), False, "x, y"), (3, None, None, None, None)],
        "id int, name string, score double, flag boolean, note string",
    )
    got = {r["id"]: (r["t"], r["all"], r["part"]) for r in rows.select(
        "id",
        row_as_text(rows).alias("t"),
        row_as_text(rows, exclude_empty=False).alias("all"),
        row_as_text(rows, ["note", "name"]).alias("part"),
    ).collect()}
    assert got[1] == ("id: 1, name: a, score: 2.5, flag: True", "id: 1, name: a, score: 2.5, flag: True, note: nan", "name: a")
    assert got[2] == ("id: 2, flag: False, note: x, y", "id: 2, name: , score: nan, flag: False, note: x, y", "note: x, y")
    assert got[3][0] == "id: 3" and got[3][2] == ""


def test_tokens_split_as_python_does(spark):
    texts = ["  a b\tc\n", "", " \n ", "one", "x y z", "tail\x1f \x1cend"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", tokens(F.col("t")).alias("w"), strip(F.col("t")).alias("s")).collect()
    for r in got:
        assert r["w"] == r["t"].split()
        assert r["s"] == r["t"].strip()
    cut = spark.createDataFrame([(" ".join(map(str, range(600))),)], "t string").select(head_tokens(tokens(F.col("t"))).alias("w"))
    assert cut.first()["w"] == [str(i) for i in range(512)]


def test_labels_encode_and_reject(spark):
    labels = ["b", "a", "c"]
    rows = spark.createDataFrame([("a",), ("c",)], "x string")
    index = encode_label(F.col("x"), labels)
    got = rows.select(index.alias("i"), decode_label(index, labels).alias("d"), one_hot(index, 3).alias("h")).collect()
    assert [(r["i"], r["d"], r["h"]) for r in got] == [(1, "a", [0, 1, 0]), (2, "c", [0, 0, 1])]
    for bad in ("z", None):
        with pytest.raises(Exception, match="unknown label"):
            spark.createDataFrame([(bad,)], "x string").select(index).collect()


def test_softmax_and_losses(spark):
    rows = spark.createDataFrame([([1000.0, 1001.0, 999.0], [0.2, 0.3, 0.5])], "z array<double>, q array<double>")
    r = rows.select(
        V.softmax(F.col("z")).alias("p"),
        V.log_softmax(F.col("z")).alias("lp"),
        V.cross_entropy(V.softmax(F.col("z")), F.lit(0)).alias("ce"),
        V.soft_cross_entropy(F.col("q"), V.log_softmax(F.col("z"))).alias("sce"),
        V.kl_divergence(F.col("q"), V.log_softmax(F.col("z"))).alias("kl"),
        V.argmax(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("top"),
        V.argmin(F.array(F.lit(1), F.lit(0), F.lit(0))).alias("low"),
        V.cross_entropy(F.array(F.lit(0.0), F.lit(1.0)), F.lit(0)).alias("floored"),
        V.clamp01(F.lit(None).cast("double")).alias("none"),
    ).first()
    e = [math.exp(x) for x in (-1, 0, -2)]
    p = [x / sum(e) for x in e]
    assert r["p"] == pytest.approx(p)
    assert r["lp"] == pytest.approx([math.log(x) for x in p])
    assert r["ce"] == pytest.approx(-math.log(p[0]))
    assert r["sce"] == pytest.approx(-sum(q * math.log(x) for q, x in zip((0.2, 0.3, 0.5), p)))
    assert r["kl"] == pytest.approx(sum(q * math.log(q / x) for q, x in zip((0.2, 0.3, 0.5), p)))
    assert (r["top"], r["low"], r["none"]) == (1, 1, None)
    assert r["floored"] == pytest.approx(-math.log(1e-15))


def test_cache_key_is_sha256_of_question_and_model(spark):
    import hashlib

    got = spark.range(1).select(cache_key(F.lit("é?"), "m").alias("k")).first()["k"]
    assert got == hashlib.sha256("é?:m".encode()).hexdigest()


def test_uniforms_and_beta_draws(spark):
    rows = spark.range(20000).select(uniform(1, F.col("id")).alias("u"), beta_draw(1, F.col("id"), 4).alias("b"))
    r = rows.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("b"), F.var_samp("b")).first()
    assert r[0] == pytest.approx(0.5, abs=0.01) and 0 <= r[1] and r[2] < 1
    assert r[3] == pytest.approx(0.5, abs=0.01) and r[4] == pytest.approx(1 / 36, abs=0.002)
