"""Small awkward tables and brute-force versions for the tests."""

import re

from pyspark.sql import types as T

SPACE = "[\x20\x09-\x0d]+"

#: ids, texts: null, empty, blank, short, repeated rows, repeated ids, clashing columns.
DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def docs_table(spark, rows):
    """Documents of (id, text, lang, source), with further columns whose names operators use."""
    rows = [(*r, *[None] * (4 - len(r)), "s", "w", "b", "k") for r in rows]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def long_text(n, seed):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 100003}" for i in range(n))
