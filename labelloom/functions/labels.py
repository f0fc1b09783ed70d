"""Label encoding: names to indices and back, one-hot rows, class attributes for MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_map(labels: Sequence[str]) -> Column:
    return F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))])


def encode_label(label: Column, labels: Sequence[str]) -> Column:
    """Index of the label in list order; an unknown label is an error."""
    index = F.try_element_at(label_map(labels), label)
    return F.coalesce(index, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def decode_label(index: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), index)


def map_values(value: Column, mapping: Mapping) -> Column:
    """Value through a fixed mapping (null where it has no entry)."""
    pairs = [x for key, name in mapping.items() for x in (F.lit(key), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), value)


def one_hot(index: Column, k: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == index, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def class_column(index: Column, name: str, labels: Sequence[str]) -> Column:
    """Class index as double, carrying all label names so that MLlib sees absent classes too."""
    return index.cast("double").alias(name, metadata={"ml_attr": {"type": "nominal", "name": name, "vals": list(labels)}})
