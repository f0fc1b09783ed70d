"""Labelling and prediction for tables whose rows are read as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.hashing import text_key
from labelloom.functions.text import row_as_text
from labelloom.operators.classify import Classifier
from labelloom.operators.joins import fan_out_join
from labelloom.operators.sampling import restore_order
from labelloom.plans.loop import LoopResult, label_loop
from labelloom.sources.corpus import read_demonstrations, table_as_corpus, write_csv


def text_columns_of(df: DataFrame, chosen: Sequence[str] | None, row_id: str, label_column: str | None = None) -> list[str]:
    """Columns that make up the text: the chosen ones, or all but the id and the truth."""
    return list(chosen) if chosen is not None else [c for c in df.columns if c not in (row_id, label_column)]


def label_table(
    df: DataFrame,
    row_id: str,
    demonstrations: DataFrame | str,
    labels: Sequence[str],
    task: str,
    text_columns: Sequence[str] | None = None,
    label_column: str | None = None,
    output_csv: str | None = None,
    ordered: bool = False,
    **loop_options,
) -> tuple[DataFrame, LoopResult]:
    """Run the loop over a table's rows; returns the table with ``annotated_label`` and the run.

    ``demonstrations`` is a table or the path of a JSON array of pairs. Rows that carry a truth
    in ``label_column`` serve as validation data; that column is never part of the text. With
    ``ordered`` the file's rows are in order of the id.
    """
    if isinstance(demonstrations, str):
        demonstrations = read_demonstrations(df.sparkSession, demonstrations)
    columns = text_columns_of(df, text_columns, row_id, label_column)
    validation = None
    if label_column is not None:
        validation = table_as_corpus(df, row_id, columns, label_column).where(F.col("label").isin(*labels))
    result = label_loop(
        table_as_corpus(df, row_id, columns),
        demonstrations,
        labels,
        task,
        validation=validation,
        text_columns=columns,
        **loop_options,
    )
    keyed = df.withColumn("text_hash", text_key(row_as_text(df, columns)))
    found = result.annotations.select("text_hash", F.col("label").alias("annotated_label"))
    annotated = fan_out_join(keyed, found, "text_hash", row_id, "left").select(*df.columns, "annotated_label")
    if output_csv is not None:
        write_csv(restore_order(annotated, row_id) if ordered else annotated, output_csv)
    return annotated, result


def predict_table(
    model_path: str,
    df: DataFrame,
    row_id: str,
    text_columns: Sequence[str] | None = None,
    output_csv: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """The table with ``predicted_label`` and ``confidence`` of a saved model; no join, no shuffle.

    Texts are made of the columns given, or else of those saved with the model.
    """
    model = Classifier.load(model_path)
    columns = text_columns_of(df, text_columns if text_columns is not None else model.text_columns, row_id)
    texts = df.select("*", row_as_text(df, columns).alias("_row_text"))
    scored = model.predict(texts.select(*[F.col(c).alias(f"c_{c}") for c in df.columns], F.col("_row_text").alias("text")))
    predicted = scored.select(*[F.col(f"c_{c}").alias(c) for c in df.columns], "predicted_label", "confidence")
    if output_csv is not None:
        write_csv(restore_order(predicted, row_id) if ordered else predicted, output_csv)
    return predicted
