"""Matching raw labels with a long table of labels, by an index of deletions.

Two strings within ``d`` edits of each other become equal when at most ``d`` characters of each
are left out. So each distinct raw label and each label is written down with all its
deletions, the two meet in a join by equality, and edit distances are taken of what met. A label
list of :func:`labelloom.functions.replies.match_label` is compared with every row instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import strip
from labelloom.operators.joins import fan_out_join
from labelloom.session import store_table

#: Longest label; one of ``n`` characters has about ``n² / 2`` deletions of up to two.
LONGEST_LABEL = 64


def deletions(text: Column, most: int) -> Column:
    """Array of the text and of all that leaving out up to ``most`` of its characters gives, each once."""

    def one_less(x: Column) -> Column:
        places = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    level = every = F.array(text)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, one_less)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def match_labels(
    rows: DataFrame,
    labels: DataFrame,
    row_id: str = "id",
    raw: str = "raw_label",
    label: str = "label",
    position: str = "position",
    most_edits: int = 2,
) -> DataFrame:
    """``rows`` with ``matched_label``: the label equal to ``raw`` but for case, or else the nearest by edits.

    ``labels`` is a table of any number of labels with their order. As in ``match_label``, ties go to the
    earlier label, and the nearest one counts if its edits are at most half its length; here they are also at
    most ``most_edits``. What matches no label is returned unchanged, null stays null. Each distinct raw label
    is looked up once; raw labels too long to be within reach of any are not looked up. Rows keep their columns
    (an earlier ``matched_label`` is replaced). A label of more than ``LONGEST_LABEL`` characters is an error.
    """
    named = labels.where(F.col(label).isNotNull()).groupBy(F.lower(label).alias("_form"))
    named = store_table(named.agg(F.min(F.struct(F.col(position).alias("pos"), F.col(label).alias("name"))).alias("_l")))
    longest = named.agg(F.max(F.length("_form"))).first()[0] or 0
    if longest > LONGEST_LABEL:
        raise ValueError(f"labels have at most {LONGEST_LABEL} characters, one has {longest}")
    asked = rows.where(F.col(raw).isNotNull()).groupBy(F.col(raw).alias("_raw")).agg(F.first(strip(F.lower(raw))).alias("_clean"))
    asked = store_table(asked.where(F.length("_clean") <= longest + most_edits))

    equal = asked.join(named, asked["_clean"] == named["_form"]).select("_raw", F.col("_l.name").alias("_matched"))
    rest = asked.join(equal, "_raw", "left_anti")
    # Equal forms stand for many raw labels (white space), and are compared once.
    forms = rest.select("_clean").distinct()
    left = forms.select("_clean", F.explode(deletions(F.col("_clean"), most_edits)).alias("_part"))
    right = named.select("_form", "_l", F.explode(deletions(F.col("_form"), most_edits)).alias("_part"))
    # Parts meet by their hashes; a pair that meets by chance fails the distance.
    met = left.withColumn("_part", F.xxhash64("_part")).join(right.withColumn("_part", F.xxhash64("_part")), "_part")
    edits = F.levenshtein(F.col("_clean"), F.col("_form"), most_edits)
    near = met.select("_clean", F.struct(edits.alias("edits"), F.col("_l.pos").alias("pos"), F.col("_l.name").alias("name")).alias("_b"))
    best = near.where(F.col("_b.edits") >= 0).groupBy("_clean").agg(F.min("_b").alias("_b"))
    best = best.where(F.col("_b.edits") <= F.length("_b.name") / F.lit(2.0))
    close = rest.join(best, "_clean").select("_raw", F.col("_b.name").alias("_matched"))
    found = store_table(equal.unionByName(close).withColumnRenamed("_raw", raw))
    kept = rows.drop("matched_label")
    joined = fan_out_join(kept, found, raw, row_id, "left")
    return joined.select(*kept.columns, F.coalesce("_matched", raw).alias("matched_label"))
