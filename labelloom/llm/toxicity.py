"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text of the training rows is unlabelled,
toxic documents among it. With the class prior p, estimated from the training labels, and the logistic loss l,
the risk is ``p·E+[l(f)] + max(0, Eu[l(-f)] − p·E+[l(-f)])``: the unlabelled part, corrected for the
positives it holds, is the risk of the negatives, and is kept from going below zero. Where it
does, its gradient is followed upwards.

Features are the words of a text in lower case and their beginnings of four to seven letters: whether one
occurs, occurs several times, makes up a share of the words. Each classifier screens its sample for features that are commoner among the positives (or the rest)
than chance explains and fits a linear function of them in numpy. Several classifiers are fitted, each by one task on its
own part of a sample of at most about ``sample_rows`` positives and as many unlabelled documents, chosen by a
hash of the id; the score is their mean.

Defined results: null and empty texts have no features and get the score of the constant;
null labels and ids are not learned from; a document that any label calls toxic is; without
positives every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common
from labelloom.llm.lang_id import Letters, code_values
from labelloom.llm.words import Powers, span_hashes

U = np.uint64
#: Lengths of word beginnings that are features; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7)
#: A feature that occurs so many times, or makes up such a share of the words, is a feature more.
TIMES, SHARES = (2, 4), (0.005, 0.02)
_SIEVE = 20


def features(column: pa.Array, letters: Letters, powers: Powers, wanted: np.ndarray | None = None):
    """Text number and hash of each feature of each text; only of those in ``wanted`` (a sieve) if given."""
    words = letters.words(column)
    values, text_of = code_values(words.data), words.text_of()
    texts, hashes = [], []
    for length in BEGINNINGS:
        long_enough = (words.ends - words.starts) > length
        starts, ends = words.starts[long_enough], words.ends[long_enough]
        found = span_hashes(values, starts, starts + length if length else ends, powers) ^ U(length)
        text = text_of[long_enough]
        if wanted is not None:
            hit = wanted[(found >> U(64 - _SIEVE)).astype(np.int64)]
            found, text = found[hit], text[hit]
        texts.append(text)
        hashes.append(found)
    text, found = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(text)))
    text, found = text[heads], found[heads]
    n_words = words.per_text()[text]
    texts, hashes = [text], [found]
    # The kind goes into the low bits: the sieve looks at the high ones.
    for kind, more in enumerate([times >= t for t in TIMES] + [times >= s * n_words for s in SHARES], 1):
        texts.append(text[more])
        hashes.append(found[more] + U(kind))
    return np.concatenate(texts), np.concatenate(hashes)


def screen(column: np.ndarray, positive: np.ndarray, sizes: tuple[int, int], most: int) -> np.ndarray:
    """Features (numbers) whose share among the positives differs most surely from that among the unlabelled."""
    n_p, n_u = sizes
    p = np.bincount(column[positive], minlength=int(column.max(initial=-1)) + 1)
    u = np.bincount(column[~positive], minlength=len(p))
    share = (p + u + 1) / (n_p + n_u + 2)
    z = (p / n_p - u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    best = np.argsort(-np.abs(z), kind="stable")[:most]
    return np.sort(best[(np.abs(z[best]) > 4) & (p[best] + u[best] >= 5)])


def fit_nnpu(
    row: np.ndarray, column: np.ndarray, positive: np.ndarray, prior: float, n_columns: int, steps: int, shrink: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and constant of a linear function of 0/1 features, by Adam on the non-negative risk.

    ``row`` and ``column`` are the places of the ones; ``positive`` is by row.
    """
    n = len(positive)
    w = np.zeros(n_columns + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    n_p, n_u = positive.sum(), (~positive).sum()
    for t in range(1, steps + 1):
        f = np.bincount(row, w[column], n) + w[-1]
        up = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # slope of l(-f); that of l(f) is up − 1
        loss = np.logaddexp(0, f)
        negative = loss[~positive].mean() - prior * loss[positive].mean()
        corrected = np.where(positive, -prior / n_p * up, up / n_u)
        slope = np.where(positive, prior / n_p * (up - 1), 0.0) + corrected if negative >= 0 else -corrected
        gradient = np.append(np.bincount(column, slope[row], n_columns), slope.sum())
        gradient[:-1] += shrink * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _member(prior: float, most: int, steps: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        letters, powers = Letters(), Powers()
        texts, hashes = [], []
        column = table.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        for start, stop in common.text_slices(column):
            t, h = features(column.slice(start, stop - start), letters, powers)
            texts.append(t + start)
            hashes.append(h)
        row, found = np.concatenate(texts), np.concatenate(hashes)
        positive = table.column("positive").to_numpy().astype(bool)
        names, column_of = np.unique(found, return_inverse=True)
        weights, chosen, constant = np.zeros(0), np.zeros(0, np.int64), float(np.log(prior / (1 - prior)))
        if positive.any() and not positive.all():
            chosen = screen(column_of, positive[row], (int(positive.sum()), int((~positive).sum())), most)
            place = np.full(len(names), -1)
            place[chosen] = np.arange(len(chosen))
            live = place[column_of] >= 0
            weights, constant = fit_nnpu(row[live], place[column_of[live]], positive, prior, len(chosen), steps)
        return pa.table(
            {
                "member": pa.array([key[0].as_py()] * (len(chosen) + 1), pa.int32()),
                "feature": pa.array(np.append(names[chosen].view(np.int64), 0)),
                "constant": pa.array([False] * len(chosen) + [True]),
                "weight": pa.array(np.append(weights, constant)),
            }
        )

    return run


class Model:
    """Weights of all classifiers by feature hash (a row each), and their constants."""

    def __init__(self, rows: list) -> None:
        members = sorted({r.member for r in rows})
        self.constants = np.zeros(len(members))
        hashes = np.unique(np.array([r.feature for r in rows if not r.constant], np.int64).view(U))
        self.hashes, self.weights = hashes, np.zeros((len(hashes), len(members)))
        for r in rows:
            if r.constant:
                self.constants[members.index(r.member)] = r.weight
            else:
                at = np.searchsorted(hashes, np.int64(r.feature).view(U))
                self.weights[at, members.index(r.member)] = r.weight

    def sieve(self) -> np.ndarray:
        out = np.zeros(1 << _SIEVE, bool)
        out[(self.hashes >> U(64 - _SIEVE)).astype(np.int64)] = True
        return out

    def scores(self, column: pa.Array, letters: Letters, powers: Powers, sieve: np.ndarray) -> np.ndarray:
        n = len(column)
        if not len(self.constants):
            return np.zeros(n)
        text, found = features(column, letters, powers, sieve)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            hit = self.hashes[at] == found
            text, at = text[hit], at[hit]
        total = np.zeros(n)
        for m, constant in enumerate(self.constants):
            f = constant + (np.bincount(text, self.weights[at, m], n) if len(self.hashes) else 0)
            total += 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return total / len(self.constants)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = 12_000,
    members: int = 3,
    most_features: int = 2000,
    steps: int = 300,
) -> Model:
    """Classifiers fitted on training rows, those for which ``train``, a condition on the id, holds."""
    known = labels.where(train & F.col(id_column).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.sum("toxic")).head()
    if not n_toxic:
        return Model([])
    prior = min(0.99, n_toxic / n_known)
    rows = docs.where(train & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    n_docs = rows.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    toxic = known.where((F.col("toxic") == 1) & (draw < (sample_rows << 20) // n_toxic)).select("id")
    # About ``sample_rows`` ids, chosen above: a proven bound.
    positives = rows.join(F.broadcast(toxic), "id").select("id", "text", F.lit(True).alias("positive"))
    unlabelled = rows.where(draw < (sample_rows << 20) // max(1, n_docs)).select("id", "text", F.lit(False).alias("positive"))
    sample = positives.unionAll(unlabelled).withColumn("member", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(members)).cast("int"))
    fitted = sample.groupBy("member").applyInArrow(
        _member(prior, most_features, steps), "member int, feature bigint, constant boolean, weight double"
    )
    return Model(fitted.collect())


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score (0 to 1), its name after ``prefix``; a column of this name is replaced."""
    shared = common.share(docs.sparkSession, model)

    def work():
        model, letters, powers = shared(), Letters(), Powers()
        sieve = model.sieve()
        return lambda batch: [pa.array(model.scores(batch.column(text), letters, powers, sieve))]

    return common.append_columns(docs, text, [common.field(prefix + "score", "double")], work)
