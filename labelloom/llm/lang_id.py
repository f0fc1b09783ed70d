"""Language identification: words first, then shorter and shorter character n-grams.

A model holds, for each language, log frequencies of its commonest words and character n-grams.
A known word votes with its log frequency in each language. An unseen word votes with the mean
of its known n-grams of the largest length at which any is known. The votes of a text add up;
the score is the posterior of the best language under equal priors.

The model is fitted on a bounded sample: about ``docs_per_language`` documents of each language,
chosen by a hash of the id. Each (language, length) keeps at most ``entries`` n-grams.

Defined results: a null text or one without a letter is ``und`` with score 0; words are letter runs in
lower case; equal scores go to the language that sorts first; no training rows, all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm import common
from labelloom.llm.words import Powers, Words, find_words, mix, span_hashes

UNKNOWN = "und"
LENGTHS = (5, 4, 3, 2, 1)
U = np.uint64


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, and where each text begins (one more at the end)."""
    column = pc.utf8_lower(pc.fill_null(column, ""))
    ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    joined = "".join(column.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate(([0], ends))


class Letters:
    """Tells letters; made once per task."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, bool)
        self.table[: 0x30000] = [chr(c).isalpha() for c in range(0x30000)]
        self.table[0x30000:0x32400] = True  # further ideographs

    def words(self, column: pa.Array) -> Words:
        points, offsets = code_points(column)
        return find_words(points, offsets, self.table[points])


def code_values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(U) + U(1))


def ngrams(words: Words, length: int, powers: Powers, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each word and the word of each; words that are shorter have none."""
    sizes = words.ends - words.starts
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = words.starts[owner] + within
    return span_hashes(values, starts, starts + length, powers) ^ U(length), owner


@dataclass
class Model:
    """Sorted hashes and log frequencies (rows as hashes, one column a language) by n-gram length; 0 is words."""

    languages: list[str]
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def look_up(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if unknown."""
        keys = self.keys[length]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def predict(self, words: Words, powers: Powers) -> tuple[list[str], np.ndarray]:
        n, k = len(words.first) - 1, len(self.languages)
        if not k or not len(words.starts):
            return [UNKNOWN] * n, np.zeros(n)
        values = code_values(words.data)
        hashes, order = np.unique(span_hashes(values, words.starts, words.ends, powers), return_inverse=True)
        votes = np.zeros((len(hashes), k))
        row = self.look_up(0, hashes)
        votes[row >= 0] = self.logs[0][row[row >= 0]]
        place = np.zeros(len(hashes), np.int64)
        place[order] = np.arange(len(order))  # any occurrence of each distinct word
        left = np.flatnonzero(row < 0)
        for length in LENGTHS:
            if not len(left):
                break
            part = Words(words.data, words.starts[place[left]], words.ends[place[left]], np.zeros(1, np.int64))
            grams, owner = ngrams(part, length, powers, values)
            at = self.look_up(length, grams)
            owner, at = owner[at >= 0], at[at >= 0]
            known = np.bincount(owner, minlength=len(left))
            total = np.stack([np.bincount(owner, self.logs[length][at, j], len(left)) for j in range(k)], 1)
            votes[left[known > 0]] = total[known > 0] / known[known > 0, None]
            left = left[known == 0]
        text_of = words.text_of()
        total = np.stack([np.bincount(text_of, votes[order, j], n) for j in range(k)], 1)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        empty = words.per_text() == 0
        return [UNKNOWN if e else self.languages[b] for e, b in zip(empty, best, strict=True)], np.where(empty, 0.0, score)


def _counts(rows: DataFrame) -> DataFrame:
    """lang, n-gram length (0: words), hash and count; counted per batch before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, powers = Letters(), Powers()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array([x == lang for x in langs]))
                for start, stop in common.text_slices(texts):
                    words = letters.words(texts.slice(start, stop - start))
                    values = code_values(words.data)
                    for length in (0, *LENGTHS):
                        if length:
                            hashes = ngrams(words, length, powers, values)[0]
                        else:
                            hashes = span_hashes(values, words.starts, words.ends, powers)
                        keys, n = np.unique(hashes, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(keys), pa.string()),
                                pa.array(np.full(len(keys), length, np.int32)),
                                pa.array(keys.view(np.int64)),
                                pa.array(n.astype(np.int64)),
                            ],
                            names=["lang", "length", "key", "n"],
                        )

    counted = rows.mapInArrow(run, "lang string, length int, key bigint, n bigint")
    return counted.groupBy("lang", "length", "key").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame,
    train: Column,
    text: str = "text",
    lang: str = "lang",
    sample_key: str = "doc_id",
    docs_per_language: int = 2000,
    entries: int = 20_000,
) -> Model:
    """A model of the rows for which ``train`` holds and text and language are known."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(sample_key).cast("string").alias("key")
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {}, {})
    draw = F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(1 << 20))
    share = F.element_at(F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, (docs_per_language << 20) // n)]), F.col("lang"))
    counts = _counts(rows.where(draw < share).select("lang", "text"))
    commonest = Window.partitionBy("lang", "length").orderBy(F.desc("n"), "key")
    kept = counts.withColumn("rank", F.row_number().over(commonest)).where(F.col("rank") <= entries)
    found = kept.select("lang", "length", "key", "n").toPandas()
    languages = sorted(sizes)
    keys, logs = {}, {}
    for length in (0, *LENGTHS):
        part = found[found["length"] == length]
        hashes, row = np.unique(part["key"].to_numpy(np.int64).view(U), return_inverse=True)
        n = np.zeros((len(hashes), len(languages)))
        n[row, [languages.index(x) for x in part["lang"]]] = part["n"]
        keys[length] = hashes
        logs[length] = np.log((n + 0.5) / (n.sum(0) + 0.5 * max(1, len(hashes))))
    return Model(languages, keys, logs)


def predict(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred and score, their names after ``prefix``; columns of these names are replaced."""
    shared = common.share(docs.sparkSession, model)

    def work():
        model, letters, powers = shared(), Letters(), Powers()

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            langs, scores = model.predict(letters.words(batch.column(text)), powers)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return compute

    new = [common.field(prefix + "lang_pred", "string"), common.field(prefix + "score", "double")]
    return common.append_columns(docs, text, new, work)
