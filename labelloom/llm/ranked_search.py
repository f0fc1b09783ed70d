"""The best documents for each item of a query set, by term-at-a-time scoring with limited accumulators.

Documents are read once. Segments of about 8 MB of text hold an inverted index of the terms that occur in items,
and are stored. Each segment scores every item term by term, rarest first. A document gets an accumulator at the
first term it holds; once the most that the remaining terms can add (their weights times the largest impact
in the segment) is below the k-th partial score, no further accumulators are made, and those
that exist are brought up to date exactly. The k-th score starts from a floor for the whole corpus: the k-th
exact score among the documents with an item's rarest terms, as many of them as occur in k documents.

With N documents that have a term, L terms in all, n terms of a document, df documents with a term
and tf its occurrences, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), a document's m is 25 + (75 n N) div L,
and its score adds w ((10^9 tf) div (1000 tf + 8 m)) for the item's terms, repeats included.

Items are searched in blocks of at most 16 MB of text; a block's terms and occurrences are sent to tasks.

Defined results: a null or empty text has no terms; items without terms or matches have no rows; rows of one
item id are one item of all their terms, null ids too; repeated document ids are documents of their own;
a null document id comes after all others among equal scores; other columns are not read.
Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm import common
from labelloom.llm.words import BYTE_VALUES, Powers, Words, find_words, span_hashes, utf8
from labelloom.session import store_table

#: Text of a segment, and of a block of items, in bytes.
SEGMENT_BYTES = 8 << 20
ITEM_BYTES = 16 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SEGMENT = (
    "doc_ids array<bigint>, lengths array<bigint>, terms array<int>, n_docs array<bigint>, posting_docs array<int>, posting_times array<bigint>"
)


def _terms(column: pa.Array, powers: Powers) -> tuple[Words, np.ndarray]:
    """Terms of texts, A-Z in lower case, and their hashes."""
    data, offsets = utf8(column)
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    words = find_words(lower, offsets, inside)
    return words, span_hashes(BYTE_VALUES[lower], words.starts, words.ends, powers)


@dataclass
class Items:
    """A block of items: distinct term hashes, and for each item its terms (as numbers of hashes) and their repeats."""

    ids: pa.Array
    hashes: np.ndarray
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _gather(counted: DataFrame) -> Items:
    """Items of a block of (item_id, term, times)."""
    table = counted.toArrow().combine_chunks()
    coded = pc.dictionary_encode(table.column("item_id").combine_chunks(), null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    item = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, hashes = _terms(table.column("term").combine_chunks(), Powers())
    distinct, number = np.unique(hashes, return_inverse=True)
    order = np.argsort(item, kind="stable")
    first = np.searchsorted(item[order], np.arange(len(coded.dictionary) + 1))
    return Items(coded.dictionary, distinct, first, number[order], table.column("times").to_numpy()[order])


def build_segments(docs: DataFrame, hashes: np.ndarray, id_column: str, text: str, segment_bytes: int) -> DataFrame:
    """Segments of the documents' index of the given terms."""
    shared = common.share(docs.sparkSession, hashes)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers = shared(), Powers()
        ids, lengths, found, size, n = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            term, doc, times = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.argsort(term, kind="stable")
            terms, n_docs = np.unique(term, return_counts=True)
            lists = [
                pa.concat_arrays(ids),
                pa.array(np.concatenate(lengths)),
                pa.array(terms.astype(np.int32)),
                pa.array(n_docs.astype(np.int64)),
                pa.array(doc[order].astype(np.int32)),
                pa.array(times[order].astype(np.int64)),
            ]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SEGMENT.split(", ")])

        for batch in batches:
            for low, high in common.text_slices(batch.column(1)):
                part = batch.slice(low, high - low)
                words, hashes = _terms(part.column(1), powers)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == hashes)
                # A document's occurrences of one term are one posting.
                pair, times = np.unique(words.text_of()[hit] * len(known) + at[hit], return_counts=True)
                found.append((pair % len(known), n + pair // len(known), times))
                ids.append(part.column(0))
                lengths.append(words.per_text())
                n += len(part)
                size += len(words.data)
                if size >= segment_bytes:
                    yield segment()
                    ids, lengths, found, size, n = [], [], [], 0, 0
        if ids:
            yield segment()

    return rows.mapInArrow(run, _SEGMENT)


class Segment:
    """A stored segment with the impact of each posting."""

    def __init__(self, row: dict, n_all: int, l_all: int) -> None:
        self.doc_ids, lengths = row["doc_ids"], row["lengths"].to_numpy(zero_copy_only=False)
        times = row["posting_times"].to_numpy(zero_copy_only=False)
        self.docs = row["posting_docs"].to_numpy(zero_copy_only=False).astype(np.int64)
        m = 25 + (75 * lengths * n_all) // max(1, l_all)
        self.impact = (1_000_000_000 * times) // (1000 * times + 8 * m[self.docs])
        self.terms = row["terms"].to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(row["n_docs"].to_numpy(zero_copy_only=False))
        self.starts = self.ends - row["n_docs"].to_numpy(zero_copy_only=False)
        self.largest = np.maximum.reduceat(self.impact, self.starts) if len(self.terms) else np.zeros(0, np.int64)
        self.n = len(lengths)

    def score(self, term: np.ndarray, weight: np.ndarray, makers: int, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with accumulators, their exact scores, and how many accumulators were made.

        ``term`` is in order of rarity; only the first ``makers`` terms may make accumulators. Documents
        below ``floor``, or below the segment's k-th score, may be missing.
        """
        at = np.searchsorted(self.terms, term)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == term[here]
        at, weight, makes = at[here], weight[here], (np.arange(len(term)) < makers)[here]
        most = np.cumsum((weight * self.largest[at])[::-1])[::-1]
        score, kth, making = np.zeros(self.n, np.int64), floor, True
        for t, w, may, bound in zip(at.tolist(), weight.tolist(), makes.tolist(), most.tolist(), strict=True):
            docs = self.docs[self.starts[t] : self.ends[t]]
            gain = w * self.impact[self.starts[t] : self.ends[t]]
            making = making and may and bound >= kth
            if making:
                score[docs] += gain
                if self.n > k:
                    kth = max(kth, int(np.partition(score, self.n - k)[self.n - k]))
            else:
                alive = score[docs] > 0
                score[docs[alive]] += gain[alive]
        made = np.flatnonzero(score > 0)
        return made, score[made], len(made)


def _search_segments(segments: DataFrame, plan: dict, k: int, makers: str) -> DataFrame:
    """The k best documents of each segment for each item (by number) that reach the item's floor.

    ``makers``: name of the plan's number of terms that make accumulators.
    """
    shared = common.share(segments.sparkSession, plan)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared()
        first, term, weight, floor, limit = plan["first"], plan["term"], plan["weight"], plan["floor"], plan[makers]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].values for name in batch.schema.names}
                segment = Segment(row, plan["n"], plan["l"])
                out = []
                for item in range(len(first) - 1):
                    own = slice(first[item], first[item + 1])
                    docs, score, made = segment.score(term[own], weight[own], int(limit[item]), int(floor[item]), k)
                    keep = score >= floor[item]
                    docs, score = docs[keep], score[keep]
                    if len(docs) > k:
                        some = score >= np.partition(score, len(score) - k)[len(score) - k]
                        docs, score = docs[some], score[some]
                    if not len(docs):
                        continue
                    ids = segment.doc_ids.take(pa.array(docs))
                    best = pc.sort_indices(
                        pa.table({"s": score, "d": ids}), [("s", "descending"), ("d", "ascending")], null_placement="at_end"
                    )[:k]
                    out.append((item, ids.take(best), score[best.to_numpy()], made))
                if not out:
                    continue
                sizes = [len(x[2]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([x[0] for x in out], sizes).astype(np.int32)),
                        pa.concat_arrays([x[1] for x in out]),
                        pa.array(np.concatenate([x[2] for x in out])),
                        pa.array(np.repeat([x[3] for x in out], sizes).astype(np.int64)),
                    ],
                    names=["item", "doc_id", "score", "made"],
                )

    return segments.mapInArrow(run, "item int, doc_id bigint, score bigint, made bigint")


def _search_block(docs: DataFrame, counted: DataFrame, id_column: str, text: str, k: int, segment_bytes: int) -> DataFrame | None:
    spark = docs.sparkSession
    items = _gather(counted)
    if not len(items.hashes):
        return None
    segments = store_table(build_segments(docs, items.hashes, id_column, text, segment_bytes))
    held = segments.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("x"))
    by_term = held.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.n_docs").alias("df")).toPandas()
    # Documents and terms of a segment are added by expressions over its array of lengths.
    sums = segments.select(
        F.size(F.filter("lengths", lambda x: x > 0)).cast("long").alias("n"),
        F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"),
    ).agg(F.sum("n"), F.sum("l")).head()
    n, total = sums[0] or 0, sums[1] or 0
    df = np.zeros(len(items.hashes), np.int64)
    df[by_term["term"].to_numpy(np.int64)] = by_term["df"].to_numpy(np.int64)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    # Terms of each item by rarity; those in no document are left out.
    owner = np.repeat(np.arange(len(items.first) - 1), np.diff(items.first))
    order = np.lexsort((items.term, df[items.term], owner))
    order = order[df[items.term[order]] > 0]
    owner, term = owner[order], items.term[order]
    first = np.searchsorted(owner, np.arange(len(items.first)))
    reached = np.concatenate(([0], np.cumsum(df[term])))
    n_items = len(first) - 1
    # The fewest terms, rarest first, that are held by k documents, counted for each term.
    rarest = np.searchsorted(reached, reached[first[:-1]] + k) - first[:-1]
    plan = {
        "n": n,
        "l": total,
        "first": first,
        "term": term,
        "weight": weight[term] * items.times[order],
        "floor": np.ones(n_items, np.int64),
        "rarest": np.minimum(rarest, np.diff(first)),
        "all": np.diff(first),
    }
    seeds = _search_segments(segments, plan, k, "rarest").select("item", "score")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    floors = seeds.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("item", "score").toPandas()
    plan["floor"][floors["item"].to_numpy(np.int64)] = floors["score"].to_numpy(np.int64)
    best = _search_segments(segments, plan, k, "all")
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", counted.schema["item_id"].dataType)])
    names = pa.table({"item": pa.array(np.arange(len(items.ids)), pa.int32()), "item_id": items.ids})
    named = spark.createDataFrame(names, schema)
    # One row per item of a block.
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score", F.col("made").alias("n_accumulators"))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    segment_bytes: int = SEGMENT_BYTES,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the k best documents of each item with a score above 0.

    ``n_accumulators`` tells how many documents of the row's segment were scored for the item.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_column).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    blocks = common.parts_for(common.text_bytes(rows), item_bytes)
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    terms = rows.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    counted = terms.groupBy("item_id", "term").agg(F.count("*").alias("times"))
    if blocks > 1:
        counted = store_table(counted)
    found = None
    for b in range(blocks):
        part = counted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else counted
        result = _search_block(docs, part, id_column, text, k, segment_bytes)
        if result is not None:
            found = result if found is None else found.unionAll(result)
    if found is None:
        schema = T.StructType([T.StructField("item_id", rows.schema["item_id"].dataType)])
        empty = spark.createDataFrame([], schema)
        kinds = (("rank", "int"), ("doc_id", "bigint"), ("score", "bigint"), ("n_accumulators", "bigint"))
        found = empty.select("item_id", *(F.lit(None).cast(kind).alias(c) for c, kind in kinds))
    return found
