"""Words of documents that repeat benchmark passages: a prefix-filtered set join.

An item's windows are runs of ``size`` consecutive words (an item of fewer words, but not none,
is one window). A document word inside any occurrence of a window is hit. Exact containment
makes the necessary prefix of a window one word: its rarest, by counts over all documents.
Document words are joined with these prefix words, the place in the document must leave room
for the whole window (length and position bounds), and what is left is compared word by word.

Items are taken in blocks of bounded size, each sent to all tasks; every block looks at every
document in the same pass, so nothing is shuffled but the counts of the blocks' words.

Defined results: null texts have no words; items without words have no window; an item with a
null id hits words but is not listed; repeated ids are one item; no items, no hits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common
from labelloom.llm.words import BYTE_VALUES, Powers, Words, find_words, span_hashes, utf8

#: Words are a-z (A-Z lowered), digits, and every byte of characters beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True

WINDOW = 13
#: Text of the items of one block, in bytes (and one item more).
BLOCK_BYTES = 16 << 20
#: A document counts as contaminated if one of so many of its words, or more, is hit.
SHARE = 20

_SPANS = "array<struct<item:string,first:int,last:int>>"


def words_of(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    data = _LOWER[data]
    return find_words(data, offsets, _INSIDE[data])


def word_hashes(words: Words, powers: Powers) -> np.ndarray:
    return span_hashes(BYTE_VALUES[words.data], words.starts, words.ends, powers)


@dataclass
class Index:
    """A block's windows, found by the hash of their rarest word."""

    windows: list[tuple[str | None, int, tuple[bytes, ...]]] = field(default_factory=list)  # item, prefix place, words
    by_prefix: dict[int, list[int]] = field(default_factory=dict)
    hashes: list[np.ndarray] = field(default_factory=list)


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items as words, in blocks of at most ``limit`` bytes and one item more."""
    block, held = [], 0
    for row in items.toLocalIterator():
        words = words_of(pa.array([row[1]], pa.string()))
        if len(words.starts):
            text = words.data.tobytes()
            block.append((row[0], [text[a:b] for a, b in zip(words.starts, words.ends, strict=True)]))
            held += len(text)
        if held > limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def _hash_list(words: list[bytes], powers: Powers) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return span_hashes(BYTE_VALUES[data], np.concatenate(([0], ends[:-1])), ends, powers)


def _word_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary (sorted hashes) occurs in all documents."""
    shared = common.share(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers = shared(), Powers()
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for start, stop in common.text_slices(batch.column(0)):
                hashes = word_hashes(words_of(batch.column(0).slice(start, stop - start)), powers)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                total += np.bincount(at[known[at] == hashes], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["word", "n"])

    counts = docs.select(F.col(text)).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = np.zeros(len(vocabulary), np.int64)
    for word, n in counts.toLocalIterator():
        total[word] = n
    return total


def _index(block: list[tuple[str | None, list[bytes]]], docs: DataFrame, text: str, size: int) -> Index:
    powers = Powers()
    hashes = [_hash_list(words, powers) for _, words in block]
    vocabulary = np.unique(np.concatenate(hashes))
    counts = _word_counts(docs, text, vocabulary)
    index, seen = Index(), set()
    for (item, words), own in zip(block, hashes, strict=True):
        rarity = counts[np.searchsorted(vocabulary, own)]
        length = min(size, len(words))
        for start in range(len(words) - length + 1):
            window = tuple(words[start : start + length])
            if (item, window) in seen:
                continue
            seen.add((item, window))
            prefix = int(np.argmin(rarity[start : start + length]))
            index.by_prefix.setdefault(int(own[start + prefix]), []).append(len(index.windows))
            index.windows.append((item, prefix, window))
            index.hashes.append(own[start : start + length])
    return index


def _find(words: Words, hashes: np.ndarray, index: Index, prefixes: np.ndarray) -> list[list[dict]]:
    """Spans of hit words of each text, as first word and one past the last."""
    n = len(words.first) - 1
    found: list[list[dict]] = [[] for _ in range(n)]
    at = np.minimum(np.searchsorted(prefixes, hashes), len(prefixes) - 1)
    places = np.flatnonzero(prefixes[at] == hashes)
    texts = np.searchsorted(words.first, places, "right") - 1
    for place, text in zip(places.tolist(), texts.tolist(), strict=True):
        low, high = int(words.first[text]), int(words.first[text + 1])
        for k in index.by_prefix[int(hashes[place])]:
            item, prefix, window = index.windows[k]
            first = place - prefix
            last = first + len(window)
            if first < low or last > high or not np.array_equal(hashes[first:last], index.hashes[k]):
                continue
            if all(
                words.data[words.starts[first + j] : words.ends[first + j]].tobytes() == w for j, w in enumerate(window)
            ):
                found[text].append({"item": item, "first": first - low, "last": last - low})
    return [_joined(spans) for spans in found]


def _joined(spans: list[dict]) -> list[dict]:
    """Overlapping or touching spans of one item as one."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: (s["item"] or "", s["item"] is not None, s["first"])):
        if out and out[-1]["item"] == span["item"] and span["first"] <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], span["last"])
        else:
            out.append(dict(span))
    return out


def _with_spans(df: DataFrame, text: str, index: Index, prefix: str) -> DataFrame:
    shared = common.share(df.sparkSession, index)
    n_words, hit_spans = prefix + "n_words", prefix + "hit_spans"
    earlier = hit_spans in df.columns

    def work():
        index, powers = shared(), Powers()
        prefixes = np.array(sorted(index.by_prefix), np.uint64)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            words = words_of(batch.column(text))
            spans = _find(words, word_hashes(words, powers), index, prefixes)
            if earlier:
                spans = [a + b for a, b in zip(batch.column(hit_spans).to_pylist(), spans, strict=True)]
            kind = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
            return [pa.array(words.per_text(), pa.int64()), pa.array(spans, kind)]

        return compute

    return common.append_columns(df, text, [common.field(n_words, "bigint"), common.field(hit_spans, _SPANS)], work)


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    share: int = SHARE,
    block_bytes: int = BLOCK_BYTES,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with n_words, hit_spans, n_hit, items (sorted) and contaminated, their names after ``prefix``.

    Columns of ``docs`` with these names are replaced.
    """
    n_words, spans, n_hit, listed, contaminated = (
        prefix + name for name in ("n_words", "hit_spans", "n_hit", "items", "contaminated")
    )
    out = docs.drop(*[c for c in docs.columns if c.lower() in (n_words, spans, n_hit, listed, contaminated)])
    blocks = _item_blocks(items.select(F.col(item_id).cast("string"), F.col(item_text)), block_bytes)
    empty = True
    for block in blocks:
        out, empty = _with_spans(out, text, _index(block, docs, text, size), prefix), False
    if empty:
        out = _with_spans(out, text, Index(by_prefix={0: []}), prefix)
    hit = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"] - F.lit(1)))))
    items_hit = F.array_sort(F.array_distinct(F.filter(F.col(f"{spans}.item"), lambda x: x.isNotNull())))
    out = out.withColumns({n_hit: F.size(hit).cast("long"), listed: items_hit})
    return out.withColumn(contaminated, (F.col(n_hit) > 0) & (F.lit(share) * F.col(n_hit) >= F.col(n_words)))
