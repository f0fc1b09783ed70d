"""Words that earlier text has: suffix automata and matching statistics.

Every word covered by a window of ``size`` consecutive words that also starts earlier (in a
document of a smaller id, or earlier in the same) is removed; windows are judged on the input.
Candidate text comes by :mod:`substrings` to shards. Segments with the same key are a
reference shard; in order of place, each is streamed through the suffix automaton of the ones
before it. Where the matching statistic, the length of the longest suffix that the automaton
knows, reaches ``size``, the window that ends there starts earlier as well. Then the segment
extends the automaton; a segment equal to an earlier one need not be streamed, all its windows
start earlier.

The automata are not broadcast to all tasks: together they are as large as all repeated text.
Documents' segments and the automaton they need meet in one task instead.

Defined results: words are runs of characters other than ASCII white space; null texts have
none; a null id is before all others; rows of the same id follow each other in order of text,
as if one document (no window spans two); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelloom.llm.substrings import Kind, Sequences, covered_spans, find_repeats, gather, ids_of, text_of
from labelloom.llm.words import BYTE_VALUES, Powers, find_words, span_hashes, utf8

U = np.uint64
SIZE = 20
SCHEMA = "doc_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, kept string"
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
#: White space as the one byte 32.
_EVEN = np.where(_SPACES, 32, np.arange(256)).astype(np.uint8)


class Automaton:
    """All substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.after: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, after: dict, link: int) -> int:
        self.after.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The part of ``q`` that is no longer than what ``p`` and ``word`` spell."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, dict(self.after[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.after[p].get(word) == q:
            self.after[p][word] = part
            p = self.link[p]
        return part

    def add(self, last: int, word) -> int:
        """State of the sequence at ``last`` (0 at its start) and one word more."""
        if word in self.after[last]:
            return self._split(last, self.after[last][word], word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.after[p]:
            self.after[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.after[p][word], word)
        return new

    def stream(self, words: list) -> list[int]:
        """For each word, the length of the longest suffix up to it that occurs earlier; adds the words."""
        after, link, length = self.after, self.link, self.length
        state = known = last = 0
        out = []
        for word in words:
            while state and word not in after[state]:
                state = link[state]
                known = length[state]
            if word in after[state]:
                state = after[state][word]
                known += 1
            out.append(known)
            last = self.add(last, word)
            while state and known <= length[link[state]]:
                state = link[state]
        return out


def earlier_windows(sequences: list[list], size: int) -> list[np.ndarray]:
    """For each window of each sequence, whether it also starts earlier, in this or an earlier sequence."""
    automaton = Automaton()
    return [np.array(automaton.stream(words)[size - 1 :], np.int64) >= size for words in sequences]


def _resolver(size: int):
    def resolve(payloads: list[bytes], keys: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            shard = [payloads[i].split() for i in range(a, z)]
            # A window that is there twice has ``size`` words that are there twice.
            if z - a == 1 and len(shard[0]) - len(set(shard[0])) < size:
                out.append(np.zeros(int(counts[a]), bool))
            else:
                out.extend(earlier_windows(shard, size))
        return out

    return resolve


def _read(table: pa.Table) -> Sequences:
    data, offsets = utf8(text_of(table))
    words = find_words(data, offsets, ~_SPACES[data])
    data = _EVEN[data]
    hashes, powers, step = np.zeros(len(words.starts), U), Powers(), 1 << 16
    for a in range(0, len(hashes), step):
        starts, ends = words.starts[a : a + step], words.ends[a : a + step]
        hashes[a : a + step] = span_hashes(BYTE_VALUES[data[starts[0] : ends[-1]]], starts - starts[0], ends - starts[0], powers)
    return Sequences(
        ids_of(table),
        words.first,
        lambda a, z: hashes[a:z],
        lambda first, last: gather(data, words.starts[first], words.ends[last - 1]),
    )


def _result(table: pa.Table, covered: np.ndarray, s: Sequences) -> pa.Table:
    kept, keep = [], (~covered).tolist()
    texts = text_of(table)
    for i, (a, z) in enumerate(zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True)):
        kept.append(b" ".join(compress(texts[i].as_buffer().to_pybytes().split(), keep[a:z])))
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(np.diff(s.first)),
            "spans": covered_spans(covered, s.first),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, **sizes) -> DataFrame:
    """doc_id, n_words, removed spans of words and the kept words, joined by one space, of every document."""
    hot = {"hot": sizes.pop("hot")} if "hot" in sizes else {}
    kind = Kind(size, max(1, size * 3 // 10), _read, True, _resolver(size), _result, SCHEMA, **hot)
    return find_repeats(docs, kind, id_column, text, **sizes)
