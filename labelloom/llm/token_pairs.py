"""Which tokens of two tokenizers end together, how often over all documents, and what each document makes of it.

Both tokenizers encode the same bytes. Byte offsets at which a token of A and a token of B end cut the tokens
into groups; the two tokens that end there are linked. For each pair of ids there is an inverted list: bitmaps
over the documents of a block. Plane j of a pair holds bit j of the number of its links in
each document, so the planes' OR is the bitmap of its documents, and popcounts of the planes, times powers
of two, add up to its links. The counts of all blocks are added by pair; every pair's planes then
return its count, and whether no other A token ends more often with its B token, to the
documents of its block.

A block is a stretch of a task's documents, of at most 4,096 documents or about 8 MB of text; a pair has one row
per block, however often it occurs, so no pair makes a task large. Documents stay where they are read:
what is shuffled are the bitmaps and the documents' digests.

Defined results: texts that are null or empty, or whose tokens of A or B do not join to a space and the text, have no
tokens: zeros and an empty digest. Null and repeated ids are documents of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import store_table

#: Documents of a block and about the bytes of its text.
BLOCK_DOCS = 4096
BLOCK_BYTES = 8 << 20
#: Words whose alignment a Python worker remembers, in each of two generations.
REMEMBERED = 300_000
#: Largest share of set bits (one in so many) that is stored as positions instead of bits.
_SPARSE = 16

_ROWS = (
    "kind int, block bigint, place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, a int, b int, n_docs bigint, links bigint, planes array<binary>"
)
_TYPES = [
    *(pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()),
    *(pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary())),
]
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)


def byte_decoder() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}


@dataclass(slots=True, eq=False)
class Aligned:
    """Alignment of one text or part: sizes, groups as text, and the linked pairs in order, as ``a << 32 | b``."""

    n_a: int
    n_b: int
    groups: str
    pairs: list[int]


class Aligner:
    """Encodes texts by both tokenizers and cuts their tokens into groups.

    Where a printable character, a single space or line feed and a printable character meet, a token of
    either kind ends before the space or line feed. Between such places texts are aligned part by part and
    parts are remembered; :meth:`whole` aligns a text without such cuts.
    """

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        decode = byte_decoder()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = {
            i: t.encode() if i in special else bytes([decode[c] for c in t]) for t, i in self.a.get_vocab().items()
        }
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        split = self.a.pre_tokenizer
        byte_level = split is not None and b'"ByteLevel"' in split.__getstate__()
        #: Marks before which a token ends if a letter stands there: no piece of B goes on over them.
        self.marks = [m for m in ".,;:!?" if byte_level and not any(m in p[1:] and p[p.index(m, 1) - 1].isalpha() for p in pieces)]
        #: Whether parts are encoded as in the whole text: no piece of B goes on over a space or line feed.
        self.by_parts = byte_level and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.mark_of = {m: self._after_letter(m) for m in self.marks} if self.by_parts else {}
        self.fresh: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def _cut(self, a_ids: list[int], b_ids: list[int], sizes: np.ndarray, data: bytes) -> list[Aligned] | None:
        """Alignments of stretches of ``data`` of the given sizes; None if the tokens of A or B do not join to it."""
        if b"".join([self.a_bytes[i] for i in a_ids]) != data or b"".join([self.b_bytes[i] for i in b_ids]) != data:
            return None
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last_a, last_b = np.searchsorted(a_ends, both).tolist(), np.searchsorted(b_ends, both).tolist()
        a_names, b_names = list(map(str, a_ids)), list(map(str, b_ids))
        groups, first_a, first_b = [], 0, 0
        for i, j in zip(last_a, last_b, strict=True):
            if i == first_a and j == first_b:
                groups.append(a_names[i] + "|" + b_names[j])
            else:
                groups.append(",".join(a_names[first_a : i + 1]) + "|" + ",".join(b_names[first_b : j + 1]))
            first_a, first_b = i + 1, j + 1
        pairs = [a_ids[i] << 32 | b_ids[j] for i, j in zip(last_a, last_b, strict=True)]
        # Of each stretch: the groups, and the tokens of A and of B, up to its end.
        ends = np.cumsum(sizes)
        upto = (np.searchsorted(x, ends, "right").tolist() for x in (both, a_ends, b_ends))
        out, g, a, b = [], 0, 0, 0
        for g2, a2, b2 in zip(*upto, strict=True):
            out.append(Aligned(a2 - a, b2 - b, ";".join(groups[g:g2]), pairs[g:g2]))
            g, a, b = g2, a2, b2
        return out

    def _a_ids(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> Aligned | None:
        data = (" " + text).encode()
        found = self._cut(self._a_ids(" " + text), self.b.encode(text, num_threads=1), np.array([len(data)]), data)
        return found[0] if found else None

    def _part(self, part: str) -> Aligned | None:
        """A part on its own; before a line feed B gets a token of its own for the space that it adds."""
        if part[0] == " ":
            return self.whole(part[1:])
        ids, pieces = self._a_ids(part), self.b.encode(part, num_threads=1)
        if self.b_bytes[pieces[0]] != b" ":
            raise ValueError("a piece goes on over a line feed")
        data = part.encode()
        found = self._cut(ids, pieces[1:], np.array([len(data)]), data)
        return found[0] if found else None

    def _after_letter(self, mark: str) -> Aligned:
        text = " a" + mark
        return self._cut(self._a_ids(text), self.b.encode(text[1:], num_threads=1), np.array([2, len(mark)]), text.encode())[1]

    def _learn(self, parts: list[str]) -> None:
        """Alignments of parts, many of them as one text, whose cuts they are."""
        joined = [p for p in parts if not p[-1].isspace()]
        for at in range(0, len(joined), 500):
            some = joined[at : at + 500]
            # B adds a space, which must be that of a part.
            text = " a" + "".join(some)
            data = text.encode()
            sizes = np.array([2, *(len(p.encode()) for p in some)])
            found = self._cut(self._a_ids(text), self.b.encode(text[1:], num_threads=1), sizes, data)
            self.fresh.update(zip(some, found[1:] if found else map(self._part, some), strict=True))
        self.fresh.update((p, self._part(p)) for p in parts if p[-1].isspace())

    def texts(self, texts: list[str]) -> list[list[Aligned] | None]:
        """Alignments of the parts of each text, None for a text without tokens."""
        if not self.by_parts:
            found = [self.whole(t) if t else None for t in texts]
            return [None if x is None else [x] for x in found]
        cut = [split_parts(t) for t in texts]
        wanted = set().union(*cut) if cut else set()
        if len(self.fresh) > REMEMBERED:
            self.old, self.fresh = self.fresh, {}
        # Differences with a dictionary itself do not go through all of it, those with its keys do.
        new = wanted.difference(self.fresh)
        for p in [p for p in new if p in self.old]:
            self.fresh[p] = self.old[p]
            new.discard(p)
        # A word with a mark after it is the word and the mark.
        tails = {p for p in new if p[-1] in self.mark_of and _LETTER.match(p, len(p) - 2)}
        self._learn(list(new - tails | {p[:-1] for p in tails}.difference(self.fresh)))
        for p in tails:
            word, mark = self.fresh[p[:-1]], self.mark_of[p[-1]]
            if word is None:
                self.fresh[p] = None
            else:
                groups = word.groups + ";" + mark.groups
                self.fresh[p] = Aligned(word.n_a + mark.n_a, word.n_b + mark.n_b, groups, word.pairs + mark.pairs)
        get = self.fresh.__getitem__
        out = []
        for parts in cut:
            found = list(map(get, parts))
            out.append(None if not found or None in found else found)
        return out


#: Between a character that is no white space and a single space or line feed with another such character after it.
_BETWEEN = re.compile(r"(?<=\S)(?=[ \n]\S)")


#: Letters that both the split of A and this module call so.
_LETTER = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")


def split_parts(text: str) -> list[str]:
    """Parts of a text, each with the space or line feed before it; the first has the space that both tokenizers add."""
    return _BETWEEN.split(" " + text) if text else []


class Block:
    """Documents and inverted lists of one block."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.size = 0
        self.docs: list[tuple] = []
        #: By pair: documents and numbers of links, in order of documents.
        self.places: dict[int, list[int]] = {}

    def add(self, doc_id: int | None, parts: list[Aligned] | None, n_bytes: int) -> None:
        place = len(self.docs)
        self.size += n_bytes
        if parts is None:
            self.docs.append((place, doc_id, 0, 0, 0, 0, ""))
            return
        groups = ";".join([p.groups for p in parts])
        links = Counter([x for p in parts for x in p.pairs])
        for pair, n in links.items():
            at = self.places.get(pair)
            if at is None:
                at = self.places[pair] = []
            at.append(place << 40 | n)
        n_a, n_b, n = sum([p.n_a for p in parts]), sum([p.n_b for p in parts]), links.total()
        # Each group ends with the one pair of tokens that end together.
        self.docs.append((place, doc_id, n_a, n_b, n, n, hashlib.sha256(groups.encode()).hexdigest()))

    def rows(self) -> pa.RecordBatch:
        """A row for each document, then one for each pair with its planes."""
        n, m = len(self.docs), len(self.places)
        pairs = np.array(list(self.places), np.int64)
        n_docs, links, planes = [], [], []
        for packed in self.places.values():
            both = np.array(packed, np.int64)
            place, times = both >> 40, both & ((1 << 40) - 1)
            made = make_planes(place, times, n)
            planes.append(made)
            n_docs.append(popcount(made[0]) if len(made) == 1 else len(merge(made, n)))
            links.append(sum(popcount(x) << j for j, x in enumerate(made)))
        columns = list(zip(*self.docs, strict=True)) if n else [[]] * 7
        none_docs, none_pairs = [None] * n, [None] * m
        values = [
            [0] * n + [1] * m,
            [self.number] * (n + m),
            [*columns[0], *none_pairs],
            *([*c, *none_pairs] for c in columns[1:]),
            [*none_docs, *(pairs >> 32).tolist()],
            [*none_docs, *(pairs & 0xFFFFFFFF).tolist()],
            [*none_docs, *n_docs],
            [*none_docs, *links],
            [*none_docs, *planes],
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _TYPES, strict=True)], names=_NAMES)


def compress(places: np.ndarray, n: int) -> bytes:
    """Sorted places below ``n``: a zero byte and bits, or a one byte and 16-bit places where few are set."""
    if len(places) * _SPARSE < n:
        return b"\1" + places.astype("<u2").tobytes()
    bits = np.zeros(n, bool)
    bits[places] = True
    return b"\0" + np.packbits(bits).tobytes()


def expand(data: bytes, n: int) -> np.ndarray:
    """Sorted places of a compressed bitmap."""
    if data[:1] == b"\1":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=n))


def popcount(data: bytes) -> int:
    if data[:1] == b"\1":
        return (len(data) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(data, np.uint8, offset=1)).sum())


def merge(bitmaps: list[bytes], n: int) -> np.ndarray:
    """Places of the OR of compressed bitmaps, by one pass over bits."""
    seen = np.zeros(n, bool)
    for data in bitmaps:
        seen[expand(data, n)] = True
    return np.flatnonzero(seen)


def make_planes(places: np.ndarray, times: np.ndarray, n: int) -> list[bytes]:
    """Compressed bitmaps of the binary digits of ``times`` at ``places``, lowest first."""
    return [compress(places[(times >> j) & 1 == 1], n) for j in range(int(times.max()).bit_length())]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_file: str, b_file: str) -> Aligner:
    """One for each Python worker, which keeps what it has met."""
    key = (a_file, b_file)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_file, b_file)
    return _ALIGNERS[key]


def encode_blocks(docs: DataFrame, a_file: str, b_file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (kind 0) and of pairs (kind 1) of all blocks."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(a_file, b_file)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(1).to_pylist()
                found = aligner.texts(texts)
                for doc_id, aligned, t in zip(part.column(0).to_pylist(), found, texts, strict=True):
                    block.add(doc_id, aligned, len(t))
                    if len(block.docs) >= BLOCK_DOCS or block.size >= BLOCK_BYTES:
                        yield block.rows()
                        number += 1
                        block = Block(number)
        if block.docs:
            yield block.rows()

    return rows.mapInArrow(run, _ROWS)


def _return(key: tuple, docs: pa.Table, lists: pa.Table) -> pa.Table:
    """Documents of a block with what the pairs' planes return."""
    docs = docs.sort_by("place")
    n = len(docs)
    best, total, linked = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for batch in lists.to_batches():
        counts, firsts = batch.column("count").to_pylist(), batch.column("is_best").to_pylist()
        for planes, count, first in zip(batch.column("planes").to_pylist(), counts, firsts, strict=True):
            for j, data in enumerate(planes):
                places = expand(data, n)
                total[places] += count << j
                linked[places] += 1 << j
                if first:
                    best[places] += 1 << j
    if (linked != docs.column("n_links").to_numpy()).any():
        raise ValueError("planes do not hold a block's links")
    own = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({**own, "n_best": best, "count_sum": total, "groups_sha256": docs.column("groups_sha256")})


@dataclass
class Pairs:
    """``documents`` with their scores, and ``pairs`` (a, b, n_docs, count, is_best)."""

    documents: DataFrame
    pairs: DataFrame


def align_pairs(docs: DataFrame, a_file: str, b_file: str, **columns: str) -> Pairs:
    """Encode ``docs`` by the byte-level tokenizer A and the piece model B and count their pairs."""
    blocks = store_table(encode_blocks(docs, a_file, b_file, **columns), None, "kind")
    lists = blocks.where("kind = 1").select("block", "a", "b", "n_docs", "links", "planes")
    counts = lists.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("links").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    pairs = store_table(counts.join(most, "b").select("a", "b", "n_docs", "count", (F.col("count") == F.col("most")).alias("is_best")))
    scored = lists.join(pairs.select("a", "b", "count", "is_best"), ["a", "b"]).select("block", "planes", "count", "is_best")
    rows = blocks.where("kind = 0").select(F.col("block").alias("own_block"), "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    result = rows.groupBy("own_block").cogroup(scored.groupBy("block")).applyInArrow(_return, RESULT)
    return Pairs(result, pairs)
