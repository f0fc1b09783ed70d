"""Token ids of documents in ORC files.

Texts are encoded with a given tokenizer and written in document order as ORC: integer
run-length encoding of the ids, a row index, and a Bloom filter on the document id in every
stripe. Files are read stripe by stripe, and a filter on ``doc_id`` skips stripes by their
statistics and filters.

Defined results: a null or empty text has only the end id; repeated ids are kept, ordered by
text; null ids come first; other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm.common import cores, parts_for, text_bytes
from labelloom.session import arrow_batches, new_run_dir, store_table

#: Text that goes into one ORC file, in bytes.
FILE_BYTES = 48 << 20
#: Text or ids that a Python worker gets at once, in bytes; a longer document comes alone.
BATCH_BYTES = 8 << 20
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "2000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids array<int>"

# A space or line feed between two printable characters always begins a piece of the byte-level
# split, so texts may be cut there and the parts encoded on their own. Parts after a line feed
# are marked by a zero character.
_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_WHOLE = re.compile(r"\0?[!-~\w](?:[!-~\w\n]*[!-~\w])?")
# What byte-level vocabularies call the bytes of the letters above ASCII.
_BYTE_NAMES = {b: chr(b) if 161 <= b <= 172 or b >= 174 else chr(256 + 33 + (b - 127 if b < 161 else 34)) for b in range(128, 256)}
_MARKS = frozenset(".,;:!?")
# Parts that a Python worker remembers, in each of two generations.
_CACHE_PARTS = 250_000


class Encoder:
    """Encodes texts part by part and remembers the ids of parts it has met.

    The cuts hold for byte-level tokenizers that attach a space to the word after it; any other
    tokenizer encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        split = self.tokenizer.pre_tokenizer
        self.by_parts = split is not None and b'"ByteLevel"' in split.__getstate__()
        words = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(words.values(), default=0) + 1, bool)
        self.opens[[i for w, i in words.items() if w[:1] in "ĠĊ"]] = True
        self.coded = [int(i).to_bytes(4, "little") for i in range(len(self.opens))]
        # A space and letters up to U+024F are one piece, which goes to the model as it is.
        self.direct = self.by_parts and self.tokenizer.normalizer is None and all(c in words for c in _BYTE_NAMES.values())
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, parts: list[str]) -> None:
        """Ids of whole parts, many per call; a part opens with the only id that holds a space or line feed."""
        groups = [parts[at : at + 100] for at in range(0, len(parts), 100)]
        texts = ["".join([" " + p if p[0] != "\0" else "\n" + p[1:] for p in some]) for some in groups]
        for some, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(some):
                raise ValueError("a part of a text has an inner opening")
            data, cuts = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            self.known.update((p, data[a:b]) for p, a, b in zip(some, cuts, cuts[1:], strict=False))

    def _learn_words(self, words: list[str]) -> None:
        """Ids of words of letters up to U+024F after a space, without the rest of the tokenizer's work."""
        tokenize, coded, known = self.tokenizer.model.tokenize, self.coded, self.known
        for w in words:
            named = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_NAMES)
            known[w] = b"".join([coded[t.id] for t in tokenize("Ġ" + named)])

    def _tail(self, part: str) -> bytes | None:
        """Ids of a known word with a mark after it, which is a piece of its own."""
        word, mark = part[:-1], part[-1]
        ids = self.known.get(word) or self.old.get(word)
        if mark not in _MARKS or ids is None or not word.isalpha() or not (word.isascii() or max(word) <= "\u024f"):
            return None
        if mark not in self.marks:
            self.marks[mark] = self.ids(mark).tobytes()
        return ids + self.marks[mark]

    def _uneven(self, text: str) -> bytes:
        """A text with other white space than single spaces and line feeds between printable characters."""
        first, *parts = _CUT.split(text)
        return self.ids(first).tobytes() + b"".join([self.ids(" " + p).tobytes() for p in parts])

    def _look_up(self, parts: list[str]) -> list[bytes | None]:
        """Ids of distinct parts, learned where they are not known; none for odd parts, which have no ids of their own."""
        if len(self.known) > _CACHE_PARTS:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        found = [*map(known.get, parts)]
        places = [i for i, ids in enumerate(found) if ids is None]
        new = [parts[i] for i in places]
        words, plain, tails = [], [], []
        for p, ids in zip(new, map(old.get, new), strict=True):
            if ids is not None:
                known[p] = ids
            elif p.isalpha() and self.direct and (p.isascii() or max(p) <= "\u024f"):
                words.append(p)
            elif p[-1:] in _MARKS and p[:-1].isalpha():
                tails.append(p)
            elif _WHOLE.fullmatch(p) and "\n" not in p:
                plain.append(p)
        self._learn_words(words)
        self._learn(plain)
        left = []
        for p in tails:
            ids = self._tail(p)
            if ids is None:
                left.append(p)
            else:
                known[p] = ids
        self._learn(left)
        for i, p in zip(places, new, strict=True):
            found[i] = known.get(p)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without an end id."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Like :meth:`encode`, for a column. Parts are cut, told apart and put together by Arrow; only distinct ones are looked at one by one."""
        if not self.by_parts:
            return [self.ids(t or "").tobytes() for t in texts.to_pylist()]
        if not len(texts):
            return []
        texts = texts.fill_null("")
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \0"), " ")
        first = cut.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        # A text's first part has no space before it and is encoded by itself.
        heads = cut.flatten().take(pa.array(first[:-1])).to_pylist()
        later = np.ones(first[-1], bool)
        later[first[:-1]] = False
        coded = cut.flatten().filter(pa.array(later)).dictionary_encode()
        found = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        odd = np.array([x is None for x in found], bool)
        which = coded.indices.to_numpy()
        joined = pa.array(found, pa.large_binary()).fill_null(b"").take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64) if len(joined) else np.zeros(1, np.int64)
        data = memoryview(joined.buffers()[2] or b"") if len(joined) else memoryview(b"")
        parts = first - np.arange(len(first))  # of each text begin here, its head left out
        uneven = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        if odd.any():
            uneven[np.searchsorted(parts, np.flatnonzero(odd[which]), "right") - 1] = True
        out = []
        for i, (head, a, z) in enumerate(zip(heads, parts.tolist(), parts[1:].tolist(), strict=False)):
            if uneven[i] or (z > a and not _WHOLE.fullmatch(head)):
                out.append(self._uneven(texts[i].as_py()))
            else:
                out.append(b"".join((self.ids(head).tobytes(), data[ends[a] : ends[z]])))
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps what it has met from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_shards(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Rows of :data:`SCHEMA`: documents in id order, dealt over shards of adjacent ids."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = parts_for(text_bytes(rows), FILE_BYTES, cores(docs))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, start, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer)
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                ids = [x + end for x in encoder.encode_column(part.column(1))]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate(([0], np.cumsum(counts)))
                values = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.full(len(counts), shard, np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)),
                    ],
                    names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    return ordered.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, **columns: str) -> None:
    """Encode ``docs`` and write the ORC files below ``path``."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        encode_shards(docs, tokenizer, end_id=end_id, **columns).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the files with ``start``, the ids of all documents before them.

    A shard's first place is the sum of the sizes of the shards before it: one row per file.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    # One row per file of FILE_BYTES of text: small enough for every task.
    places = F.broadcast(_running(sizes))
    return rows.join(places, "shard").select(
        "doc_id", (F.col("shard_before") + F.col("shard_start")).alias("start"), "n_tokens", "ids"
    )


def _running(sizes: DataFrame) -> DataFrame:
    """Sum of the sizes of all earlier shards; the window holds one row per file."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shard_before"))


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; stripes are skipped by the id's statistics and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the unsigned crc32 of the ids as little-endian 32-bit integers, stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            ids = batch.column(3)
            values = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            ends = 4 * np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64))
            sums = [zlib.crc32(values[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    with arrow_batches(tokens.sparkSession, BATCH_BYTES):
        return store_table(tokens.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def token_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the documents' ids and return what the files hold, one row per document."""
    spark = docs.sparkSession
    path = path or new_run_dir(spark, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(spark, path)
