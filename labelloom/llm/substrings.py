"""Where documents repeat strings of a fixed length: the part that is the same for bytes and words.

A document is a sequence (bytes or words), a window ``size`` consecutive elements. Which windows
also begin earlier is found without comparing documents with each other:

1. Windows are gathered by their least hash among the ``gram``-element substrings. Equal windows
   have the same least hash, and neighbouring windows mostly share one, so a run of windows with
   the same key is one segment, ``size - 1`` elements longer than its number of windows.
2. Each chunk of documents sends its distinct keys. A key is of interest if two documents (or
   places) have it. All other text cannot repeat and goes no further.
3. Segments with such keys are folded where equal, and sent to the shard of their key, where a
   resolver tells which of their windows begin earlier.
4. Chunks get the answers and mark what is covered.

Documents are dealt over chunks once, by a hash of their id; all three looks at the text read
that one shuffle. What is sent is packed per chunk and shard. A key that very many segments
have is split: its windows are sent one by one to the shard of a hash of the whole window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common
from labelloom.llm.words import Powers, find_words, mix, span_hashes

U = np.uint64
_STEP = U(0xC2B2AE3D27D4EB4F)
_MOST = U(0xFFFFFFFFFFFFFFFF)
#: Text of one chunk and, roughly, of one shard, in bytes.
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
#: Elements looked at together.
_SLICE = 1 << 19
#: Windows of one segment at most.
_RUN = 256
#: A key with more segments than this is split by window.
HOT_SEGMENTS = 20_000
_NULL_ID = np.iinfo(np.int64).min


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, each of as many bytes as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=U)


@dataclass
class Sequences:
    """Documents of a chunk, in order of id, one after the other.

    ``values`` gives the 64-bit values of a range of elements; ``first`` where each document begins (one more at
    the end); ``slice_bytes`` the bytes of a range of elements.
    """

    ids: np.ndarray
    first: np.ndarray
    values: Callable[[int, int], np.ndarray]
    slice_bytes: Callable[[np.ndarray, np.ndarray], tuple[bytes, np.ndarray]]


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Slices of ``data``, one after the other, and their lengths."""
    lengths = ends - starts
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return data[shift + np.arange(len(shift))].tobytes(), lengths


def covered_spans(covered: np.ndarray, first: np.ndarray) -> pa.Array:
    """Maximal covered runs of each document, as first place and one past the last, from the document's start."""
    runs = find_words(covered, first, covered)
    base = np.repeat(first[:-1], runs.per_text())
    spans = pa.StructArray.from_arrays([pa.array(runs.starts - base), pa.array(runs.ends - base)], names=["first", "last"])
    return pa.ListArray.from_arrays(pa.array(runs.first.astype(np.int32)), spans)


@dataclass
class Segments:
    start: np.ndarray
    count: np.ndarray  # windows
    key: np.ndarray
    content: np.ndarray

    def take(self, which: np.ndarray) -> Segments:
        return Segments(self.start[which], self.count[which], self.key[which], self.content[which])


def _grams(x: np.ndarray, gram: int) -> np.ndarray:
    """48-bit hashes of all runs of ``gram`` elements."""
    done, hashes, part, width, step = 0, None, x, 1, _STEP
    while True:
        if gram & width:
            if hashes is None:
                hashes = part
            else:
                n = len(x) - done - width + 1
                hashes = hashes[:n] * step + part[done : done + n]
            done += width
            if done == gram:
                return mix(hashes[: len(x) - gram + 1]) >> U(16)
        part = part[:-width] * step + part[width:]
        step = U(int(step) ** 2 & int(_MOST))
        width *= 2


def _least(x: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Least (or by ``of``) of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = of(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def _key(least: np.ndarray) -> np.ndarray:
    """48-bit key of a least hash. Least hashes crowd near zero; keys are spread evenly, as shards are ranges of them."""
    return mix(least + _STEP) >> U(16)


def segments(s: Sequences, size: int, gram: int, content: bool) -> Segments:
    """All windows of the documents, as runs with the same key."""
    out, powers = [], Powers()
    for low, x, least, fits in _windows(s, size, gram):
        new = fits.copy()
        new[1:] &= ~fits[:-1] | (least[1:] != least[:-1])
        last = fits.copy()
        last[:-1] &= ~fits[1:] | (least[1:] != least[:-1])
        starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
        pieces = (ends - starts + _RUN - 1) // _RUN
        owner = np.repeat(np.arange(len(starts)), pieces)
        at = starts[owner] + _RUN * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        count = np.minimum(ends[owner] - at, _RUN)
        hashes = span_hashes(x, at, at + count + size - 1, powers) if content else np.zeros(0, U)
        out.append((at + low, count, _key(least[at]), hashes))
    if not out:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none.view(U), none.view(U))
    return Segments(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _windows(s: Sequences, size: int, gram: int):
    """Slices: where they begin, values, the key of the window at each place, and whether it is inside one document."""
    n = int(s.first[-1])
    lengths = np.diff(s.first)
    for low in range(0, max(0, n - size + 1), _SLICE):
        high = min(n, low + _SLICE + size - 1)
        x = s.values(low, high)
        least = _least(_grams(x, gram), size - gram + 1)
        place = np.arange(low, low + len(least))
        doc = np.searchsorted(s.first, place, "right") - 1 if len(lengths) < 2 else _doc_of(s.first, low, len(least))
        yield low, x, least, place + size <= s.first[doc + 1]


def _doc_of(first: np.ndarray, low: int, n: int) -> np.ndarray:
    """Document of each of ``n`` places from ``low`` on."""
    begin = int(np.searchsorted(first, low, "right")) - 1
    inside = first[begin + 1 : np.searchsorted(first, low + n)] - low
    steps = np.bincount(inside, minlength=n + 1)[:n]
    return begin + np.cumsum(steps)


def key_places(s: Sequences, size: int, gram: int) -> np.ndarray:
    """Key of each place that holds the least hash of some window."""
    width, out = size - gram + 1, []
    for low, x, least, fits in _windows(s, size, gram):
        grams = _grams(x, gram)
        masked = np.concatenate((np.zeros(width - 1, U), np.where(fits, least, U(0)), np.zeros(width - 1, U)))
        places = np.flatnonzero((_least(masked, width, np.maximum) == grams) & (grams > 0))
        out.append(np.stack((_key(grams[places]), (places + low).astype(U)), 1))
    if not out:
        return np.zeros(0, U)
    both = np.concatenate(out)
    order = np.lexsort((both[:, 1], both[:, 0]))
    both = both[order]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]).any(1)  # slices overlap
    return both[new, 0]


@dataclass
class Kind:
    """What differs between bytes and words."""

    size: int
    gram: int
    read: Callable[[pa.Table], Sequences]
    #: Whether repeats inside one document count, with the place in it; else only other documents do.
    within: bool
    #: (payloads by order of owner, keys, owners, window counts) -> for each, which windows begin earlier.
    resolve: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]
    #: (chunk's table in order, covered elements, sequences) -> result table.
    result: Callable[[pa.Table, np.ndarray, Sequences], pa.Table]
    schema: str
    hot: int = HOT_SEGMENTS


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each key; rises with the key."""
    return ((keys >> U(16)) * U(n) >> U(32)).astype(np.int64)


def _in_order(table: pa.Table) -> pa.Table:
    """Rows by id, null first, and text."""
    order = pc.sort_indices(table.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(order).combine_chunks()


def text_of(table: pa.Table) -> pa.Array:
    column = table.column("text")
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def ids_of(table: pa.Table) -> np.ndarray:
    """Ids as 64-bit integers, null before all others."""
    return table.column("doc_id").fill_null(_NULL_ID).to_numpy()


def _pack_facts(n: np.ndarray, twice: np.ndarray) -> bytes:
    """Numbers of segments and whether a key is repeated in its chunk, by planes of bytes, most of which are zeros."""
    facts = np.minimum(n, (1 << 31) - 1).astype("<u4") << np.uint32(1) | twice.astype("<u4")
    return facts.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack_facts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]


def _send_keys(kind: Kind, n_buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        s = kind.read(_in_order(table))
        found = segments(s, kind.size, kind.gram, False)
        order = np.argsort(found.key, kind="stable")
        keys = found.key[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(keys)))
        keys = keys[heads]
        if kind.within:
            places, times = np.unique(key_places(s, kind.size, kind.gram), return_counts=True)
            at = np.minimum(np.searchsorted(places, keys), max(0, len(places) - 1))
            twice = (places[at] == keys) & (times[at] > 1) if len(places) else np.zeros(len(keys), bool)
        else:
            ids = s.ids[np.searchsorted(s.first, found.start, "right") - 1][order]
            twice = ids[heads] != ids[np.append(heads[1:], len(ids)) - 1] if len(keys) else np.zeros(0, bool)
        rows = []
        bucket = _buckets(keys, n_buckets)
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
        for b in np.unique(bucket).tolist():
            a, z = cuts[b], cuts[b + 1]
            rows.append((b, pack(keys[a:z]), _pack_facts(n[a:z], twice[a:z])))
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "keys": pa.array([r[1] for r in rows], pa.binary()),
                "facts": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    return run


def _judge_keys(hot: int):
    """For each chunk's keys: 0 not repeated, 1 repeated, 2 repeated by very many segments."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack(k) for k in table.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        facts = np.concatenate([_unpack_facts(x) for x in table.column("facts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        chunks = np.diff(np.append(heads, len(keys)))
        total = np.add.reduceat((facts[order] >> np.uint32(1)).astype(np.int64), heads)
        twice = np.maximum.reduceat(facts[order] & np.uint32(1), heads) > 0
        verdict = ((chunks > 1) | twice).astype(np.uint8) * (1 + (total > hot)).astype(np.uint8)
        flags = np.zeros(len(keys), np.uint8)
        flags[order] = np.repeat(verdict, chunks)
        ends = np.cumsum([len(p) for p in parts])
        raw = flags.tobytes()
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "flags": pa.array([raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()),
            }
        )

    return run


@dataclass
class Plan:
    """Repeated segments of a chunk, ordered by key and content, and the distinct ones among them."""

    found: Segments
    group: np.ndarray  # number of the distinct segment
    heads: np.ndarray  # first of each distinct segment, the earliest
    sequences: Sequences


def _plan(kind: Kind, table: pa.Table, flags: np.ndarray) -> Plan:
    s = kind.read(table)
    found = segments(s, kind.size, kind.gram, True)
    # One sort gives each segment the number of its key, and so its flag.
    order = np.argsort(found.key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(found.key[order]) != 0
    if len(flags) != np.count_nonzero(new):
        raise ValueError("a chunk's keys differ between two looks at it")
    flag = np.zeros(len(order), np.uint8)
    flag[order] = flags[np.cumsum(new) - 1]
    plain, hot = found.take(flag == 1), found.take(flag == 2)
    if len(hot.start):
        owner = np.repeat(np.arange(len(hot.start)), hot.count)
        at = hot.start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(hot.count) - hot.count, hot.count)
        hashes, powers = np.zeros(len(at), U), Powers()
        for low in range(0, int(s.first[-1]), _SLICE):
            a, z = np.searchsorted(at, (low, low + _SLICE))
            if z > a:
                x = s.values(low, min(int(s.first[-1]), low + _SLICE + kind.size - 1))
                hashes[a:z] = span_hashes(x, at[a:z] - low, at[a:z] - low + kind.size, powers)
        single = Segments(at, np.ones(len(at), np.int64), mix(hashes) >> U(16), hashes)
        plain = Segments(*(np.concatenate(x) for x in zip(_fields(plain), _fields(single), strict=True)))
    order = np.lexsort((plain.start, plain.content, plain.key))
    plain = plain.take(order)
    new = np.ones(len(order), bool)
    new[1:] = (plain.key[1:] != plain.key[:-1]) | (plain.content[1:] != plain.content[:-1]) | (plain.count[1:] != plain.count[:-1])
    return Plan(plain, np.cumsum(new) - 1, np.flatnonzero(new), s)


def _fields(s: Segments) -> tuple[np.ndarray, ...]:
    return s.start, s.count, s.key, s.content


def _flags_of(table: pa.Table) -> np.ndarray:
    table = table.sort_by("bucket")
    return np.frombuffer(b"".join(table.column("flags").to_pylist()), np.uint8)


_SENT = "bucket int, chunk int, keys binary, ids binary, places binary, counts binary, lengths binary, payload binary"


def _send_segments(kind: Kind, n_buckets: int):
    def run(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        flags = _flags_of(flags)
        plan = _plan(kind, _in_order(table), flags)
        s, own = plan.sequences, plan.found.take(plan.heads)
        ids = s.ids[np.searchsorted(s.first, own.start, "right") - 1] if len(own.start) else np.zeros(0, np.int64)
        bucket = _buckets(own.key, n_buckets)
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
        # The flags go along, to come back with the answers.
        rows = [(chunk % n_buckets, b"", b"", b"", b"", b"", flags.tobytes())]
        for b in np.unique(bucket).tolist():
            a, z = cuts[b], cuts[b + 1]
            payload, lengths = s.slice_bytes(own.start[a:z], own.start[a:z] + own.count[a:z] + kind.size - 1)
            rows.append(
                (
                    b,
                    pack(own.key[a:z]),
                    ids[a:z].astype("<i8").tobytes(),
                    own.start[a:z].astype("<i8").tobytes() if kind.within else b"",
                    own.count[a:z].astype("<u2").tobytes(),
                    lengths.astype("<u4").tobytes(),
                    payload,
                )
            )
        kinds = [pa.int32(), *[pa.binary()] * 6]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        columns.insert(1, pa.array([chunk] * len(rows), pa.int32()))
        return pa.Table.from_arrays(columns, names="bucket chunk keys ids places counts lengths payload".split())

    return run


def _resolve(kind: Kind):
    """One shard: fold equal segments of all chunks, and say of each chunk's which windows begin earlier."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        distinct: dict[tuple[int, bytes], int] = {}
        owner: list[tuple[int, int]] = []
        keys: list[int] = []
        counts: list[int] = []
        member: list[np.ndarray] = []
        firsts: list[list[tuple[int, int]]] = []
        for row in rows:
            if not row["keys"]:
                member.append(np.zeros(0, np.int64))
                firsts.append([])
                continue
            ids = np.frombuffer(row["ids"], "<i8").tolist()
            places = np.frombuffer(row["places"], "<i8").tolist() if kind.within else [0] * len(ids)
            ends = np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64)).tolist()
            count = np.frombuffer(row["counts"], "<u2").tolist()
            data, at, own = row["payload"], 0, []
            for k, i, p, e, c in zip(unpack(row["keys"]).tolist(), ids, places, ends, count, strict=True):
                what = (k, data[at:e])
                at = e
                d = distinct.get(what)
                if d is None:
                    d = distinct[what] = len(owner)
                    owner.append((i, p))
                    keys.append(k)
                    counts.append(c)
                elif (i, p) < owner[d]:
                    owner[d] = (i, p)
                own.append(d)
            member.append(np.array(own, np.int64))
            firsts.append(list(zip(ids, places, strict=True)))
        early: list[np.ndarray] = [np.zeros(0, bool)] * len(owner)
        if owner:
            order = sorted(range(len(owner)), key=lambda d: (keys[d], owner[d]))
            payloads = [x[1] for x in distinct]
            answers = kind.resolve(
                [payloads[d] for d in order],
                np.array([keys[d] for d in order], U),
                np.array([owner[d][0] for d in order], np.int64),
                np.array([counts[d] for d in order], np.int64),
            )
            for d, mask in zip(order, answers, strict=True):
                early[d] = mask
        states, masks = [], []
        for own, first in zip(member, firsts, strict=True):
            state, bits = np.zeros(len(own), np.uint8), []
            for j, (d, f) in enumerate(zip(own.tolist(), first, strict=True)):
                mask = early[d]
                if f > owner[d] if kind.within else f[0] > owner[d][0]:
                    state[j] = 1
                elif mask.any():
                    state[j] = 1 if mask.all() else 2
                    if state[j] == 2:
                        bits.append(mask)
            states.append(state.tobytes())
            masks.append(np.packbits(np.concatenate(bits)).tobytes() if bits else b"")
        passed = [None if r["keys"] else r["payload"] for r in rows]
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "states": pa.array(states, pa.binary()),
                "masks": pa.array(masks, pa.binary()),
                "flags": pa.array(passed, pa.binary()),
            }
        )

    return run


def _mark(kind: Kind):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = answers.sort_by("bucket").to_pylist()
        table = _in_order(table)
        flags = b"".join(r["flags"] for r in rows if r["flags"] is not None)
        plan = _plan(kind, table, np.frombuffer(flags, np.uint8))
        s, found, group = plan.sequences, plan.found, plan.group
        rows = [r for r in rows if r["flags"] is None]
        states = np.frombuffer(b"".join(r["states"] for r in rows), np.uint8)
        counts = found.count[plan.heads]
        if len(states) != len(plan.heads):
            raise ValueError("answers do not fit a chunk's segments")
        # Bits of each partly repeated segment; those of one shard are packed together.
        partly = np.flatnonzero(states == 2)
        bits, at = [], 0
        for r in rows:
            own = np.frombuffer(r["states"], np.uint8)
            n = int(counts[at : at + len(own)][own == 2].sum())
            bits.append(np.unpackbits(np.frombuffer(r["masks"], np.uint8))[:n].astype(bool))
            at += len(own)
        bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        offset = np.zeros(len(states), np.int64)
        offset[partly] = np.cumsum(counts[partly]) - counts[partly]
        if kind.within:
            later = np.arange(len(group)) != plan.heads[group]
        else:
            ids = s.ids[np.searchsorted(s.first, found.start, "right") - 1] if len(group) else np.zeros(0, np.int64)
            later = ids != ids[plan.heads][group]
        whole = later | (states[group] == 1)
        edge = np.zeros(int(s.first[-1]) + 1, np.int32)
        np.add.at(edge, found.start[whole], 1)
        np.add.at(edge, found.start[whole] + found.count[whole] + kind.size - 1, -1)
        some = np.flatnonzero(~whole & (states[group] == 2))
        n = found.count[some]
        which = np.repeat(some, n)
        j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        hit = bits[offset[group[which]] + j] if len(which) else np.zeros(0, bool)
        np.add.at(edge, found.start[which[hit]] + j[hit], 1)
        np.add.at(edge, found.start[which[hit]] + j[hit] + kind.size, -1)
        return kind.result(table, np.cumsum(edge[:-1], dtype=np.int32) > 0, s)

    return run


def find_repeats(
    docs: DataFrame,
    kind: Kind,
    id_column: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Rows of ``kind.result`` for all documents."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = common.text_bytes(rows)
    least = max(common.cores(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_chunks = common.parts_for(total, chunk_bytes, least)
    n_key_buckets = common.parts_for(total, 4 * chunk_bytes, common.cores(docs))
    n_buckets = common.parts_for(total, shard_bytes, least)
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).cast("int")
    dealt = rows.withColumn("chunk", chunk).repartition(n_chunks, "chunk")
    keys = dealt.groupBy("chunk").applyInArrow(
        _send_keys(kind, n_key_buckets), "bucket int, chunk int, keys binary, facts binary"
    )
    flags = keys.groupBy("bucket").applyInArrow(_judge_keys(kind.hot), "chunk int, bucket int, flags binary")
    sent = dealt.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_send_segments(kind, n_buckets), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(
        _resolve(kind), "chunk int, bucket int, states binary, masks binary, flags binary"
    )
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_mark(kind), kind.schema)
