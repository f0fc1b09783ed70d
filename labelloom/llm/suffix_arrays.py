"""Bytes that earlier documents have: suffix arrays of shards.

Every byte covered by a string of ``size`` bytes that also starts in a document of a smaller id
is removed; strings are judged on the input. Candidate text comes by :mod:`substrings` to
shards. A shard sorts its suffixes by Larsson and Sadakane's refinement (groups of equal
prefixes, only those not yet single, by the rank ``h`` bytes on, ``h`` doubling), takes the
common prefixes of neighbours, and has the smallest document of each group that shares
``size`` bytes. A shard over ``sort_bytes`` is sorted in parts, whose groups are merged
by binary search. Kasai's common prefixes are computed for all neighbours at once, eight bytes a step, as
only whether they reach ``size`` matters.

Defined results: null texts are empty; a null id is before all others; documents of the same id
do not remove each other's bytes; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelloom.llm.substrings import Kind, Sequences, covered_spans, find_repeats, gather, ids_of, text_of
from labelloom.llm.words import BYTE_VALUES, utf8

U = np.uint64
SIZE = 50
#: Text sorted at once, in bytes, and the share of the corpus whose repeats are one shard.
SORT_BYTES, SHARD_BYTES = 1 << 20, 2 << 20
SCHEMA = "doc_id bigint, n_bytes bigint, spans array<struct<first:bigint,last:bigint>>, kept binary"


def eights(text: np.ndarray, reach: int) -> np.ndarray:
    """The eight bytes at each place as one number that sorts like them; zeros follow the text for ``reach`` bytes."""
    x = np.concatenate((text, np.zeros(reach + 8, np.uint8))).astype(U)
    for width in (1, 2, 4):
        x = (x[:-width] << U(8 * width)) | x[width:]
    return x


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` bytes (or more) that follow them."""
    n = len(text)
    key = eights(text, 0)[:n]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n + 1, np.int64)  # of the group's first slot, one up; 0 is past the end
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    h = 8
    while h < depth:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        active = order[slots]
        keys = (rank[active] << 32) | rank[np.minimum(active + h, n)]
        by = np.argsort(keys)
        order[slots], keys = active[by], keys[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        new[slots] = fresh
        rank[order[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        h *= 2
    return order


def share_prefix(key: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and ``b`` are the same."""
    same = np.ones(len(a), bool)
    for step in _steps(size):
        live = np.flatnonzero(same)
        same[live] = key[a[live] + step] == key[b[live] + step]
    return same


def _steps(size: int) -> list[int]:
    return sorted({*range(0, size - 7, 8), size - 8})


def _before(key: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` sort before those at ``b``."""
    out, live = np.zeros(len(a), bool), np.arange(len(a))
    for step in _steps(size):
        x, y = key[a[live] + step], key[b[live] + step]
        out[live] = x < y
        live = live[x == y]
    return out


def find_places(key: np.ndarray, ordered: np.ndarray, wanted: np.ndarray, size: int) -> np.ndarray:
    """Binary search of strings among ordered ones: the first that is not smaller."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(ordered), np.int64)
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) // 2
        smaller = _before(key, ordered[middle], wanted[live], size)
        low[live] = np.where(smaller, middle + 1, low[live])
        high[live] = np.where(smaller, high[live], middle)


def smallest_owner(text: np.ndarray, places: np.ndarray, owner: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """For each string of ``size`` bytes at ``places``, the smallest owner of an equal string.

    ``part`` (rising) numbers the parts of the text that are sorted on their own.
    """
    key = eights(text, size)
    label = np.zeros(len(places), np.int64)
    ordered, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = np.zeros(0, np.int64)
    which = np.full(len(text), -1, np.int64)
    which[places] = np.arange(len(places))
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        low, high = int(places[own[0]]), int(places[own[-1]]) + size
        order = suffix_array(text[low:high], size) + low
        order = order[which[order] >= 0]
        order = order[part[which[order]] == p]
        new = np.ones(len(order), bool)
        new[1:] = ~share_prefix(key, order[:-1], order[1:], size)
        heads = np.flatnonzero(new)
        least = np.minimum.reduceat(owner[which[order]], heads)
        reps = order[heads]
        at = find_places(key, ordered, reps, size)
        met = np.zeros(len(reps), bool)
        inside = at < len(ordered)
        met[inside] = share_prefix(key, ordered[at[inside]], reps[inside], size)
        name = np.zeros(len(reps), np.int64)
        name[met] = names[at[met]]
        best[name[met]] = np.minimum(best[name[met]], least[met])
        name[~met] = len(best) + np.arange(int((~met).sum()))
        best = np.concatenate((best, least[~met]))
        ordered, names = np.insert(ordered, at[~met], reps[~met]), np.insert(names, at[~met], name[~met])
        label[which[order]] = name[np.cumsum(new) - 1]
    return best[label]


def _resolver(size: int, sort_bytes: int):
    def resolve(payloads: list[bytes], keys: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        text = np.frombuffer(b"".join(payloads), np.uint8)
        lengths = np.array([len(p) for p in payloads], np.int64)
        starts = np.cumsum(lengths) - lengths
        n = counts
        segment = np.repeat(np.arange(len(n)), n)
        places = starts[segment] + np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        least = smallest_owner(text, places, owners[segment], (starts // sort_bytes)[segment], size)
        return np.split(least < owners[segment], np.cumsum(n)[:-1])

    return resolve


def _read(table: pa.Table) -> Sequences:
    data, first = utf8(text_of(table))
    return Sequences(
        ids_of(table), first, lambda a, z: BYTE_VALUES[data[a:z]], lambda starts, ends: gather(data, starts, ends)
    )


def _result(table: pa.Table, covered: np.ndarray, s: Sequences) -> pa.Table:
    data, first = utf8(text_of(table))
    keep = ~covered
    ends = np.concatenate(([0], np.cumsum(keep)))[first].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[keep].tobytes())])
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "n_bytes": pa.array(np.diff(first)),
            "spans": covered_spans(covered, first),
            "kept": kept,
        }
    )


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, sort_bytes: int = SORT_BYTES, **sizes
) -> DataFrame:
    """doc_id, n_bytes, removed spans of bytes and the kept bytes of every document."""
    sizes = {"shard_bytes": SHARD_BYTES} | sizes
    kind = Kind(size, max(1, size * 8 // 25), _read, False, _resolver(size, sort_bytes), _result, SCHEMA, **_hot(sizes))
    return find_repeats(docs, kind, id_column, text, **sizes)


def _hot(sizes: dict) -> dict:
    return {"hot": sizes.pop("hot")} if "hot" in sizes else {}
