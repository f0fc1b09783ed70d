import hashlib
import random

import numpy as np
import pytest

from labelloom.llm import suffix_arrays, suffix_automata
from labelloom.llm.substrings import pack, unpack
from llm_helpers import docs_table, long_text, words

U = np.uint64


def text_of(rng, pieces):
    return " ".join(rng.choice(pieces) if rng.random() < 0.4 else f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40)))


def corpus(seed, n=60):
    rng = random.Random(seed)
    pieces = [" ".join(f"p{k}_{j}" for j in range(rng.randrange(3, 30))) for k in range(6)]
    rows = [(i, text_of(rng, pieces)) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "a " * 300), (n + 4, "ab " * 150), (n + 5, "a b\tc\r\nd  e " * 40)]
    rows += [(n + 6, rows[3][1]), (n + 7, rows[3][1]), (n + 8, "é" * 120), (n + 9, "é" * 120), (n + 10, long_text(5000, 1))]
    rows += [(n + 11, "z " + long_text(5000, 1)[500:20_000])]
    rng.shuffle(rows)
    return rows


def expected_words(rows, size):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        hit = [False] * len(w)
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            if g in seen:
                hit[s : s + size] = [True] * size
            seen.add(g)
        out[i] = (len(w), sum(hit), " ".join(x for x, h in zip(w, hit, strict=True) if not h))
    return out


def expected_bytes(rows, size):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        for s in range(len(b) - size + 1):
            first.setdefault(b[s : s + size], i)
    for i, text in rows:
        b = (text or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < i:
                hit[s : s + size] = b"\1" * size
        out[i] = (len(b), sum(hit), bytes(x for x, h in zip(b, hit, strict=True) if not h))
    return out


def removed(r):
    return sum(s["last"] - s["first"] for s in r["spans"])


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 3000, "shard_bytes": 2000}, {"hot": 1, "chunk_bytes": 9000}])
def test_words(spark, options):
    rows = corpus(1)
    got = suffix_automata.remove_repeats(docs_table(spark, rows), **options).collect()
    assert {r["doc_id"]: (r["n_words"], removed(r), r["kept"]) for r in got} == expected_words(rows, 20)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 3000, "sort_bytes": 300}, {"hot": 1, "shard_bytes": 3000}])
def test_bytes(spark, options):
    rows = corpus(2)
    got = suffix_arrays.remove_repeats(docs_table(spark, rows), **options).collect()
    assert {r["doc_id"]: (r["n_bytes"], removed(r), bytes(r["kept"])) for r in got} == expected_bytes(rows, 50)


@pytest.mark.parametrize("operator", [suffix_automata, suffix_arrays])
def test_empty_null_ids_and_repeated_ids(spark, operator):
    assert operator.remove_repeats(docs_table(spark, [])).count() == 0
    text = long_text(30, 2)
    got = operator.remove_repeats(docs_table(spark, [(None, text), (1, text), (5, "one two"), (5, "one two")])).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(removed(r))
    assert by_id[None] == [0] and by_id[1][0] > 0 and by_id[5] == [0, 0]


def test_query_digest(spark, sf_dir):
    from labelloom.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.q_op2_suffix_automata(spark, sf_dir).collect()}
    assert got == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in expected_words(rows, 20).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in queries.q_op8_suffix_arrays(spark, sf_dir).collect()}
    assert got == {i: (n, m, hashlib.sha256(t).hexdigest()) for i, (n, m, t) in expected_bytes(rows, 50).items()}


def test_automaton_against_all_substrings():
    rng = random.Random(5)
    for _ in range(60):
        sequences = [[rng.choice("abc") for _ in range(rng.randrange(0, 14))] for _ in range(5)]
        seen = set()
        for got, s in zip(suffix_automata.earlier_windows(sequences, 3), sequences, strict=True):
            for i, early in enumerate(got):
                assert early == (tuple(s[i : i + 3]) in seen)
                seen.add(tuple(s[i : i + 3]))


def test_suffix_array_order_and_merge():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    order = suffix_arrays.suffix_array(text, 64)
    raw = text.tobytes()
    assert sorted(order.tolist()) == list(range(3000))
    keys = [raw[i : i + 64].ljust(64, b"\0") for i in order]
    assert keys == sorted(keys)
    places = np.arange(0, 2950)
    owner = rng.integers(0, 50, len(places))
    for part in (places * 0, places // 700):
        got = suffix_arrays.smallest_owner(text, places, owner, part, 12)
        best = {}
        for p, o in zip(places, owner, strict=True):
            best[raw[p : p + 12]] = min(o, best.get(raw[p : p + 12], 99))
        assert got.tolist() == [best[raw[p : p + 12]] for p in places]


def test_packing():
    for values in ([], [0], [5, 5, 2**48 - 1], sorted(random.Random(1).sample(range(2**48), 1000))):
        assert unpack(pack(np.array(values, U))).tolist() == values


def test_keys_are_hot_by_all_their_segments():
    """At the default limit: 30,000 segments of one key in four chunks, beside keys of a few."""
    import pyarrow as pa

    from labelloom.llm import substrings

    keys = np.array([5, 9, 12], np.uint64)
    parts = [(keys, np.array([7_500, 4_999, 1]), np.zeros(3, bool))] * 4
    table = pa.table(
        {
            "bucket": pa.array([0] * 4, pa.int32()),
            "chunk": pa.array(range(4), pa.int32()),
            "keys": pa.array([substrings.pack(k) for k, _, _ in parts], pa.binary()),
            "facts": pa.array([substrings._pack_facts(n, t) for _, n, t in parts], pa.binary()),
        }
    )
    flags = substrings._judge_keys(substrings.HOT_SEGMENTS)((), table).column("flags").to_pylist()
    assert [list(f) for f in flags] == [[2, 1, 1]] * 4
    alone = table.slice(0, 1).set_column(3, "facts", pa.array([substrings._pack_facts(np.array([30_000, 2, 1]), np.array([True, True, False]))]))
    assert list(substrings._judge_keys(substrings.HOT_SEGMENTS)((), alone).column("flags")[0].as_py()) == [2, 1, 0]
