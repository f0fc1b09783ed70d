"""Language-model scores, ranked search and token pairs against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelloom.llm import lm_score, queries, ranked_search, token_pairs
from labelloom.llm.common import crc_mod
from llm_helpers import docs_table, long_text

ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 %% The THE the"), (None, "the and of"), (5, long_text(5_000, 3)), (6, "x"), (6, "x"), (6, "y x")]


def random_rows(n, seed, vocabulary=40):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(rng.randrange(60)))) for i in range(n)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_lm(rows, order, ks):
    """(doc_id, n_tokens, n_known, N, base, score) of every row by dictionaries, one token at a time."""
    texts = [re.findall(r"[^\x20\x09-\x0d]+", lower(t)) + [" "] for _, t in rows]
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for i, _ in rows]
    counts = collections.Counter()
    for ws, t in zip(texts, train, strict=True):
        ws = ["  ", *ws]
        for size in range(1, order + 1):
            for at in range(1, len(ws)):
                if t and at - size + 1 >= 0:
                    counts[tuple(ws[at - size + 1 : at + 1])] += 1
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)
    counts[("  ",)] = sum(train)
    unknown = n + 0.5 * (v + 1)

    def p(h, w):
        if not h:
            return (counts[(w,)] + 0.5) / unknown
        k = ks[min(len(h) - 1, len(ks) - 1)]
        return (counts[(*h, w)] + k * p(h[1:], w)) / (counts[h] + k)

    out = []
    for (i, _), ws in zip(rows, texts, strict=True):
        before = ["  "]
        base = score = 0.0
        for w in ws:
            base += math.log10(p((), w))
            score += math.log10(p(tuple(before[-(order - 1) :]) if order > 1 else (), w))
            before.append(w)
        out.append((str(i), len(ws), sum(counts[(w,)] > 0 for w in ws), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize(("order", "ks"), [(1, (5.0,)), (2, (5.0,)), (3, (5.0, 2.0)), (4, (7.0, 3.0, 1.0))])
def test_model_scores(spark, order, ks):
    rows = [*ODD, *[(100 + i, t) for i, t in random_rows(120, 5)]]
    scored = lm_score.score_texts(docs_table(spark, rows), crc_mod("doc_id", 5) != 1, order=order, concentration=ks, chunk_bytes=2000)
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in scored.collect()]
    for a, b in zip(sorted(got), plain_lm(rows, order, ks), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-5)


def test_stretches_do_not_change_scores():
    rows = random_rows(20, 9)
    rows.append((50, long_text(400, 1)))
    table = pa.table({"doc_id": [r[0] for r in rows], "trained": [r[0] % 3 != 0 for r in rows], "text": [r[1] for r in rows]})
    texts = lm_score.Texts(table)
    grams = texts.grams(3)
    counts = [g.train for g in grams]
    machine = lm_score.Automaton(texts, grams, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), (4.0, 2.0))
    assert np.allclose(machine.walk(texts, 2, stretch=1000), machine.walk(texts, 2, stretch=7))


def test_probabilities_add_up():
    """Of all known words, the end and one unknown word, after any history."""
    rows = random_rows(30, 4, vocabulary=6)
    table = pa.table({"doc_id": [r[0] for r in rows], "trained": [True] * len(rows), "text": [r[1] for r in rows]})
    texts = lm_score.Texts(table)
    grams = texts.grams(2)
    counts = [g.train for g in grams]
    machine = lm_score.Automaton(texts, grams, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), (4.0,))
    unknown = 0.5 / (counts[0].sum() + 0.5 * (len(counts[0]) + 1))
    for state in range(len(machine.fail)):
        _, weight = machine.step(np.full(machine.n_symbols, state), np.arange(machine.n_symbols))
        rest = unknown * (10 ** machine.fail_weight[state] if state else 1)
        assert (10**weight).sum() + rest == pytest.approx(1)


def test_model_without_training_rows(spark):
    none = lm_score.score_texts(docs_table(spark, [(1, "a b"), (2, None)]), F.lit(False))
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in none.collect()) == [
        (1, 3, 0, 0, 0.0, 0.0),
        (2, 1, 0, 0, 0.0, 0.0),
    ]
    assert lm_score.score_texts(docs_table(spark, []), F.lit(True)).count() == 0


def test_known_texts_score_higher(spark, sf_dir):
    rows = queries.q_op11_lm_score(spark, sf_dir).where("n_tokens > 20")
    for held, least in ((True, 0.7), (False, 0.95)):
        part = rows.where(F.col("held_out") == held)
        assert part.where("score > base_score").count() >= least * part.count() > 0


def plain_search(docs, items, k):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))

    tf = [(i, collections.Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in tf if c)
    total = sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for i, t in items:
        wanted[i].update(terms(t))
    out = []
    for item, c in wanted.items():
        scores = []
        for doc, own in tf:
            m = 25 + 75 * sum(own.values()) * n // total if total else 25
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t, q in c.items() if own[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 4])
def test_ranked_search(spark, blocks):
    docs = [*ODD, *[(100 + i, t) for i, t in random_rows(300, 8)], *[(500 + i, "w1 w2 rare copied") for i in range(40)]]
    items = [*random_rows(25, 3), (30, "rare The x"), (31, None), (32, "nowhere"), (33, "w1 w1 W1"), (None, "of"), (34, ""), (33, "copied")]
    table = spark.createDataFrame([(*i, "e") for i in items], "item_id long, text string, doc_id string")
    size = sum(len((t or "").encode()) for _, t in items)
    found = ranked_search.search(docs_table(spark, docs), table, segment_bytes=3000, item_bytes=-(-size // blocks))
    got = sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()], key=str)
    assert got == plain_search(docs, items, 10)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(docs_table(spark, []), items).count() == 0
    assert ranked_search.search(docs_table(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert ranked_search.search(docs_table(spark, [(1, None)]), items).count() == 0


def test_accumulators_are_limited():
    """A common term adds to documents that rarer terms have found and finds none of its own."""
    n = 1000
    common, rare = np.arange(n), np.array([3, 8, 500])
    row = {
        "doc_ids": pa.array(np.arange(n)),
        "lengths": pa.array(np.full(n, 10)),
        "posting_times": pa.array(np.ones(n + 3, np.int64)),
        "posting_docs": pa.array(np.concatenate([common, rare]).astype(np.int32)),
        "terms": pa.array(np.array([0, 1], np.int32)),
        "n_docs": pa.array(np.array([n, 3])),
    }
    segment = ranked_search.Segment(row, n, 10 * n)
    docs, score, made = segment.score(np.array([1, 0]), np.array([6000, 1]), 2, 1, 2)
    assert docs.tolist() == [3, 8, 500] and made == 3
    assert set(score.tolist()) == {6001 * int(segment.impact[0])}
    assert segment.score(np.array([1, 0]), np.array([6000, 1]), 2, 1, 10)[2] == n


@pytest.fixture(scope="module")
def aligner():
    return token_pairs.Aligner(queries.tokenizer_file(), queries.tokenizer_file("piece_bpe_32k.model"))


def plain_groups(aligner, text):
    """Ids of A and of B by group, found with sets of byte offsets; None where tokens do not join to the text."""
    data = (" " + text).encode()
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    ends = []
    for ids, names in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        if b"".join(names[i] for i in ids) != data:
            return None
        ends.append(np.cumsum([len(names[i]) for i in ids]).tolist())
    out, before = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([i for i, e in zip(ids, ends[x], strict=True) if before < e <= cut] for x, ids in enumerate((a, b))))
        before = cut
    return out


STRANGE = ["the cat", "  a  b", "x\ny", "\ny", " lead ", "tab\there", "a　b", "▁x y", "a\0b", "é ﬁ", "<s> <|endoftext|>", "\r\n\r\n", "a \n b\n\n c", "\U0001f600 ok", "x" * 3000]


def test_parts_align_as_whole_texts(aligner):
    assert aligner.by_parts
    rng = random.Random(2)
    pieces = [*"ab c \n\n  ',.1x9\té▁中　\xa0\r\0's\x1c\x85", "the", "ing", " the", " ", "\n", "<s>", "<|endoftext|>", "\U0001f600"]
    texts = STRANGE + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 20))) for _ in range(3000)]
    assert all("".join(token_pairs.split_parts(t)) == " " + t for t in texts)
    lost = 0
    for t, parts in zip(texts, aligner.texts(texts), strict=True):
        expected = plain_groups(aligner, t)
        lost += expected is None
        whole = aligner.whole(t)
        if expected is None:
            assert parts is None and whole is None
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in expected)
        assert whole.groups == text == ";".join(p.groups for p in parts)
        assert whole.pairs == [a[-1] << 32 | b[-1] for a, b in expected] == [x for p in parts for x in p.pairs]
        assert (whole.n_a, whole.n_b) == (sum(p.n_a for p in parts), sum(p.n_b for p in parts))
    assert lost > 10


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n, share in ((1, 1.0), (100, 0.5), (4096, 0.01), (4096, 0.9), (5000, 0.0)):
        places = np.flatnonzero(rng.random(n) < share)
        data = token_pairs.compress(places, n)
        assert token_pairs.expand(data, n).tolist() == places.tolist() and token_pairs.popcount(data) == len(places)
        if len(places):
            times = rng.integers(1, 40, len(places))
            planes = token_pairs.make_planes(places, times, n)
            assert token_pairs.merge(planes, n).tolist() == places.tolist()
            assert sum(token_pairs.popcount(p) << j for j, p in enumerate(planes)) == times.sum()


def test_token_pairs(spark, aligner):
    rows = [*ODD, *[(10 + i, t) for i, t in enumerate(STRANGE)], *[(100 + i, t) for i, t in random_rows(60, 2)], (200, "the cat")]
    made = token_pairs.align_pairs(docs_table(spark, rows), queries.tokenizer_file(), queries.tokenizer_file("piece_bpe_32k.model"))
    groups = [plain_groups(aligner, t) if t else None for _, t in rows]
    links = [[(a[-1], b[-1]) for a, b in g or []] for g in groups]
    count = collections.Counter(x for own in links for x in own)
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    expected = []
    for (i, _), g, own in zip(rows, groups, links, strict=True):
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
        n_a, n_b = (sum(len(x[s]) for x in g or []) for s in (0, 1))
        expected.append((str(i), n_a, n_b, len(own), len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), digest))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in made.documents.collect()) == sorted(expected)
    docs = collections.Counter(x for own in links for x in set(own))
    got = {(r["a"], r["b"]): (r["n_docs"], r["count"], r["is_best"]) for r in made.pairs.collect()}
    assert got == {x: (docs[x], n, n == most[x[1]]) for x, n in count.items()}


def test_token_pairs_of_nothing(spark):
    files = queries.tokenizer_file(), queries.tokenizer_file("piece_bpe_32k.model")
    assert token_pairs.align_pairs(docs_table(spark, []), *files).documents.count() == 0
    only = token_pairs.align_pairs(docs_table(spark, [(1, None)]), *files).documents.collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "")]
