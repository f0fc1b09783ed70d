"""Language, toxicity, decontamination, mixing, near copies and token files."""

import collections
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelloom.llm import decontaminate, lang_id, mixing, ngram_join, queries, token_store, toxicity
from labelloom.llm.common import crc_mod, table
from llm_helpers import docs_table, long_text, words

ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 %% 34"), (None, "the and of"), (5, long_text(30_000, 3)), (6, "x"), (6, "x"), (6, "y")]


def test_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs, crc_mod("doc_id", 4) != 2)
    got = lang_id.predict(docs_table(spark, [*ODD, (7, "the thing of the and"), (8, "der die und einung")]), model)
    assert got.columns[:2] == ["doc_id", "text"] and got.schema["score"].dataType.typeName() == "double"
    by_text = {r["text"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    for text in (None, "", " \n", "12 %% 34"):
        assert by_text[text] == ("und", 0.0)
    assert by_text["the thing of the and"][0] == "en" and by_text["der die und einung"][0] == "de"
    assert all(0 <= s <= 1 for _, s in by_text.values())
    held = queries.q_op5_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() == held.count() > 20


def test_language_without_training_rows(spark):
    docs = docs_table(spark, [(1, "a b", None), (2, None, "en")])
    model = lang_id.fit(docs, F.lit(True))
    assert {r["lang_pred"] for r in lang_id.predict(docs, model).collect()} == {"und"}
    assert lang_id.predict(docs_table(spark, []), model).count() == 0


def test_language_backoff():
    """An unseen word is scored by its longest known n-grams."""
    import pyarrow as pa

    from labelloom.llm.words import Powers, span_hashes

    letters, powers = lang_id.Letters(), Powers()

    def key(text, length):
        w = letters.words(pa.array([text]))
        v = lang_id.code_values(w.data)
        return span_hashes(v, w.starts, w.ends, powers)[0] ^ np.uint64(length)

    keys, logs = {}, {}
    for length, entries in {0: {"cat": (-1, -5)}, 5: {}, 4: {}, 3: {"dog": (-7, -2)}, 2: {"do": (-1, -9)}, 1: {"d": (-3, -4)}}.items():
        pairs = sorted((int(key(t, length)), v) for t, v in entries.items())
        keys[length] = np.array([p[0] for p in pairs], np.uint64)
        logs[length] = np.array([p[1] for p in pairs], float).reshape(-1, 2)
    model = lang_id.Model(["a", "b"], keys, logs)
    langs, scores = model.predict(letters.words(pa.array(["Cat", "dogs", "dust", "zz", "cat dogs"])), powers)
    assert langs == ["a", "b", "a", "a", "b"]
    assert scores[0] == pytest.approx(1 / (1 + np.exp(-4))) and scores[3] == 0.5 and scores[4] == pytest.approx(1 / (1 + np.exp(-1)))


def test_toxicity(spark, sf_dir):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        w = [f"v{rng.randrange(400)}" for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(["idiotic", "scumbag", "scummy"])
        rows.append((i, " ".join("abcdefghij"[int(c)] if c.isdigit() else c for x in w for c in x + " ")))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None)]
    label_table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = docs_table(spark, rows)
    model = toxicity.fit(docs, label_table, crc_mod("doc_id", 3) != 1, members=2)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(got[i] >= 0.7) == (i % 6 == 0) for i in held]
    assert sum(right) / len(right) > 0.95
    odd = toxicity.score(docs_table(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    none = toxicity.fit(docs, label_table.where("toxic = 0"), crc_mod("doc_id", 3) != 1)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    got = queries.q_op4_toxicity(spark, sf_dir)
    assert got.count() == table(spark, sf_dir, "documents").count() and got.columns == ["doc_id", "held_out", "score", "predicted"]


def test_nnpu_risk_stays_fitted():
    """A feature of all positives, that also marks their share of the unlabelled, gets a high score."""
    positive = np.array([True] * 100 + [False] * 400)
    marked = np.r_[np.arange(100), 100 + np.arange(80)]
    w, b = toxicity.fit_nnpu(marked, np.zeros(len(marked), int), positive, 0.2, 1, 300)
    assert 1 / (1 + np.exp(-(w[0] + b))) > 0.9 and 1 / (1 + np.exp(-b)) < 0.1


def plain(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontaminate(spark, block_bytes):
    rng = random.Random(4)
    items = [(k, " ".join(f"b{rng.randrange(50)}" for _ in range(n))) for k, n in enumerate([40, 30, 13, 5, 1, 20])]
    items += [(2, "more words of a repeated id " * 4), (9, None), (10, ""), (11, "?!"), (None, "null item id " * 6)]
    rows = [*ODD, (7, "")]
    for i in range(10, 80):
        w = [f"b{rng.randrange(50)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            item = words(rng.choice(items[:7])[1])
            a = rng.randrange(len(item))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in item[a : a + rng.randrange(1, 20)]]
        rows.append((i, " ".join(w)))
    windows = collections.defaultdict(set)
    for k, text in items:
        w = plain(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(None if k is None else str(k))
    expected = []
    for i, text in rows:
        w, hit, found = plain(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])] - {None}
        expected.append((i, text, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    docs, table_ = docs_table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_overlaps(docs, table_, block_bytes=block_bytes)
    got = [(r["doc_id"], r["text"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {r["n_hit"] for r in decontaminate.find_overlaps(docs, table_.limit(0)).collect()} == {0}
    assert decontaminate.find_overlaps(docs_table(spark, []), table_).count() == 0


def mix_rows(rng, sizes):
    return [(i, " ".join(["w"] * rng.randrange(0, 30)), None, s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]


@pytest.mark.parametrize("entropy, repetition", [(0.95, 4.0), (1.0, 3.0), (0.0, 2.0), (0.9, 100.0)])
def test_mixing(spark, entropy, repetition):
    rows = mix_rows(random.Random(2), {"big": 700, "mid": 150, "small": 30, None: 20})
    docs = docs_table(spark, rows)
    size = {r[0]: len(words(r[1])) + 1 for r in rows}
    total = sum(size.values())
    tokens = collections.Counter()
    for r in rows:
        tokens[r[3]] += size[r[0]]

    def weights(a):
        raw = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def entropy_of(a):
        return -sum(w * np.log(w) for w in weights(a).values())

    # The largest exponent of a fine grid that reaches the entropy, raised to the repetition limit.
    grid = np.linspace(0, 1, 4001)
    a = max([x for x in grid if entropy_of(x) >= entropy * np.log(4) - 1e-9], default=0)
    while a < 1 and max(w * total / tokens[s] for s, w in weights(a).items()) > repetition:
        a += 1 / 4000
    got = mixing.mix_sources(docs, target_entropy=entropy, max_repetition=repetition, block_tokens=500).collect()
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += size[r["doc_id"]]
    for s, w in weights(a).items():
        assert abs(taken[s] - w * total) < 40 + 0.002 * total
        assert taken[s] <= w * total + 0.002 * total
    copies = collections.Counter(r["doc_id"] for r in got)
    for s in tokens:
        counts = {copies[r[0]] for r in rows if r[3] == s}
        assert max(counts) - min(counts) <= 1 and max(counts) <= np.ceil(repetition)
    assert len({(r["doc_id"], r["mix_epoch"]) for r in got}) == len(got)
    for (s, e), ranks in _by(got, lambda r: (r["source"], r["mix_epoch"])).items():
        assert sorted({r["mix_rank"] for r in ranks}) == list(range(1, len({r["mix_block"] for r in ranks}) + 1)) or e > 0, s


def _by(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def test_mixing_odd_rows(spark):
    assert mixing.mix_sources(docs_table(spark, [])).count() == 0
    got = mixing.mix_sources(docs_table(spark, ODD))
    assert got.count() == len(ODD) and "mix_epoch" in got.columns
    assert mixing.mix_sources(docs_table(spark, [(1, "a", None, "s")]), budget=0).count() == 0
    again = mixing.mix_sources(got.repartition(3).select(docs_table(spark, []).columns + ["mix_rank"]))
    assert again.count() == len(ODD)


def near_expected(rows, threshold=0.8):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links, top = collections.Counter(), {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            met = len(sets[a] & sets[b])
            if met and met >= threshold * (len(sets[a]) + len(sets[b]) - met) - 1e-9:
                links[a] += 1
                links[b] += 1
                ra, rb = root(a), root(b)
                top[max(ra, rb)] = min(ra, rb)
    return {i: (root(i), links[i]) for i in ids}


def near_rows():
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "one  two\n"), (6, long_text(20_000, 9)), (7, long_text(20_000, 9) + " more")]
    base = long_text(200, 4).split()
    for i in range(10, 90):
        w = list(base)
        w[rng.randrange(200)] = f"edit{i}"
        if i % 3 == 0:
            w[rng.randrange(200)] = f"other{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base)) for i in range(100, 130)] + [(i, long_text(60, i)) for i in range(200, 260)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 16])
def test_near_copies(spark, block):
    rows = near_rows()
    got = ngram_join.join_near(docs_table(spark, rows), block=block).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == near_expected(rows)


def test_near_copies_odd_rows(spark):
    assert ngram_join.join_near(docs_table(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, None), (4, "")]
    got = collections.Counter(tuple(r) for r in ngram_join.join_near(docs_table(spark, rows)).collect())
    assert got == collections.Counter(
        [(None, None, None, 0), (None, None, None, 0), (1, 1, 1, 2), (2, 1, 1, 2), (2, 1, 1, 2), (3, 3, 3, 0), (4, 4, 4, 0)]
    )
    kept = ngram_join.keep_one(docs_table(spark, [*rows, (9, "z z z"), (9, "z z z")]))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted(
        [("None", "a b c d e f"), ("1", "a b c d e f"), ("3", "None"), ("None", "None"), ("4", ""), ("9", "z z z")]
    )


@pytest.mark.parametrize("turned", [False, True])
def test_near_copies_of_an_id_with_two_texts(spark, turned):
    one, two = long_text(60, 1), long_text(60, 2)
    rows = [(1, one + " x"), (2, one), (2, two), (3, two + " y"), (4, long_text(60, 3))]
    docs = docs_table(spark, rows[::-1] if turned else rows).coalesce(1)
    got = sorted((r["doc_id"], r["class_id"], r["copy_id"], r["n_links"]) for r in ngram_join.join_near(docs).collect())
    assert got == [(1, 1, 1, 1), (2, 1, 2, 1), (2, 2, 2, 1), (3, 2, 3, 1), (4, 4, 4, 0)]
    assert sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()) == [(1, one + " x"), (2, two), rows[4]]


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


def test_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    plain_encoder = Tokenizer.from_file(path)
    rng = random.Random(8)
    marks = [" ", " ", "\n", "a", "the", "é", "ß.", ",", "'s", "1", "\t", "　", "<|endoftext|>", "\0", "!?", "語", "  "]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "null id"), (402, long_text(30_000, 2)), (403, "same"), (403, "same")]
    rng.shuffle(rows)
    where = f"file://{tmp_path}/tokens"
    got = token_store.token_store(docs_table(spark, rows), path, where)
    start, expected = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain_encoder.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), ids))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in got.collect() if r["doc_id"] is not None) == sorted(
        e for e in expected if e[0] is not None
    )
    sums = {r["doc_id"]: r["ids_crc32"] for r in token_store.checksums(got).collect()}
    assert sums == {i: zlib.crc32(np.array(ids, "<u4").tobytes()) for i, _, _, ids in expected}
    found = token_store.find_documents(spark, where, [402, 7])
    assert {r["doc_id"] for r in found.collect()} == {402, 7}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert token_store.token_store(docs_table(spark, []), path).count() == 0


def test_token_batches(spark, tmp_path, monkeypatch):
    """Texts go to the encoder, and ids to the checksums, by bytes and not by 10,000 rows; the session's own setting comes back."""
    monkeypatch.setattr(token_store, "BATCH_BYTES", 100_000, raising=False)
    key, counted = "spark.sql.execution.arrow.maxBytesPerBatch", token_store.pc.list_value_length

    class Ones:
        def encode_column(self, texts):
            if len(texts) > 130:
                raise ValueError(f"{len(texts)} texts of 1,000 bytes at once")
            return [np.ones(500, np.uint32).tobytes()] * len(texts)

    def lengths(ids):
        if len(ids) > 70:
            raise ValueError(f"{len(ids)} rows of 501 ids at once")
        return counted(ids)

    monkeypatch.setattr(token_store, "_encoder", lambda path: Ones())
    monkeypatch.setattr(token_store, "pc", SimpleNamespace(list_flatten=token_store.pc.list_flatten, list_value_length=lengths))
    for own in (None, "50m"):
        if own:
            spark.conf.set(key, own)
        try:
            docs = docs_table(spark, [(i, "x" * 1000) for i in range(8000)])
            out = token_store.checksums(token_store.token_store(docs, "", f"file://{tmp_path}/tokens-{own}"))
            assert spark.conf.get(key, None) == own
        finally:
            spark.conf.unset(key)
        crc = zlib.crc32(np.array([1] * 500 + [0], "<u4").tobytes())
        assert sorted(map(tuple, out.collect())) == [(i, 501 * i, 501, crc) for i in range(8000)]


def test_orc_metadata(spark, sf_dir, tmp_path):
    from pyarrow import fs, orc

    token_store.write_tokens(table(spark, sf_dir, "documents"), queries.tokenizer_file(), f"file://{tmp_path}/t")
    files = [f.path for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/t")) if f.path.endswith(".orc")]
    assert files and sum(orc.ORCFile(f).nrows for f in files) == 200
    assert all(orc.ORCFile(f).row_index_stride == 2000 for f in files)


def test_remembered_parts_overflow(monkeypatch):
    """Ids stay those of whole texts while parts are forgotten and met again."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "_CACHE_PARTS", 30)
    plain = Tokenizer.from_file(queries.tokenizer_file())
    encoder = token_store.Encoder(queries.tokenizer_file())
    rng = random.Random(4)
    words = [w + m for w in ("the", "cat", "Ünder", "naïve", "x9", "e-mail", "123", *(f"word{i}" for i in range(80))) for m in ("", ".", ",", "!?")]
    forgotten = 0
    for _ in range(60):
        texts = [" ".join(rng.choices(words, k=25)) + rng.choice(["", "\n", "\nend", "  "]) for _ in range(3)]
        before = set(encoder.old)
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [
            plain.encode(t, add_special_tokens=False).ids for t in texts
        ]
        forgotten += bool(before - set(encoder.old) - set(encoder.known))
    assert forgotten > 3


def test_plain_words_go_straight_to_the_model(monkeypatch):
    """Words of letters are not encoded as texts, and a column's texts get the ids of whole texts."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_file())
    encoder = token_store.Encoder(queries.tokenizer_file())
    texts = [None, "", "a", " lead", "Éa naïveté çà Ǆungla ŉone ɏ ɐ ª", "x\0y z", "one  two", "two \n", "3rd don't stop. e-mail! İstanbul ﬁne 語 ß", "\nend it", "a <|endoftext|> b", "line\nline two"]
    column = pa.array(["left out", *texts])[1:]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_column(column)] == [
        plain.encode(t or "", add_special_tokens=False).ids for t in texts
    ]
    assert encoder.encode_column(pa.array([], pa.string())) == []
    sent = []
    monkeypatch.setattr(encoder, "_learn", lambda parts: sent.extend(parts))
    encoder.encode(["The quick brown fox", "été naïve words"])
    assert not sent
