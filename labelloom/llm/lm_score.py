"""Log-probabilities of texts under an n-gram model, by a weighted automaton with failure arcs.

The model is interpolated: with c the counts of the training documents, k the concentration of an order,
``p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k)``, where h' is h without its first word, down to
``p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))`` with all words that are not known as one more entry.
Each n-gram below the largest order is a state, each n-gram an arc into the state of its longest known
suffix; a failure arc of weight ``k / (c(h) + k)`` leads from h to h'. A text is walked once from left to
right, the state carried along and the logarithms added up. All n-grams are kept, whatever their count.

Neither documents nor model are ever in one place. Documents are dealt over chunks by a hash. A chunk sends the
hashes of its distinct n-grams, with their counts in its training documents, to shards by ranges of
the hash; a shard adds up and answers with the counts of the whole corpus, in the order asked. From
these a chunk builds the part of the automaton that its documents can reach. An n-gram is one entry
per chunk, however often it occurs, so no word makes a shard large.

Defined results: null and empty texts have only the end token; null ids count as empty text when the training
documents are chosen; repeated rows are documents of their own; no training documents: every
token has probability one; other columns are not read. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common
from labelloom.llm.words import BYTE_VALUES, Powers, find_words, mix, span_hashes, utf8

U = np.uint64
#: Text of a chunk and text whose n-grams a shard holds, in bytes.
CHUNK_BYTES = 8 << 20
#: Concentrations of the orders from two on; further orders take the last.
CONCENTRATION = (500.0, 10.0)
#: Longest stretch that is walked as one; a longer text is walked as several, each entered with the state that it would have.
STRETCH = 1024

_END = mix(np.array([0x656E64], U))[0]
_START = mix(np.array([0x7374617274], U))[0]
_MESSAGE = "chunk int, shard int, gram_order int, n_keys bigint, keys binary, counts binary"
_ANSWER = "chunk int, shard int, gram_order int, counts binary, total_tokens bigint, total_types bigint"
RESULT = "doc_id bigint, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """64-bit integers by planes of bytes, which compress where high bytes are alike."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8")[:, 0]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the number of each value of ``hashes`` among them, and a place of each."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(ordered), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number, order[new]


@dataclass
class Grams:
    """N-grams of one order: those at which places, their distinct hashes, numbers and training counts."""

    places: np.ndarray
    keys: np.ndarray
    number: np.ndarray
    sample: np.ndarray
    train: np.ndarray


class Texts:
    """Tokens of a chunk's documents in order of id: a start mark, the words in lower case and an end for each."""

    def __init__(self, table: pa.Table) -> None:
        order = pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        table = table.take(order)
        n = len(table)
        text = table.column("text")
        self.doc_ids = table.column("doc_id")
        self.trained = table.column("trained").to_numpy(zero_copy_only=False).astype(bool)
        hashes, counts = [], []
        powers = Powers()
        joined = text.combine_chunks() if text.num_chunks != 1 else text.chunk(0)
        for low, high in common.text_slices(joined):
            data, offsets = utf8(joined.slice(low, high - low))
            lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
            words = find_words(lower, offsets, ~((lower == 32) | ((lower >= 9) & (lower <= 13))))
            hashes.append(span_hashes(BYTE_VALUES[lower], words.starts, words.ends, powers))
            counts.append(words.per_text())
        self.n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        #: Place of each document's start mark; one more at the end.
        self.first = np.concatenate(([0], np.cumsum(self.n_words + 2))).astype(np.int64)
        self.symbols = np.full(self.first[-1], _END, U)
        self.symbols[self.first[:-1]] = _START
        self.doc_of = np.repeat(np.arange(n, dtype=np.int32), self.n_words + 2)
        inside = np.ones(len(self.symbols), bool)
        inside[self.first[:-1]] = inside[self.first[1:] - 1] = False
        self.symbols[inside] = np.concatenate(hashes) if hashes else np.zeros(0, U)

    def grams(self, order: int) -> list[Grams]:
        """N-grams of each order from one on, by the place of their last token; a start mark is only ever first."""
        out, hashes = [], self.symbols
        since = np.arange(len(hashes)) - self.first[self.doc_of]
        places = np.flatnonzero(since >= 1)
        for size in range(1, order + 1):
            if size > 1:
                longer = np.zeros(len(hashes), U)
                longer[1:] = mix(hashes[:-1] * U(3) + mix(self.symbols[1:] + U(size)))
                hashes = longer
                places = places[since[places] >= size - 1]
            keys, number, sample = distinct(hashes[places])
            train = np.bincount(number, self.trained[self.doc_of[places]], len(keys)).astype(np.int64)
            out.append(Grams(places, keys, number, places[sample], train))
        return out


def _shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each key; rises with the key."""
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _ask(order: int, n_shards: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk, rows = key[0].as_py(), []
        for size, grams in enumerate(Texts(table).grams(order), 1):
            cuts = np.searchsorted(_shard_of(grams.keys, n_shards), np.arange(n_shards + 1))
            for shard in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[shard], cuts[shard + 1]
                steps = np.diff(grams.keys[a:b], prepend=U(0))
                rows.append((chunk, int(shard), size, int(b - a), pack(steps), pack(grams.train[a:b])))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        names = [x.split()[0] for x in _MESSAGE.split(", ")]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Corpus counts for every message of a shard and order; for words also a row of totals, of chunk -1."""
    shard, order = key[0].as_py(), key[1].as_py()
    table = table.sort_by("chunk")
    sizes = table.column("n_keys").to_numpy()
    keys = np.concatenate([np.cumsum(unpack(x.as_py()), dtype=U) for x in table.column("keys")])
    counts = np.concatenate([unpack(x.as_py()) for x in table.column("counts")])
    different, number, _ = distinct(keys)
    total = np.zeros(len(different), U)
    np.add.at(total, number, counts)
    found = total[number]
    ends = np.cumsum(sizes)
    answers = [pack(found[b - n : b]) for n, b in zip(sizes, ends, strict=True)]
    chunks = table.column("chunk").to_pylist()
    n = len(answers)
    tokens, types = [None] * n, [None] * n
    if order == 1:
        chunks.append(-1)
        answers.append(None)
        tokens.append(int(total.sum()))
        types.append(int((total > 0).sum()))
        n += 1
    return pa.Table.from_arrays(
        [
            pa.array(chunks, pa.int32()),
            pa.array([shard] * n, pa.int32()),
            pa.array([order] * n, pa.int32()),
            pa.array(answers, pa.binary()),
            pa.array(tokens, pa.int64()),
            pa.array(types, pa.int64()),
        ],
        names=[x.split()[0] for x in _ANSWER.split(", ")],
    )


class Automaton:
    """States, arcs and failure arcs of the n-grams that some texts can meet.

    State 0 is the empty history, from which every symbol has an arc. Other states are n-grams
    below the largest order. Weights are base-10 logarithms.
    """

    def __init__(self, texts: Texts, grams: list[Grams], counts: list[np.ndarray], n_tokens: int, n_types: int, concentration) -> None:
        words = grams[0]
        self.n_symbols = len(words.keys)
        weights = (counts[0] + 0.5) / (n_tokens + 0.5 * (n_types + 1))
        probability = weights
        ends_text = texts.symbols == _END
        #: Number of each place's n-gram, by order.
        number = [np.full(len(texts.symbols), -1, np.int64) for _ in grams]
        for of, g in zip(number, grams, strict=True):
            of[g.places] = g.number
        self.symbol_at = number[0]
        # States of each order: known n-grams that do not end a text. The last state is the start mark.
        n_states, state = 1, []
        for g, c in zip(grams[:-1], counts, strict=False):
            known = (c > 0) & ~ends_text[g.sample]
            state.append(np.where(known, n_states + np.cumsum(known) - 1, 0))
            n_states += int(known.sum())
        # Every training document has one start and one end.
        starts = int(counts[0][np.searchsorted(words.keys, _END)])
        self.start = n_states if starts and state else 0
        self.fail, self.fail_weight = np.zeros(n_states + 1, np.int64), np.zeros(n_states + 1)
        self.root_target = state[0] if state else np.zeros(self.n_symbols, np.int64)
        self.root_weight = np.log10(weights)
        arc_keys, arc_targets, arc_weights = [], [], []
        for size in range(2, len(grams) + 1):
            g, c = grams[size - 1], counts[size - 1]
            k = concentration[min(size - 2, len(concentration) - 1)]
            before = number[size - 2][g.sample - 1]
            if size == 2:
                # The token before may be the start mark, which is not a word.
                source = np.where(before >= 0, state[0][before], self.start)
                context = np.where(before >= 0, counts[0][before], starts)
            else:
                source, context = state[size - 2][before], counts[size - 2][before]
            shorter = number[size - 2][g.sample]
            probability = (c + k * probability[shorter]) / (context + k)
            known = (c > 0) & (source > 0)
            # What ends a text or is of the largest order leads to its longest suffix that is a state.
            target = state[size - 2][shorter]
            if size < len(grams):
                target = np.where(state[size - 1] > 0, state[size - 1], target)
            arc_keys.append(source[known] * self.n_symbols + number[0][g.sample][known])
            arc_targets.append(target[known])
            arc_weights.append(np.log10(probability[known]))
            at = state[size - 2] > 0
            self.fail_weight[state[size - 2][at]] = np.log10(k / (counts[size - 2][at] + k))
            if size == 2 and self.start:
                self.fail_weight[self.start] = np.log10(k / (starts + k))
            if size > 2:
                self.fail[state[size - 2][at]] = state[size - 3][number[size - 3][grams[size - 2].sample]][at]
        keys = np.concatenate(arc_keys) if arc_keys else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.arc_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.arc_targets = np.append((np.concatenate(arc_targets) if arc_keys else keys)[order], 0)
        self.arc_weights = np.append((np.concatenate(arc_weights) if arc_keys else keys.astype(float))[order], 0.0)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and weight of each walker: along an arc, or down failure arcs until there is one."""
        state, weight = state.copy(), np.zeros(len(state))
        after = np.empty(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            at_root = state[left] == 0
            done = left[at_root]
            after[done] = self.root_target[symbol[done]]
            weight[done] += self.root_weight[symbol[done]]
            left = left[~at_root]
            wanted = state[left] * self.n_symbols + symbol[left]
            at = np.searchsorted(self.arc_keys, wanted)
            hit = self.arc_keys[at] == wanted
            done, arc = left[hit], at[hit]
            after[done] = self.arc_targets[arc]
            weight[done] += self.arc_weights[arc]
            left = left[~hit]
            weight[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return after, weight

    def walk(self, texts: Texts, memory: int, stretch: int = STRETCH) -> np.ndarray:
        """Log-probability of each document; all stretches walk abreast, one token a step.

        A state is settled by the last ``memory`` tokens, so a stretch inside a text is entered by
        walking as many tokens before it from the empty history, without counting them.
        """
        n = texts.n_words + 1
        pieces = -(-n // stretch)
        doc = np.repeat(np.arange(len(n)), pieces)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = texts.first[doc] + 1 + within * stretch
        end = np.minimum(begin + stretch, texts.first[doc + 1])
        state = np.where(within == 0, self.start, 0)
        inner = np.flatnonzero(within > 0)
        for back in range(memory, 0, -1):
            state[inner], _ = self.step(state[inner], self.symbol_at[begin[inner] - back])
        order = np.argsort(begin - end, kind="stable")
        doc, begin, state, length = doc[order], begin[order], state[order], (end - begin)[order]
        total = np.zeros(len(doc))
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t))  # those longer than t
            state[:m], weight = self.step(state[:m], self.symbol_at[begin[:m] + t])
            total[:m] += weight
        return np.bincount(doc, total, len(n))


def _score(order: int, concentration: tuple[float, ...]):
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):  # a chunk without documents is only told the totals
            return pa.schema(list(zip(names, types, strict=True))).empty_table()
        texts = Texts(table)
        grams = texts.grams(order)
        totals = answers.filter(pc.is_valid(answers.column("total_tokens")))
        n_tokens, n_types = (pc.sum(totals.column(c)).as_py() or 0 for c in ("total_tokens", "total_types"))
        counts = []
        for size, g in enumerate(grams, 1):
            own = answers.filter(pc.and_(pc.equal(answers.column("gram_order"), size), pc.is_valid(answers.column("counts"))))
            found = [unpack(x.as_py()) for x in own.sort_by("shard").column("counts")]
            counts.append((np.concatenate(found) if found else np.zeros(0, U)).astype(np.int64))
            if len(counts[-1]) != len(g.keys):
                raise ValueError("answers do not fit a chunk's n-grams")
        machine = Automaton(texts, grams, counts, n_tokens, n_types, concentration)
        doc = texts.doc_of[grams[0].places]
        own = counts[0][grams[0].number]
        n = len(texts.n_words)
        base = np.log10((counts[0] + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
        return pa.Table.from_arrays(
            [
                texts.doc_ids,
                pa.array(texts.trained),
                pa.array(texts.n_words + 1),
                pa.array(np.bincount(doc, own > 0, n).astype(np.int64)),
                pa.array(np.full(n, n_tokens, np.int64)),
                pa.array(np.bincount(doc, base[grams[0].number], n)),
                pa.array(machine.walk(texts, order - 1)),
            ],
            names=names,
        )

    return run


def score_texts(
    docs: DataFrame,
    train: Column,
    id_column: str = "doc_id",
    text: str = "text",
    order: int = 2,
    concentration: tuple[float, ...] = CONCENTRATION,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Columns of :data:`RESULT` for every document; the model is that of the rows for which ``train`` holds."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("trained"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    total = common.text_bytes(rows)
    least = max(common.cores(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = common.parts_for(total, chunk_bytes, least)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask(order, n), _MESSAGE)
    answers = asked.groupBy("shard", "gram_order").applyInArrow(_answer, _ANSWER)
    # The totals of all shards, one row for each chunk.
    totals = answers.where("chunk < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_tokens", "total_types")])
    told = totals.select(
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"),
        F.lit(None).cast("int").alias("shard"),
        F.lit(None).cast("int").alias("gram_order"),
        F.lit(None).cast("binary").alias("counts"),
        "total_tokens",
        "total_types",
    )
    known = answers.where("chunk >= 0").unionAll(told)
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score(order, concentration), RESULT)
