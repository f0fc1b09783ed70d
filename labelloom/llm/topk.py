"""Exact top-k by inner product over vectors sorted by length.

Vectors are turned by the basis of an SVD (of their Gram matrix, summed over all rows), so
that the first coordinates carry most of a product. Candidates are dealt to shards by descending
length, queries to blocks, both of bounded bytes; a block meets a shard in one task. First the queries meet
the shards of the longest candidates; each one's k-th score there is the floor that it takes to all other shards.
In a task, candidates come in runs by descending length. A run is passed over, with all that follow, if even its longest
vector's length times the query's is below the query's k-th score so far. The rest of a run is
pruned by the product of the first coordinates plus the product of the residual lengths, which
bounds the whole product (Cauchy and Schwarz). Only what is left is scored, exactly, in whole numbers.
Each task keeps k per query, and the shards' lists are merged.

Defined results: vectors that are null or empty, or hold a null or non-finite component, take no part;
vectors are compared with those of their own size; scores that are equal go to the smaller id; a query is not its own
candidate, by id; null ids take no part; fewer candidates than k give all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm import common
from labelloom.session import store_table

#: Bytes of the candidates of one shard and of the queries of one block, at 8 a component.
SHARD_BYTES, BLOCK_BYTES = 32 << 20, 16 << 20
#: Candidates that are worth a shard of their own while there are cores for it.
SHARD_ROWS = 1 << 14
#: Queries and candidates that are looked at together.
STEP_ROWS, RUN_ROWS = 1 << 10, 1 << 11
#: Share of a run's pairs from which on their whole rectangle is multiplied, and pairs multiplied at once below.
DENSE, PAIRS = 0.125, 1 << 16


def quantise(vector: str, scale: int) -> Column:
    """floor(scale · x) of each component as double, whole numbers; null if a component is null or not finite."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(values, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(None)).otherwise(whole)


def basis(vectors: DataFrame, size: int) -> np.ndarray:
    """Right singular vectors of all rows, from the sum of the tasks' Gram matrices."""

    def gram(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0), size)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(size * size)), pa.array(total.ravel())], names=["i", "v"])

    sums = vectors.select("vector").mapInArrow(gram, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v"))
    matrix = np.zeros(size * size)
    for i, v in sums.collect():  # size² numbers
        matrix[i] = v
    return np.linalg.svd(matrix.reshape(size, size))[0]


def _matrix(column, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, size)


def _scores(q: np.ndarray, c: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, columns and products of the pairs that are ``kept``, by row, and how many products were computed."""
    r, col = np.nonzero(kept)
    if not len(r):
        return r, col, np.zeros(0), 0
    # Whole numbers below 2^53 are exact as doubles, in any order of summing.
    if len(r) >= DENSE * kept.size:
        rows, columns = np.flatnonzero(kept.any(1)), np.flatnonzero(kept.any(0))
        return r, col, (q[rows] @ c[columns].T)[np.searchsorted(rows, r), np.searchsorted(columns, col)], len(rows) * len(columns)
    parts = [np.einsum("ij,ij->i", q[r[a : a + PAIRS]], c[col[a : a + PAIRS]]) for a in range(0, len(r), PAIRS)]
    return r, col, np.concatenate(parts), len(r)


def search(
    q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, turn: np.ndarray, run_rows: int, step_rows: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query ids, candidate ids and scores of each query's best k that reach its ``floor``, and how many pairs were scored."""
    head = max(1, len(turn) // 4)
    lengths = np.sqrt((c * c).sum(1))
    order = np.lexsort((c_ids, -lengths))
    c_ids, c, lengths = c_ids[order], c[order], lengths[order]
    turned_q, turned = q @ turn, c @ turn
    rest_q = np.sqrt((turned_q[:, head:] ** 2).sum(1))
    rest = np.sqrt((turned[:, head:] ** 2).sum(1))
    turned_q, turned = turned_q[:, :head], turned[:, :head]
    q_length = np.sqrt((q * q).sum(1))
    slack = 1e-6 * (1 + q_length.max(initial=0) * lengths.max(initial=0))
    top_s = [np.zeros(0)] * len(q)
    top_i = [np.zeros(0, np.int64)] * len(q)
    floor = floor.copy()  # the k-th score so far
    scored = 0
    for s in range(0, len(q), step_rows):
        for a in range(0, len(c), run_rows):
            z = min(a + run_rows, len(c))
            live = s + np.flatnonzero(q_length[s : s + step_rows] * lengths[a] + slack >= floor[s : s + step_rows])
            if not len(live):
                break
            bound = turned_q[live] @ turned[a:z].T + rest_q[live, None] * rest[a:z] + slack
            r, col, scores, n = _scores(q[live], c[a:z], bound >= floor[live, None])
            scored += n
            good = (scores >= floor[live[r]]) & (c_ids[a + col] != q_ids[live[r]])
            r, ids, scores = live[r[good]], c_ids[a + col[good]], scores[good]
            ends = np.append(np.flatnonzero(r[1:] != r[:-1]) + 1, len(r)) if len(r) else []
            start = 0
            for end in ends:
                i, found, names = r[start], scores[start:end], ids[start:end]
                start = end
                if len(found) > 4 * k:
                    least = np.partition(found, len(found) - k)[len(found) - k]
                    found, names = found[found >= least], names[found >= least]
                found, names = np.append(top_s[i], found), np.append(top_i[i], names)
                best = np.lexsort((names, -found))[:k]
                top_s[i], top_i[i] = found[best], names[best]
                if len(best) == k:
                    floor[i] = max(floor[i], top_s[i][-1])
    n = [len(x) for x in top_s]
    empty = np.zeros(0, np.int64)
    return np.repeat(q_ids, n), np.concatenate([empty, *top_i]), np.concatenate([empty, *top_s]).astype(np.int64), scored


def _search(k: int, turn: np.ndarray, run_rows: int, step_rows: int):
    def run(key: tuple, queries: pa.Table, shard: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score")
        if not len(queries) or not len(shard):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        found = search(
            queries.column("id").to_numpy(),
            _matrix(queries.column("vector"), len(turn)),
            queries.column("floor").to_numpy(),
            shard.column("id").to_numpy(),
            _matrix(shard.column("vector"), len(turn)),
            k,
            turn,
            run_rows,
            step_rows,
        )
        return pa.table(dict(zip(names, map(pa.array, found[:3]), strict=True)))

    return run


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
    shard_rows: int = SHARD_ROWS,
    block_bytes: int = BLOCK_BYTES,
    run_rows: int = RUN_ROWS,
    step_rows: int = STEP_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the best k other rows of each row for which ``queries`` holds."""
    rows = vectors.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), quantise(vector, scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    rows = store_table(rows.where("vector is not null").withColumn("size", F.size("vector")))
    sizes = rows.where("size > 0").groupBy("size").agg(F.count("*").alias("n"), F.count_if("asks").alias("n_asked"))
    sizes = sizes.where("n > 1 and n_asked > 0").orderBy("size").collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    parts = [
        _of_size(rows.where(F.col("size") == s["size"]), s["size"], s["n"], s["n_asked"], k, shard_rows, block_bytes, run_rows, step_rows)
        for s in sizes
    ]
    return reduce(DataFrame.unionByName, parts)


def _of_size(
    rows: DataFrame, size: int, n: int, n_asked: int, k: int, shard_rows: int, block_bytes: int, run_rows: int, step_rows: int
) -> DataFrame:
    """The result of :func:`top_k` among ``n`` rows (id, vector, asks) of one size, ``n_asked`` of them queries."""
    turn = basis(rows, size)
    length = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_shards = max(common.parts_for(8 * size * n, SHARD_BYTES), min(cores, common.parts_for(n, shard_rows)))
    n_blocks = common.parts_for(8 * size * n_asked, block_bytes)
    # Shards are ranges of descending length, cut at quantiles of all lengths; equal lengths are spread by id.
    lengths, shares = rows.select(length.cast("double").alias("l")), [i / n_shards for i in range(1, n_shards)]
    cuts = sorted(set(lengths.approxQuantile("l", shares, 0.01)), reverse=True) if shares else []
    spread = _spread(n_shards, len(cuts))
    place = F.aggregate(F.lit(cuts), F.lit(0), lambda s, cut: s + (length <= cut).cast("int")) if cuts else F.lit(0)
    candidates = rows.select("id", "vector", place.alias("range")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int"))
    candidates = candidates.select("id", "vector", (F.col("range") * F.lit(spread) + F.col("part")).alias("shard"))
    asked = rows.where("asks").select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def meet(queries: DataFrame, first: int, last: int) -> DataFrame:
        """Best k of each query in the shards of a range of numbers."""
        left = queries.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard"))
        right = candidates.where(F.col("shard").between(first, last))
        right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        keys = ("block", "shard")
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own: both come from ``rows``
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            _search(k, turn, run_rows, step_rows), "query_id bigint, vec_id bigint, score bigint"
        )
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    none = F.lit(float("-inf"))
    found = meet(asked.withColumn("floor", none), 0, spread - 1)
    if cuts:
        found = store_table(found)
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        known = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", none))
        rest = meet(known, spread, (len(cuts) + 1) * spread - 1)
        found = found.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _spread(n_shards: int, n_cuts: int) -> int:
    """Parts of each range, where too many equal lengths leave fewer ranges than shards."""
    return -(-n_shards // (n_cuts + 1))
