"""Mixing sources by temperature: weights, token budgets and block permutations.

A source's weight is its share of all tokens to a power, normalised. Powers from 1 (shares as
they are) to 0 (all sources alike) give rising entropy and rising repetition of small sources.
The power is found by bisection: the largest that reaches a target entropy, raised if a source
would be repeated more often than allowed. A weight times the total budget is a source's budget
in tokens.

A source's documents are dealt over blocks by a hash of their id. Every epoch is a seeded
permutation of the source's blocks. Whole epochs are taken while the budget lasts; the last one
takes blocks in their order and, of the block that exceeds the budget, documents in hash order
as long as they fit. So a budget is met up to less than one document (documents whose id is
repeated go together).

Defined results: a null source is a source; a null or empty text counts one token, its end;
a null id counts as empty text; an empty table gives no rows. Everything runs as DataFrame
operations, and windows only hold a source's blocks, at most ``max_blocks``, or one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import store_table

#: Bisection levels taken by one aggregate, and how many such aggregates are run.
_LEVELS, _ROUNDS = 5, 8
PLAN = ["mix_source", "mix_block", "mix_epoch", "mix_rank"]


def n_tokens(text: str = "text") -> Column:
    """Words of a text and one for its end."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + F.lit(1)


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def _digest(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def solve_exponent(sources: DataFrame, target_entropy: float, max_repetition: float, budget: int) -> float:
    """The exponent for ``sources`` (key, tokens), see the module's text.

    Each aggregate tries all inner points of some levels of the bisection at once.
    """
    stats = sources.agg(F.sum("tokens"), F.count("*")).head()
    total, n = stats[0], stats[1]
    if not total or n < 2:
        return 1.0
    wanted = target_entropy * math.log(n)
    share = F.col("tokens") / F.lit(float(total))

    def tried(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and largest repetition at each exponent."""
        rows = sources.select(share.alias("p"), F.posexplode(F.array(*[F.lit(x) for x in points])).alias("i", "a"))
        z = F.sum(F.pow("p", "a"))
        s = F.sum(F.pow("p", "a") * F.col("a") * F.log("p"))
        most = F.max(F.pow(F.col("p"), F.col("a") - F.lit(1.0)))
        out = rows.groupBy("i").agg(z.alias("z"), s.alias("s"), most.alias("m")).collect()  # one row per point
        return [(math.log(r["z"]) - r["s"] / r["z"], r["m"] / r["z"] * budget / total) for r in sorted(out)]

    def bisect(holds) -> float:
        """Where ``holds`` turns from true to false as the exponent rises from 0 to 1."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            steps = 1 << _LEVELS
            points = [low + (high - low) * k / steps for k in range(1, steps)]
            true = sum(holds(*x) for x in tried(points))
            low, high = low + (high - low) * true / steps, low + (high - low) * (true + 1) / steps
        return low

    (_, most_even), (entropy, most) = tried([0.0, 1.0])
    exponent = 1.0 if entropy >= wanted else bisect(lambda h, _: h >= wanted)
    if most_even > max_repetition >= most:
        exponent = max(exponent, bisect(lambda _, m: m > max_repetition) + 2.0 ** -(_LEVELS * _ROUNDS))
    elif most > max_repetition:
        exponent = 1.0
    return min(1.0, exponent)


def budgets(sources: DataFrame, exponent: float, budget: int) -> DataFrame:
    """key, tokens, weight and the whole tokens granted to each source."""
    total = sources.agg(F.sum("tokens")).head()[0] or 1
    raw = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent))
    norm = sources.agg(F.sum(raw)).head()[0] or 1.0
    weight = raw / F.lit(norm)
    return sources.select("key", "tokens", weight.alias("weight"), F.floor(weight * F.lit(budget) + F.lit(1e-6)).alias("granted"))


def mix_sources(
    docs: DataFrame,
    source: str = "source",
    id_column: str = "doc_id",
    text: str = "text",
    target_entropy: float = 0.95,
    max_repetition: float = 4.0,
    budget: int | None = None,
    block_tokens: int = 1 << 16,
    max_blocks: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with columns of :data:`PLAN`.

    ``target_entropy`` is a share of the largest possible, the log of the number of sources.
    ``budget`` is in tokens; without it, it is what ``docs`` have. ``mix_rank`` is the place of
    the row's block in its source's permutation of the epoch ``mix_epoch``. Columns of ``docs``
    named as in :data:`PLAN` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in PLAN])
    spark = docs.sparkSession
    place = _digest(seed, F.lit("doc"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    sized = docs.select(_key(source).alias("key"), place.alias("digest"), n_tokens(text).alias("n"))
    sources = store_table(sized.groupBy("key").agg(F.sum("n").alias("tokens")))
    total = sources.agg(F.sum("tokens")).head()[0] or 0
    budget = total if budget is None else budget
    exponent = solve_exponent(sources, target_entropy, max_repetition, budget)
    blocks_of = F.greatest(F.lit(1), F.least(F.lit(max_blocks), F.ceil(F.col("tokens") / F.lit(block_tokens)))).cast("long")
    granted = store_table(budgets(sources, exponent, budget).withColumn("blocks", blocks_of))

    def block(digest: str, blocks: str) -> Column:
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col(blocks)

    dealt = sized.join(granted.select("key", "blocks"), "key").select("key", block("digest", "blocks").alias("block"), "digest", "n")
    sums = dealt.groupBy("key", "block").agg(F.sum("n").alias("block_tokens"))
    plan = sums.join(granted, "key").select(
        "key",
        "block",
        "block_tokens",
        (F.col("granted") / F.col("tokens")).cast("long").alias("full"),
        (F.col("granted") % F.col("tokens")).alias("rest"),
    )
    epochs = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))).alias("epoch"))
    order = _digest(seed, F.lit("block"), F.col("key"), F.col("epoch").cast("string"), F.col("block").cast("string"))
    by_order = Window.partitionBy("key", "epoch").orderBy("order", "block")
    ranked = epochs.withColumn("order", order).select(
        "key",
        "block",
        "epoch",
        "full",
        "rest",
        F.row_number().over(by_order).alias("rank"),
        F.sum("block_tokens").over(by_order.rowsBetween(Window.unboundedPreceding, 0)).alias("reached"),
        "block_tokens",
    )
    whole = (F.col("epoch") < F.col("full")) | (F.col("reached") <= F.col("rest"))
    left = F.col("rest") - (F.col("reached") - F.col("block_tokens"))
    ranked = store_table(
        ranked.select("key", "block", "epoch", F.col("rank").cast("long"), whole.alias("whole"), left.alias("left")).where(
            F.col("whole") | (F.col("left") > 0)
        )
    )
    # Of the one block per source that exceeds the budget: the last document digest that fits.
    cut = ranked.where(~F.col("whole")).select("key", "block", "left")
    partly = dealt.join(cut, ["key", "block"])
    upto = Window.partitionBy("key").orderBy("digest").rangeBetween(Window.unboundedPreceding, 0)
    fits = partly.withColumn("sum", F.sum("n").over(upto)).where(F.col("sum") <= F.col("left"))
    last = store_table(fits.groupBy("key").agg(F.max("digest").alias("last")))
    takes = ranked.join(last, "key", "left").select(
        F.col("key").alias("mix_key"), F.col("block").alias("mix_block"), F.col("epoch").alias("mix_epoch"),
        F.col("rank").alias("mix_rank"), F.when(F.col("whole"), F.lit("g")).otherwise(F.coalesce("last", F.lit(""))).alias("mix_last"),
    )
    plans = store_table(
        takes.groupBy("mix_key", "mix_block").agg(F.collect_list(F.struct("mix_epoch", "mix_rank", "mix_last")).alias("mix_takes"))
    )
    sizes = granted.select(F.col("key").alias("mix_key"), F.col("blocks").alias("mix_blocks"))
    rows = docs.withColumns({"mix_key": _key(source), "mix_digest": place}).join(sizes, "mix_key")
    rows = rows.withColumn("mix_block", block("mix_digest", "mix_blocks")).join(plans, ["mix_key", "mix_block"])
    rows = rows.withColumn("mix_take", F.explode(F.filter("mix_takes", lambda t: F.col("mix_digest") <= t["mix_last"])))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("mix_key") != "null", F.substring("mix_key", 2, 1 << 30)).alias("mix_source"),
        "mix_block",
        F.col("mix_take.mix_epoch").alias("mix_epoch"),
        F.col("mix_take.mix_rank").alias("mix_rank"),
    )
