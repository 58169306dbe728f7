"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's share of tokens is raised to an exponent and the powers are
normalised.  The exponent is bisected, inside one SQL expression over the array
of source totals, to the largest value in [0, 1] (1: the corpus as it is, 0: all
sources alike) at which the goal holds: entropy at least ``entropy_target`` nats,
or no, if ``max_repeats`` is given, the smallest at which no source is repeated
more than that.  The sources are a small dimension; their totals are one row.

Weights become token budgets, by default the smallest total at which every
source is used at least once, so no document is left out.  Each source then runs
through block permutations: documents are dealt to blocks of about
``block_tokens`` by hash, each epoch takes the blocks in an order of its own, and
the last, partial epoch ends in the block where the budget is reached.  Only
that block is ordered by document, so no source needs one task.

Defined results: a null source is a source of its own; a null or wordless text
counts one token; repeated rows each count; a null id is passed on; an empty
table gives no rows; all other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop, written

STEPS = 60


def word_count(text: Column) -> Column:
    """Words between white space, at least one."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("bigint")


def _fold(array: str, f, start: float = 0.0) -> Column:
    return F.aggregate(array, F.lit(start), lambda acc, x: acc + f(x))


def _meets(exponent: Column, entropy_target: float | None, max_repeats: float | None) -> Column:
    norm = _fold("shares", lambda p: F.pow(p, exponent))
    if entropy_target is not None:
        # H = log(norm) - exponent * sum(p^e log p) / norm
        return F.log(norm) - exponent * _fold("shares", lambda p: F.pow(p, exponent) * F.log(p)) / norm >= entropy_target
    # Epochs of a source, in units of those of the least repeated one: p^(e-1) over its minimum.
    most = F.array_max(F.transform("shares", lambda p: F.pow(p, exponent - 1)))
    least = F.array_min(F.transform("shares", lambda p: F.pow(p, exponent - 1)))
    return most / least <= max_repeats


def source_weights(totals: DataFrame, entropy_target: float | None = None, max_repeats: float | None = None) -> DataFrame:
    """``totals`` (source, tokens) with exponent and weight.

    Give one goal.  Entropy falls as the exponent rises, so the largest exponent
    that meets it is taken; repeats fall as it rises, so the smallest is.  If no
    exponent in [0, 1] meets the goal, the nearest end is taken.
    """
    if (entropy_target is None) == (max_repeats is None):
        raise ValueError("give either entropy_target or max_repeats")
    upward = max_repeats is not None
    one = totals.agg(F.array_sort(F.collect_list("tokens")).alias("t"))
    one = one.select(F.transform("t", lambda x: x / F.aggregate("t", F.lit(0).cast("bigint"), lambda a, y: a + y)).alias("shares"))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        good = _meets(mid, entropy_target, max_repeats)
        goes_down = good if upward else ~good
        return F.struct(
            F.when(goes_down, acc["lo"]).otherwise(mid).alias("lo"), F.when(goes_down, mid).otherwise(acc["hi"]).alias("hi")
        )

    ends = F.lit(0.0 if upward else 1.0)  # the end that is wanted if it meets the goal
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    found = found["hi"] if upward else found["lo"]
    one = one.select(F.when(_meets(ends, entropy_target, max_repeats), ends).otherwise(found).alias("exponent"), "shares")
    norm = _fold("shares", lambda p: F.pow(p, F.col("exponent")))
    fit = one.select(F.struct("exponent", norm.alias("norm")).alias("fit")).scalar()
    whole = totals.agg(F.sum("tokens").alias("all")).scalar()
    return totals.select(*totals.columns, fit.alias("fit"), (F.col("tokens") / whole).alias("share")).select(
        *totals.columns, F.col("fit.exponent").alias("exponent"), (F.pow("share", "fit.exponent") / F.col("fit.norm")).alias("weight")
    )


def mix_sources(
    docs: DataFrame,
    entropy_target: float | None = None,
    max_repeats: float | None = None,
    budget_tokens: int | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 10,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` as often as the mixture takes each, with mix_epoch (from 0), mix_order and mix_tokens.

    Read in the order of (mix_epoch, mix_order) a source is a sequence of block permutations.
    """
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("own"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_source"),
        word_count(F.col(text_col).cast("string")).alias("_tokens"),
        F.xxhash64(F.col(id_col), F.col(text_col).cast("string"), F.lit(seed)).alias("_hash"),
    )
    lean = written(rows.select("_source", "_tokens", "_hash"), "mix-tokens")
    totals = written(lean.groupBy(F.col("_source").alias("source")).agg(F.sum("_tokens").alias("tokens")), "mix-totals")
    weights = source_weights(totals, entropy_target, max_repeats)
    # Least budget at which each source is used once: the source with the least weight per token.
    need = weights.agg(F.max(F.col("tokens") / F.col("weight")))
    total = F.lit(float(budget_tokens)) if budget_tokens is not None else need.scalar()
    budgets = weights.withColumn("all", total).select(
        F.col("source").alias("_source"), F.col("tokens").alias("_total"),
        # Rounding must not take a token off a source's one whole epoch.
        F.floor(F.col("all") * F.col("weight") + 1e-6 * F.col("tokens")).cast("bigint").alias("_budget"),
        F.ceil(F.col("tokens") / block_tokens).cast("bigint").alias("_blocks"),
    )
    budgets = written(budgets, "mix-budgets")  # one row per source; Spark sees its size and broadcasts it if small
    block = F.pmod(F.col("_hash"), F.col("_blocks"))
    epochs = F.floor(F.col("_budget") / F.col("_total")).cast("bigint")
    order = lambda epoch: F.xxhash64("_source", "_block", epoch, F.lit(seed))

    blocks = lean.join(budgets, "_source").withColumn("_block", block)
    blocks = blocks.groupBy("_source", "_block", "_total", "_budget").agg(F.sum("_tokens").alias("size"))
    upto = F.sum("size").over(
        Window.partitionBy("_source").orderBy(order(epochs), "_block").rowsBetween(Window.unboundedPreceding, 0)
    )
    rest = F.col("_budget") - epochs * F.col("_total")
    # What of the last epoch each block may still hold: all of it, a part, or nothing.
    last = blocks.withColumn("room", rest - (upto - F.col("size"))).where("room > 0")
    last = written(last.select(F.col("_source").alias("l_source"), F.col("_block").alias("l_block"), "size", "room"), "mix-last")
    drop(lean, totals)

    dealt = rows.join(budgets, "_source").withColumn("_block", block)
    whole = dealt.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), epochs - 1))).where(epochs > 0)
    in_last = (F.col("_source") == F.col("l_source")) & (F.col("_block") == F.col("l_block"))
    full = dealt.join(last.where("size <= room"), in_last, "left_semi").withColumn("mix_epoch", epochs)
    edge = dealt.join(last.where("size > room"), in_last)  # at most one block per source
    sofar = F.sum("_tokens").over(
        Window.partitionBy("_source", "_block").orderBy(F.xxhash64("_hash", F.lit(seed)), "_hash")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    edge = edge.withColumn("_sofar", sofar).where("_sofar - _tokens < room").withColumn("mix_epoch", epochs)
    edge = edge.drop("_sofar", "l_source", "l_block", "size", "room")
    mixed = whole.unionByName(full).unionByName(edge)
    return mixed.select(
        *[F.col("own").getField(c).alias(c) for c in docs.columns], "mix_epoch",
        F.struct(order(F.col("mix_epoch")).alias("block_order"), F.xxhash64("_hash", "mix_epoch").alias("row_order")).alias("mix_order"),
        F.col("_tokens").alias("mix_tokens"),
    )
