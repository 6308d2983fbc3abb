"""Mixing sources to target weights, with DataFrame operations only.

A source with T tokens of all (share p) gets a weight in proportion to p ** alpha. The exponent is found by
section search over [0, 1], evaluating a grid of exponents in one aggregation over the sources a round: the
flattest mix whose largest repetition is within `max_repeats`, or the mix nearest to the corpus whose entropy is
still `min_entropy` nats. Unless `budget` tokens are given, the budget is the least that shows every source once, so
no row is lost.

The weights are realised as block permutations. A row has a block and a slot from a hash of its doc_id; pass n over a
source permutes its blocks and slots by exclusive or with a hash of n. A source gets as many whole passes as its
budget holds and a last one that is cut where the running sum of tokens would exceed the rest: the block is found from
sums by block, the slot by a window over that one block. So a hot source is never sorted as a whole, and a row's
copies follow from its own columns and one short row of its source.

Null text has no tokens. A source without tokens is shown once. A null source is a source. Rows that repeat a doc_id
share one place and are kept or cut together; a null doc_id is hashed like a text of its own. Extra columns are kept,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topograph.lineage import cut
from topograph.llm.columns import back, fresh, held

BLOCKS = 4096
GRID, ROUNDS = 64, 7
PLAN = ("_passes", "_cut_block", "_cut_slot", "_turn_block", "_turn_slot")
SALTS = 64
#: Sources whose short rows are broadcast; more are joined by shuffle, with hot ones salted.
MOST_BROADCAST = 20_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _digest(seed: int, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("null"))).cast("binary"))


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def placed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds _source (never null), _block and _slot."""
    digest = _digest(seed, F.col("doc_id"))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.withColumns({"_source": source, "_block": _number(digest, 1, 3), "_slot": _number(digest, 4, 12)})


def turn(seed: int, n: Column) -> tuple[Column, Column]:
    """What pass n's blocks and slots are combined with."""
    digest = _digest(seed, F.concat(F.lit("pass"), n.cast("string")))
    return _number(digest, 1, 3), _number(digest, 4, 12)


def exponent(sources: DataFrame, max_repeats: float | None, min_entropy: float | None, budget: int | None) -> float:
    """alpha for sources(tokens); one row for each exponent of the grid comes to the driver."""
    top = sources.agg(F.max("tokens").alias("most"), F.sum("tokens").alias("all"))
    row = top.first()
    if not row["all"]:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * k / GRID for k in range(GRID + 1)]
        share = F.col("tokens") / F.lit(float(row["all"]))
        x = sources.where("tokens > 0").select("tokens", share.alias("p"), F.posexplode(F.array(*map(F.lit, grid))).alias("k", "alpha"))
        x = x.withColumn("w", F.pow("p", F.col("alpha")))
        repeats = F.max(F.col("w") / F.col("tokens")) * (F.lit(float(budget)) / F.sum("w") if budget else F.lit(float(row["most"])) / F.max("w"))
        entropy = F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")
        found = {r["k"]: (r["repeats"], r["entropy"]) for r in x.groupBy("k").agg(repeats.alias("repeats"), entropy.alias("entropy")).collect()}
        if max_repeats is not None:  # repetition falls as the exponent rises; the least exponent within the limit
            k = next((k for k in range(GRID + 1) if found[k][0] <= max_repeats * (1 + 1e-12)), GRID)
            lo, hi = grid[max(k - 1, 0)], grid[k]
        else:  # entropy falls as the exponent rises; the largest exponent that still has it
            k = next((k for k in range(GRID, -1, -1) if found[k][1] >= min_entropy - 1e-12), 0)
            lo, hi = grid[k], grid[min(k + 1, GRID)]
        if lo == hi:
            break
    return hi if max_repeats is not None else lo


def _few(sources: DataFrame) -> bool:
    return sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def plan(docs: DataFrame, max_repeats: float | None = 1.5, min_entropy: float | None = None, budget: int | None = None, seed: int = 17) -> DataFrame:
    """One row for each source: _source, tokens and PLAN: its whole passes, and where its last pass is cut.

    In the last pass, rows of blocks before _cut_block and of it up to _cut_slot are shown; both are as permuted.
    """
    rows = placed(docs.select("doc_id", "source", "text"), seed)
    blocks = cut(rows.groupBy("_source", "_block").agg(F.sum(tokens(F.col("text"))).alias("tokens")))
    sources = cut(blocks.groupBy("_source").agg(F.sum("tokens").alias("tokens")).coalesce(8))
    if min_entropy is not None:
        max_repeats = None
    alpha = exponent(sources, max_repeats, min_entropy, budget)
    sums = sources.agg(F.max("tokens").alias("most"), F.sum("tokens").alias("all"), F.sum(F.pow(F.col("tokens") / F.lit(1.0), F.lit(alpha))).alias("w")).first()
    if budget:
        repeats = F.lit(float(budget)) * F.pow(F.col("tokens") / F.lit(1.0), F.lit(alpha)) / F.lit(sums["w"] or 1.0) / F.col("tokens")
    else:
        repeats = F.pow(F.lit(float(sums["most"] or 0)) / F.col("tokens"), F.lit(1 - alpha))
    due = F.when(F.col("tokens") > 0, F.floor(F.col("tokens") * F.when(F.col("tokens") > 0, repeats) + F.lit(1e-6))).otherwise(F.lit(0)).cast("long")
    passes = F.when(F.col("tokens") > 0, F.expr("due div tokens")).otherwise(F.lit(1))
    sources = sources.withColumn("due", due).withColumn("passes", passes.cast("int")).withColumn("rest", F.col("due") - F.col("passes") * F.col("tokens"))
    sources = sources.withColumn("rest", F.when(F.col("tokens") > 0, F.col("rest")).otherwise(F.lit(0)))
    turn_block, turn_slot = turn(seed, F.col("passes") + 1)
    sources = sources.withColumns({"turn_block": turn_block, "turn_slot": turn_slot})
    # the block in which the rest runs out
    order = blocks.withColumnRenamed("tokens", "own").join(sources, "_source").withColumn("at", F.col("_block").bitwiseXOR(F.col("turn_block")))
    order = order.withColumn("before", F.sum("own").over(Window.partitionBy("_source").orderBy("at")) - F.col("own"))
    last = order.where("before <= rest and before + own > rest").select("_source", "_block", F.col("at").alias("cut_block"), (F.col("rest") - F.col("before")).alias("room"), "turn_slot")
    # the slot in that block
    near = rows.join(F.broadcast(last) if _few(sources) else last, ["_source", "_block"])
    near = near.select("_source", "cut_block", "room", F.col("_slot").bitwiseXOR(F.col("turn_slot")).alias("slot"), tokens(F.col("text")).alias("n"))
    running = F.sum("n").over(Window.partitionBy("_source").orderBy("slot").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    slot = near.withColumn("running", running).where("running <= room").groupBy("_source").agg(F.max("slot").alias("cut_slot"))
    out = sources.join(last.select("_source", "cut_block"), "_source", "left").join(slot, "_source", "left")
    out = out.withColumns({"cut_block": F.coalesce("cut_block", F.lit(-1)), "cut_slot": F.coalesce("cut_slot", F.lit(-1))})
    return out.select("_source", "tokens", *(F.col(c[1:]).alias(c) for c in PLAN))


def mix(docs: DataFrame, seed: int = 17, **target) -> DataFrame:
    """The rows of docs, one for each time they are shown, with _pass (from 1), _at_block and _at_slot: the mix is
    read in order of these three, which shares out the sources evenly. If docs has such a column, the new one gets more
    underscores."""
    made = cut(plan(docs, seed=seed, **target).select("_source", *PLAN))
    rows, names = held(docs, "doc_id", "source")
    rows = placed(rows, seed).drop("doc_id", "source")
    if _few(made):
        rows = rows.join(F.broadcast(made), "_source")
    else:
        made = made.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", (F.col("_block") % SALTS).cast("int")).join(made, ["_source", "_salt"])
    block, slot = F.col("_block").bitwiseXOR(F.col("_turn_block")), F.col("_slot").bitwiseXOR(F.col("_turn_slot"))
    more = (block < F.col("_cut_block")) | ((block == F.col("_cut_block")) & (slot <= F.col("_cut_slot")))
    shown = F.col("_passes") + F.when(more, 1).otherwise(0)
    rows = rows.where(shown > 0).withColumn("_pass", F.explode(F.sequence(F.lit(1), shown)))
    turn_block, turn_slot = turn(seed, F.col("_pass"))
    rows = rows.withColumns({"_at_block": F.col("_block").bitwiseXOR(turn_block), "_at_slot": F.col("_slot").bitwiseXOR(turn_slot)})
    own = ("_pass", "_at_block", "_at_slot")
    return rows.select(*back(docs, names), *(F.col(c).alias(n) for c, n in zip(own, fresh(docs, *own), strict=True)))
