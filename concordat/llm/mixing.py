"""Temperature mixing of sources, realised as budgeted block permutations.

Weights. Source s with a share p_s of all tokens gets the weight p_s^t / sum p^t. Entropy falls as t goes from 0 (even) to
1 (natural). The exponent is bisected: the largest t whose entropy is at least `entropy` times that of even weights, or,
given `repetition`, the smallest t with which no source is read more than so many times; with both, the larger t. It is
rounded to six decimals.

Budget. `budget` tokens in all, or "cover": the least budget with which every source is read whole at least once.

Realisation. A source's rows fall into 2^block_bits blocks by a keyed hash of their identity. Epoch after epoch the
source is read whole; the last, partial epoch reads blocks in the order of a keyed permutation until the budget is met,
and the block on the border row by row in hash order, stopping before the row that would pass the budget. `position` in
[0, 1) spreads each source evenly over the mix: sorting by it gives every stretch about the target weights.

Only DataFrame functions are used. Rows are combined to (source, block) before any shuffle, so a source that holds a third
of all rows is 2^block_bits numbers; only the border block's rows, one block of each source, are ever ordered one by one.
Every row then decides by itself from its source's few numbers.

Defined results: a null source is a source of its own. Rows without tokens cost nothing and take part like others. Rows
of the same identity and text share a hash, and go together. An empty table gives an empty mix. A carried column named
like an output takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.shared import whole, written

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 40
_HEX = 8  # hex digits of a hash that are used: 32 bits


def words_of(text: str) -> Column:
    """Token estimate without a tokenizer: words of the whole text."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def keyed_hash(*parts: Column) -> Column:
    """32 bits of the MD5 of the parts, as a bigint."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HEX), 16, 10).cast("bigint")


def row_hash(seed: int, identity: str, text: str) -> Column:
    return keyed_hash(F.lit(f"{seed}"), F.coalesce(F.col(identity).cast("string"), F.lit("")), F.md5(whole(text)))


def exponent(tokens: Column, entropy: float | None, repetition: float | None, budget: float | None) -> Column:
    """The bisected exponent of an array of the sources' (positive) token counts. budget None: cover."""
    total = F.aggregate(tokens, F.lit(0.0), lambda a, b: a + b)
    share = F.transform(tokens, lambda x: x / total)
    added = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    def entropy_at(t: Column) -> Column:
        z = added(F.transform(share, lambda p: F.pow(p, t)))
        return F.log(z) - t * added(F.transform(share, lambda p: F.pow(p, t) * F.log(p))) / z

    def most_read_at(t: Column) -> Column:
        # Epochs of s: budget w_s / T_s, proportional to p_s^(t-1); "cover" makes the least of them 1.
        rate = F.transform(share, lambda p: F.pow(p, t - 1))
        if budget is None:
            return F.array_max(rate) / F.array_min(rate)
        return F.array_max(rate) * budget / total / added(F.transform(share, lambda p: F.pow(p, t)))

    def bisected(right: object) -> Column:
        """The point of [0, 1] from which right(t) turns."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(x: Column, _: Column) -> Column:
            mid = (x["lo"] + x["hi"]) / 2
            up = right(mid)
            return F.struct(F.when(up, mid).otherwise(x["lo"]).alias("lo"), F.when(up, x["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["lo"]

    parts = []
    if entropy is not None:
        wanted = entropy * F.log(F.size(tokens).cast("double"))
        parts.append(F.when(entropy_at(F.lit(1.0)) >= wanted, F.lit(1.0)).otherwise(bisected(lambda t: entropy_at(t) >= wanted)))
    if repetition is not None:
        parts.append(F.when(most_read_at(F.lit(0.0)) <= repetition, F.lit(0.0)).otherwise(bisected(lambda t: most_read_at(t) > repetition)))
    t = F.greatest(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(1.0)
    return F.rint(t * 1e6) / 1e6


def weights(sources: DataFrame, *, entropy: float | None = 0.9, repetition: float | None = 4.0, budget: int | str = "cover") -> DataFrame:
    """Each source of sources(source, tokens): (source, tokens, exponent, weight, wanted: its tokens of the budget).

    One row holds the counts of all sources (8 bytes each) while the exponent is found.
    """
    fixed = None if budget == "cover" else float(budget)
    known = sources.filter("tokens > 0")
    t = known.agg(exponent(F.sort_array(F.collect_list(F.col("tokens").cast("double"))), entropy, repetition, fixed).alias("t"))
    raised = written(sources.withColumn("t", t.scalar()).withColumn("raised", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), "t")).otherwise(0.0)), "raised")
    z = raised.agg(F.sum("raised").alias("z")).scalar()
    full = raised.withColumn("weight", F.coalesce(F.try_divide("raised", z), F.lit(0.0)))
    full = written(full, "weights")
    # Under "cover" the source with the most tokens for its weight is read exactly once.
    least = full.filter("weight > 0").agg(F.max(F.col("tokens") / F.col("weight")).alias("b")).scalar() if fixed is None else F.lit(fixed)
    wanted = F.greatest("tokens", F.rint(F.col("weight") * least)) if fixed is None else F.rint(F.col("weight") * least)
    return full.select("source", "tokens", F.col("t").alias("exponent"), "weight", F.coalesce(wanted, F.lit(0)).cast("bigint").alias("wanted"))


def plan(docs: DataFrame, *, text: str = "text", source: str = "source", identity: str = "doc_id", tokens: Column | None = None, seed: int = 17, block_bits: int = 12, **target) -> DataFrame:
    """For each source: (source, exponent, weight, wanted, epochs, border, border_hash). target: see weights.

    epochs: whole readings. In the partial one, blocks whose order is below border are read, and of the border block the
    rows up to border_hash.
    """
    size = 1 << block_bits
    rows = docs.select(F.col(source).alias("source"), (words_of(text) if tokens is None else tokens).alias("n"), row_hash(seed, identity, text).alias("h"))
    rows = written(rows.withColumn("block", F.expr(f"div(h, {(1 << 4 * _HEX) // size})")), "mixing-rows")
    blocks = written(rows.groupBy("source", "block").agg(F.sum("n").alias("n")), "mixing-blocks")
    by_source = weights(blocks.groupBy("source").agg(F.sum("n").alias("tokens")), **target)
    by_source = written(by_source.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("div(wanted, tokens)")).otherwise(1)).withColumn("rest", F.when(F.col("tokens") > 0, F.col("wanted") % F.col("tokens")).otherwise(0)), "mixing-sources")
    keyed = by_source.select(F.col("source").alias("own"), "rest", "epochs")
    ordered = blocks.join(keyed, F.col("source").eqNullSafe(F.col("own"))).drop("own").withColumn("order", block_order(seed))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1))
    border = ordered.withColumn("before", F.coalesce(before, F.lit(0))).filter("before + n > rest").groupBy("source").agg(F.min(F.struct("order", "block", "before", "rest")).alias("b"))
    border = written(border.select("source", "b.*"), "mixing-border")
    edge = border.select(F.col("source").alias("own"), F.col("block").alias("own_block"), "before", "rest")
    close = rows.join(edge, F.col("source").eqNullSafe(F.col("own")) & (F.col("block") == F.col("own_block")))
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("h"))  # rows of equal hash go together
    last = close.withColumn("so_far", so_far).filter("before + so_far <= rest").groupBy("source").agg(F.max("h").alias("border_hash"))
    found = border.join(last.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")), "left").select(F.col("source").alias("own"), F.col("order").alias("border"), F.coalesce("border_hash", F.lit(-1)).alias("border_hash"))
    planned = by_source.join(found, F.col("source").eqNullSafe(F.col("own")), "left")
    return written(planned.select("source", "tokens", "exponent", "weight", "wanted", "epochs", F.coalesce("border", F.lit(-1)).alias("border"), F.coalesce("border_hash", F.lit(-1)).alias("border_hash")), "mixing-plan")


def block_order(seed: int) -> Column:
    """Where a block stands in the permutation of its source's partial epoch: 32 hashed bits, then the block itself."""
    return keyed_hash(F.lit(f"{seed}"), F.coalesce("source", F.lit("")), F.col("epochs").cast("string"), F.col("block").cast("string")) * (1 << 16) + F.col("block")


def mix(docs: DataFrame, planned: DataFrame, *, text: str = "text", source: str = "source", identity: str = "doc_id", carry: tuple[str, ...] = ("doc_id",), seed: int = 17, block_bits: int = 12) -> DataFrame:
    """The mix: (*carry, source, weight, epoch, block, position), one row for each reading of a row of docs."""
    size = 1 << block_bits
    names = ["source", "weight", "epochs", "border", "border_hash", "wanted", "tokens"]
    own = planned.select(*[F.col(x).alias(f"plan_{x}") for x in names])
    chosen = docs.select(*[F.col(x).alias(f"__{x}") for x in carry], F.col(source).alias("source"), row_hash(seed, identity, text).alias("h"))
    joined = chosen.withColumn("block", F.expr(f"div(h, {(1 << 4 * _HEX) // size})")).join(own, F.col("source").eqNullSafe(F.col("plan_source")), "left").withColumn("epochs", F.col("plan_epochs")).withColumn("order", block_order(seed))
    partly = (F.col("order") < F.col("plan_border")) | ((F.col("order") == F.col("plan_border")) & (F.col("h") <= F.col("plan_border_hash")))
    read = joined.filter((F.col("epochs") > 0) | partly).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("epochs") + F.when(partly, 1).otherwise(0))))
    readings = F.coalesce(F.try_divide("plan_wanted", "plan_tokens"), F.lit(1.0))
    spread = keyed_hash(F.lit(f"{seed}"), F.coalesce("source", F.lit("")), F.col("epoch").cast("string"), F.col("block").cast("string")) / float(1 << 4 * _HEX)
    found = {"source": F.col("source"), "weight": F.round("plan_weight", 9), "epoch": F.col("epoch"), "block": F.col("block"), "position": F.round((F.col("epoch") - 1 + spread) / F.ceil(readings), 9)}
    return read.select(*[F.col(f"__{x}").alias(x) for x in carry], *[c.alias(x) for x, c in found.items() if x not in carry])
