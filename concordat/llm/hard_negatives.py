"""Hard-negative mining by dual-tree search, in pairs of blocks.

Rows are dealt to cells around pivots and cells to blocks of bounded size, however many rows share a vector or a label.
First each anchor's positives are sought among the blocks of its label, then its negatives: in the cell's own block, whose
third best raises what is wanted, and then in every other block whose ball can hold a wanted score. A task holds one block
of anchors and one of candidates and searches them with two trees (see dual_tree.py); results are merged by rank.

Anchors are a stated query set against all rows, in blocks: rows move once for each block of anchors that can need them.
The pivots are at most PIVOTS rows, chosen by hash (parameter); they shape blocks and never the result.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no part, nor do rows with
a null id. Components become floor(256 * x). Vectors of different lengths are compared as if the shorter one went on in
zeros; empty vectors score 0. Repeated rows are rows of their own: each repeated anchor returns its rows, and "other" rows
are other rows, not other ids. Ties go to the smaller id, then to any of the repeated rows, which are equal. A negative
positive score asks for an empty interval, so such a pair returns nothing. Scores beyond 64 bits are cut to their range.
An anchor without positives or negatives has no rows. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.dual_tree import LONG, Side, search
from concordat.llm.shared import cogrouped, written

#: Rows of a block of candidates and of anchors; pivots of the cells at most.
BLOCK, ANCHORS, PIVOTS = 8192, 2048, 256
SCALE = 256
FOUND = "a_row bigint, slot int, c_id bigint, score bigint"
BALL = "block bigint, centre array<double>, radius double, low bigint, high bigint"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of any lengths as rows of whole numbers, filled up with zeros."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out * SCALE)


def _width(*columns: pa.ChunkedArray) -> int:
    return max((x for c in columns for x in c.combine_chunks().value_lengths().to_pylist()), default=0)


def _long(score: object) -> int:
    return max(-LONG - 1, min(LONG, int(score)))


def _searched(top: int, same: bool):
    """Searches one block of candidates for one block of anchors."""

    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        width = _width(candidates["vector"], anchors["vector"])
        sides = [Side(t["row"].to_numpy(), t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["vector"], width)) for t in (anchors, candidates)]
        low, high = (np.array(anchors[c].to_pylist(), np.int64).reshape(anchors.num_rows, -1) for c in ("low", "high"))
        a, slot, c, score = search(*sides, low, high, top, same)
        found = [sides[0].place[a], slot.astype(np.int32), sides[1].key[c], pa.array([_long(x) for x in score.tolist()], pa.int64())]
        return pa.table([pa.array(x) for x in found], ["a_row", "slot", "c_id", "score"])

    return run


def _ball(rows: pa.Table) -> pa.Table:
    """The ball around a block's rows."""
    width = _width(rows["vector"])
    points = _matrix(rows["vector"], width)
    with np.errstate(all="ignore"):
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max(initial=0)))
    radius = radius if math.isfinite(radius) else math.inf
    wanted = [rows[c].to_pylist() if c in rows.column_names else [] for c in ("low", "high")]
    low = min((x for xs, ys in zip(*wanted) for x, y in zip(xs, ys) if x <= y), default=LONG)
    high = max((y for xs, ys in zip(*wanted) for x, y in zip(xs, ys) if x <= y), default=-LONG)
    return pa.table({"block": rows["block"][:1], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64())})


def _parts(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("int")


def _dealt(n: Column, seed: int) -> Column:
    """Which of n parts a row goes to."""
    return F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("int")


def _best(found: DataFrame, top: int) -> DataFrame:
    ranks = Window.partitionBy("a_row", "slot").orderBy(F.desc("score"), "c_id")
    return found.withColumn("place", F.row_number().over(ranks)).filter(F.col("place") <= top)


def usable(vectors: DataFrame, *, id: str, vector: str, label: Column) -> DataFrame:
    """(row, id, label, vector) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < math.inf))
    chosen = vectors.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.when(finite, F.col(vector).cast("array<double>")).alias("vector"))
    return written(chosen.dropna().withColumn("row", F.monotonically_increasing_id()), "vectors")


def _celled(rows: DataFrame, pivots: int, block: int) -> DataFrame:
    """rows with the cell of the nearest pivot."""
    wanted = max(1, min(pivots, rows.count() // block))
    chosen = [r.vector for r in rows.select("vector", F.xxhash64("row").alias("h")).orderBy("h").limit(wanted).collect()]
    width = max(map(len, chosen), default=0)
    centres = np.zeros((max(1, len(chosen)), width))
    for k, v in enumerate(chosen):
        centres[k, : len(v)] = v
    names = rows.columns

    def run(batches):
        with np.errstate(all="ignore"):
            sizes = (centres**2).sum(axis=1)
            for x in batches:
                own = pa.chunked_array([x.column(names.index("vector"))])
                points = _matrix(own, max(width, _width(own)))[:, :width] / SCALE
                cell = np.argmin(np.nan_to_num(sizes - 2 * points @ centres.T), axis=1) if width else np.zeros(x.num_rows)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(cell.astype(np.int64))], [*names, "cell"])

    return rows.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields) + "cell bigint")


def mine(
    vectors: DataFrame, anchor: Column, *, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 3,
    least: tuple[int, int] = (50, 100), most: tuple[int, int] = (95, 100), block: int = BLOCK, anchors_block: int = ANCHORS, pivots: int = PIVOTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where anchor (a condition on id) holds.

    A negative's score lies between least and most of the positive's, each given as a fraction.
    """
    rows = usable(vectors, id=id, vector=vector, label=F.col(label) if isinstance(label, str) else label)
    rows = written(_celled(rows.withColumn("anchor", F.coalesce(anchor, F.lit(False))), pivots, block), "cells")
    anchors = rows.filter("anchor").drop("anchor")
    rows = rows.drop("anchor")

    # Positives: an anchor's label alone, in blocks of the label.
    by_label = rows.groupBy("label").agg(_parts(F.count("*"), block).alias("parts"))
    by_label = written(by_label.join(anchors.groupBy("label").agg(_parts(F.count("*"), anchors_block).alias("a_parts")), "label"), "labels")
    keys = ("label", "part", "a_part")
    theirs = rows.join(by_label, "label").withColumn("part", _dealt(F.col("parts"), 1)).withColumn("a_part", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1)))
    everything = [F.array(F.lit(x).cast("bigint")).alias(n) for x, n in ((-LONG - 1, "low"), (LONG, "high"))]
    ours = anchors.join(by_label, "label").withColumn("a_part", _dealt(F.col("a_parts"), 2)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ("row", "id", "label", "vector", "part", "a_part")
    found = cogrouped(theirs.select(*columns), ours.select(*columns, *everything), keys, _searched(positives, True), FOUND)
    wanted = written(_best(found, positives).withColumn("slot", F.col("place") - 1).drop("place"), "positives")

    # What each positive asks of its negatives, in the order of the slots.
    score = "cast(score as decimal(20, 0))"
    up, down = F.expr(f"({score} * {least[0]} + {least[1] - 1}) div {least[1]}"), F.expr(f"({score} * {most[0]}) div {most[1]}")
    asked = wanted.filter("score >= 0").select("a_row", F.struct("slot", up.alias("low"), down.alias("high")).alias("x"))
    asked = asked.groupBy("a_row").agg(F.array_sort(F.collect_list("x")).alias("x"))
    asked = asked.select(F.col("a_row").alias("row"), F.col("x.slot").alias("slots"), F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    cells = written(rows.groupBy("cell").agg(_parts(F.count("*"), block).alias("parts")).join(anchors.groupBy("cell").agg(_parts(F.count("*"), anchors_block).alias("a_parts")), "cell", "left"), "cell-sizes")
    blocked = written(rows.join(cells, "cell").withColumn("block", F.col("cell") * (1 << 32) + _dealt(F.col("parts"), 3)).select("row", "id", "label", "vector", "block"), "blocks")
    asking = anchors.join(asked, "row").join(cells, "cell").withColumn("part", _dealt(F.col("a_parts"), 4))
    # An anchor's own block of candidates: of its cell, as the block of anchors says.
    asking = asking.withColumn("block", F.col("cell") * (1 << 32) + F.col("part")).withColumn("home", F.col("cell") * (1 << 32) + F.pmod(F.col("part"), F.col("parts")))
    asking = written(asking.select("row", "id", "label", "vector", "slots", "low", "high", "block", "home"), "asking")

    def searched(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        theirs = blocked.join(pairs, "block").select("row", "id", "label", "vector", "block", "a_block")
        ours = asking.withColumnRenamed("block", "a_block").drop("home", "slots").join(pairs, "a_block").select("row", "id", "label", "vector", "low", "high", "block", "a_block")
        return cogrouped(theirs, ours, ("block", "a_block"), _searched(negatives, False), FOUND)

    home = written(asking.select(F.col("block").alias("a_block"), F.col("home").alias("block")).distinct(), "home-pairs")
    near = written(_best(searched(home, asking), negatives), "near-negatives")
    # Elsewhere only what beats the last of a full set is wanted. Equal scores stay wanted: a smaller id comes first.
    last = near.filter(F.col("place") == negatives).groupBy("a_row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("last"))
    raised = asking.join(last.withColumnRenamed("a_row", "row"), "row", "left")
    raised = raised.withColumn("low", F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("last", i), x)))).drop("last")
    raised = written(raised, "asking-more")

    balls = written(blocked.groupBy("block").applyInArrow(_ball, BALL).drop("low", "high"), "balls")
    ours = raised.groupBy("block").applyInArrow(_ball, BALL).select(F.col("block").alias("a_block"), F.col("centre").alias("a_centre"), F.col("radius").alias("a_radius"), "low", "high")
    ours = ours.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pivots - 1).cast("bigint"))))
    middle = F.aggregate(F.zip_with("centre", "a_centre", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    def norm(c: str) -> Column:
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))

    spread = F.col("radius") * norm("a_centre") + F.col("a_radius") * norm("centre") + F.col("radius") * F.col("a_radius")
    slack = 0.5 + 1e-9 * (F.abs("middle") + F.col("spread"))
    pairs = ours.join(balls.withColumn("cell", F.shiftright("block", 32)), "cell").withColumn("middle", middle).withColumn("spread", spread).withColumn("slack", slack)
    misses = (F.col("middle") + F.col("spread") + F.col("slack") < F.col("low")) | (F.col("middle") - F.col("spread") - F.col("slack") > F.col("high"))
    pairs = written(pairs.filter(~F.coalesce(misses, F.lit(False))).select("a_block", "block").join(home, ["a_block", "block"], "left_anti"), "pairs")

    all_found = near.drop("place").unionByName(searched(pairs, raised))
    chosen = _best(all_found, negatives).withColumnsRenamed({"c_id": "negative_id", "score": "negative_score", "place": "rank"})
    named = asking.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id"), "slots")
    chosen = chosen.join(named, "a_row").withColumn("slot", F.element_at("slots", F.col("slot") + 1))
    chosen = chosen.join(wanted.withColumnsRenamed({"c_id": "positive_id", "score": "positive_score"}), ["a_row", "slot"])
    return chosen.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
