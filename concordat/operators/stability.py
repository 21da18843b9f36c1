"""Leave-one-source-out stability of the priority ranking.

An entity's fold statistics change only in the folds of its own units, so they are computed there, from sums over the units
before and behind; in all other folds its full statistics stand. Ranks are wanted for every entity in every
fold, so there is a row for each; ranges of the score are ordered by themselves, and the sizes of the ranges above are
added, so that no task orders a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.special import rounded
from concordat.operators.consensus import TINY, concordant_share, least_units, strength
from concordat.operators.evidence import clipped
from concordat.operators.lanes import PRIORITY, from_effect, from_z, geometric
from concordat.store import settled

#: Ranges of the priority score (0 to 100) for each point.
RANGES_PER_POINT = 20
#: Sums over an entity's units that its priority score is made of.
PARTS = ("wz", "ww", "up", "down", "n_up", "n_down", "wy", "wn", "r", "n")


def _parts(rows: DataFrame) -> DataFrame:
    """(gene_symbol, source_unit_id, PARTS): what each unit adds to its entity's statistics, dealt by entity."""
    kept = rows.filter("signed_z is not null and normalized_rank is not null and weight is not null")
    w, z, y = F.col("weight"), F.col("signed_z"), F.col("lfc")
    made = {
        "wz": w * z,
        "ww": w * w,
        "up": F.when(z > 0, strength(z)).otherwise(0.0),
        "down": F.when(z < 0, strength(z)).otherwise(0.0),
        "n_up": (z > 0).cast("double"),
        "n_down": (z < 0).cast("double"),
        "wy": F.coalesce(w * y, F.lit(0.0)),
        "wn": F.when(y.isNotNull(), w).otherwise(0.0),
        "r": F.log(F.least(F.greatest(F.col("normalized_rank"), F.lit(TINY)), F.lit(1.0))),
        "n": F.lit(1),
    }
    dealt = kept.select("gene_symbol", "source_unit_id", "weight", "signed_z", "lfc", "normalized_rank").repartition("gene_symbol")
    return dealt.select("gene_symbol", "source_unit_id", *[made[c].alias(c) for c in PARTS])


def priority(sums: DataFrame) -> DataFrame:
    """sums (PARTS added up) with n_source_units, priority_score and direction_confidence_index in place of PARTS."""
    out = sums.withColumn("n_source_units", F.col("n").cast("int")).filter("n_source_units > 0")
    out = out.withColumn("__z", F.col("wz") / F.sqrt("ww"))
    n_up, n_down = F.col("n_up"), F.col("n_down")
    agreed = F.when(F.col("__z") > 0, n_up).when(F.col("__z") < 0, n_down).otherwise(0.5 * (n_up + n_down))
    out = out.withColumns({
        "direction_score": clipped(concordant_share(F.col("__z"), F.col("up"), F.col("down")), 0.0),
        "evidence_score": from_z(F.col("__z")),
        "rank_score_component": clipped(1 - F.exp(F.col("r") / F.col("n_source_units")), 0.0),
        "effect_score": from_effect(F.try_divide("wy", "wn")),
        "direction_confidence_index": rounded(F.when(n_up + n_down > 0, (1 + agreed) / (2 + n_up + n_down)).otherwise(0.5)),
    })
    return out.withColumn("priority_score", rounded(geometric(PRIORITY))).drop("__z", "direction_score", "evidence_score", "rank_score_component", "effect_score", *PARTS)


def folds(rows: DataFrame, units: DataFrame, least: int = 2) -> DataFrame:
    """(fold, gene_symbol, fold_rank) of every entity that stays eligible without the fold's unit.

    rows: evidence, one row for each entity and unit. units: (source_unit_id), one row for each unit.
    """
    least = least_units(least)
    parts = _parts(rows)
    # What is left of an entity without a unit is what comes before it and what comes behind: nothing is taken away from a sum,
    # which would leave a remainder where the others cancel.
    sides = [Window.partitionBy("gene_symbol").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("source_unit_id"), F.desc("source_unit_id"))]
    left = parts.select("gene_symbol", F.col("source_unit_id").alias("fold"), *[(F.coalesce(F.sum(c).over(sides[0]), F.lit(0)) + F.coalesce(F.sum(c).over(sides[1]), F.lit(0))).alias(c) for c in PARTS])
    columns = ["gene_symbol", "n_source_units", "priority_score", "direction_confidence_index", "fold"]
    # Entities without the fold's unit keep their full statistics; units are few, and known by their count.
    full = priority(parts.groupBy("gene_symbol").agg(*[F.sum(c).alias(c) for c in PARTS], F.collect_set("source_unit_id").alias("own")))
    names = units.agg(F.array_sort(F.collect_set("source_unit_id")).alias("folds")).scalar()
    rest = full.withColumn("fold", F.explode(F.array_except(names, "own"))).select(columns)
    scored = priority(left).select(columns).unionByName(rest).filter(F.col("n_source_units") >= least)
    scored = settled(scored.withColumn("range", F.floor(F.col("priority_score") * RANGES_PER_POINT)))
    above = Window.partitionBy("fold").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = scored.groupBy("fold", "range").agg(F.count("*").alias("n")).select("fold", "range", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    order = Window.partitionBy("fold", "range").orderBy(F.desc("priority_score"), F.desc("n_source_units"), F.desc("direction_confidence_index"), "gene_symbol")
    placed = scored.withColumn("within", F.row_number().over(order)).join(ranges, ["fold", "range"])
    return placed.select("fold", "gene_symbol", (F.col("above") + F.col("within")).cast("int").alias("fold_rank"))


def stability(ranks: DataFrame, scores: DataFrame, n_units: int, n_entities: int) -> DataFrame:
    """Per entity of scores (gene_symbol, priority_rank): what its fold ranks say. Ineligible folds cost a rank of N + 1."""
    many = n_units >= 2
    grouped = ranks.groupBy("gene_symbol").agg(F.collect_list(F.col("fold_rank").cast("double")).alias("r"))
    held = scores.select("gene_symbol", "priority_rank").join(grouped, "gene_symbol", "left").withColumn("r", F.array_sort(F.coalesce("r", F.array().cast("array<double>"))) if many else F.array().cast("array<double>"))
    n = F.size("r")
    penalised = F.concat("r", F.array_repeat(F.lit(float(n_entities + 1)), F.lit(n_units) - n))
    available = n > 0
    shift = F.abs(_quantile(penalised, F.lit(n_units), 0.5) - F.col("priority_rank"))
    share = lambda top: F.size(F.filter("r", lambda x: x <= top)) / n
    return held.select(
        "gene_symbol",
        F.lit(n_units).alias("loo_total_folds"),
        n.alias("loo_rank_evaluable_folds"),
        (F.lit(n_units) - n).alias("loo_penalty_folds"),
        available.alias("loo_component_available"),
        F.when(available, _quantile(F.col("r"), n, 0.5)).alias("loo_median_rank"),
        F.when(available, _quantile(F.col("r"), n, 0.75) - _quantile(F.col("r"), n, 0.25)).alias("loo_rank_iqr"),
        F.when(available, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), shift / max(n_entities, 1)))).alias("loo_rank_stability_score"),
        F.when(available, share(50)).alias("loo_top50_fraction"),
        F.when(available, share(100)).alias("loo_top100_fraction"),
    )


def _quantile(values: Column, n: Column, p: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (n - 1) * p
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
    return a + (b - a) * (at - low)
