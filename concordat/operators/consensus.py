"""Consensus over source units: weighted Stouffer, concordance, heterogeneity and the rank product.

One groupBy on the entity carries everything. What depends on the combined sign is summed for both signs at once, and Q is
expanded around the weighted mean from an array of the entity's units (bounded by the number of units), so nothing is
aggregated, joined back and aggregated again.
"""

from __future__ import annotations

import math
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.special import log_sf
from concordat.operators.ranking import bh_adjust, global_rank
from concordat.operators.units import collapse
from concordat.store import settled

TINY = 2.2250738585072014e-308


def least_units(value) -> int:
    """A whole number of units of at least 1; text such as "2" is read, 2.5, true and NaN are refused."""
    if isinstance(value, bool):
        raise ValueError("the least number of units can't be a boolean")
    try:
        parsed = Decimal(str(value).strip())
    except InvalidOperation:
        raise ValueError(f"the least number of units must be a whole number, not {value!r}") from None
    if not parsed.is_finite() or parsed != parsed.to_integral_value() or parsed < 1:
        raise ValueError(f"the least number of units must be a whole number of at least 1, not {value!r}")
    return int(parsed)


def sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def strength(z: Column) -> Column:
    return F.least(F.abs(z), F.lit(8.0))


def weighted_effect(w: Column) -> Column:
    return F.try_divide(F.sum(w * F.col("lfc")), F.sum(F.when(F.col("lfc").isNotNull(), w)))


def concordant_share(total_z: Column, up: Column, down: Column) -> Column:
    """The share of strength that goes with the sign of total_z."""
    agreed = F.when(total_z > 0, up).when(total_z < 0, down).otherwise(0.0)
    return F.coalesce(F.try_divide(agreed, up + down), F.lit(0.0))


def up_down(w: Column | float = 1.0) -> list[Column]:
    z = F.col("signed_z")
    parts = [F.coalesce(F.sum(F.when(side, w * strength(z))), F.lit(0.0)) for side in (z > 0, z < 0)]
    return [parts[0].alias("up"), parts[1].alias("down")]


def stouffer(units: DataFrame, least: int = 2) -> DataFrame:
    """Per entity of at least `least` units: combined z, p (also in logs), effect, concordance, heterogeneity.

    units: as collapse gives them.
    """
    w, z = F.col("weight"), F.col("signed_z")
    grouped = units.groupBy("gene_symbol").agg(
        F.count("*").cast("int").alias("n_studies"),
        (F.sum(w * z) / F.sqrt(F.sum(w * w))).alias("stouffer_z"),
        (F.sum(w * z) / F.sum(w)).alias("mean_z"),
        weighted_effect(w).alias("weighted_lfc"),
        *up_down(),
        F.collect_list(F.struct(w.alias("w"), z.alias("z"))).alias("members"),
    )
    kept = grouped.filter(F.col("n_studies") >= least_units(least)).withColumn("__a", F.abs("stouffer_z"))
    q = F.aggregate("members", F.lit(0.0), lambda s, m: s + m["w"] * (m["z"] - F.col("mean_z")) * (m["z"] - F.col("mean_z")))
    kept = kept.withColumn("__log_p", F.least(F.lit(0.0), F.lit(math.log(2)) + log_sf("__a"))).withColumn("heterogeneity_q", q)
    df = F.col("n_studies") - 1
    return kept.select(
        "gene_symbol",
        "n_studies",
        "stouffer_z",
        F.exp("__log_p").alias("stouffer_p"),
        (-F.col("__log_p") / math.log(10) + 0.0).alias("stouffer_neglog10_p"),
        "weighted_lfc",
        concordant_share(F.col("stouffer_z"), F.col("up"), F.col("down")).alias("sign_concordance"),
        "heterogeneity_q",
        df.alias("heterogeneity_df"),
        F.when(F.col("heterogeneity_q") > 0, F.greatest(F.lit(0.0), (F.col("heterogeneity_q") - df) / F.col("heterogeneity_q"))).otherwise(0.0).alias("heterogeneity_i2"),
    )


def rank_product(units: DataFrame, least: int = 2) -> DataFrame:
    """Per entity: the geometric mean of its units' normalised ranks and minus its logarithm."""
    logs = F.log(F.least(F.greatest(F.col("normalized_rank"), F.lit(TINY)), F.lit(1.0)))
    grouped = units.groupBy("gene_symbol").agg(F.count("*").cast("int").alias("n_studies_rank"), F.avg(logs).alias("m"))
    return grouped.filter(F.col("n_studies_rank") >= least_units(least)).select("gene_symbol", "n_studies_rank", F.exp("m").alias("rank_product"), (-F.col("m") + 0.0).alias("rank_score"))


def consensus(harmonized: DataFrame, least: int = 2, units: DataFrame | None = None, ranked: bool = True) -> DataFrame:
    """Stouffer and rank product together with adjusted p and, if ranked, slice_rank by (padj, p, -log10 p descending, entity)."""
    units = settled(collapse(harmonized)) if units is None else units
    both = stouffer(units, least).join(rank_product(units, least), "gene_symbol", "left")
    adjusted = bh_adjust(both, "stouffer_p", "stouffer_padj")
    if not ranked:
        return adjusted
    # Ordering by p is ordering by padj, then p, where adjusted values tie; the log tells underflowed p apart.
    return global_rank(adjusted, -F.col("stouffer_neglog10_p"), [F.col("gene_symbol")], "slice_rank")
