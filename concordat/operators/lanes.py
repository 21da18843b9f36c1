"""Scoring lanes over evidence: quality-weighted consensus, direction confidence, random effects, rank aggregation, effect
meta-analysis. Each is one groupBy on the entity and column expressions; per-entity arrays are bounded by the units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.special import log_beta_cdf, log_sf, rounded, t_quantile
from concordat.functions.text import literal_map
from concordat.operators.consensus import TINY, concordant_share, least_units, sign, up_down, weighted_effect
from concordat.operators.evidence import clipped
from concordat.operators.ranking import bh_adjust, global_rank
from concordat.store import settled

# Component weights.
MAIN = {"support_score": 0.30, "direction_score": 0.25, "evidence_score": 0.20, "rank_score_component": 0.15, "effect_score": 0.10}
PRIORITY = {"direction_score": 0.25, "evidence_score": 0.30, "rank_score_component": 0.30, "effect_score": 0.15}
RELIABILITY = {"support_score": 0.25, "source_quality_support_score": 0.25, "direction_confidence_index": 0.25, "loo_rank_stability_score": 0.25}


def from_z(z: Column) -> Column:
    return clipped(1 - F.exp(-F.abs(F.coalesce(z, F.lit(0.0))) / 8), 0.0)


def from_effect(lfc: Column) -> Column:
    return clipped(1 - F.exp(-F.abs(F.coalesce(lfc, F.lit(0.0))) / 2), 0.0)


def geometric(weights: dict[str, float], prefix: str = "") -> Column:
    """100 times the weighted geometric mean of components, each at least 1e-6. Weights are normalised."""
    total = sum(weights.values())
    logs = [w * F.log(clipped(F.col(prefix + c), 1e-6)) for c, w in weights.items()]
    return 100 * F.exp(reduce(lambda a, b: a + b, logs) / total)


def quality_consensus(rows: DataFrame, total_reliability: Column, weights: dict[str, float] | None = None) -> DataFrame:
    """The lane that weighs units by sample size times reliability. total_reliability: the sum over all units."""
    kept = rows.filter("signed_z is not null and normalized_rank is not null and weight is not null and source_reliability_weight is not null")
    e = F.greatest(F.col("weight") * F.col("source_reliability_weight"), F.lit(0.05))
    log_rank = F.log(F.least(F.greatest(F.col("normalized_rank"), F.lit(TINY)), F.lit(1.0)))
    z = F.col("signed_z")
    grouped = kept.groupBy("gene_symbol").agg(
        (F.sum(e * z) / F.sqrt(F.sum(e * e))).alias("quality_stouffer_z"),
        weighted_effect(e).alias("quality_weighted_lfc"),
        F.exp(F.sum(e * log_rank) / F.sum(e)).alias("quality_rank_product"),
        F.sum(F.greatest("source_reliability_weight", F.lit(0.05))).alias("source_quality_weight_sum"),
        *up_down(e),
    )
    denominator = F.when(total_reliability > 0, F.log1p(total_reliability)).otherwise(1.0)
    q = F.col("quality_stouffer_z")
    out = grouped.withColumns({
        "source_quality_support_score": clipped(F.log1p("source_quality_weight_sum") / denominator, 0.0),
        "quality_evidence_score": from_z(q),
        "quality_rank_score_component": clipped(1 - F.col("quality_rank_product"), 0.0),
        "quality_effect_score": from_effect(F.col("quality_weighted_lfc")),
        "quality_direction": F.when(q > 0, "up").when(q < 0, "down").otherwise("flat"),
        "quality_sign_concordance": concordant_share(q, F.col("up"), F.col("down")),
    })
    out = out.withColumn("quality_direction_score", F.col("quality_sign_concordance")).withColumn("quality_support_score", F.col("source_quality_support_score"))
    return out.withColumn("quality_score", geometric(weights or MAIN, "quality_")).drop("up", "down", "quality_rank_product")


def sides(rows: DataFrame) -> DataFrame:
    """Per entity: units with a sign on each side (__up, __down), and their reliability (__up_weight, __down_weight)."""
    z, w = F.col("signed_z"), F.greatest(F.coalesce("source_reliability_weight", F.lit(1.0)), F.lit(0.05))
    parts = {"__up": (z > 0, F.lit(1.0)), "__down": (z < 0, F.lit(1.0)), "__up_weight": (z > 0, w), "__down_weight": (z < 0, w)}
    return rows.groupBy("gene_symbol").agg(*[F.coalesce(F.sum(F.when(side, x)), F.lit(0.0)).alias(n) for n, (side, x) in parts.items()])


def agreement(z: Column, up: Column, down: Column) -> tuple[Column, Column, Column]:
    """(agreeing, all, confidence) of an entity's sides against the sign of z; a z of 0 counts halves. See direction_confidence."""
    agreed, every = F.when(z > 0, up).when(z < 0, down).otherwise(0.5 * (up + down)), up + down
    return agreed, every, (1 + agreed) / (2 + every)


def direction_confidence(rows: DataFrame, reference: DataFrame, z: str, name: str, by_reliability: bool = False) -> DataFrame:
    """(1 + agreeing) / (2 + all) units with a sign, against the sign of reference.z; a reference of 0 counts halves.

    reference: (gene_symbol, z), one row for each entity.
    """
    w = F.greatest(F.coalesce("source_reliability_weight", F.lit(1.0)), F.lit(0.05)) if by_reliability else F.lit(1.0)
    sides = rows.filter(sign(F.col("signed_z")) != 0).groupBy("gene_symbol").agg(*[F.coalesce(F.sum(F.when(side, w)), F.lit(0.0)).alias(n) for n, side in (("up", F.col("signed_z") > 0), ("down", F.col("signed_z") < 0))])
    agreed = F.when(F.col(z) > 0, F.col("up")).when(F.col(z) < 0, F.col("down")).otherwise(0.5 * (F.col("up") + F.col("down")))
    both = sides.join(reference.select("gene_symbol", z), "gene_symbol").select("gene_symbol", agreed.alias(f"{name}_agreed"), (F.col("up") + F.col("down")).alias(f"{name}_all"))
    return both.withColumn(name, (1 + F.col(f"{name}_agreed")) / (2 + F.col(f"{name}_all")))


def random_effects(scores: DataFrame) -> DataFrame:
    """scores (stouffer_z, heterogeneity_i2, n_source_units) with the shrunk z, its p and adjusted p."""
    factor = F.sqrt(1 + clipped(F.coalesce("heterogeneity_i2", F.lit(0.0)), 0.0) * F.greatest(F.col("n_source_units") - 1, F.lit(0)))
    held = scores.withColumn("re_stouffer_shrinkage_factor", factor).withColumn("re_stouffer_z", F.coalesce("stouffer_z", F.lit(0.0)) / factor)
    held = held.withColumn("__a", F.abs("re_stouffer_z")).withColumn("re_stouffer_p", F.least(F.lit(1.0), 2 * F.exp(log_sf("__a")))).drop("__a")
    return bh_adjust(held, "re_stouffer_p", "re_stouffer_padj")


def rank_aggregation(rows: DataFrame, n_units: int, least: int = 2, digits: int | None = None) -> DataFrame:
    """Robust rank aggregation: the least log Beta probability of an entity's ordered ranks among n_units lists.

    digits: rra_rank goes by log_rho at so many decimals, as it is published, and entities that tie there go by name.
    """
    grouped = rows.filter("normalized_rank is not null").groupBy("gene_symbol").agg(F.array_sort(F.collect_list(clipped(F.col("normalized_rank"), 0.0))).alias("ranks"))
    kept = grouped.filter(F.size("ranks") >= least_units(least))
    logs = F.transform("ranks", lambda r, k: log_beta_cdf(F.greatest(r, F.lit(TINY)), k + 1, n_units))
    out = kept.select("gene_symbol", F.array_min(F.slice(logs, 1, n_units)).alias("log_rho"))
    out = out.withColumn("rra_rho", clipped(F.exp("log_rho"), 0.0)).withColumn("rra_neglog10_rho", F.greatest(F.lit(0.0), -F.col("log_rho") / F.log(F.lit(10.0))) + 0.0)
    # A ranking reads its rows twice (their order is sampled first), and the tails are dear to compute.
    return global_rank(settled(out), F.col("log_rho") if digits is None else rounded(F.col("log_rho"), digits), [F.col("gene_symbol")], "rra_rank")


def effect_meta(rows: DataFrame, most_units: int, least: int = 2) -> DataFrame:
    """DerSimonian-Laird pooled effects with a truncated Hartung-Knapp interval; errors come from effect over z."""
    least = least_units(least)
    se = F.abs("lfc") / F.abs("signed_z")
    usable = rows.filter("lfc is not null and signed_z is not null and signed_z <> 0 and lfc <> 0")
    each = usable.select("gene_symbol", F.col("lfc").alias("y"), (se * se).alias("v")).filter((F.col("v") > 0) & (F.col("v") < float("inf")))
    grouped = each.groupBy("gene_symbol").agg(F.count("*").cast("int").alias("k"), F.collect_list(F.struct("y", "v")).alias("m")).filter(F.col("k") >= least)
    total = lambda f: F.aggregate("m", F.lit(0.0), lambda s, x: s + f(x))
    w = lambda x: 1 / x["v"]
    held = grouped.withColumn("sw", total(w)).filter("sw > 1e-15 and sw < double('infinity')").withColumn("fixed", total(lambda x: w(x) * x["y"]) / F.col("sw"))
    held = held.withColumn("q", total(lambda x: w(x) * (x["y"] - F.col("fixed")) * (x["y"] - F.col("fixed")))).withColumn("c", F.col("sw") - total(lambda x: w(x) * w(x)) / F.col("sw"))
    df = F.col("k") - 1
    held = held.withColumn("tau2", F.when((F.col("c") > 0) & (df > 0), F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("c"))).otherwise(0.0))
    wr = lambda x: 1 / (x["v"] + F.col("tau2"))
    held = held.withColumn("swr", total(wr)).filter("swr > 1e-15").withColumn("pooled", total(lambda x: wr(x) * x["y"]) / F.col("swr"))
    spread = total(lambda x: wr(x) * (x["y"] - F.col("pooled")) * (x["y"] - F.col("pooled"))) / (df * F.col("swr"))
    held = held.withColumn("se", F.when(df >= 1, F.greatest(F.sqrt(F.when(df >= 1, spread)), F.sqrt(1 / F.col("swr")))).otherwise(F.sqrt(1 / F.col("swr"))))
    critical = F.coalesce(F.try_element_at(literal_map({k: t_quantile(k) for k in range(1, max(2, most_units + 1))}), df), F.lit(1.96))
    return held.select(
        "gene_symbol",
        F.col("pooled").alias("effect_meta_log2fc_re"),
        F.col("se").alias("effect_meta_se"),
        (F.col("pooled") - critical * F.col("se")).alias("effect_meta_ci_low"),
        (F.col("pooled") + critical * F.col("se")).alias("effect_meta_ci_high"),
        F.col("tau2").alias("effect_meta_tau2"),
        F.when((F.col("q") > 0) & (df > 0), F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q"))).otherwise(0.0).alias("effect_meta_i2"),
        F.col("k").alias("effect_meta_k"),
    )

