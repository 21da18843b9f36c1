"""The score table: every lane of every entity, its ranks, tiers and labels."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.special import rounded
from concordat.operators import evidence as ev
from concordat.operators import lanes
from concordat.operators.consensus import consensus, least_units, rank_product, stouffer
from concordat.operators.evidence import clipped
from concordat.operators.ranking import global_rank
from concordat.operators.stability import folds, stability
from concordat.operators.units import collapse
from concordat.store import settled


@dataclass(frozen=True)
class Ablation:
    """What to leave out of the quality lane: all components but some, source quality, sample sizes."""

    components: tuple[str, ...] | None = None
    source_quality: bool = True
    sample_size: bool = True
    weights: dict[str, float] | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        if self.components is not None:
            unknown = [c for c in self.components if c not in lanes.MAIN]
            if unknown or not self.components:
                raise ValueError(f"components must be some of {list(lanes.MAIN)}, not {self.components}")
            object.__setattr__(self, "weights", {c: lanes.MAIN[c] for c in lanes.MAIN if c in self.components})


@dataclass(frozen=True)
class Scored:
    scores: DataFrame
    evidence: DataFrame
    diagnostics: DataFrame
    n_units: int


def tier(top_percent: Column, units: Column, concordance: Column, n_units: int) -> Column:
    strong, some = max(1, min(3, n_units)), max(1, min(2, n_units))
    return F.when((top_percent <= 1) & (units >= strong) & (concordance >= 0.9), "A").when((top_percent <= 5) & (units >= some) & (concordance >= 0.75), "B").when((top_percent <= 20) & (units >= some), "C").otherwise("D")


def heterogeneity_flag(i2: Column) -> Column:
    return F.when(i2 >= 0.75, "high_context_dependent_review").when(i2 >= 0.5, "moderate_context_review").otherwise("low_or_unestimated")


def percent_label(top: Column) -> Column:
    return F.when(top < 0.01, F.format_string("top %.4f%%", top)).when(top < 1, F.format_string("top %.3f%%", top)).otherwise(F.format_string("top %.2f%%", top))


def assessed(harmonized: DataFrame, columns: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(evidence with diagnostics attached, diagnostics). columns: what the caller reads of evidence, see there.

    harmonized is read once, and one table with a row for each entity and unit is written; what depends on the unit alone is
    joined to it when it is read.
    """
    bare = ev.evidence(ev.capped_effects(harmonized), columns)
    units = settled(ev.diagnostics(bare))
    return ev.attach(bare, units), units


def support(rows: DataFrame) -> DataFrame:
    """Per entity: its units, and the distinct contrasts behind them, where rows tell them. rows: one for each entity and unit."""
    found = [F.count("source_unit_id").cast("int").alias("n_source_units"), F.array_join(F.array_sort(F.collect_set("source_unit_id")), ";").alias("source_units")]
    if "contributing_study_ids" in rows.columns:
        found.insert(0, F.size(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split("contributing_study_ids", ";"))), lambda x: F.trim(x) != ""))).alias("n_contrasts_observed"))
    return rows.groupBy("gene_symbol").agg(*found)


def components(found: DataFrame, n_units: int) -> DataFrame:
    """The five components of the main lane and its two scores. found: consensus joined to support."""
    denominator = F.log1p(F.lit(float(n_units))) if n_units > 1 else F.lit(1.0)
    out = found.withColumns({
        "support_score": clipped(F.log1p(F.col("n_source_units").cast("double")) / denominator, 0.0),
        "direction_score": clipped(F.coalesce("sign_concordance", F.lit(0.0)), 0.0),
        "evidence_score": lanes.from_z(F.col("stouffer_z")),
        "rank_score_component": clipped(1 - F.coalesce("rank_product", F.lit(1.0)), 0.0),
        "effect_score": lanes.from_effect(F.col("weighted_lfc")),
    })
    return out.withColumn("composite_score", lanes.geometric(lanes.MAIN)).withColumn("priority_score", lanes.geometric(lanes.PRIORITY))


def reliability_score() -> Column:
    """Over the parts that are there: stability takes part only where a fold could be ranked."""
    without = {k: v for k, v in lanes.RELIABILITY.items() if k != "loo_rank_stability_score"}
    return F.when(F.col("loo_rank_stability_score").isNotNull(), lanes.geometric(lanes.RELIABILITY)).otherwise(lanes.geometric(without))


#: What a lane adds to the score table. A score table of some columns computes the lanes that these need.
LANES = {
    "re": ("re_stouffer_z", "re_stouffer_shrinkage_factor", "re_stouffer_p", "re_stouffer_padj"),
    "rra": ("rra_rho", "rra_neglog10_rho", "rra_rank"),
    "meta": ("effect_meta_log2fc_re", "effect_meta_se", "effect_meta_ci_low", "effect_meta_ci_high", "effect_meta_tau2", "effect_meta_i2", "effect_meta_k"),
    "loo": ("loo_total_folds", "loo_rank_evaluable_folds", "loo_penalty_folds", "loo_component_available", "loo_median_rank", "loo_rank_iqr", "loo_rank_stability_score", "loo_top50_fraction", "loo_top100_fraction"),
    "padj": ("stouffer_padj",),
    "contrasts": ("n_contrasts_observed",),
}
#: What columns of the score table are made of, where that isn't themselves.
MADE_OF = {
    "evidence_reliability_score": (*lanes.RELIABILITY, "loo_rank_stability_score"),
    "composite_rank": ("composite_score", "n_source_units", "sign_concordance"),
    "quality_rank": ("quality_score", "n_source_units", "quality_sign_concordance"),
    "priority_rank": ("priority_score", "n_source_units", "direction_confidence_index"),
    **{c: ("priority_rank",) for c in LANES["loo"]},
    **{c: ("stouffer_z", "heterogeneity_i2", "n_source_units") for c in LANES["re"]},
    "high_confidence": ("n_source_units", "sign_concordance", "rank_score_component", "evidence_score"),
    **{c: ("quality_rank",) for c in ("rank_label", "quality_top_percent", "top_percent_label")},
    "top_percent": ("composite_rank",),
    "percentile": ("composite_rank",),
    "priority_top_percent": ("priority_rank",),
    "support_label": ("n_source_units",),
    "direction_label": ("quality_sign_concordance", "quality_direction"),
    "evidence_tier": ("quality_top_percent", "n_source_units", "quality_sign_concordance"),
    "heterogeneity_flag": ("heterogeneity_i2",),
}


def needed(columns: Collection[str]) -> set[str]:
    """columns and all that they are made of."""
    found, left = set(), ["gene_symbol", *columns]
    while left:
        c = left.pop()
        if c not in found:
            found.add(c)
            left += MADE_OF.get(c, ())
    return found


def complete(harmonized: DataFrame) -> bool:
    """Whether evidence has all rows that consensus keeps, so that units needn't be collapsed once more."""
    return harmonized.filter(f"signed_z is not null and normalized_rank is not null and study_id is not null and not coalesce({ev.PRESENT}, false)").isEmpty()


def score(harmonized: DataFrame, least: int = 2, ablation: Ablation | None = None, columns: Collection[str] | None = None, same_rows: bool | None = None) -> Scored:
    """All lanes of all entities with at least `least` source units.

    columns: the score columns that are wanted, if not all: lanes and ranks that none of them needs aren't computed. All
    entities are scored in any case. same_rows: what complete() says, where the caller knows.
    """
    least, ablation = least_units(least), ablation or Ablation()
    wanted = None if columns is None else needed(columns)
    asked = lambda *names: wanted is None or not wanted.isdisjoint(names)
    kept = lambda df, *more: df if wanted is None else df.select([c for c in df.columns if c in wanted or c in more])
    capped = ev.capped_effects(harmonized)
    bare, units = assessed(harmonized, None if wanted is None else LANES["contrasts"] if asked(*LANES["contrasts"]) else ())
    rows, units = ablated(bare, units, ablation)
    n_units = units.count()
    # Consensus doesn't feel ablations. It keeps rows without effect, which evidence drops: where there are none, units are the same.
    own = bare if (complete(harmonized) if same_rows is None else same_rows) else settled(collapse(capped))
    found = consensus(capped, least, own, ranked=False) if asked(*LANES["padj"]) else stouffer(own, least).join(rank_product(own, least), "gene_symbol", "left")
    found = found.join(support(rows), "gene_symbol", "left")
    found = found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_source_units", "n_contrasts_observed") if c in found.columns})
    found = components(found, n_units)
    zeros = {c: F.coalesce(c, F.lit(0.0)) for c in ("quality_score", "quality_stouffer_z", "quality_sign_concordance", "source_quality_support_score", "source_quality_weight_sum", *[f"quality_{c}" for c in lanes.MAIN])}
    found = found.join(quality(rows, units, ablation), "gene_symbol", "left").withColumns(zeros).withColumn("quality_direction", F.coalesce("quality_direction", F.lit("flat")))
    confident = ("direction_confidence_index", "quality_direction_confidence_index", "direction_agreed_units", "direction_all_units")
    if asked(*confident):
        found = found.join(lanes.sides(rows), "gene_symbol", "left")
        plain, weighed = (lanes.agreement(F.col(z), *[F.coalesce(c, F.lit(0.0)) for c in both]) for z, both in (("stouffer_z", ("__up", "__down")), ("quality_stouffer_z", ("__up_weight", "__down_weight"))))
        found = found.withColumns(dict(zip(confident, (rounded(plain[2]), rounded(weighed[2]), rounded(plain[0], 3), rounded(plain[1], 3))))).drop("__up", "__down", "__up_weight", "__down_weight")
    up_or_down = F.when(F.col("stouffer_z") > 0, "up").when(F.col("stouffer_z") < 0, "down").otherwise("flat")
    found = settled(kept(found.withColumns({"consensus_direction": up_or_down, "priority_score": rounded(F.col("priority_score"))})))
    n = found.count()
    if asked(*LANES["re"]):
        found = lanes.random_effects(found)
    if asked(*LANES["rra"]):
        found = found.join(lanes.rank_aggregation(rows, n_units, least), "gene_symbol", "left")
    if asked(*LANES["meta"]):
        found = found.join(lanes.effect_meta(rows, n_units, least), "gene_symbol", "left")
    if asked("priority_rank"):
        # A ranking reads its rows twice (their order is sampled first), so what is dear to compute is written before.
        found = settled(found) if asked(*LANES["re"], *LANES["rra"], *LANES["meta"]) else found
        found = global_rank(found, F.col("priority_score"), [F.desc("n_source_units"), F.desc("direction_confidence_index"), F.col("gene_symbol")], "priority_rank", descending=True)
    if asked(*LANES["loo"]):
        found = settled(found)
        loo = stability(folds(rows, units, least), found, n_units, n)
        found = found.join(loo, "gene_symbol", "left")
    if asked("evidence_reliability_score"):
        found = found.withColumn("evidence_reliability_score", rounded(reliability_score()))
    found = found.withColumns({c: rounded(F.col(c)) for c in ("composite_score", "quality_score", "quality_sign_concordance") if c in found.columns})
    if asked("composite_rank"):
        found = global_rank(found, F.col("composite_score"), [F.desc("n_source_units"), F.desc("sign_concordance"), F.col("gene_symbol")], "composite_rank", descending=True)
    if asked("quality_rank"):
        found = global_rank(found, F.col("quality_score"), [F.desc("n_source_units"), F.desc("quality_sign_concordance"), F.col("gene_symbol")], "quality_rank", descending=True)
    return Scored(labelled(found, n, n_units, wanted), rows, units, n_units)


def ablated(rows: DataFrame, units: DataFrame, ablation: Ablation) -> tuple[DataFrame, DataFrame]:
    """Evidence and diagnostics without what the ablation leaves out."""
    if not ablation.source_quality:
        names = ["source_quality_weight", "source_coherence_weight", "source_recommended_weight", "source_reliability_weight"]
        rows, units = (df.withColumns({c: F.lit(1.0) for c in names}) for df in (rows, units))
    return (rows if ablation.sample_size else rows.withColumn("weight", F.lit(1.0))), units


def quality(rows: DataFrame, units: DataFrame, ablation: Ablation) -> DataFrame:
    """The quality lane of ablated evidence."""
    total = units.agg(F.sum("source_reliability_weight")).first()[0] or 0.0  # one number
    return lanes.quality_consensus(rows, F.lit(float(total)), ablation.weights).drop("quality_weighted_lfc")


def labelled(found: DataFrame, n: int, n_units: int, wanted: set[str] | None = None) -> DataFrame:
    """Percentiles, tiers, labels and published rounding. wanted: columns to make, if not all."""
    take = lambda made: {c: x for c, x in made.items() if wanted is None or c in wanted}
    share = lambda c: rounded(100.0 * F.col(c) / max(n, 1))
    out = found.withColumns(take({
        "high_confidence": (F.col("n_source_units") >= max(1, min(2, n_units))) & (F.col("sign_concordance") >= 0.75) & (F.col("rank_score_component") >= 0.8) & (F.col("evidence_score") >= 0.5),
        "rank_label": F.concat(F.lit("#"), F.format_number("quality_rank", 0), F.lit(" / "), F.format_number(F.lit(n), 0)),
        "top_percent": share("composite_rank"),
        "priority_top_percent": share("priority_rank"),
        "quality_top_percent": share("quality_rank"),
        "percentile": rounded(100.0 * (1 - (F.col("composite_rank") - 1) / max(n, 1))),
        "support_label": F.concat(F.format_number("n_source_units", 0), F.lit(f" / {n_units:,} source units")),
        "direction_label": F.concat(F.format_string("%.1f%%", F.col("quality_sign_concordance") * 100), F.lit(" "), F.col("quality_direction"), F.lit("-concordant")),
        "heterogeneity_i2": rounded(F.coalesce("heterogeneity_i2", F.lit(0.0))),
    }))
    out = out.withColumns(take({"top_percent_label": percent_label(F.col("quality_top_percent")), "evidence_tier": tier(F.col("quality_top_percent"), F.col("n_source_units"), F.col("quality_sign_concordance"), n_units), "heterogeneity_flag": heterogeneity_flag(F.col("heterogeneity_i2"))}))
    six = ("heterogeneity_q", "re_stouffer_z", "re_stouffer_shrinkage_factor", "rra_neglog10_rho", "source_quality_support_score", "source_quality_weight_sum", "effect_meta_log2fc_re", "effect_meta_se", "effect_meta_ci_low", "effect_meta_ci_high", "effect_meta_tau2", "effect_meta_i2", "loo_rank_stability_score", "loo_top50_fraction", "loo_top100_fraction")
    out = out.withColumns(take({c: rounded(F.col(c)) for c in six} | {c: rounded(F.col(c), 3) for c in ("loo_median_rank", "loo_rank_iqr")}))
    defaults = {"rra_rho": 1.0, "re_stouffer_p": 1.0, "re_stouffer_padj": 1.0}
    out = out.withColumns(take({c: rounded(F.coalesce(c, F.lit(v)), 12) for c, v in defaults.items()}))
    return out.withColumns(take({"rra_rank": F.coalesce("rra_rank", F.lit(0)), "rra_neglog10_rho": F.coalesce("rra_neglog10_rho", F.lit(0.0)), "effect_meta_k": F.coalesce("effect_meta_k", F.lit(0))})).drop("log_rho")


def primary_order(scores: DataFrame) -> DataFrame:
    """Scores in the order of the quality rank; rows without a rank come last."""
    rank = F.when(F.col("quality_rank") > 0, F.col("quality_rank"))
    return scores.orderBy(rank.asc_nulls_last(), "gene_symbol")


def significance_warning(scores: DataFrame, limit: float = 0.05) -> DataFrame:
    """Whether no entity at all is significant after adjustment."""
    return scores.agg(F.min("stouffer_padj").alias("least_padj")).withColumn("none_significant", F.coalesce(F.col("least_padj") > limit, F.lit(True)))
