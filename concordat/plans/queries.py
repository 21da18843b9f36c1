"""The integration queries over the bridge view, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.special import rounded
from concordat.operators import evidence as ev
from concordat.operators import harmonize as hz
from concordat.operators import lanes, stability
from concordat.operators import score as sc
from concordat.operators.consensus import consensus, rank_product, stouffer
from concordat.operators.ranking import bh_adjust
from concordat.operators.units import collapse, eligible_rows
from concordat.plans.bridge import bridge, tie_order
from concordat.plans.oracle import BH, MAIN, geometric, r6, sql
from concordat.store import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            # Beyond 8000 bytes HotSpot doesn't compile a method; Spark then splits the stage's code instead.
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return f(spark, sf)

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return register


def six(**columns: Column) -> list[Column]:
    return [rounded(c).alias(n) for n, c in columns.items()]


def harmonized(spark: SparkSession, sf: str) -> DataFrame:
    """The bridge's rows, harmonised and written: evidence and consensus read them several times."""
    return settled(hz.harmonize(bridge(spark, sf), tie_order(), check=False))


def _read_once(spark: SparkSession, sf: str) -> DataFrame:
    """The harmonised rows for evidence, which goes over them once: they needn't be written, and unread notes aren't joined."""
    carried = ("source_unit_id", "paper_id", "n_ctrl", "n_treat", "source_input_type", "time_course_mode", "duration_h")
    return hz.harmonize(bridge(spark, sf), tie_order(), check=False, carried=carried)


def scored(spark: SparkSession, sf: str, *columns: str, ablation: sc.Ablation | None = None) -> sc.Scored:
    """The score table with these columns. The bridge's studies have names and harmonising leaves no row without effect."""
    return sc.score(_read_once(spark, sf), 2, ablation, columns, same_rows=True)


def assessed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Evidence as lanes read it, and diagnostics."""
    return sc.assessed(_read_once(spark, sf), ())


@query(f"select gene_symbol, study_id, pvalue, pvalue < 1e-300 as clipped, {r6('signed_z')} as signed_z, n_source_rows from zed")
def signed_z(spark, sf):
    rows = hz.signed_z(hz.best_rows(hz.valid_rows(bridge(spark, sf)), tie_order()))
    return rows.select("gene_symbol", "study_id", "pvalue", F.col("pvalue_was_clipped").alias("clipped"), *six(signed_z=F.col("signed_z")), F.col("n_source_rows_for_gene").cast("bigint").alias("n_source_rows"))


@query("select study_id, gene_symbol, lfc, pvalue, padj, n_source_rows::bigint as n_source_rows from best")
def dedupe_best_row(spark, sf):
    return hz.best_rows(hz.valid_rows(bridge(spark, sf)), tie_order()).select("study_id", "gene_symbol", "lfc", "pvalue", "padj", F.col("n_source_rows_for_gene").cast("bigint").alias("n_source_rows"))


@query(f"select study_id, gene_symbol, case when signed_z is not null then average end as within_study_rank, {r6('normalized_rank', 9)} as normalized_rank, universe::bigint as universe from harm")
def normalized_rank_universe(spark, sf):
    return harmonized(spark, sf).select("study_id", "gene_symbol", "within_study_rank", rounded(F.col("normalized_rank"), 9).alias("normalized_rank"), F.col("rank_universe_size_used").cast("bigint").alias("universe"))


@query("""select study_id, "column", count(*) as n_bad, string_agg(printf('%.6f', v), ';' order by k) filter (k <= 5) as examples
from (select *, row_number() over (partition by study_id, "column" order by v) as k from (select study_id, 'pvalue' as "column", lfc as v from bridge union all select study_id, 'padj', padj * 3 from bridge) where v < 0 or v > 1) group by 1, 2""")
def unit_interval_violations(spark, sf):
    # The bridge's p-values are all valid, so its effects and tripled adjusted values stand in for bad columns.
    return hz.unit_interval_violations(bridge(spark, sf).select("study_id", F.col("lfc").alias("pvalue"), (F.col("padj") * 3).alias("padj")))


_REASON = """case when assessment = 'declared' then 'the catalog declares ' || declared when n_values = 0 then 'no numeric p-values to judge by'
  when assessment = 'full_results_likely' then 'many rows aren''t significant and values are high' when below / n_values >= 0.98 and most <= 0.05 then 'nearly all values are 0.05 or less'
  when assessment = 'deg_only_likely' then 'a short table of mostly significant rows' else 'nothing is clear: declare table_scope' end"""


@query(f"select study_id, declared as declared_scope, n_rows, value_column, n_values as n_numeric_values, below as n_le_0_05, above as n_gt_0_05, most as max_value, below / n_values as fraction_le_0_05, assessment, effective as effective_scope, {_REASON} as reason from scope")
def scope_assessment(spark, sf):
    return hz.assess_scope(bridge(spark, sf), F.col("table_scope"))


@query("""select study_id, 'auto' as declared_scope, case when n_gt >= greatest(100, floor(0.1 * n_rows)) and most >= 0.2 or n_rows >= 10000 and n_gt >= 100 and most >= 0.5 then 'full_results_likely'
    when share >= 0.98 and most <= 0.05 or n_rows < 5000 and share >= 0.95 and most <= 0.1 then 'deg_only_likely' else 'auto_ambiguous' end as assessment
  from (select study_id, count(*) as n_rows, count(*) filter (p > 0.05) as n_gt, avg((p <= 0.05)::int) as share, max(p) as most from (select study_id, case source_unit_id when 'N0' then pvalue * 0.04 when 'N1' then pvalue * 0.09 * (pvalue > 0.9)::int else pvalue end as p from bridge) group by 1)""")
def scope_without_padj(spark, sf):
    p, unit = F.col("pvalue"), F.col("source_unit_id")
    rows = bridge(spark, sf).withColumn("padj", F.lit(None).cast("double")).withColumn("pvalue", F.when(unit == "N0", p * 0.04).when(unit == "N1", p * 0.09 * (p > 0.9).cast("int")).otherwise(p))
    return hz.assess_scope(rows).select("study_id", "declared_scope", "assessment")


_UNIVERSE_NOTE = """case when declared_universe < observed then 'declared universe ' || declared_universe::bigint || ' is below the ' || observed || ' reported rows; observed rows are used'
  when declared_universe is not null then case when table_scope = 'deg_only' then 'list of significant rows: ranks use the declared universe, missing genes are unreported' else '' end
  when table_scope = 'deg_only' then 'list of significant rows without a declared universe; ranks use its length and may be optimistic'
  when table_scope = 'ambiguous' then 'table scope is ambiguous; ranks use observed rows, review the source' else '' end"""


@query(f"select distinct study_id, table_scope, n_genes::int as n_genes_in_study, assessment as table_scope_assessment, value_column as table_scope_value_column, n_source_table_rows as n_rows_in_source_table, observed as n_reported_rows_after_filter, below as n_scope_significant_rows_le_0_05, case when declared_universe is not null then greatest(declared_universe, observed) end as rank_universe_size_declared, {_UNIVERSE_NOTE} as rank_universe_warning from harm")
def effective_scope(spark, sf):
    names = ["study_id", "table_scope", "n_genes_in_study", *[c for c in hz.STUDY_NOTES if "collapse" not in c and c not in ("table_scope_reason", "rank_universe_size_used")]]
    return harmonized(spark, sf).select(*names).distinct()


@query("select study_id, max(n) as most_rows, round_even(sum(n) filter (n > 1) / sum(n) * 1e6, 0) / 1e6 as repeated_share, max(n) >= 3 and sum(n) filter (n > 1) / sum(n) >= 0.25 as looks_stacked from (select study_id, gene_symbol, count(*) as n from bridge group by 1, 2) group by 1")
def stacked_tables(spark, sf):
    return hz.stacked_tables(hz.valid_rows(bridge(spark, sf))).withColumn("repeated_share", rounded(F.coalesce("repeated_share", F.lit(0.0))))


_ASKED = "(['', 'Best-Probe', 'median expression', 'nan'])[substr(source_unit_id, 2)::int % 4 + 1]"


@query(f"""select study_id, case when most > 1 then 'min_pvalue_max_abs_lfc' else 'none' end as gene_symbol_collapse_rule, asked as requested_probe_collapse,
  case when most <= 1 then '' when asked = '' then case when unit % 3 = 0 then study_id || ': duplicate gene symbols were collapsed by min_pvalue_max_abs_lfc; declare probe_collapse if that is meant'
      when most >= 3 and share >= 0.25 then study_id || ': ' || (total - genes) || ' of ' || total || ' rows shared an entity (up to ' || most || ' rows each) and were collapsed by min_pvalue_max_abs_lfc, which selects on the outcome; keep one contrast of a stacked table' else '' end
    when asked = 'Best-Probe' then '' else study_id || ': probe_collapse=' || asked || ' was declared, but duplicates were left and collapsed by min_pvalue_max_abs_lfc' end as gene_symbol_collapse_warning
from (select study_id, any_value(substr(source_unit_id, 2)::int) as unit, any_value(case when asked = 'nan' then '' else asked end) as asked, max(n)::bigint as most, sum(n)::bigint as total, count(*) as genes, coalesce(sum(n) filter (n > 1), 0) / sum(n) as share
  from (select study_id, gene_symbol, any_value(source_unit_id) as source_unit_id, any_value({_ASKED}) as asked, count(*) as n from bridge group by 1, 2) group by 1)""")
def collapse_warnings(spark, sf):
    unit = F.substring("source_unit_id", 2, 9).cast("int")
    asked = F.get(F.array(*map(F.lit, ("", "Best-Probe", "median expression", "nan"))), unit % 4)
    rows = bridge(spark, sf).withColumn("probe_collapse", asked).withColumn("assay_type", F.when(unit % 3 == 0, "Microarray").otherwise("RNA-seq"))
    return hz.study_notes(rows, hz.best_rows(hz.valid_rows(rows), tie_order())).select("study_id", "gene_symbol_collapse_rule", "requested_probe_collapse", "gene_symbol_collapse_warning")


def _time_mode(mode: str):
    def run(spark, sf):
        rows = eligible_rows(harmonized(spark, sf)).filter(F.col("time_course_mode") == mode)
        return rows.select("gene_symbol", "source_unit_id", "study_id", *six(signed_z=F.col("signed_z")))

    return run


for _mode in ("early", "late", "peak_mean"):
    _f = _time_mode(_mode)
    _f.__name__ = f"time_mode_{_mode}"
    query(f"select gene_symbol, source_unit_id, study_id, {r6('signed_z')} as signed_z from elig where mode = '{_mode}'")(_f)


@query(f"select gene_symbol, source_unit_id, study_id, {r6('signed_z')} as signed_z, {r6('lfc')} as lfc, {r6('normalized_rank', 9)} as normalized_rank, {r6('weight')} as weight, n_genes_in_study, n_contrast_rows, n_studies_in_source_unit from units")
def collapse_units(spark, sf):
    rows = collapse(harmonized(spark, sf))
    return rows.withColumns({c: rounded(F.col(c)) for c in ("signed_z", "lfc", "weight")} | {"normalized_rank": rounded(F.col("normalized_rank"), 9)})


_STOUFFER = f"select gene_symbol, n_studies, {r6('z')} as stouffer_z, {r6('exp(log_p)', 9)} as stouffer_p, {r6('-log_p / ln(10e0)')} as stouffer_neglog10_p, {r6('weighted_lfc')} as weighted_lfc, {r6('sign_concordance')} as sign_concordance, {r6('heterogeneity_q')} as heterogeneity_q, n_studies - 1 as heterogeneity_df, {r6('heterogeneity_i2')} as heterogeneity_i2"


def _rounded_stouffer(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: rounded(F.col(c)) for c in ("stouffer_z", "stouffer_neglog10_p", "weighted_lfc", "sign_concordance", "heterogeneity_q", "heterogeneity_i2")} | {"stouffer_p": rounded(F.col("stouffer_p"), 9)})


@query(_STOUFFER + " from stouffer")
def stouffer_consensus(spark, sf):
    return _rounded_stouffer(stouffer(collapse(harmonized(spark, sf))))


@query(f"select gene_symbol, n_studies as n_studies_rank, {r6('rank_product', 9)} as rank_product, {r6('-ln(rank_product)')} as rank_score from sums")
def rank_product_consensus(spark, sf):
    rows = rank_product(collapse(harmonized(spark, sf)))
    return rows.withColumn("rank_product", rounded(F.col("rank_product"), 9)).withColumn("rank_score", rounded(F.col("rank_score")))


@query(_STOUFFER + f", n_studies as n_studies_rank, {r6('rank_product', 9)} as rank_product, {r6('-ln(rank_product)')} as rank_score, {r6('padj', 9)} as stouffer_padj, rn::int as slice_rank from consensus")
def slice_consensus(spark, sf):
    rows = _rounded_stouffer(consensus(harmonized(spark, sf)))
    return rows.withColumns({c: rounded(F.col(c), 9) for c in ("rank_product", "stouffer_padj")} | {"rank_score": rounded(F.col("rank_score"))})


@query("select gene_symbol, study_id, pvalue, round_even(adj * 1e9, 0) / 1e9 as adjusted from (select *, least(1.0, min(pvalue * n_all / rn) over (order by rn desc rows between unbounded preceding and current row)) as adj from (select *, row_number() over (order by pvalue, study_id, gene_symbol) as rn, count(*) over () as n_all from best))")
def bh_adjusted(spark, sf):
    rows = hz.best_rows(hz.valid_rows(bridge(spark, sf)), tie_order()).select("gene_symbol", "study_id", "pvalue")
    return bh_adjust(rows, "pvalue", "adjusted").withColumn("adjusted", rounded(F.col("adjusted"), 9))


@query("select source_unit_id, source_input_type, table_scope, pipeline from labels")
def unit_labels(spark, sf):
    return ev.evidence(harmonized(spark, sf)).select("source_unit_id", "source_input_type", "table_scope", "pipeline").distinct()


@query(f"select gene_symbol, source_unit_id, study_id, {r6('signed_z')} as signed_z, {r6('static_quality')} as source_quality_weight, min_p as min_source_pvalue, min_padj as min_source_padj, studies as contributing_study_ids, durations as duration_h, direction, n_ctrl, n_treat from evid0")
def gene_evidence(spark, sf):
    rows = ev.evidence(harmonized(spark, sf))
    return rows.select("gene_symbol", "source_unit_id", "study_id", *six(signed_z=F.col("signed_z"), source_quality_weight=F.col("source_quality_weight")), "min_source_pvalue", "min_source_padj", "contributing_study_ids", "duration_h", "direction", "n_ctrl", "n_treat")


@query(f"select source_a, source_b, overlap, {r6('rho')} as lfc_spearman, {r6('sign_agreement')} as sign_agreement from pairs")
def pairwise_spearman(spark, sf):
    return ev.pairwise(ev.evidence(harmonized(spark, sf))).withColumns({c: rounded(F.col(c)) for c in ("lfc_spearman", "sign_agreement")})


_LABEL = "case when {x} >= 0.85e0 then 'high' when {x} >= 0.6e0 then 'medium' else 'low' end"


@query(f"select source_unit_id, n_genes, comparisons as n_pairwise_comparisons, {r6('median_rho')} as median_pairwise_lfc_spearman, {r6('least_rho')} as min_pairwise_lfc_spearman, {r6('median_sign')} as median_pairwise_sign_agreement, {r6('quality')} as source_quality_weight, coherence as source_coherence_weight, {r6('recommended')} as source_recommended_weight, {r6('reliability')} as source_reliability_weight, odd as source_outlier_flag, {_LABEL.format(x='reliability')} as source_reliability_label, case when odd or quality < 0.6e0 then 'sensitivity' else 'primary' end as recommended_role from diag")
def source_diagnostics(spark, sf):
    rows = ev.diagnostics(settled(ev.evidence(harmonized(spark, sf))))
    numbers = ("median_pairwise_lfc_spearman", "min_pairwise_lfc_spearman", "median_pairwise_sign_agreement", "source_quality_weight", "source_recommended_weight", "source_reliability_weight")
    return rows.withColumns({c: rounded(F.col(c)) for c in numbers}).select("source_unit_id", "n_genes", "n_pairwise_comparisons", *numbers[:4], "source_coherence_weight", *numbers[4:], "source_outlier_flag", "source_reliability_label", "recommended_role")


@query(f"select gene_symbol, {r6('qz')} as quality_stouffer_z, {r6('qlfc')} as quality_weighted_lfc, {r6('wsum')} as source_quality_weight_sum, {r6('quality_support_score')} as quality_support_score, {r6('quality_direction_score')} as quality_sign_concordance, {r6(geometric(MAIN, 'quality_'))} as quality_score from qual")
def quality_consensus(spark, sf):
    rows, units = assessed(spark, sf)
    total = units.agg(F.sum("source_reliability_weight").alias("t")).scalar()
    found = lanes.quality_consensus(rows, total)
    return found.select("gene_symbol", *six(**{c: F.col(c) for c in ("quality_stouffer_z", "quality_weighted_lfc", "source_quality_weight_sum", "quality_support_score", "quality_sign_concordance", "quality_score")}))


@query(f"select gene_symbol, {r6('confidence')} as direction_confidence_index from confid")
def direction_confidence(spark, sf):
    rows, _ = assessed(spark, sf)
    return lanes.direction_confidence(rows, stouffer(rows), "stouffer_z", "c").select("gene_symbol", *six(direction_confidence_index=F.col("c")))


@query(f"select gene_symbol, {r6('re_z')} as re_stouffer_z, {r6('factor')} as re_stouffer_shrinkage_factor, {r6('re_p', 9)} as re_stouffer_p, {r6('adj', 9)} as re_stouffer_padj from (select *, {BH.format(p='re_p')} as adj from (select *, row_number() over (order by re_p, gene_symbol) as rn, count(*) over () as n_all from re))")
def re_stouffer(spark, sf):
    rows, _ = assessed(spark, sf)
    found = stouffer(rows).join(sc.support(rows), "gene_symbol")
    return lanes.random_effects(found).select("gene_symbol", *six(re_stouffer_z=F.col("re_stouffer_z"), re_stouffer_shrinkage_factor=F.col("re_stouffer_shrinkage_factor")), *[rounded(F.col(c), 9).alias(c) for c in ("re_stouffer_p", "re_stouffer_padj")])


@query(f"select gene_symbol, {r6('log_rho')} as log_rho, {r6('-log_rho / ln(10e0)')} as rra_neglog10_rho, row_number() over (order by {r6('log_rho')}, gene_symbol)::int as rra_rank from rra")
def rra_rho(spark, sf):
    rows, units = assessed(spark, sf)
    found = lanes.rank_aggregation(rows, units.count(), 2, digits=6)
    return found.select("gene_symbol", *six(log_rho=F.col("log_rho"), rra_neglog10_rho=F.col("rra_neglog10_rho")), "rra_rank")


@query(f"select gene_symbol, {r6('pooled')} as effect_meta_log2fc_re, {r6('se')} as effect_meta_se, {r6('pooled - t * se')} as effect_meta_ci_low, {r6('pooled + t * se')} as effect_meta_ci_high, {r6('tau2')} as effect_meta_tau2, {r6('i2')} as effect_meta_i2, k::int as effect_meta_k from pooled")
def effect_meta(spark, sf):
    rows, units = assessed(spark, sf)
    found = lanes.effect_meta(rows, units.count(), 2)
    return found.withColumns({c: rounded(F.col(c)) for c in found.columns if c not in ("gene_symbol", "effect_meta_k")})


@query("select fold, gene_symbol, fold_rank::int as fold_rank from fold_ranks")
def loo_folds(spark, sf):
    return stability.folds(*assessed(spark, sf))


@query(f"select gene_symbol, total as loo_total_folds, evaluable as loo_rank_evaluable_folds, total - evaluable as loo_penalty_folds, {r6('med', 3)} as loo_median_rank, {r6('iqr', 3)} as loo_rank_iqr, {r6('stability')} as loo_rank_stability_score, {r6('top50')} as loo_top50_fraction, {r6('top100')} as loo_top100_fraction from loo")
def loo_stability(spark, sf):
    names = [c for c in sc.LANES["loo"] if c != "loo_component_available"]
    return scored(spark, sf, *names).scores.select("gene_symbol", *names)


@query("select gene_symbol, evidence_reliability_score from reliable")
def reliability(spark, sf):
    return scored(spark, sf, "evidence_reliability_score").scores.select("gene_symbol", "evidence_reliability_score")


@query("select gene_symbol, n_source_units, source_units, composite_score, quality_score, priority_score, composite_rank::int as composite_rank, quality_rank::int as quality_rank, priority_rank::int as priority_rank, direction_confidence_index, quality_confidence as quality_direction_confidence_index, case when z > 0 then 'up' when z < 0 then 'down' else 'flat' end as consensus_direction, case when qz > 0 then 'up' when qz < 0 then 'down' else 'flat' end as quality_direction from ranked")
def gene_scores(spark, sf):
    names = ("n_source_units", "source_units", "composite_score", "quality_score", "priority_score", "composite_rank", "quality_rank", "priority_rank", "direction_confidence_index", "quality_direction_confidence_index", "consensus_direction", "quality_direction")
    return scored(spark, sf, *names).scores.select("gene_symbol", *names)


_TOP = "round_even(100e0 * quality_rank / n_scored * 1e6, 0) / 1e6"


@query(f"select gene_symbol, top as quality_top_percent, case when top <= 1 and n_source_units >= least(3, u) and quality_sign_concordance >= 0.9 then 'A' when top <= 5 and n_source_units >= least(2, u) and quality_sign_concordance >= 0.75 then 'B' when top <= 20 and n_source_units >= least(2, u) then 'C' else 'D' end as evidence_tier, case when heterogeneity_i2 >= 0.75 then 'high_context_dependent_review' when heterogeneity_i2 >= 0.5 then 'moderate_context_review' else 'low_or_unestimated' end as heterogeneity_flag, '#' || format('{{:,}}', quality_rank) || ' / ' || format('{{:,}}', n_scored) as rank_label, n_source_units >= least(2, u) and sign_concordance >= 0.75 and rank_score_component >= 0.8 and evidence_score >= 0.5 as high_confidence from (select *, {_TOP} as top, (select u from totals) as u from (select * replace ({r6('heterogeneity_i2')} as heterogeneity_i2) from ranked))")
def evidence_tiers(spark, sf):
    names = ("quality_top_percent", "evidence_tier", "heterogeneity_flag", "rank_label", "high_confidence")
    return scored(spark, sf, *names).scores.select("gene_symbol", *names)


@query(f"select gene_symbol, {r6('sum(weight * signed_z) / sqrt(sum(weight * weight))')} as quality_stouffer_z from evid group by 1 having count(*) >= 2")
def ablation_no_quality(spark, sf):
    rows = scored(spark, sf, "n_source_units", "quality_stouffer_z", ablation=sc.Ablation(source_quality=False)).scores
    return rows.filter("n_source_units >= 2").select("gene_symbol", "quality_stouffer_z").withColumn("quality_stouffer_z", rounded(F.col("quality_stouffer_z")))


def _ablated(spark: SparkSession, sf: str, ablation: sc.Ablation) -> DataFrame:
    """The quality lane alone: the other lanes don't feel these ablations."""
    return sc.quality(*sc.ablated(*assessed(spark, sf), ablation), ablation)


@query(f"select gene_symbol, {r6('sum(e * signed_z) / sqrt(sum(e * e))')} as quality_stouffer_z from (select *, greatest(reliability, 0.05) as e from evid) group by 1")
def ablation_no_sample_size(spark, sf):
    return _ablated(spark, sf, sc.Ablation(sample_size=False)).select("gene_symbol", rounded(F.col("quality_stouffer_z")).alias("quality_stouffer_z"))


_SOME = {"support_score": 0.30, "evidence_score": 0.20}


@query(f"select gene_symbol, {r6(geometric(_SOME, 'quality_'))} as quality_score from qual")
def ablation_components(spark, sf):
    return _ablated(spark, sf, sc.Ablation(components=tuple(_SOME))).select("gene_symbol", rounded(F.col("quality_score")).alias("quality_score"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The entities with the strongest combined evidence first."""
    return consensus(harmonized(spark, sf)).orderBy("slice_rank")
