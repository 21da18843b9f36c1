import math
from statistics import NormalDist

import numpy as np
import pytest
from concordat.functions import special
from concordat.operators import evidence as ev
from concordat.operators import lanes
from concordat.operators.consensus import consensus, least_units, rank_product, stouffer
from concordat.operators.score import Ablation, primary_order, score
from concordat.operators.stability import folds
from concordat.operators.units import collapse
from pyspark.sql import functions as F

COLUMNS = "study_id string, paper_id string, gene_symbol string, lfc double, signed_z double, pvalue double, padj double, normalized_rank double, n_ctrl double, n_treat double, n_genes_in_study int, pipeline string, source_input_type string, duration_h string, time_course_mode string"


def frame(spark, rows):
    """rows: (study, paper, entity, lfc, z, p, rank, n) with defaults for the rest."""
    full = [(s, p, g, y, z, pv, pv, r, float(n), float(n), 1000, "pipe", "author_deg_table", "24", "mean") for s, p, g, y, z, pv, r, n in rows]
    return spark.createDataFrame(full, COLUMNS)


def golden(spark):
    return frame(spark, [
        ("S1", "P1", "VEGFA", 2.4, 6.0, 1e-8, 0.02, 3), ("S2", "P1", "VEGFA", 2.0, 5.0, 1e-7, 0.03, 3), ("S3", "P2", "VEGFA", 1.8, 4.5, 1e-6, 0.04, 4),
        ("S1", "P1", "RPL13A", 0.2, 0.2, 0.8, 0.8, 3), ("S2", "P1", "RPL13A", -0.2, -0.2, 0.7, 0.7, 3), ("S3", "P2", "RPL13A", 0.1, 0.1, 0.9, 0.9, 4),
        ("S1", "P1", "HK2", 2.1, 4.0, 1e-5, 0.06, 3), ("S3", "P2", "HK2", 1.9, 3.8, 2e-5, 0.05, 4),
    ])


def test_golden_scores(spark):
    got = score(golden(spark)).scores
    row = got.filter("gene_symbol = 'VEGFA'").first()
    assert round(row.evidence_score, 6) == 0.583257 and round(row.rank_score_component, 6) == 0.968377 and round(row.effect_score, 6) == 0.629470
    assert row.composite_score == pytest.approx(85.305316, abs=1e-6) and row.quality_score == pytest.approx(85.298205, abs=1e-6)
    assert (row.loo_total_folds, row.loo_rank_evaluable_folds, row.loo_penalty_folds, row.loo_component_available) == (2, 0, 2, False)
    assert row.loo_median_rank is None and row.loo_rank_stability_score is None
    assert primary_order(got).first().gene_symbol == "VEGFA"


@pytest.mark.parametrize("p", [5e-301, 1e-100, 1e-12, 1e-5, 0.01, 0.1, 0.3, 0.5])
def test_normal_quantile(spark, p):
    got = spark.range(1).select(F.lit(p).alias("q")).select(special.isf("q")).first()[0]
    assert got == pytest.approx(NormalDist().inv_cdf(p) * -1, rel=1e-14, abs=1e-15)


def test_normal_log_survival(spark):
    zs = [0.0, 0.1, 0.5, 0.7, 1.0, 2.0, 5.0, 5.7, 8.0, 20.0, 37.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(special.log_sf("z")).collect()]
    for z, x in zip(zs, got):
        assert x == pytest.approx(math.log(math.erfc(z / math.sqrt(2)) / 2), rel=1e-13)
    far = spark.createDataFrame([(1e3,)], "z double").select(special.log_sf("z")).first()[0]
    assert far == pytest.approx(-500007.8266948121, rel=1e-12)


def test_beta_tail_and_t(spark):
    rows = [(0.2, 2), (0.5, 1), (1.0, 3), (1e-300, 5), (0.999, 5)]
    got = [math.exp(r[0]) for r in spark.createDataFrame(rows, "x double, k int").select(special.log_beta_cdf(F.col("x"), F.col("k"), 5)).collect()]
    want = [sum(math.comb(5, j) * x**j * (1 - x) ** (5 - j) for j in range(k, 6)) for x, k in rows]
    assert got == pytest.approx(want, rel=1e-12, abs=0)
    assert special.t_quantile(1) == pytest.approx(12.7062047364, rel=1e-9) and special.t_quantile(10) == pytest.approx(2.22813885196, rel=1e-9)
    assert special.t_two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.0733880348, rel=1e-8)


def test_one_source_is_not_two(spark):
    rows = frame(spark, [("S1", "P1", "A", 1.0, 3.0, 1e-3, 0.1, 3), ("S2", "P1", "A", 1.0, 3.0, 1e-3, 0.1, 3), ("S1", "P1", "B", 1.0, 2.0, 1e-2, 0.2, 3), ("S3", "P2", "B", 1.0, 2.0, 1e-2, 0.2, 3)])
    got = stouffer(collapse(rows)).collect()
    assert [(r.gene_symbol, r.n_studies) for r in got] == [("B", 2)]


def test_mean_not_max(spark):
    rows = frame(spark, [(f"S{k}", "P1", "A", 1.0, z, 1e-3, r, 3) for k, (z, r) in enumerate([(0.2, 0.5), (-0.1, 0.7), (3.0, 0.03), (-2.5, 0.5)])])
    unit = collapse(rows).first()
    assert unit.signed_z == pytest.approx(0.15) and unit.normalized_rank == pytest.approx(0.4325) and unit.n_contrast_rows == 4


def test_order_survives_underflow(spark):
    rows = frame(spark, [(f"S{k}", f"P{k}", g, 1.0, z, 1e-300, 0.01, 3) for g, z in (("A", 37.0), ("B", 38.0)) for k in (1, 2)])
    got = consensus(rows).orderBy("slice_rank").collect()
    assert [r.gene_symbol for r in got] == ["B", "A"] and got[0].stouffer_p == 0.0 == got[1].stouffer_p


def test_time_modes(spark):
    def with_mode(mode):
        rows = frame(spark, [(f"T{k}", "P1", "A", 1.0, z, 1e-3, 0.1, 3) for k, z in enumerate([1.0, 3.0, 5.0])])
        hours = F.element_at(F.create_map(*[F.lit(x) for pair in (("T0", "4h"), ("T1", "12 h"), ("T2", "24h")) for x in pair]), F.col("study_id"))
        return collapse(rows.withColumn("duration_h", hours).withColumn("time_course_mode", F.lit(mode))).first()

    assert with_mode("first").signed_z == 1.0 and with_mode("latest").signed_z == 5.0
    peak = with_mode("strongest-window")
    assert peak.signed_z == 4.0 and peak.n_contrast_rows == 2
    assert with_mode("auto").signed_z == 3.0


def test_missing_effect_stays_out_of_the_mean(spark):
    rows = frame(spark, [("S1", "P1", "A", 2.0, 3.0, 1e-3, 0.1, 3), ("S2", "P2", "A", None, 3.0, 1e-3, 0.1, 3)])
    assert stouffer(collapse(rows)).first().weighted_lfc == pytest.approx(2.0)


def test_direction_tie(spark):
    rows = score(frame(spark, [("S1", "P1", "A", 1.0, 2.0, 1e-3, 0.1, 3), ("S2", "P2", "A", -1.0, -2.0, 1e-3, 0.1, 3)])).scores.first()
    assert (rows.consensus_direction, rows.direction_agreed_units, rows.direction_all_units, rows.direction_confidence_index) == ("flat", 1.0, 2.0, 0.5)


def test_unusable_variance(spark):
    rows = frame(spark, [("S1", "P1", "A", 1.0, 1e-154, 0.9, 0.1, 3), ("S2", "P2", "A", 1.0, -1e-154, 0.9, 0.1, 3)])
    assert lanes.effect_meta(ev.evidence(rows), 2).count() == 0


def test_outlier_unit(spark):
    rows = []
    for k in range(8):
        rows += [("S1", "A", f"G{k}", k + 1.0, k + 1.0, 1e-3, 0.1, 3), ("S2", "B", f"G{k}", k + 1.5, k + 1.0, 1e-3, 0.1, 3), ("S3", "C", f"G{k}", 9.0 - k, 1.0, 1e-3, 0.1, 1)]
    harmonized = frame(spark, rows).withColumn("source_input_type", F.when(F.col("paper_id") == "C", "normalized_expression_matrix").otherwise("author_deg_table"))
    units = {r.source_unit_id: r for r in ev.diagnostics(ev.evidence(harmonized)).collect()}
    assert units["C"].source_outlier_flag and units["C"].source_coherence_weight == 0.5 and units["C"].source_quality_label == "low"
    assert units["C"].median_pairwise_lfc_spearman == pytest.approx(-1.0) and not units["A"].source_outlier_flag


def test_left_out_folds_equal_rescoring(spark):
    rows = [(f"S{k}", f"P{k}", f"G{g}", (g % 5) - 1.7 + 0.3 * k, ((g * 7 + k * 3) % 11) - 4.5, 1e-3, 0.01 + ((g * 5 + k) % 17) / 20, 2 + k) for g in range(12) for k in range(4) if (g + k) % 5]
    harmonized = frame(spark, rows)
    got = score(harmonized)
    ranks = {(r.fold, r.gene_symbol): r.fold_rank for r in folds(got.evidence, got.diagnostics).collect()}
    for left in ("P0", "P3"):
        again = score(harmonized.filter(F.col("paper_id") != left)).scores.orderBy("priority_rank").collect()
        assert [g for _, g in sorted((v, g) for (u, g), v in ranks.items() if u == left)] == [r.gene_symbol for r in again]


def test_row_order_and_partitions_do_not_matter(spark):
    a = score(golden(spark)).scores.select("gene_symbol", "composite_score", "quality_rank", "rra_rank").orderBy("gene_symbol").collect()
    b = score(golden(spark).orderBy(F.rand(7)).repartition(5)).scores.select("gene_symbol", "composite_score", "quality_rank", "rra_rank").orderBy("gene_symbol").collect()
    assert a == b


def test_ablation(spark):
    plain = score(golden(spark), ablation=Ablation(source_quality=False, sample_size=False)).scores.filter("gene_symbol = 'VEGFA'").first()
    assert plain.quality_stouffer_z == pytest.approx((5.5 + 4.5) / math.sqrt(2))
    only = score(golden(spark), ablation=Ablation(components=("effect_score",))).scores.filter("gene_symbol = 'VEGFA'").first()
    assert only.quality_score == pytest.approx(100 * only.quality_effect_score, abs=1e-6)
    with pytest.raises(ValueError):
        Ablation(components=("none",))


@pytest.mark.parametrize("value", [True, 2.5, float("nan"), 0, "x", None])
def test_least_units_refuses(value):
    with pytest.raises(ValueError):
        least_units(value)


def test_least_units_reads():
    assert least_units("2") == 2 == least_units(2.0)


def test_rank_product(spark):
    rows = frame(spark, [("S1", "P1", "A", 1.0, 2.0, 1e-3, 0.1, 3), ("S2", "P2", "A", 1.0, 2.0, 1e-3, 0.4, 3)])
    assert rank_product(collapse(rows)).first().rank_product == pytest.approx(0.2)
