"""What larger tables and odd rows brought up: each test fails on the code before its change."""

import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from concordat.operators import evidence as ev
from concordat.operators import inspection, lanes, score, stability
from concordat.plans import discovery, files, queries  # noqa: F401
from concordat.plans.queries import ORACLES, QUERIES
from concordat.sources import paged
from concordat.store import settled
from pyspark.sql import functions as F
from test_score import frame, golden


def by_sql(folder, name):
    with duckdb.connect() as con:
        for f in (x for x in os.listdir(folder) if x.endswith(".parquet")):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
        return sorted(con.execute(ORACLES[name]).fetchall(), key=str)


def test_component_without_reasons_has_no_basis(spark, sf, tmp_path):
    """Order 51 is called ready without a file: its tier has no reason."""
    orders = pq.read_table(f"{sf}/orders.parquet").slice(0, 3)
    orders = orders.set_column(0, "o_orderkey", [[51, 34, 4]]).set_column(1, "o_custkey", [[1, 2, 3]])
    pq.write_table(orders, f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, QUERIES["readiness_merged"](spark, str(tmp_path)).collect()), key=str)
    assert got == by_sql(tmp_path, "readiness_merged") and got[0] == (1, "verified_ready", None)


def test_aggregation_rank_goes_by_the_published_value(spark, monkeypatch):
    """B's value is less than A's only beyond six decimals, so A comes first by name."""
    ranks = {"A": (0.2, 0.3), "B": (0.2 - 1e-9, 0.3), "C": (0.01, 0.02)}
    rows = spark.createDataFrame([(g, r) for g, both in ranks.items() for r in both], "gene_symbol string, normalized_rank double")
    monkeypatch.setattr(queries, "assessed", lambda spark, sf, *a, **k: (rows, spark.range(25)))
    got = {r.gene_symbol: r.rra_rank for r in QUERIES["rra_rho"](spark, "").collect()}
    assert got == {"C": 1, "A": 2, "B": 3}


def test_score_table_of_some_columns_computes_their_lanes_alone(spark, monkeypatch):
    rows = golden(spark)
    whole = score.score(rows).scores

    def never(*a, **k):
        raise AssertionError("a lane that no column needs")

    for module, name in ((score, "folds"), (lanes, "rank_aggregation"), (lanes, "effect_meta"), (lanes, "random_effects")):
        monkeypatch.setattr(module, name, never)
    names = ("quality_rank", "quality_score", "evidence_tier", "composite_rank", "priority_rank", "quality_direction_confidence_index", "rank_label")
    got = score.score(rows, columns=names).scores.select("gene_symbol", *names)
    assert sorted(got.collect()) == sorted(whole.select("gene_symbol", *names).collect())


def test_evidence_is_written_once(spark, monkeypatch):
    """Of all that assessing writes, one table alone grows with entities: before, rows, evidence and attached evidence did."""
    sizes = []

    def counted(df):
        out = settled(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ev, "settled", counted)
    monkeypatch.setattr(score, "settled", counted)
    rows = frame(spark, [(f"S{u}", f"P{u}", f"G{g}", 0.1 * (g % 7) - 0.3, 1.0 + g % 5, 0.01, 0.5, 3) for g in range(40) for u in range(3)])
    evidence, units = score.assessed(rows, ())
    assert (evidence.count(), units.count()) == (120, 3) and sorted(sizes) == [3, 3, 120]


def test_pairs_of_units_are_ranked_by_counts(spark):
    """Equal pairs of effects are one row with a count before they are dealt to their units."""
    rows = spark.createDataFrame([(f"G{g}", u, float(g % (k + 2))) for g in range(60) for k, u in enumerate("ABC")], "gene_symbol string, source_unit_id string, lfc double")
    got = ev.pairwise(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("Aggregate [source_a")  # printed from the top: counts lie below the windows
    x, y = (np.array([float(g % k) for g in range(60)]) for k in (2, 3))
    average = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    first = {(r.source_a, r.source_b): r for r in got.collect()}[("A", "B")]
    assert first.overlap == 60 and first.lfc_spearman == pytest.approx(np.corrcoef(average(x), average(y))[0, 1], abs=1e-12)


def test_folds_add_up_what_others_leave(spark, monkeypatch):
    """A fold's sums are windows over the entity's units, not a walk over an array of them for each unit."""
    plans = []
    monkeypatch.setattr(stability, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df))
    got = score.score(frame(spark, [(f"S{u}", f"P{u}", g, 1.0, z, 0.01, 0.5, 3) for g, zs in {"A": (3.0, -3.0, 2.0), "B": (1.0, 1.0, 1.0)}.items() for u, z in enumerate(zs)]))
    found = {(r.fold, r.gene_symbol): r.fold_rank for r in stability.folds(got.evidence, got.diagnostics).collect()}
    assert found == {("P0", "A"): 2, ("P0", "B"): 1, ("P1", "A"): 1, ("P1", "B"): 2, ("P2", "A"): 2, ("P2", "B"): 1}
    assert plans and not any("aggregate(" in p for p in plans)


def test_inspection_joins_nothing(spark):
    """Lines of tables pack so well that Spark took them for few and broadcast them."""
    lines = spark.createDataFrame([(1, k, ["gene", "log2FoldChange", "pvalue"] if k == 2 else ["G1", "0.5", "0.01"]) for k in range(1, 9)], "table int, line int, cells array<string>")
    got = inspection.inspect_rows(lines)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    row = got.first()
    assert (row.header_row, row.status, row.sample_rows) == (2, "ready_for_review", 6)


def test_whole_lists_are_read_in_growing_steps(spark, tmp_path, monkeypatch):
    """A step for each two pages of 64 would start 32 streams, and count all that was read after each."""
    calls, advance = [], paged.Scan.advance
    monkeypatch.setattr(paged.Scan, "advance", lambda self, *a: (calls.append(a), advance(self, *a)))
    rows = spark.range(320).select(F.col("id").alias("position"), F.concat(F.lit("GSE"), F.col("id").cast("string")).alias("accession"), F.lit("Homo sapiens").alias("taxon"), F.lit("t").alias("title"))
    assert paged.write_pages(rows, f"{tmp_path}/pages", 5) == 64
    got = paged.scan(spark, f"{tmp_path}/pages", 5, "Homo sapiens", step=2)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 321)) and len(calls) <= 7


def test_files_of_a_round_are_taken_away(spark, sf, tmp_path, monkeypatch):
    orders = pq.read_table(f"{sf}/lineitem.parquet").slice(0, 400)
    pq.write_table(orders, f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(files, "ROUND", 40)
    monkeypatch.setattr(files, "_folder", lambda spark, name: f"file:{tmp_path}/{name}")
    got = sorted(map(tuple, QUERIES["prefix_tables"](spark, str(tmp_path)).collect()), key=str)
    assert len(got) > 80 and got == by_sql(tmp_path, "prefix_tables")
    assert not list(tmp_path.glob("**/*_deg.csv"))
