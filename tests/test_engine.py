import gzip
import json
import math
import random

import numpy as np
import pytest
from concordat import cli, run
from concordat.functions import text as tx
from concordat.functions import special
from concordat.operators import classify, inspection, linkage, matrix, ranking, records, serve
from concordat.operators import harmonize as hz
from concordat.operators.units import collapse
from concordat.sources import catalog, ooxml, sinks, tables
from concordat.streaming import incremental
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

ROWS = "study_id string, gene_symbol string, lfc double, pvalue double, padj double, source_order bigint"


def results(spark, rows):
    return spark.createDataFrame([("S", g, y, p, q, k) for k, (g, y, p, q) in enumerate(rows)], ROWS)


def test_basic_table(spark):
    got = {r.gene_symbol: r for r in hz.harmonize(results(spark, [("VEGFA", 2.0, 1e-8, 1e-6), ("RPL13A", 0.1, 0.5, 0.8), ("HK2", -1.5, 1e-4, 1e-3)])).collect()}
    assert sorted(got, key=lambda g: got[g].within_study_rank) == ["VEGFA", "HK2", "RPL13A"]
    assert got["HK2"].signed_z < 0 and got["VEGFA"].normalized_rank == pytest.approx(1 / 3)


def test_p_boundaries(spark):
    got = {r.gene_symbol: r for r in hz.harmonize(results(spark, [("A", 1.0, 1.0, None), ("B", 1.0, 1e-310, None), ("C", -1.0, 0.01, None), ("D", 0.0, 0.01, None)])).collect()}
    assert got["A"].signed_z is None and got["D"].signed_z is None and got["A"].within_study_rank is None
    assert got["B"].pvalue == 1e-300 and got["B"].pvalue_was_clipped and got["C"].signed_z == pytest.approx(-2.5758293035489004)
    assert got["B"].normalized_rank == 0.25  # neutral rows stay in the denominator


def test_gene_repair(spark):
    cases = {"6-Mar": "MARCHF6", "Sep-2": "SEPTIN2", "2025-03-10 00:00:00": "MARCHF10", "2007-09-01 00:00:00": "SEPTIN7", "2024-12-01 00:00:00": "BHLHE40", "DEC2": "BHLHE41", "vegfa.3": "VEGFA", "2025-09-01": "SEPTIN1", "SEP2": "SEP2", "40-Mar": "40-MAR", "nan": None, "": None, None: None}
    frame = spark.createDataFrame(list(enumerate(cases)), "k int, v string")
    got = {r.v: r.g for r in frame.select("v", tx.clean_gene(F.col("v")).alias("g")).collect()}
    assert got == cases


def test_bad_values_stop_the_run(spark):
    bad = results(spark, [("A", 1.0, -0.3, 2.0), ("B", 1.0, 0.1, 0.0)])
    with pytest.raises(SparkRuntimeException, match="pvalue outside"):
        hz.harmonize(bad).collect()
    assert {(r["column"], r.n_bad) for r in hz.unit_interval_violations(bad).collect()} == {("pvalue", 1), ("padj", 1)}


def test_duplicates_and_universe(spark):
    rows = results(spark, [("GENEX", 1.0, 1e-3, 1e-2), ("GENEX", 2.5, 1e-6, 1e-4), ("GENEX", -2.0, 1e-6, 1e-4), ("RPL13A", 0.1, 0.5, 0.9)]).withColumn("declared_universe", F.lit(20000.0)).withColumn("table_scope", F.lit("deg_only"))
    got = {r.gene_symbol: r for r in hz.harmonize(rows).collect()}
    assert got["GENEX"].lfc == 2.5 and got["GENEX"].n_source_rows_for_gene == 3 and got["GENEX"].normalized_rank == pytest.approx(1 / 20000)
    assert "declared" in got["GENEX"].rank_universe_warning
    small = hz.harmonize(rows.withColumn("declared_universe", F.lit(1.0))).first()
    assert small.rank_universe_size_used == 2 and "below" in small.rank_universe_warning


def test_effective_scope_and_collapse_notes(spark):
    """The scope that leaves is the effective one; the universe is n_genes_in_study; duplicates are told of."""
    rows = results(spark, [(f"G{k}", 0.1, 0.001 if k < 20 else 0.8, 0.01 if k < 20 else 1.0) for k in range(200)]).withColumn("table_scope", F.lit("auto")).withColumn("declared_universe", F.lit(20000.0))
    one = hz.harmonize(rows).first()
    assert (one.table_scope, one.table_scope_assessment, one.n_genes_in_study, one.n_rows_in_source_table) == ("full_results", "full_results_likely", 20000, 200)
    assert (one.gene_symbol_collapse_rule, one.gene_symbol_collapse_warning, one.n_scope_significant_rows_le_0_05) == ("none", "", 20)
    twice = results(spark, [("GENEX", 2.5, 1e-5, 1e-3), ("GENEX", -3.0, 1e-4, 1e-3), ("RPL13A", 0.1, 0.9, 0.9)])
    note = lambda asked, assay: hz.harmonize(twice.withColumn("probe_collapse", F.lit(asked)).withColumn("assay_type", F.lit(assay))).first()
    assert note("nan", "RNA-seq").gene_symbol_collapse_warning == "" and note("nan", "RNA-seq").requested_probe_collapse == ""
    assert "duplicate gene symbols were collapsed" in note(None, "microarray").gene_symbol_collapse_warning
    assert "median_expression" in note("median_expression", "microarray").gene_symbol_collapse_warning and note("best-probe", "microarray").gene_symbol_collapse_warning == ""
    stacked = results(spark, [(g, 1.0, 0.01, 0.1) for g in "AAABC"])
    assert "5 rows" in hz.harmonize(stacked).first().gene_symbol_collapse_warning


def test_scope(spark):
    full = results(spark, [(f"G{k}", 1.0, 0.01 if k < 20 else 0.2 + k / 300, None) for k in range(200)])
    listed = results(spark, [(f"G{k}", 1.0, 0.001, 0.01) for k in range(50)])
    assert [hz.assess_scope(x).first().assessment for x in (full, listed)] == ["full_results_likely", "deg_only_likely"]
    assert hz.assess_scope(listed, F.lit("full")).first().effective_scope == "full_results"
    assert [r[0] for r in spark.createDataFrame([("Hit-List",), (" ",), (None,), ("odd",)], "v string").select(tx.table_scope(F.col("v"))).collect()] == ["deg_only", "auto", "auto", None]


def test_bh(spark):
    frame = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double")
    assert [r.a for r in ranking.bh_adjust(frame, "p", "a").orderBy("k").collect()] == pytest.approx([0.03, 0.04, 0.04, None], nan_ok=True)


def test_ranks_in_ranges(spark):
    random.seed(4)
    values = [(k, random.choice([None, *[x / 50 for x in range(51)]])) for k in range(700)]
    frame = spark.createDataFrame(values, "k int, p double")
    got = {r.k: r.n for r in ranking.global_rank(frame, F.col("p"), [F.col("k")], "n").collect()}
    order = sorted(values, key=lambda x: (x[1] is None, x[1] or 0, x[0]))
    assert got == {k: n for n, (k, _) in enumerate(order, 1)}
    adjusted = {r.k: r.a for r in ranking.bh_adjust(frame, "p", "a").collect()}
    known = sorted((p for _, p in values if p is not None), reverse=True)
    low, want = 1.0, {}
    for n, p in zip(range(len(known), 0, -1), known):
        low = want[p] = min(low, p * len(known) / n)
    assert all(adjusted[k] == (None if p is None else pytest.approx(want[p])) for k, p in values)


def test_matrix_lane(spark):
    wide = spark.createDataFrame([("TP53", 100, 110, 500, 520), ("CDKN1A", 50, 55, 200, 210), ("LOW", 0, 1, 0, 1), ("NA", 9, 9, 9, 9)], "gene string, c1 int, c2 int, t1 int, t2 int")
    got = {r.gene_symbol: r for r in matrix.derive(wide, "gene", ["c1", "c2"], ["t1", "t2"]).collect()}
    assert set(got) == {"TP53", "CDKN1A"} and got["TP53"].lfc > 0 and all(0 <= r.pvalue <= 1 and 0 <= r.padj <= 1 for r in got.values())
    long = matrix.long_form(wide, "gene", ["c1", "c2", "t1", "t2"])
    assert matrix.low_count_summary(long).first().n_removed == 1
    scale = spark.createDataFrame([("A", 3.0, 3.0, 15.0, 15.0), ("B", 7.0, 7.0, 7.0, 7.0), ("A", 3.0, 3.0, 15.0, 15.0)], "gene string, c1 double, c2 double, t1 double, t2 double")
    got = {r.gene_symbol: r.lfc for r in matrix.derive(scale, "gene", ["c1", "c2"], ["t1", "t2"], "normalized").collect()}
    assert got == {"A": 2.0, "B": 0.0}
    for groups in ((["a"], ["b", "c"]), (["a", "b"], ["b", "c"]), (["a", "a"], ["b", "c"])):
        with pytest.raises(ValueError):
            matrix.sample_groups(*groups)


def test_welch_p_value(spark):
    long = spark.createDataFrame([("A", s, v) for s, v in zip(("c1", "c2", "c3", "t1", "t2", "t3"), (1.0, 2.0, 3.0, 4.0, 6.0, 8.0))], "gene_symbol string, sample string, value double")
    got = matrix.welch(long, ["c1", "c2", "c3"], ["t1", "t2", "t3"]).first()
    assert got.t == pytest.approx(4 / math.sqrt(1 / 3 + 4 / 3)) and got.df == pytest.approx(2.941176470588235)
    assert got.pvalue == pytest.approx(0.05460160, abs=2e-3)


def test_t_tail_for_whole_degrees_of_freedom():
    """Against the closed forms for whole degrees of freedom."""
    def closed(t, df):
        theta = math.atan(abs(t) / math.sqrt(df))
        c, total = math.cos(theta), 0.0
        term = c if df % 2 else 1.0
        for k in range(1, (df - 1) // 2 + 1 if df % 2 else df // 2 + 1):
            total += term
            term *= c * c * (2 * k / (2 * k + 1) if df % 2 else (2 * k - 1) / (2 * k))
        return 1 - (2 / math.pi * (theta + math.sin(theta) * total) if df % 2 else math.sin(theta) * total)

    cases = [(t, df) for t in (0.01, 0.3, 1.0, 2.5, 6.0, -3.0) for df in (1, 2, 3, 4, 7, 10, 31, 60, 200)]
    got = special.t_two_sided(np.array([t for t, _ in cases]), np.array([float(d) for _, d in cases]))
    for (t, df), p in zip(cases, got):
        assert p == pytest.approx(closed(t, df), abs=1e-12, rel=1e-9)
    assert list(special.t_two_sided(np.array([0.0, math.nan, math.inf, 1.0]), np.array([3.0, 3.0, 3.0, 0.0]))) == [1.0] * 4


def test_linkage(spark):
    records = spark.createDataFrame([(1, "d1", None, ["x"], "A rather long title of a study here", None), (2, "d1", "p2", ["y"], "b", "9"), (3, None, "p2", [], "A rather long title of a study here!", None), (4, None, None, None, "c", None)], "k int, doi string, pmc string, acc array<string>, title string, pmid string")
    linked = linkage.link(records, "k", ["doi", "pmc", "acc"])
    assert {r.k: r.component for r in linked.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    merged = {r.component: r for r in linkage.merge(linked, [F.col("k")], texts=["title"], unions=["acc"]).collect()}
    assert merged[1].n_records == 3 and merged[1].acc == ["x", "y"] and merged[1].title == "A rather long title of a study here!"
    shared = linkage.shared_submissions(records.withColumn("source_unit_id", F.col("k").cast("string")))
    assert {r.k for r in shared.filter("shared_submission").collect()} == {1, 3}
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a int, b int")
    assert {r.root for r in linkage.connected(chain).collect()} == {0}
    units = linkage.source_unit_components(spark.createDataFrame([("g1", ["12", "7"]), ("g2", ["12"]), ("g3", [])], "g string, papers array<string>"), "g", "papers")
    assert {r.g: r.source_unit_id for r in units.collect()} == {"g1": "PMID:7", "g2": "PMID:7", "g3": "g3"}


def test_sample_matching(spark):
    columns = spark.createDataFrame([("ctrl_1",), ("Treated rep2 counts",), ("other",), ("gsm9",), ("A1",), ("control 9",), ("liver",)], "column string")
    labels = spark.createDataFrame([("G1", "Ctrl 1", "x"), ("G2", "treated rep2", "x"), ("G3", "control 9", "x"), ("G4", "control 9", "Liver"), ("GSM9", "A1", "x")], "sample string, title string, source string")
    want = {"ctrl_1": "G1", "Treated rep2 counts": "G2", "other": None, "gsm9": "GSM9", "A1": None, "control 9": None, "liver": "G4"}
    assert {r.column: r.sample for r in linkage.match_samples(columns, labels).collect()} == want


def test_sample_names(spark):
    names = {"control": True, "wt": True, "KO_2": True, "GSM123": True, "gene": False, "start": False, "padj": False, "S1": True, "liver": False, "donor-7": True, "baseMean": False, " ": False}
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in frame.select("n", classify.looks_like_sample(F.col("n")).alias("s")).collect()} == names


def test_classifiers(spark):
    names = {"https://x.org/a/GSE1_DESeq2.csv.gz?b=1": ("strong", "deg_table", True), "raw_counts.txt": ("upstream", "count_matrix", True), "x_tpm.tsv": ("upstream", "normalized_expression_matrix", True), "GSE1_RAW.tar": ("reject", "unsupported", False), "a.xlsx": ("weak", "unknown_table", True), "a.pdf": ("unsupported", "unsupported", False)}
    got = {r.v: tuple(r.c) for r in spark.createDataFrame([(n,) for n in names], "v string").select("v", classify.filename_class(F.col("v")).alias("c")).collect()}
    assert {v: c[:3] for v, c in got.items()} == names and all(c[3] for c in got.values())
    heads = [(["gene_id", "symbol", "log2FoldChange", "pvalue", "padj"],), (["gene", "foldchange", "p.value"],), (["gene", "logFC", "FDR"],), (["a", "b"],), (["gene", "logFC_a", "logFC_b", "pval"],)]
    got = [r.c for r in spark.createDataFrame(heads, "h array<string>").select(classify.header_class(F.col("h")).alias("c")).collect()]
    assert [c.status for c in got] == ["candidate_header", "requires_lfc_confirmation", "requires_pvalue_mapping", "not_deg_table", "requires_column_mapping"]
    assert (got[0].gene, got[0].lfc, got[0].p, got[0].padj) == ("symbol", "log2FoldChange", "pvalue", "padj")
    assert [r[0] for r in spark.createDataFrame([("Homo sapiens",), ("mus_musculus",), ("7227",), ("baker's  YEAST",), ("n/a",), ("mixed",), ("Taxon: 9",)], "v string").select(classify.species(F.col("v"))).collect()] == ["Human", "Mouse", "Taxon:7227", "Other:Baker's yeast", None, None, "Taxon:9"]
    flags = "labels array<string>, v boolean, q boolean, b boolean, e string"
    cases = [((["Human"], True, None, None, None), "target_species_verified"), ((["Human"], None, None, None, None), "target_species_likely"), ((["Human", "Mouse"], None, None, None, None), "mixed_quarantined"), ((["Human", "Mouse"], True, None, None, "file"), "mixed_rescued"), ((["Human", "Mouse"], True, None, None, "n/a"), "mixed_quarantined"), ((["Mouse"], None, None, None, None), "non_target"), (([], None, None, None, None), "unknown"), ((["Human"], True, None, True, "x"), "mixed_quarantined")]
    decided = spark.createDataFrame([c for c, _ in cases], flags).select(classify.species_decision(F.col("labels"), "Human", F.col("v"), F.col("q"), F.col("b"), F.col("e")).alias("d"))
    assert [r.d for r in decided.collect()] == [d for _, d in cases]
    tiers = decided.select("d", records.readiness(F.col("d"), F.lit(True), F.lit(False)).alias("t")).collect()
    assert [r.t.tier for r in tiers][:4] == ["verified_ready", "likely_ready", "mixed_quarantined", "verified_ready"]
    row = spark.createDataFrame([(" https://doi.org/10.1093/NAR/gkaa000. ", "PMID: 12", "pmc77", "in 2019-05")], "d string, p string, c string, y string")
    assert tuple(row.select(tx.doi(F.col("d")), tx.pmid(F.col("p")), tx.pmcid(F.col("c")), tx.year(F.col("y"))).first()) == ("10.1093/nar/gkaa000", "12", "PMC77", 2019)


def test_serving(spark):
    scores = spark.createDataFrame([(f"G{k}", k, 100.0 - k, "up" if k % 2 else "down", k % 4, 0.1) for k in range(1, 40)], "gene_symbol string, quality_rank int, quality_score double, quality_direction string, n_source_units int, weighted_lfc double")
    page = serve.entity_page(scores, q="g1", direction="up", min_units=1, limit=3, offset=1).collect()
    assert [r.gene_symbol for r in page] == ["G11", "G13", "G15"]
    panel = spark.createDataFrame([("G1",), ("G12",), ("none",), ("G1",)], "gene_symbol string")
    assert {r.k: (r.n_recovered, r.n_positives) for r in serve.recall_at(scores, panel, (10, 20)).collect()} == {10: (1, 3), 20: (2, 3)}
    assert {r.gene_symbol for r in serve.missed(scores, panel, 10).collect()} == {"G12", "none"}
    with pytest.raises(ValueError):
        serve.entity_page(scores, sort="drop table")
    with pytest.raises(ValueError):
        serve.entity_page(scores, limit=501)


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',log2FC,p\nVEGFA,1.0,0.01\nHK2,x,0.2\n')
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as file:
        file.write("gene\tlfc\nA\t1\n")
    (tmp_path / "c.txt").write_text("gene lfc  p\nA 1   0.1\n")
    (tmp_path / "d.csv").write_text("gene;lfc;p\nA;1;0.1\n")
    (tmp_path / "r.csv").write_text("log2FC,p\nVEGFA,1.5,0.01\n#B,2.0,0.02\n")
    r = tables.read_table(spark, str(tmp_path / "r.csv"))
    assert [tuple(x) for x in r.collect()] == [("VEGFA", "1.5", "0.01"), ("#B", "2.0", "0.02")] and r.columns == ["row_name", "log2FC", "p"]
    ooxml.write_sheets(str(tmp_path / "x.xlsx"), {"Notes": (["n"], []), "DEG": (["gene", "lfc"], [["A", 1.5], [None, None], ["B", 2]])})
    assert [tuple(x) for x in tables.read_table(spark, str(tmp_path / "x.xlsx"), sheet="DEG").collect()] == [("A", "1.5"), ("B", "2")]
    assert tables.read_table(spark, str(tmp_path / "x.xlsx")).columns == ["n"]
    with pytest.raises(KeyError, match="no sheet"):
        tables.read_table(spark, str(tmp_path / "x.xlsx"), sheet="other")
    a = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["row_name", "log2FC", "p"] and tables.resolved(a, "Unnamed: 0") == "row_name"
    assert [r.lfc for r in hz.Mapping("row_name", "log2FC", "p").project(a).orderBy("gene_symbol").collect()] == [None, 1.0]
    assert tables.read_table(spark, str(tmp_path / "b.tsv.gz")).columns == ["gene", "lfc"]
    assert tables.read_table(spark, str(tmp_path / "c.txt"), "whitespace").collect()[0].asDict() == {"gene": "A", "lfc": "1", "p": "0.1"}
    with pytest.raises(ValueError, match="splits"):
        tables.read_table(spark, str(tmp_path / "d.csv"))
    with pytest.raises(KeyError):
        hz.Mapping("nope", "log2FC", "p").project(a)


def test_soft_text(spark):
    text = ["^SAMPLE = GSM1", "!Sample_title = one", "!Sample_characteristics_ch1 = a: b", "^SAMPLE = GSM2", "!Sample_title = two", "!Sample_source_name_ch1 = cells"]
    got = {r.sample: r for r in tables.soft_samples(spark.createDataFrame([("r", k, v) for k, v in enumerate(text)], "record string, line int, value string")).collect()}
    assert got["GSM1"].characteristics == ["a: b"] and got["GSM2"].title == "two" and got["GSM2"].source == "cells"
    lines = spark.createDataFrame([(0, "!Series_title = T"), (1, "!Series_pubmed_id = 2"), (2, "!Series_pubmed_id = 1"), (3, "!Series_pubmed_id = 2")], "line int, value string")
    assert {r.key: r["values"] for r in tables.soft_series(lines).collect()} == {"!Series_title": ["T"], "!Series_pubmed_id": ["2", "1"]}


def test_records(spark):
    assert records.query_terms("HIF-1 alpha's (target)[MeSH]") == ["HIF-1", "alpha's", "target", "MeSH"]
    assert records.entrez_query("low oxygen", "Homo sapiens").startswith('("low"[All Fields] AND "oxygen"[All Fields]) AND gse[ETYP] AND "Homo sapiens"[Organism]')
    for wrong in ("", "x" * 201, "a\tb", "?!", " ".join("abcdefghijklm")):
        with pytest.raises(ValueError):
            records.query_terms(wrong)
    ranked = spark.createDataFrame([(k,) for k in range(1, 46)], "rank int")
    rows, totals = records.page(ranked, 3, 20)
    assert [r.rank for r in rows.collect()] == list(range(41, 46)) and tuple(totals.first()) == (45, 3, False, 3, 20)
    kind = f"record_id string, candidates array<{records.CANDIDATE}>"
    c = lambda n: (None, "geo", "GSE1", f"http://h/{n}", n, "deg_table", None, None)
    own = spark.createDataFrame([("a", [c("x")]), ("b", None)], kind)
    found = records.bound(own, spark.createDataFrame([("a", [c("x"), c("y")])], kind)).collect()
    assert {r.record_id: [x.name for x in r.candidates] for r in found} == {"a": ["x", "y"], "b": []}
    full = own.withColumns({"canonical_id": F.col("record_id"), "paper_title": F.lit("T"), "authors": F.array(F.lit("A"), F.lit("B")), "geo_accessions": F.array(F.lit("GSE1"), F.lit("")), "sources": F.array(F.struct(F.lit("sra").alias("provider"), F.lit("S1").alias("accession"), F.lit("u").alias("landing_url")))})
    full = full.withColumn("data_readiness", records.readiness(F.lit("unknown"), records.has_file(F.col("candidates")), F.lit(False)))
    flat = {r.canonical_id: r for r in records.publication_rows(full).collect()}
    assert (flat["a"].authors, flat["a"].candidate_count, flat["a"].readiness_tier, flat["b"].candidate_count, flat["b"].readiness_tier) == ("A; B", 1, "likely_ready", 0, "metadata_only")
    assert records.dataset_rows(full).count() == 4
    assert {(r.field, r.value) for r in records.metadata_rows(spark.range(1).select(F.create_map(F.lit("a"), F.lit("1")).alias("metadata"))).collect()} == {("a", "1")}


def test_inspection(spark):
    text = "note\ngene;log2FoldChange;pvalue\nA;1.5;0.01\nB;x;0.2\nC;2;0.5\n"
    frame = spark.createDataFrame([("t", gzip.compress(text.encode())), ("u", b"\x1f\x8bbroken"), ("v", text.encode("utf-8-sig"))], "table string, payload binary")
    lines = inspection.table_lines(frame, inspection.decoded(F.col("payload")))
    got = {r.table: r for r in inspection.inspect_rows(lines).collect()}
    assert (got["t"].status, got["t"].header_row, got["t"].lfc_numeric_fraction, got["t"].sample_rows) == ("ready_for_review", 2, 0.667, 3) == (got["v"].status, got["v"].header_row, got["v"].lfc_numeric_fraction, got["v"].sample_rows)
    assert "u" not in got
    stats = spark.createDataFrame([("m", 1, ["gene", "ctrl1", "ctrl2", "ko1", "ko2", "padj"])] + [("m", k, ["A", "1", "2", "3", "4", "0.5"]) for k in (2, 3)], "table string, line int, cells array<string>")
    known, unknown = inspection.inspect_matrix(stats).first(), inspection.inspect_matrix(stats, F.lit(True)).first()
    assert known.status == "upstream_matrix_ready_for_contrast" and known.sample_columns == ["ctrl1", "ctrl2", "ko1", "ko2"] and unknown.sample_columns == [] and unknown.statistic_columns == ["padj"]
    table = spark.createDataFrame([("A", "1", "0.1", "x", 1), ("A", "2", "0.2", "x", 2), ("B", "3", "1.5", "x", 3), ("C", "4", "0.3", "y", 4), ("", "4", "0.3", "x", 5)], "g string, l string, p string, kind string, source_order int")
    table = table.unionByName(spark.createDataFrame([("D", " 5 ", "1", "x", 6)], table.schema)).withColumn("q", F.lit("0.5"))
    every = inspection.author_rows(table, "g", "l", "p", "q", {"kind": "x"})
    assert sorted(tuple(r) for r in every.collect()) == [("A", 1.0, 0.1, 0.5), ("A", 2.0, 0.2, 0.5), ("D", 5.0, 1.0, 0.5)]
    first = inspection.author_rows(table, "g", "l", "p", filters={"kind": "x"}, first=F.col("source_order"))
    assert sorted(tuple(r) for r in first.collect()) == [("A", 1.0, 0.1, None), ("D", 5.0, 1.0, None)]
    with pytest.raises(ValueError, match="fewer than two"):
        inspection.author_rows(table, "g", "l", "p", filters={"kind": "y"})


def test_soft_summary_and_links(spark):
    text = ["!Series_title = T = t", "!Series_summary = a", "!Series_summary = b", "!Series_supplementary_file = f1", "!Series_supplementary_file = f1", "!Series_pubmed_id = 2", "!Sample_organism_ch1 = Mus musculus", "!Sample_organism_ch1 = Homo sapiens", "no mark"]
    one = tables.soft_summary(spark.createDataFrame(list(enumerate(text)), "line int, value string")).first()
    assert (one.title, one.summary, one.design, one.supplementary_files, one.pubmed_ids, one.taxa) == ("T = t", "a b", "", ["f1"], ["2"], ["Homo sapiens", "Mus musculus"])
    found = tables.links(spark.createDataFrame([('{"a": [{"url": "u1", "name": "n"}, {"URL": "u2", "b": {"href": "u3", "fileName": "f"}}]}',), ("broken",), (None,)], "payload string")).collect()
    assert {(r.name, r.url) for r in found} == {("n", "u1"), ("", "u2"), ("f", "u3")}
    assert tables.settings([["Key", "Value"], ["# note", "x"], [" a ", 1], ["b"], [None, 2]]) == {"a": "1", "b": ""}


def test_catalog():
    base = {"Study ID": "S", "paper-id": "P", "Source Path": "x.csv", "Result Scope": "deg", "gene_column": "g", "lfc_column": "l", "p_column": "p"}
    rows = catalog.normalized([base, base | {"Study ID": "T", "Source Path": "y.csv"}])
    assert rows[0]["source_path"] == "x.csv" and rows[0]["table_scope"] == "deg" and len(catalog.checked(rows)) == 2
    for wrong in ({"table_scope": "odd"}, {"n_ctrl": "3"}, {"rank_universe_size": "1.5"}, {"gene_column": ""}, {"include_in_analysis": "maybe"}):
        with pytest.raises(ValueError):
            catalog.checked([rows[0] | wrong])
    with pytest.raises(ValueError, match="twice"):
        catalog.checked([rows[0], rows[0]])
    assert [catalog.included(x) for x in ("true", "no", "", None, "1.0")] == [True, False, True, True, True]


def test_workbooks_and_sidecars(tmp_path):
    path = str(tmp_path / "a.xlsx")
    ooxml.write_sheets(path, {"Contrasts": (["a", "b"], [["=1+1", 2.5], [None, True]]), "Other": (["x"], [])})
    assert ooxml.read_sheets(path) == {"Contrasts": [["a", "b"], ["=1+1", "2.5"], [None, "1"]], "Other": [["x"]]}
    note = sinks.sidecar(path, "run", api_token="x", place="/root/secret/file")
    assert "[redacted]" in open(note).read() and "/root/secret" not in open(note).read()
    (tmp_path / "new").write_text("2")
    (tmp_path / "old").write_text("1")
    with pytest.raises(OSError):
        sinks.publish({str(tmp_path / "new"): str(tmp_path / "old"), str(tmp_path / "missing"): str(tmp_path / "z")})
    assert (tmp_path / "old").read_text() == "1"


def test_demo_run(spark, tmp_path):
    path = cli.demo(str(tmp_path / "demo"))
    assert run.validate(spark, path).count() == 4
    done = run.run(spark, path, str(tmp_path / "out"))
    scores = spark.read.parquet(str(tmp_path / "out" / "scores"))
    told = {r.field: json.loads(r.value) for r in spark.read.parquet(str(tmp_path / "out" / "summary")).collect()}
    assert told["n_active_catalog_rows"] == 4 and told["n_harmonized_rows"] == 40 and told["gold_panel_status"] == "not_provided" and set(told["scopes"].values()) == {"full_results"}
    apart = spark.createDataFrame([("A", "x"), ("B", "y")], "source_unit_id string, gene_symbol string")
    assert "no entity is in all 2 units" in run.nothing_scored(apart, 2) and "only 2" in run.nothing_scored(apart, 3)
    assert done.n_units == 3 and scores.count() == 9 and scores.orderBy("quality_rank").first().gene_symbol == "CA9"
    db = str(tmp_path / "serve.sqlite")
    sinks.write_sqlite({"genes": scores.select("gene_symbol", "quality_rank")}, db, {"genes": ["quality_rank"]})
    assert sinks.read_sqlite(spark, db, "genes").count() == 9
    sinks.write_workbook(str(tmp_path / "r.xlsx"), scores.select("gene_symbol", "quality_rank", "quality_score"), done.evidence.select("gene_symbol", "source_unit_id", "lfc"), {"entities": 10}, cap=7)
    assert len(ooxml.read_sheets(str(tmp_path / "r.xlsx"))["Evidence"]) == 8


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"S{s}", f"G{g}", (g % 5) - 2.1 + s / 3, 10.0 ** -(g % 7 + 1), None, g) for s in range(4) for g in range(15)], ROWS)
    rows = rows.withColumn("paper_id", F.concat(F.lit("P"), (F.substring("study_id", 2, 1).cast("int") % 3).cast("string")))
    for k in range(4):
        rows.filter(F.col("study_id") == f"S{k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.ingest(stream, str(tmp_path / "state")).awaitTermination()
    key = ["gene_symbol", "source_unit_id"]
    got, want = (df.orderBy(*key).collect() for df in (incremental.integrated(spark, str(tmp_path / "state")), collapse(hz.harmonize(rows))))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_a_study_in_two_batches_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([("S", f"G{g}", 1.0 + g, 0.01, None, g) for g in range(6)], ROWS).withColumn("paper_id", F.lit("P"))
    for k in range(2):
        rows.filter(F.col("source_order") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="send a study whole"):
        incremental.ingest(stream, str(tmp_path / "state")).awaitTermination()


def test_entry_points(spark):
    import __spark_entry__

    first = __spark_entry__.entry(spark)
    assert first.count() > 0 and "slice_rank" in first.columns
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 50
