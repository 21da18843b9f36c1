"""From a catalog of result tables to harmonised rows, scores and written results."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators.harmonize import Mapping, assess_scope, filter_entity_type, harmonize
from concordat.operators.score import Scored, score, significance_warning
from concordat.operators.serve import has_listed_sources, identifier_overlap, in_all_units, label_counts, locked_panel, recall_at
from concordat.sources.catalog import checked, included, read_catalog
from concordat.sources.sinks import write_tables
from concordat.sources.tables import read_table, resolved
from concordat.store import settled

LABELS = ("paper_id", "source_unit_id", "pipeline", "species", "cell_system", "hypoxia_modality", "duration_h", "assay_type", "source_input_type", "platform", "normalization", "probe_collapse", "time_course_mode", "temporal_mode", "sign_convention", "table_scope", "source_url", "source_path")


def source_rows(spark: SparkSession, row: dict[str, str], base: str) -> DataFrame:
    """One contrast's table as rows with its catalog labels."""
    path = row["source_path"] if os.path.isabs(row["source_path"]) or "://" in row["source_path"] else os.path.join(base, row["source_path"])
    table = read_table(spark, path, row["sep"], row["sheet_name"] or None, order=True)
    if row["gene_type_column"]:
        table = filter_entity_type(table, row["gene_type_column"], row["gene_type_keep"])
    name = lambda c: resolved(table, row[c]) if row[c] else None
    rows = Mapping(name("gene_column"), name("lfc_column"), name("p_column"), name("padj_column")).project(table).select("gene_symbol", "lfc", "pvalue", "padj", "source_order")
    labels = {c: F.lit(row[c]) for c in LABELS}
    numbers = {c: F.lit(row[c] or None).cast("double") for c in ("n_ctrl", "n_treat")}
    return rows.withColumns({"study_id": F.lit(row["study_id"]), **labels, **numbers, "declared_universe": F.lit(row["rank_universe_size"] or None).cast("double")})


def harmonized_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All active contrasts of a catalog, harmonised together."""
    active = checked(read_catalog(path))
    if not active:
        raise ValueError(f"no row of {path} takes part")
    base = os.path.dirname(os.path.abspath(path))
    return harmonize(reduce(DataFrame.unionByName, [source_rows(spark, r, base) for r in active]))


def validate(spark: SparkSession, path: str) -> DataFrame:
    """Each study's rows and scope, without writing anything."""
    active = checked(read_catalog(path))
    base = os.path.dirname(os.path.abspath(path))
    return assess_scope(reduce(DataFrame.unionByName, [source_rows(spark, r, base) for r in active]), F.col("table_scope"))


def study_metrics(rows: DataFrame) -> DataFrame:
    """Per study of harmonised rows: its rows, clipped p-values, scope, universe and notes."""
    return rows.groupBy("study_id").agg(
        F.count("*").alias("n_rows"), F.count_if("pvalue_was_clipped").alias("n_clipped"),
        *[F.max(c).alias(c) for c in ("table_scope", "table_scope_assessment", "rank_universe_size_used", "rank_universe_warning", "gene_symbol_collapse_rule", "gene_symbol_collapse_warning")],
    )


def summary(catalog: list[dict[str, str]], rows: DataFrame, done: Scored, least: int, panel: DataFrame | None = None) -> dict[str, object]:
    """What a run read and found, as plain values: bounded by the catalog's length."""
    active = checked(catalog)
    by_study = {r.study_id: r for r in study_metrics(rows).collect()}
    counts = lambda c: {r.label: r.n for r in label_counts(spark_rows(rows, active), c).collect()}
    lost = [r.source_unit_id for r in identifier_overlap(rows).filter("suspicious").select("source_unit_id").collect()]
    found: dict[str, object] = {
        "n_catalog_rows": len(catalog), "n_active_catalog_rows": len(active), "min_units": least, "n_source_units": done.n_units,
        "excluded": [{"study_id": r["study_id"], "notes": r["notes"]} for r in catalog if not included(r["include_in_analysis"])],
        "n_harmonized_rows": sum(r.n_rows for r in by_study.values()), "n_scored": done.scores.count(), "n_clipped": sum(r.n_clipped for r in by_study.values()),
        "study_rows": {k: r.n_rows for k, r in sorted(by_study.items())}, "scopes": {k: r.table_scope for k, r in sorted(by_study.items())},
        "universe_warnings": sorted({r.rank_universe_warning for r in by_study.values()} - {""}), "collapse_warnings": sorted({r.gene_symbol_collapse_warning for r in by_study.values()} - {""}),
        "identifier_space_warnings": [f"{u} shares hardly any identifier with another unit" for u in sorted(lost)],
        **{f"{c}_counts": counts(c) for c in ("pipeline", "assay_type", "source_input_type")},
    }
    if not found["n_scored"]:
        found["why_nothing_was_scored"] = nothing_scored(rows, least)
    if panel is not None:
        found["recall"] = {r.k: r.recall for r in recall_at(done.scores, panel).collect()}
    return found


def spark_rows(rows: DataFrame, active: list[dict[str, str]]) -> DataFrame:
    """The catalog's rows as a table beside the session of rows."""
    names = ["pipeline", "assay_type", "source_input_type"]
    return rows.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in active], ", ".join(f"{c} string" for c in names))


def nothing_scored(rows: DataFrame, least: int) -> str:
    """Why no entity reached the least number of units."""
    units = rows.groupBy("source_unit_id").agg(F.count_distinct("gene_symbol").alias("n"), F.min("gene_symbol").alias("first")).orderBy("source_unit_id").collect()
    if not units:
        return "no source gave a usable row"
    if len(units) < least:
        return f"only {len(units)} source units gave rows and {least} are needed: give independent studies units of their own, or lower the number"
    shared = in_all_units(rows).count()
    each = ", ".join(f"{r.source_unit_id} ({r.n})" for r in units[:6])
    if shared:
        return f"{shared} entities are in all {len(units)} units ({each}): check directions and p-value columns"
    best = max((r.best_overlap for r in identifier_overlap(rows).collect()), default=0)
    firsts = ", ".join(f"{r.source_unit_id}: {r.first}" for r in units[:3])
    return f"no entity is in all {len(units)} units ({each}); two units share {best} at most; first ones: {firsts}. Bring all sources to one kind of identifier"


def run(spark: SparkSession, catalog: str, output: str, least: int = 2, panel: DataFrame | None = None) -> Scored:
    """Harmonises, scores and writes a catalog: harmonized, scores, evidence, diagnostics, metrics, warnings and summary below output."""
    rows = settled(harmonized_catalog(spark, catalog))
    done = score(rows, least)
    scores = settled(done.scores)
    done = Scored(scores, done.evidence, done.diagnostics, done.n_units)
    genes = None if panel is None else locked_panel(panel)
    facts = summary(read_catalog(catalog), rows, done, least, genes) | {"gold_panel_status": "not_provided" if panel is None else "locked" if not genes.isEmpty() else "invalid"}
    told = spark.createDataFrame([(k, json.dumps(v)) for k, v in facts.items()], "field string, value string")
    warnings = significance_warning(scores).join(has_listed_sources(done.evidence))
    write_tables({"harmonized": rows, "scores": scores, "evidence": done.evidence, "diagnostics": done.diagnostics, "metrics": study_metrics(rows), "warnings": warnings, "summary": told}, output)
    return done
