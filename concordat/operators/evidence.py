"""Evidence rows: one for each entity and source unit, with joined metadata, quality weights and unit diagnostics."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.special import log_sf, rounded
from concordat.functions.text import joined
from concordat.operators.consensus import sign
from concordat.operators.units import collapse, eligible_rows, number_of
from concordat.store import settled

# Quality weights by source type and table scope.
TYPE_WEIGHTS = {"author_deg_table": 1.00, "limma_full_table": 0.90, "microarray_author_deg_table": 0.90, "derived_count_table": 0.85, "normalized_expression_matrix": 0.35}
SCOPE_WEIGHTS = {"full_results": 1.00, "auto": 0.90, "ambiguous": 0.75, "deg_only": 0.65}
# Metadata joined over all rows of a unit, and over the rows of an entity in a unit.
UNIT_LABELS = ("paper_id", "pipeline", "assay_type", "source_input_type", "platform", "normalization", "probe_collapse", "species", "cell_system", "hypoxia_modality", "table_scope", "sign_convention", "source_path", "source_url")
UNIT_CONTRIBUTING = {"contributing_pipelines": "pipeline", "contributing_assay_types": "assay_type", "contributing_source_input_types": "source_input_type", "contributing_platforms": "platform", "contributing_normalizations": "normalization", "contributing_probe_collapse": "probe_collapse"}
ENTITY_LABELS = {"duration_h": "duration_h", "time_course_mode": "time_course_mode", "temporal_mode": "temporal_mode", "contributing_study_ids": "study_id", "contributing_duration_h": "duration_h", "contributing_time_course_modes": "time_course_mode", "contributing_source_paths": "source_path", "contributing_source_urls": "source_url"}


def _least_of(label: Column, one, none: float) -> Column:
    """The least weight of a list of labels joined by semicolons."""
    clean = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    clean = F.when(clean.isin("nan", "<na>"), "").otherwise(clean)
    parts = F.filter(F.transform(F.split(clean, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.contains(clean, F.lit(";")), F.coalesce(F.array_min(F.transform(parts, one)), F.lit(none))).otherwise(one(clean))


def type_weight(label: Column) -> Column:
    def one(x: Column) -> Column:
        out = F.when((F.contains(x, F.lit("author"))) & F.contains(x, F.lit("deg")) & F.contains(x, F.lit("table")), 1.0).when(F.contains(x, F.lit("derived")) & F.contains(x, F.lit("count")), 0.85).when(F.contains(x, F.lit("normalized")) & F.contains(x, F.lit("matrix")), 0.35).when(x == "", 0.65).otherwise(0.70)
        for name, weight in TYPE_WEIGHTS.items():
            out = F.when(x == name, weight).otherwise(out)
        return out

    return _least_of(label, one, 0.65)


def scope_weight(label: Column) -> Column:
    def one(x: Column) -> Column:
        out = F.when(x == "", 0.90).otherwise(0.85)
        for name, weight in SCOPE_WEIGHTS.items():
            out = F.when(x == name, weight).otherwise(out)
        return out

    return _least_of(label, one, 0.75)


def replicate_weight(n_ctrl: Column, n_treat: Column) -> Column:
    least = F.least(n_ctrl, n_treat)
    return F.when(n_ctrl.isNull() | n_treat.isNull(), 0.75).when(least >= 3, 1.0).when(least >= 2, 0.85).when(least >= 1, 0.5).otherwise(0.35)


def clipped(x: Column, low: float = 0.05, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def quality_label(weight: Column) -> Column:
    return F.when(weight.isNull() | F.isnan(weight), "unknown").when(weight >= 0.85, "high").when(weight >= 0.60, "medium").otherwise("low")


def capped_effects(harmonized: DataFrame, cap: float = 10.0) -> DataFrame:
    """Infinite effects as +-cap."""
    return harmonized.withColumn("lfc", F.when(F.abs("lfc") == float("inf"), F.signum("lfc") * cap).otherwise(F.col("lfc")))


#: Rows that enter evidence.
PRESENT = "lfc is not null and signed_z is not null and pvalue is not null and normalized_rank is not null and trim(study_id) <> ''"
#: Labels of a unit and numbers of its entities that quality weights and scores are made of.
NEEDED = ("source_input_type", "table_scope", "n_ctrl", "n_treat", "signed_z", "lfc", "normalized_rank", "weight")


def evidence(harmonized: DataFrame, columns: Collection[str] | None = None) -> DataFrame:
    """Evidence before diagnostics. Rows without effect drop out here, though consensus keeps them.

    columns: what the caller reads, if that isn't all; NEEDED and what follows from it is always there. One row for each
    entity and unit is written, with the unit's labels as they come; all else is made of it when it is read.
    """
    asked = None if columns is None else {*columns, *NEEDED, "gene_symbol", "source_unit_id"}
    names = lambda of: [c for c in of if asked is None or c in asked]
    present = harmonized.filter(PRESENT)
    for name, value in {"pipeline": "unknown_pipeline", "time_course_mode": "mean"}.items():
        if name not in present.columns:
            present = present.withColumn(name, F.lit(value))
    for name in {*UNIT_LABELS, *UNIT_CONTRIBUTING.values(), *ENTITY_LABELS.values(), "n_ctrl", "n_treat", "padj"} - set(present.columns):
        present = present.withColumn(name, F.lit(None).cast("string"))
    labels = {t: t for t in UNIT_LABELS} | UNIT_CONTRIBUTING
    labels = {t: labels[t] for t in names(labels)}
    more = [
        *[joined(F.col(ENTITY_LABELS[t]).cast("string")).alias(t) for t in names(ENTITY_LABELS)],
        *[F.min(number_of(present, c)).alias(c) for c in ("n_ctrl", "n_treat")],
        F.min("pvalue").alias("min_source_pvalue"),
        F.min(F.col("padj").cast("double")).alias("min_source_padj"),
        F.collect_set(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(set(labels.values()))])).alias("__labels"),
    ]
    each = collapse(eligible_rows(present), eligible=True, more=more)
    kept = [c for c in each.columns if asked is None or c in asked or c == "__labels"]
    each = settled(each.select(*kept))
    # A unit has few different labels: those of its entities are made distinct before they are joined.
    distinct = each.select("source_unit_id", F.explode("__labels").alias("x")).distinct()
    by_unit = distinct.groupBy("source_unit_id").agg(*[joined(F.col(f"x.{c}")).alias(t) for t, c in labels.items()])
    by_unit = settled(by_unit.withColumn("__weight", type_weight(F.col("source_input_type")) * scope_weight(F.col("table_scope"))))
    out = each.drop("__labels").join(by_unit, "source_unit_id")
    out = out.withColumn("__a", F.abs("signed_z")).withColumn("aggregate_pvalue", 2 * F.exp(log_sf("__a"))).drop("__a")
    out = out.withColumn("source_quality_weight", clipped(F.col("__weight") * replicate_weight(F.col("n_ctrl"), F.col("n_treat")))).drop("__weight")
    direction = F.when(F.col("lfc") > 0, "up").when(F.col("lfc") < 0, "down").otherwise("flat")
    return out.withColumn("source_quality_label", quality_label(F.col("source_quality_weight"))).withColumn("direction", direction)


def pairwise(rows: DataFrame) -> DataFrame:
    """Each pair of units: (source_a, source_b, overlap, lfc_spearman, sign_agreement) over the entities that both hold.

    The self-join on the entity gives at most units^2/2 rows for each entity. Ranks are averages over ties within a pair.
    Effects are compared at nine decimals, so that ties don't hang on the order in which a mean was summed.
    """
    each = rows.select("gene_symbol", "source_unit_id", rounded(F.col("lfc"), 9).alias("lfc"))
    pairs = each.alias("a").join(each.alias("b"), (F.col("a.gene_symbol") == F.col("b.gene_symbol")) & (F.col("a.source_unit_id") < F.col("b.source_unit_id"))).select(F.col("a.source_unit_id").alias("source_a"), F.col("b.source_unit_id").alias("source_b"), F.col("a.lfc").alias("x"), F.col("b.lfc").alias("y"))
    # Equal pairs of effects are counted before they are dealt to their pair of units. With N entities, of which u have a value
    # up to x and d one from x on, the average rank of x is (N + 1 + u - d) / 2.
    cells = pairs.groupBy("source_a", "source_b", "x", "y").agg(F.count("*").alias("n"))
    pair, n = Window.partitionBy("source_a", "source_b"), F.col("n")
    cells = cells.repartition("source_a", "source_b").withColumn("all", F.sum("n").over(pair))
    for v in ("x", "y"):
        up, down = (F.sum("n").over(pair.orderBy(o)) for o in (F.col(v).asc(), F.col(v).desc()))
        cells = cells.withColumn(f"__u{v}", up).withColumn(f"__d{v}", down).withColumn(f"r{v}", (F.col("all") + 1 + F.col(f"__u{v}") - F.col(f"__d{v}")) / 2.0)
    agreed = F.sum(F.when(sign(F.col("x")) * sign(F.col("y")) > 0, n).otherwise(0)) / F.sum("n")
    several = lambda c: (F.coalesce(F.min(c) != F.max(c), F.lit(False))).alias(f"several_{c}")
    stats = cells.groupBy("source_a", "source_b").agg(F.sum("n").alias("overlap"), agreed.alias("sign_agreement"), several("x"), several("y"), *[F.sum(n * e).alias(k) for k, e in {"sx": F.col("rx"), "sy": F.col("ry"), "sxx": F.col("rx") * F.col("rx"), "syy": F.col("ry") * F.col("ry"), "sxy": F.col("rx") * F.col("ry")}.items()])
    n = F.col("overlap")
    spread = lambda a, b, ab: n * F.col(ab) - F.col(a) * F.col(b)
    rho = F.try_divide(spread("sx", "sy", "sxy"), F.sqrt(spread("sx", "sx", "sxx")) * F.sqrt(spread("sy", "sy", "syy")))
    usable = (n >= 3) & F.col("several_x") & F.col("several_y")
    return stats.select("source_a", "source_b", F.col("overlap").cast("bigint").alias("overlap"), F.when(usable, rho).alias("lfc_spearman"), "sign_agreement")


def reliability(quality: Column, coherence: Column, comparisons: Column, genes: Column, prior: float = 0.65, weight: float = 1.0) -> Column:
    """Quality shrunk towards a neutral prior; coverage and comparisons say how far it is trusted."""
    observed = clipped(quality * coherence)
    trust = F.greatest(F.lit(1.0), F.least(F.lit(6.0), F.log1p(genes.cast("double")) / 2) + F.least(F.lit(3.0), comparisons.cast("double")))
    return clipped((weight * prior + trust * observed) / (weight + trust))


def diagnostics(rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row for each unit: how it agrees with the others, its coherence, reliability and whether it is an outlier.

    rows: evidence, so one row for each entity and unit.
    """
    pairs = pairwise(rows) if pairs is None else pairs
    sides = pairs.select(F.explode(F.array("source_a", "source_b")).alias("source_unit_id"), "lfc_spearman", "sign_agreement")
    agreement = sides.groupBy("source_unit_id").agg(
        F.count("lfc_spearman").cast("int").alias("n_pairwise_comparisons"),
        F.percentile("lfc_spearman", 0.5).alias("median_pairwise_lfc_spearman"),
        F.min("lfc_spearman").alias("min_pairwise_lfc_spearman"),
        F.percentile("sign_agreement", 0.5).alias("median_pairwise_sign_agreement"),
    )
    by_unit = rows.groupBy("source_unit_id").agg(
        *[F.max(c).alias(c) for c in ("source_input_type", "assay_type", "pipeline") if c in rows.columns],
        F.count("gene_symbol").cast("int").alias("n_genes"),
        F.percentile("source_quality_weight", 0.5).alias("source_quality_weight"),
    )
    out = by_unit.join(agreement, "source_unit_id", "left").withColumn("n_pairwise_comparisons", F.coalesce("n_pairwise_comparisons", F.lit(0)))
    odd = (F.col("n_pairwise_comparisons") >= 2) & (F.col("source_quality_weight") < 0.60) & F.coalesce(F.col("median_pairwise_lfc_spearman") < 0.05, F.lit(False))
    out = out.withColumn("source_outlier_flag", odd).withColumn("source_coherence_weight", F.when(odd, 0.5).otherwise(1.0))
    q, c = F.col("source_quality_weight"), F.col("source_coherence_weight")
    out = out.withColumn("source_recommended_weight", clipped(q * c)).withColumn("source_reliability_weight", reliability(q, c, F.col("n_pairwise_comparisons"), F.col("n_genes")))
    out = out.withColumn("source_quality_label", quality_label(q)).withColumn("source_reliability_label", quality_label(F.col("source_reliability_weight")))
    return out.withColumn("recommended_role", F.when(odd | (q < 0.60), "sensitivity").otherwise("primary"))


def attach(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Evidence with its unit's quality, coherence and reliability. units: diagnostics, one row for each unit."""
    names = ["source_quality_weight", "source_coherence_weight", "source_recommended_weight", "source_reliability_weight", "source_outlier_flag", "source_quality_label", "source_reliability_label"]
    bare = rows.drop(*names)
    return bare.join(units.select("source_unit_id", *names), "source_unit_id")
