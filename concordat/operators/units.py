"""Independent source units: which unit a row belongs to, which of its rows count, and their collapse to one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.text import blank_to_null, duration, finite, time_mode

MOST_WEIGHT = 4.0
OUT = ["gene_symbol", "source_unit_id", "study_id", "signed_z", "lfc", "normalized_rank", "n_genes_in_study", "weight", "n_contrast_rows", "n_studies_in_source_unit"]


def source_unit(frame: DataFrame):
    """An explicit source unit wins, then the paper, then the study; blank labels don't count."""
    names = [c for c in ("source_unit_id", "paper_id", "study_id") if c in frame.columns]
    return F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in names])


def number_of(rows: DataFrame, name: str) -> Column:
    """The column as a finite number. What is a number already isn't written and parsed again."""
    plain = rows.schema[name].dataType.simpleString() in ("double", "int", "bigint")
    return finite(F.col(name) if plain else F.col(name).cast("string"))


def eligible_rows(harmonized: DataFrame) -> DataFrame:
    """The harmonised rows that enter aggregation, with their unit and row weight."""
    n_ctrl, n_treat = (number_of(harmonized, c) if c in harmonized.columns else F.lit(None).cast("double") for c in ("n_ctrl", "n_treat"))
    total = n_ctrl + n_treat
    held = harmonized.select(
        *[F.col(c) for c in harmonized.columns if c not in ("gene_symbol", "study_id", "source_unit_id", "signed_z", "lfc", "normalized_rank", "n_genes_in_study")],
        F.trim(F.upper("gene_symbol")).alias("gene_symbol"),
        F.trim("study_id").alias("study_id"),
        source_unit(harmonized).alias("source_unit_id"),
        *[finite(F.col(c)).alias(c) for c in ("signed_z", "lfc")],
        F.col("normalized_rank").cast("double").alias("normalized_rank"),
        (F.col("n_genes_in_study").cast("double") if "n_genes_in_study" in harmonized.columns else F.lit(None).cast("double")).alias("n_genes_in_study"),
        F.least(F.when(total > 0, F.sqrt(total)).otherwise(1.0), F.lit(MOST_WEIGHT)).alias("row_weight"),
    )
    kept = held.filter("gene_symbol <> '' and study_id is not null and source_unit_id is not null and signed_z is not null and normalized_rank is not null")
    return by_time_mode(kept)


def by_time_mode(rows: DataFrame) -> DataFrame:
    """Rows of time courses by their mode: all, the earliest, the latest, or the stronger half of each unit.

    One filter over windows of one order; the modes never leave their own rows. The rows are dealt by entity, so what groups
    them by entity and unit next moves nothing, and what is written of them keeps an entity together.
    """
    column = next((c for c in ("time_course_mode", "temporal_mode") if c in rows.columns), None)
    if column is None:
        return rows.withColumn("time_course_mode", F.lit("mean"))
    hours = duration(F.col("duration_h").cast("string")) if "duration_h" in rows.columns else F.lit(None).cast("double")
    held = rows.withColumn("time_course_mode", time_mode(F.col(column))).withColumn("__hours", hours).repartition("gene_symbol")
    strongest = Window.partitionBy("gene_symbol", "source_unit_id", "time_course_mode").orderBy(F.abs("signed_z").desc(), "study_id", "normalized_rank")
    unit = strongest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = held.withColumns({"__least": F.min("__hours").over(unit), "__most": F.max("__hours").over(unit), "__n": F.count("*").over(unit), "__k": F.row_number().over(strongest)})
    mode = F.col("time_course_mode")
    kept = (
        F.when(mode == "early", F.coalesce(F.col("__hours") == F.col("__least"), F.col("__least").isNull()))
        .when(mode == "late", F.coalesce(F.col("__hours") == F.col("__most"), F.col("__most").isNull()))
        .when(mode == "peak_mean", F.col("__k") <= F.when(F.col("__n") <= 2, F.col("__n")).otherwise(F.greatest(F.lit(2), F.ceil(F.col("__n") * 0.5))))
        .otherwise(True)
    )
    return held.filter(kept).drop("__hours", "__least", "__most", "__n", "__k")


def cancelled(mean: Column) -> Column:
    """A mean of values that cancel is 0, whatever the order of the sum leaves of it."""
    return F.when(F.abs(mean) < 1e-12, 0.0).otherwise(mean)


def collapse(harmonized: DataFrame, eligible: bool = False, more: Sequence[Column] = ()) -> DataFrame:
    """One row for each entity and source unit: weighted mean z and effect, mean rank. eligible: rows are eligible_rows.

    more: further aggregates of the same groups, which follow these columns.
    """
    rows = harmonized if eligible else eligible_rows(harmonized)
    w = F.col("row_weight")
    grouped = rows.groupBy("gene_symbol", "source_unit_id").agg(
        F.min("study_id").alias("study_id"),
        cancelled(F.sum(w * F.col("signed_z")) / F.sum(w)).alias("signed_z"),
        cancelled(F.try_divide(F.sum(w * F.col("lfc")), F.sum(F.when(F.col("lfc").isNotNull(), w)))).alias("lfc"),
        F.avg("normalized_rank").alias("normalized_rank"),
        F.max("n_genes_in_study").cast("int").alias("n_genes_in_study"),
        F.avg(w).alias("weight"),
        F.count("*").cast("int").alias("n_contrast_rows"),
        F.count_distinct("study_id").cast("int").alias("n_studies_in_source_unit"),
        *more,
    )
    return grouped.select(*OUT, *grouped.columns[len(OUT) :])
