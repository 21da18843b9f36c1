"""Serving queries over the score tables: filtered, sorted and paged lists, details, lookups, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS, DEFAULT_ROWS = 500, 50
SORTS = ("quality_rank", "composite_rank", "priority_rank", "quality_score", "composite_score", "n_source_units", "weighted_lfc", "gene_symbol")


def bounded(value, name: str, default: int, low: int = 0, high: int = MOST_ROWS) -> int:
    """A whole-number parameter within its range."""
    if value is None or value == "":
        return default
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a whole number") from None
    if not low <= number <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
    return number


def filtered(scores: DataFrame, q: str = "", direction: str = "", min_units=None, min_score: float | None = None) -> DataFrame:
    """Entities whose name holds q, with a direction, enough units and score. Filters reach the table's scan."""
    if direction and direction not in ("up", "down", "flat"):
        raise ValueError("direction must be up, down or flat")
    out = scores
    if q.strip():
        out = out.filter(F.contains("gene_symbol", F.lit(q.strip().upper())))
    if direction:
        out = out.filter(F.col("quality_direction") == direction)
    if min_units is not None:
        out = out.filter(F.col("n_source_units") >= bounded(min_units, "min_units", 1, 1, 1_000_000))
    if min_score is not None:
        out = out.filter(F.col("quality_score") >= float(min_score))
    return out


def entity_page(scores: DataFrame, sort: str = "quality_rank", descending: bool = False, limit=None, offset=None, **filters) -> DataFrame:
    """One page in order: null values last, then by rank and name. filters: see filtered."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    ordered = filtered(scores, **filters).orderBy(key, "quality_rank", "gene_symbol")
    return ordered.offset(bounded(offset, "offset", 0, 0, 10_000_000)).limit(bounded(limit, "limit", DEFAULT_ROWS, 1))


def entity_detail(scores: DataFrame, evidence: DataFrame, symbol: str) -> DataFrame:
    """An entity's evidence rows with its ranks."""
    name = symbol.strip().upper()
    own = scores.filter(F.col("gene_symbol") == name).select("gene_symbol", "quality_rank", "quality_score")
    return evidence.filter(F.col("gene_symbol") == name).join(own, "gene_symbol", "left")


def panel_lookup(panel: DataFrame, scores: DataFrame, tops: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """A curated panel with where its entities rank."""
    found = panel.join(scores.select("gene_symbol", "quality_rank", "quality_score", "quality_direction"), "gene_symbol", "left")
    return found.withColumns({f"in_top_{k}": F.coalesce(F.col("quality_rank") <= k, F.lit(False)) for k in tops})


def recall_at(scores: DataFrame, panel: DataFrame, tops: tuple[int, ...] = (10, 20, 50, 100), rank: str = "quality_rank") -> DataFrame:
    """(k, n_positives, n_recovered, recall): how much of the panel the first k entities hold."""
    wanted = panel.select("gene_symbol").filter("gene_symbol is not null").distinct()
    found = wanted.join(scores.select("gene_symbol", F.col(rank).alias("r")), "gene_symbol", "left")
    each = found.select("r", F.explode(F.array(*map(F.lit, tops))).alias("k"))
    return each.groupBy("k").agg(F.count("*").alias("n_positives"), F.count_if(F.col("r") <= F.col("k")).alias("n_recovered")).withColumn("recall", F.col("n_recovered") / F.col("n_positives"))


def missed(scores: DataFrame, panel: DataFrame, k: int, rank: str = "quality_rank") -> DataFrame:
    """Panel entities that aren't among the first k."""
    return panel.select("gene_symbol").distinct().join(scores.filter(F.col(rank) <= k), "gene_symbol", "left_anti")


def locked_panel(panel: DataFrame) -> DataFrame:
    """Distinct upper-case symbols of the rows that are locked (yes, true, 1 or blank)."""
    locked = F.lower(F.trim(F.coalesce(F.col("locked").cast("string"), F.lit("")))).isin("", "1", "1.0", "true", "yes", "y", "locked")
    return panel.filter(locked).select(F.upper(F.trim("gene_symbol")).alias("gene_symbol")).filter("gene_symbol <> ''").distinct()


def health(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: how many entities, contrasts and units there are, and the first entity."""
    first = scores.agg(F.count("*").alias("n_entities"), F.min_by("gene_symbol", F.struct("quality_rank", "gene_symbol")).alias("top_entity"))
    held = evidence.agg(F.count_distinct("source_unit_id").alias("n_source_units"), F.count("*").alias("n_evidence_rows"))
    return first.withColumns({c: held.select(c).scalar() for c in held.columns})


def label_counts(rows: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    label = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return rows.groupBy(F.when(label == "", unknown).otherwise(label).alias("label")).agg(F.count("*").alias("n"))


def study_table(harmonized: DataFrame, columns: tuple[str, ...] = ("source_unit_id", "table_scope", "pipeline", "source_input_type")) -> DataFrame:
    """One row for each study: the values of its least row, so that they belong together, and how many rows it has."""
    least = harmonized.groupBy("study_id").agg(F.min(F.struct(*columns)).alias("x"), F.count("*").alias("n_rows"))
    return least.select("study_id", "x.*", "n_rows")


def capped_evidence(evidence: DataFrame, scores: DataFrame, cap: int) -> DataFrame:
    """The first cap evidence rows by their entity's rank, for a workbook."""
    ranked = evidence.join(scores.select("gene_symbol", "quality_rank"), "gene_symbol", "left")
    return ranked.orderBy(F.col("quality_rank").asc_nulls_last(), "gene_symbol", "source_unit_id").limit(cap)


def identifier_overlap(harmonized: DataFrame) -> DataFrame:
    """Per unit: entities, and the best share of them that another unit has too; below 1 % the identifiers may differ."""
    each = harmonized.select("gene_symbol", "source_unit_id").distinct()
    sizes = each.groupBy("source_unit_id").agg(F.count("*").alias("n_entities"))
    pairs = each.alias("a").join(each.alias("b"), (F.col("a.gene_symbol") == F.col("b.gene_symbol")) & (F.col("a.source_unit_id") != F.col("b.source_unit_id")))
    shared = pairs.groupBy(F.col("a.source_unit_id").alias("source_unit_id"), F.col("b.source_unit_id").alias("other")).agg(F.count("*").alias("n"))
    best = shared.groupBy("source_unit_id").agg(F.max("n").alias("best_overlap"))
    out = sizes.join(best, "source_unit_id", "left").withColumn("best_overlap", F.coalesce("best_overlap", F.lit(0)))
    return out.withColumn("suspicious", F.col("best_overlap") < 0.01 * F.col("n_entities"))


def in_all_units(harmonized: DataFrame, unit: str = "source_unit_id") -> DataFrame:
    """Entities that every unit reports; unit may name a coarser column."""
    n = harmonized.agg(F.count_distinct(unit).alias("n")).scalar()
    return harmonized.groupBy("gene_symbol").agg(F.count_distinct(unit).alias("units")).filter(F.col("units") == n)


def has_listed_sources(evidence: DataFrame) -> DataFrame:
    """One row: whether a source reports significant rows only, which inflates combined significance."""
    return evidence.agg(F.coalesce(F.bool_or(F.contains(F.lower("table_scope"), F.lit("deg_only"))), F.lit(False)).alias("any_listed_source"))
