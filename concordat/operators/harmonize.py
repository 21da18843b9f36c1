"""Harmonising a two-group result table: clean entities, validate p-values, resolve duplicates, signed z and ranks.

The rows of many studies are harmonised together, so one pass over the fact table serves any number of studies. Whatever
concerns a whole study (its scope, its universe, its repeated entities) is a groupBy with partial aggregation, and ranks
are added up from the counts of ranges of |z|: no task holds or orders a study.
"""

from __future__ import annotations

import difflib
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.special import isf
from concordat.functions.text import clean_gene, finite, number, table_scope
from concordat.store import settled

P_FLOOR = 1e-300
#: Declared collapse labels that agree with choosing the best row after the test.
BEST_ROW_LABELS = ("min_pvalue_max_abs_lfc", "best_probe", "min_p", "min_pvalue", "min_p_max_lfc")


@dataclass(frozen=True)
class Mapping:
    """Which columns of a source table hold entity, effect, p-value and, if there, adjusted p-value."""

    gene: str
    lfc: str
    p: str
    padj: str | None = None
    sep: str | None = None
    sheet: str | int | None = None

    def project(self, table: DataFrame) -> DataFrame:
        """The table's rows as (gene_symbol, lfc, pvalue, padj, source_order) with all else carried along."""
        missing = [c for c in (self.gene, self.lfc, self.p) if c not in table.columns]
        if missing:
            hints = {c: difflib.get_close_matches(c, table.columns, 3, 0.5) for c in missing}
            raise KeyError(f"required columns {missing} not found; close ones: {hints}; the table has {table.columns}")
        taken = {self.gene, self.lfc, self.p, self.padj}
        padj = F.col(f"`{self.padj}`") if self.padj in table.columns else F.lit(None)
        rest = [F.col(f"`{c}`") for c in table.columns if c not in taken and c not in ("gene_symbol", "lfc", "pvalue", "padj", "source_order")]
        order = F.col("source_order") if "source_order" in table.columns else F.monotonically_increasing_id()
        text = lambda c: F.col(f"`{c}`").cast("string")
        return table.select(text(self.gene).alias("gene_symbol"), number(text(self.lfc)).alias("lfc"), number(text(self.p)).alias("pvalue"), number(padj.cast("string")).alias("padj"), order.alias("source_order"), *rest)


def unit_interval_violations(rows: DataFrame, by: tuple[str, ...] = ("study_id",)) -> DataFrame:
    """Values outside [0, 1] of each study: (by, column, n_bad, examples: the five smallest)."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("pvalue", "padj")])).alias("x")).select(*by, "x.*")
    bad = long.filter((F.col("value") < 0) | (F.col("value") > 1))
    order = Window.partitionBy(*by, "column").orderBy("value")
    first = bad.withColumn("k", F.row_number().over(order)).groupBy(*by, "column")
    return first.agg(F.count("*").alias("n_bad"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("value")))), lambda v: F.format_string("%.6f", v)), ";").alias("examples"))


def reject_invalid(rows: DataFrame) -> DataFrame:
    """rows; running them fails on the first p-value or adjusted p-value outside [0, 1], naming study and column."""
    for c in ("pvalue", "padj"):
        wrong = F.concat(F.lit(f"{c} outside [0, 1] in study "), F.coalesce(F.col("study_id"), F.lit("?")), F.lit(": "), F.col(c).cast("string"))
        rows = rows.withColumn(c, F.when((F.col(c) < 0) | (F.col(c) > 1), F.raise_error(wrong).cast("double")).otherwise(F.col(c)))
    return rows


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows with entity, effect and p-value; p in [1e-300, 1] with a flag where it was clipped, padj in [0, 1]."""
    kept = rows.withColumn("gene_symbol", clean_gene(F.col("gene_symbol"))).filter("gene_symbol is not null and lfc is not null and pvalue is not null")
    p = F.least(F.greatest(F.col("pvalue"), F.lit(P_FLOOR)), F.lit(1.0))
    padj = F.when(F.col("padj").isNotNull(), F.least(F.greatest(F.col("padj"), F.lit(0.0)), F.lit(1.0)))
    return kept.withColumn("pvalue_was_clipped", (F.col("pvalue") != p)).withColumn("pvalue", p).withColumn("padj", padj)


def assess_scope(rows: DataFrame, declared: Column | None = None, by: tuple[str, ...] = ("study_id",), most: dict[str, Column] | None = None) -> DataFrame:
    """Whether each study's table holds all results or significant ones only, from its padj (p where it has none).

    most: further columns by name, of which each study's greatest value is told too.
    """
    most = most or {}
    held = rows.select(*by, (F.lit("auto") if declared is None else declared).alias("__raw"), *[c.alias(n) for n, c in most.items()], *[F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))).alias(c) for c in ("padj", "pvalue")])
    parts = {"n_numeric_values": F.count, "n_le_0_05": lambda c: F.count_if(F.col(c) <= 0.05), "n_gt_0_05": lambda c: F.count_if(F.col(c) > 0.05), "max_value": F.max}
    # A study has few different labels, so numbers alone are aggregated over its rows, and labels over what is left.
    few = held.groupBy(*by, "__raw", *most).agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{c}_{n}") for c in ("padj", "pvalue") for n, f in parts.items()])
    stats = few.groupBy(*by).agg(
        F.max(F.coalesce(table_scope(F.col("__raw")), F.lit("auto"))).alias("declared_scope"),
        *[F.max(n).alias(n) for n in most],
        F.sum("n_rows").alias("n_rows"),
        *[(F.max if n == "max_value" else F.sum)(f"{c}_{n}").alias(f"{c}_{n}") for c in ("padj", "pvalue") for n in parts],
    )
    has_padj = F.col("padj_n_numeric_values") > 0
    stats = stats.select(*by, "declared_scope", *most, "n_rows", F.when(has_padj, "padj").otherwise("pvalue").alias("value_column"), *[F.when(has_padj, F.col(f"padj_{n}")).otherwise(F.col(f"pvalue_{n}")).alias(n) for n in parts])
    stats = stats.withColumn("fraction_le_0_05", F.try_divide(F.col("n_le_0_05").cast("double"), F.col("n_numeric_values")))
    many = F.col("n_gt_0_05") >= F.greatest(F.lit(100), F.floor(0.1 * F.col("n_rows")))
    full = ((F.col("n_rows") >= 10_000) & (F.col("n_gt_0_05") >= 100) & (F.col("max_value") >= 0.5)) | (many & (F.col("max_value") >= 0.2))
    all_listed = (F.col("fraction_le_0_05") >= 0.98) & (F.col("max_value") <= 0.05)
    short_listed = (F.col("n_rows") < 5_000) & (F.col("fraction_le_0_05") >= 0.95) & (F.col("max_value") <= 0.1)
    verdict = F.when(F.col("declared_scope") != "auto", "declared").when(F.col("n_numeric_values") == 0, "auto_ambiguous").when(full, "full_results_likely").when(all_listed | short_listed, "deg_only_likely").otherwise("auto_ambiguous")
    scope = F.when(F.col("assessment") == "declared", F.col("declared_scope")).when(F.col("assessment") == "full_results_likely", "full_results").when(F.col("assessment") == "deg_only_likely", "deg_only").otherwise("ambiguous")
    reason = (
        F.when(F.col("assessment") == "declared", F.concat(F.lit("the catalog declares "), F.col("declared_scope")))
        .when(F.col("n_numeric_values") == 0, "no numeric p-values to judge by")
        .when(full, "many rows aren't significant and values are high")
        .when(all_listed, "nearly all values are 0.05 or less")
        .when(short_listed, "a short table of mostly significant rows")
        .otherwise("nothing is clear: declare table_scope")
    )
    return stats.withColumn("assessment", verdict).withColumn("effective_scope", scope).withColumn("reason", reason)


def best_rows(rows: DataFrame, tie: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each study and entity: least p, then largest |effect|, then least padj, then source order.

    Adds the number of rows it stands for.
    """
    keys = ["gene_symbol", "study_id"]  # the key with more values first: it decides most comparisons
    order = [F.col("pvalue").asc(), F.abs("lfc").desc(), F.col("padj").asc_nulls_last(), *(tie or (F.col("source_order").asc(),))]
    own = Window.partitionBy(*keys).orderBy(*order)  # one order for both windows, so rows are sorted once
    seen = rows.withColumns({"n_source_rows_for_gene": F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int"), "__k": F.row_number().over(own)})
    return seen.filter("__k = 1").drop("__k")


def repeats(best: DataFrame) -> DataFrame:
    """Per study of best_rows: n_observed, most_rows of an entity, the share of rows whose entity is repeated, looks_stacked.

    A table looks like several stacked ones where an entity has three rows and a quarter of all rows are repeated.
    """
    n = F.col("n_source_rows_for_gene")
    found = best.groupBy("study_id").agg(F.count("*").alias("n_observed"), F.sum(n).cast("bigint").alias("n_valid_rows"), F.max(n).alias("most_rows"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("__r"))
    found = found.withColumn("repeated_share", F.col("__r") / F.col("n_valid_rows")).drop("__r")
    return found.withColumn("looks_stacked", (F.col("most_rows") >= 3) & (F.col("repeated_share") >= 0.25))


def stacked_tables(rows: DataFrame) -> DataFrame:
    """Studies of valid_rows and whether their tables look like several stacked ones."""
    counts = rows.groupBy("study_id", "gene_symbol").agg(F.count("*").alias("n_source_rows_for_gene"))
    return repeats(counts).select("study_id", "most_rows", "repeated_share", "looks_stacked")


def collapse_notes(studies: DataFrame, requested: Column, assay: Column) -> DataFrame:
    """studies (as repeats gives them) with the rule that was applied, the one that was asked for and a warning."""
    asked = F.trim(F.coalesce(requested, F.lit("")))
    asked = F.when(F.lower(asked).isin("nan", "none"), "").otherwise(asked)
    label = F.replace(F.replace(F.lower(asked), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    rule = BEST_ROW_LABELS[0]
    undeclared = F.concat("study_id", F.lit(f": duplicate gene symbols were collapsed by {rule}; declare probe_collapse if that is meant"))
    stacked = F.concat("study_id", F.lit(": "), (F.col("n_valid_rows") - F.col("n_observed")).cast("string"), F.lit(" of "), F.col("n_valid_rows").cast("string"), F.lit(" rows shared an entity (up to "), F.col("most_rows").cast("string"), F.lit(f" rows each) and were collapsed by {rule}, which selects on the outcome; keep one contrast of a stacked table"))
    unmet = F.concat("study_id", F.lit(": probe_collapse="), asked, F.lit(f" was declared, but duplicates were left and collapsed by {rule}"))
    warning = (
        F.when(F.col("most_rows") <= 1, "")
        .when(asked == "", F.when(F.contains(F.lower(F.coalesce(assay, F.lit(""))), F.lit("microarray")), undeclared).when(F.col("looks_stacked"), stacked).otherwise(""))
        .when(label.isin(*BEST_ROW_LABELS), "")
        .otherwise(unmet)
    )
    return studies.withColumns({"gene_symbol_collapse_rule": F.when(F.col("most_rows") <= 1, "none").otherwise(rule), "requested_probe_collapse": asked, "gene_symbol_collapse_warning": warning})


def signed_z(rows: DataFrame) -> DataFrame:
    """rows with signed_z: null for an effect of 0 or a p of 1."""
    halved = rows.withColumn("__q", F.greatest(F.col("pvalue"), F.lit(P_FLOOR)) / 2).withColumn("__root", F.sqrt(-F.log("__q")))
    z = F.when((F.col("lfc") != 0) & (F.col("pvalue") < 1), F.signum("lfc") * isf("__q", "__root"))
    return halved.withColumn("signed_z", z).withColumn("abs_signed_z", F.abs("signed_z")).drop("__q", "__root")


def universe(studies: DataFrame, declared: Column) -> DataFrame:
    """studies (n_observed, effective_scope) with the size that ranks are divided by, what was declared, and a warning."""
    wanted, scope, n = F.rint(F.when(declared > 0, declared)), F.col("effective_scope"), F.col("n_observed")
    small = F.concat(F.lit("declared universe "), wanted.cast("bigint").cast("string"), F.lit(" is below the "), n.cast("string"), F.lit(" reported rows; observed rows are used"))
    warning = (
        F.when(wanted < n, small)
        .when(wanted.isNotNull(), F.when(scope == "deg_only", "list of significant rows: ranks use the declared universe, missing genes are unreported").otherwise(""))
        .when(scope == "deg_only", "list of significant rows without a declared universe; ranks use its length and may be optimistic")
        .when(scope == "ambiguous", "table scope is ambiguous; ranks use observed rows, review the source")
        .otherwise("")
    )
    used = F.greatest(F.coalesce(wanted.cast("int"), F.lit(0)), n.cast("int"))
    kept = F.when(wanted < n, n.cast("double")).otherwise(F.when(declared > 0, declared))
    return studies.withColumns({"rank_universe_size_declared": kept, "rank_universe_size_used": used, "rank_universe_warning": warning})


#: Ranges of |z| for each unit; |z| is below 38, so a study has some 2,400 of them at most.
Z_RANGES = 64


def ranked(rows: DataFrame) -> DataFrame:
    """rows with within_study_rank: average ranks of |z| in the study, largest first; a null z has none.

    Equal values are counted before anything is ordered. Each range of |z| of a study is ordered by itself, and what the
    study's higher ranges hold is added. rows: a written table.
    """
    values = rows.filter("abs_signed_z is not null").groupBy("study_id", "abs_signed_z").agg(F.count("*").alias("n"))
    values = settled(values.withColumn("range", F.floor(F.col("abs_signed_z") * Z_RANGES)))
    higher = Window.partitionBy("study_id").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = values.groupBy("study_id", "range").agg(F.sum("n").alias("m")).select("study_id", "range", F.coalesce(F.sum("m").over(higher), F.lit(0)).alias("above"))
    own = Window.partitionBy("study_id", "range").orderBy(F.col("abs_signed_z").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).join(ranges, ["study_id", "range"])
    ranks = placed.select("study_id", "abs_signed_z", (F.col("above") + F.col("before") + (F.col("n") + 1) / 2.0).alias("within_study_rank"))
    return rows.join(ranks, ["study_id", "abs_signed_z"], "left")


#: What is known of each study, beside its effective scope.
STUDY_NOTES = ("table_scope_assessment", "table_scope_reason", "table_scope_value_column", "n_rows_in_source_table", "n_reported_rows_after_filter", "n_scope_significant_rows_le_0_05", "rank_universe_size_declared", "rank_universe_size_used", "rank_universe_warning", "gene_symbol_collapse_rule", "requested_probe_collapse", "gene_symbol_collapse_warning")


def study_notes(rows: DataFrame, best: DataFrame) -> DataFrame:
    """One row for each study: its effective scope as table_scope, n_genes_in_study (the rank universe) and STUDY_NOTES."""
    there = lambda c, kind="string": F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    scope = assess_scope(rows, there("table_scope"), most={"__asked": there("probe_collapse"), "__assay": there("assay_type"), "__declared": finite(there("declared_universe"))})
    known = repeats(best).join(scope, "study_id")
    known = universe(collapse_notes(known, F.col("__asked"), F.col("__assay")), F.col("__declared"))
    known = known.withColumnsRenamed({"assessment": "table_scope_assessment", "reason": "table_scope_reason", "value_column": "table_scope_value_column", "n_le_0_05": "n_scope_significant_rows_le_0_05"})
    known = known.withColumn("n_rows_in_source_table", F.col("n_rows")).withColumn("n_reported_rows_after_filter", F.col("n_observed"))
    return settled(known.select("study_id", F.col("effective_scope").alias("table_scope"), F.col("rank_universe_size_used").alias("n_genes_in_study"), *STUDY_NOTES))


#: What harmonising itself makes of a row, before its ranks.
MADE = ("study_id", "gene_symbol", "lfc", "pvalue", "padj", "pvalue_was_clipped", "n_source_rows_for_gene", "signed_z", "abs_signed_z")


def harmonize(rows: DataFrame, tie: tuple[Column, ...] = (), check: bool = True, carried: Collection[str] | None = None) -> DataFrame:
    """Result rows of any number of studies as the harmonised fact table. Needs study_id, gene_symbol, lfc, pvalue, padj.

    A declared table_scope, declared_universe, probe_collapse and assay_type are read where rows has them; the scope that
    leaves here is the effective one. carried: the other columns that leave, if not all.
    """
    checked = reject_invalid(rows) if check else rows
    best = signed_z(best_rows(valid_rows(checked), tie))
    best = settled(best if carried is None else best.select(*MADE, *[c for c in carried if c in best.columns]))
    notes = study_notes(checked, best)
    out = ranked(best.drop("table_scope", "n_genes_in_study", *STUDY_NOTES)).join(notes, "study_id")
    return out.withColumn("normalized_rank", F.col("within_study_rank") / F.greatest("rank_universe_size_used", F.lit(1)))


def filter_entity_type(rows: DataFrame, column: str, keep: str) -> DataFrame:
    """Rows whose type is one of keep, which separates several by |."""
    wanted = [x.strip().lower() for x in keep.split("|") if x.strip()]
    return rows.filter(F.lower(F.trim(F.col(column))).isin(*wanted)) if wanted else rows


def entity_type_summary(rows: DataFrame, column: str, keep: str) -> DataFrame:
    """One row: whether the filter applies, and how many rows there are before and after it."""
    wanted = [x.strip().lower() for x in keep.split("|") if x.strip()]
    good = F.lower(F.trim(F.col(column))).isin(*wanted) if wanted else F.lit(True)
    return rows.agg(F.lit(bool(wanted)).alias("applied"), F.count("*").alias("rows_before"), F.count_if(good).alias("rows_after"))
