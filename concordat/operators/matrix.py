"""Two-group results from expression matrices: low-count filter, log CPM, Welch's t-test."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from concordat.functions.special import t_two_sided
from concordat.functions.text import clean_gene, number
from concordat.operators.ranking import bh_adjust

MOST_SAMPLES = 100


def sample_groups(control: Sequence[str], treatment: Sequence[str], expected: tuple[int | None, int | None] = (None, None), most: int = MOST_SAMPLES) -> tuple[list[str], list[str]]:
    """Both groups, checked: two samples or more each, unique, disjoint, no more than `most`, as many as declared."""
    groups = [str(x).strip() for x in control], [str(x).strip() for x in treatment]
    for name, group, wanted in zip(("control", "treatment"), groups, expected):
        if len(group) < 2:
            raise ValueError(f"the {name} group needs two samples or more")
        if len(set(group)) != len(group):
            raise ValueError(f"the {name} group names a sample twice")
        if len(group) > most:
            raise ValueError(f"the {name} group has more than {most} samples")
        if wanted is not None and len(group) != wanted:
            raise ValueError(f"the {name} group has {len(group)} samples, {wanted} were declared")
    if shared := sorted(set(groups[0]) & set(groups[1])):
        raise ValueError(f"samples in both groups: {shared}")
    return groups


def long_form(matrix: DataFrame, entity: str, samples: Sequence[str]) -> DataFrame:
    """A wide matrix as (gene_symbol, sample, value); only the chosen samples' columns are read."""
    missing = [c for c in (entity, *samples) if c not in matrix.columns]
    if missing:
        raise KeyError(f"the matrix has no columns {missing}")
    cleaned = matrix.select(clean_gene(F.col(f"`{entity}`").cast("string"), ("", "NAN", "NONE", "NA")).alias("gene_symbol"), *[number(F.col(f"`{c}`").cast("string")).alias(c) for c in samples])
    return cleaned.filter("gene_symbol is not null").unpivot("gene_symbol", list(samples), "sample", "value")


def summed(long: DataFrame) -> DataFrame:
    """Counts of rows of one entity added up."""
    return long.groupBy("gene_symbol", "sample").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))


def median(long: DataFrame) -> DataFrame:
    """Values of rows of one entity by their median."""
    return long.groupBy("gene_symbol", "sample").agg(F.percentile("value", 0.5).alias("value"))


def low_counts(long: DataFrame, least: float = 10, samples: int = 2) -> DataFrame:
    """(gene_symbol, passes): whether at least `samples` samples reach `least`; a missing count is 0."""
    return long.groupBy("gene_symbol").agg((F.count_if(F.col("value") >= least) >= samples).alias("passes"))


def low_count_summary(long: DataFrame, least: float = 10, samples: int = 2) -> DataFrame:
    mask = low_counts(long, least, samples)
    return mask.agg(F.count("*").alias("n_before"), F.count_if("passes").alias("n_after"), F.count_if(~F.col("passes")).alias("n_removed"))


def log_cpm(long: DataFrame) -> DataFrame:
    """log2 of counts per million plus one, by the sample's total over the entities that are there."""
    library = long.groupBy("sample").agg(F.sum("value").alias("library"))  # one row for each sample
    cpm = F.coalesce(F.try_divide(F.col("value"), F.col("library")), F.lit(0.0)) * 1e6
    return long.join(library, "sample").select("gene_symbol", "sample", F.log2(cpm + 1).alias("value"))


@F.pandas_udf(DoubleType())
def _welch_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(), df.to_numpy()))


def welch(long: DataFrame, control: Sequence[str], treatment: Sequence[str]) -> DataFrame:
    """Per entity: mean difference, t, degrees of freedom, p (1 where undefined) and adjusted p."""
    group = F.when(F.col("sample").isin(*control), "c").when(F.col("sample").isin(*treatment), "t")
    stat = lambda f, g: f(F.when(group == g, F.col("value")))
    names = {f"{n}{g}": stat(f, g) for n, f in {"m": F.avg, "v": F.var_samp, "n": F.count}.items() for g in "ct"}
    grouped = long.filter(group.isNotNull()).groupBy("gene_symbol").agg(*[c.alias(n) for n, c in names.items()])
    ec, et = (F.try_divide(F.col(f"v{g}"), F.col(f"n{g}")) for g in "ct")
    held = grouped.withColumn("lfc", F.col("mt") - F.col("mc")).withColumn("__s", ec + et)
    held = held.withColumn("t", F.try_divide(F.col("lfc"), F.sqrt("__s"))).withColumn("df", F.try_divide(F.col("__s") * F.col("__s"), F.try_divide(ec * ec, F.col("nc") - 1) + F.try_divide(et * et, F.col("nt") - 1)))
    tested = held.withColumn("pvalue", _welch_p(F.coalesce("t", F.lit(float("nan"))), F.coalesce("df", F.lit(float("nan")))))
    return bh_adjust(tested.select("gene_symbol", "lfc", "t", "df", "pvalue"), "pvalue", "padj", missing_as_one=True)


def derive(matrix: DataFrame, entity: str, control: Sequence[str], treatment: Sequence[str], kind: str = "counts", log_scale: bool = False) -> DataFrame:
    """A result table from a matrix of counts (summed, filtered, log CPM) or normalised values (median, log2 unless log_scale)."""
    control, treatment = sample_groups(control, treatment)
    long = long_form(matrix, entity, [*control, *treatment])
    if kind == "counts":
        counts = summed(long)
        kept = counts.join(low_counts(counts).filter("passes").select("gene_symbol"), "gene_symbol", "left_semi")
        return welch(log_cpm(kept), control, treatment)
    if kind != "normalized":
        raise ValueError(f"kind must be counts or normalized, not {kind!r}")
    values = median(long)
    return welch(values if log_scale else values.withColumn("value", F.log2(F.when(F.col("value") > -1, F.col("value") + 1))), control, treatment)
