"""The bridge view: result rows of many studies made of lineitem, supplier and nation, so every operator has an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result row for each lineitem: entity = part, source unit = supplier nation, study = nation and return flag."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = line.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    unit = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    effect = (F.col("l_discount") - 0.05) * 60
    share = ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 9973 + 1) / F.lit(9974.0)
    p = F.when(F.abs(F.col("l_tax") - 0.08) < 1e-9, 1.0).otherwise(share * share * share)
    by_region = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.col("n_regionkey").cast("int") + 1)
    flag = lambda a, n, r: F.when(F.col("l_returnflag") == "A", a).when(F.col("l_returnflag") == "N", n).otherwise(r)
    return rows.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene_symbol"),
        unit.alias("source_unit_id"),
        unit.alias("paper_id"),
        F.concat(unit, F.lit("_"), F.col("l_returnflag")).alias("study_id"),
        F.when(F.abs(effect) < 1e-9, 0.0).otherwise(effect).alias("lfc"),
        p.alias("pvalue"),
        F.when(F.abs("l_tax") > 1e-9, F.least(F.lit(1.0), 2 * p)).alias("padj"),
        (1 + F.col("s_nationkey") % 4).cast("double").alias("n_ctrl"),
        (2 + F.col("s_nationkey") % 3).cast("double").alias("n_treat"),
        by_region("author_deg_table", "limma_full_table", "derived_count_table", "normalized_expression_matrix", "other_table").alias("source_input_type"),
        by_region("mean", "early", "late", "peak", "mean").alias("time_course_mode"),
        flag("full_results", "auto", "deg_only").alias("table_scope"),
        flag("4h", "12h", "24h").alias("duration_h"),
        flag(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(30000.0)).alias("declared_universe"),
        flag("edger", "deseq2", "limma").alias("pipeline"),
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
    )


def tie_order() -> tuple[Column, ...]:
    """Orders equal rows by all that tells them apart."""
    return tuple(F.col(c).asc() for c in ("lfc", "l_suppkey", "l_orderkey", "l_linenumber"))
