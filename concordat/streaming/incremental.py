"""Incremental integration: result rows that arrive as a stream are harmonised study by study and merged into unit sums.

A study arrives whole, as a batch. Unit rows are a plain groupBy, so what a unit has gathered is kept as sums that add up;
each micro-batch appends its own partial sums, and reading adds them. Event counts by window show the same for streams
with late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concordat.operators.harmonize import harmonize
from concordat.operators.units import eligible_rows


def partial_units(harmonized: DataFrame) -> DataFrame:
    """Sums of each entity and unit that add up over batches of studies. Only for time courses by mean."""
    w = F.col("row_weight")
    return eligible_rows(harmonized).groupBy("gene_symbol", "source_unit_id").agg(F.sum(w * F.col("signed_z")).alias("wz"), F.sum(w).alias("w"), F.sum(w * F.col("lfc")).alias("wy"), F.sum(F.when(F.col("lfc").isNotNull(), w)).alias("wyn"), F.sum("normalized_rank").alias("r"), F.count("*").alias("n"), F.min("study_id").alias("study_id"), F.max("n_genes_in_study").alias("g"), F.count_distinct("study_id").alias("s"))


def merged_units(parts: DataFrame) -> DataFrame:
    """Unit rows, as operators.units.collapse gives them, of all batches' partial sums."""
    total = parts.groupBy("gene_symbol", "source_unit_id").agg(*[F.sum(c).alias(c) for c in ("wz", "w", "wy", "wyn", "r", "n", "s")], F.min("study_id").alias("study_id"), F.max("g").alias("g"))
    return total.select("gene_symbol", "source_unit_id", "study_id", (F.col("wz") / F.col("w")).alias("signed_z"), F.try_divide("wy", "wyn").alias("lfc"), (F.col("r") / F.col("n")).alias("normalized_rank"), F.col("g").cast("int").alias("n_genes_in_study"), (F.col("w") / F.col("n")).alias("weight"), F.col("n").cast("int").alias("n_contrast_rows"), F.col("s").cast("int").alias("n_studies_in_source_unit"))


def ingest(rows: DataFrame, folder: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Starts a query that adds each micro-batch of whole studies to folder/parts, once each even after a restart.

    A study must come in one micro-batch, since its ranks need all of its rows: one that comes again stops the query.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        spark, rows = batch.sparkSession, prepare(batch)
        new = rows.select("study_id").distinct()
        try:
            before = spark.read.parquet(f"{folder}/studies").filter(F.col("epoch") < epoch)
        except AnalysisException:  # the first batch
            before = None
        again = [] if before is None else [r.study_id for r in new.join(before, "study_id").select("study_id").limit(5).collect()]
        if again:
            raise ValueError(f"studies {again} came in an earlier micro-batch: send a study whole")
        partial_units(harmonize(rows)).write.mode("overwrite").parquet(f"{folder}/parts/epoch={epoch}")
        new.write.mode("overwrite").parquet(f"{folder}/studies/epoch={epoch}")

    return rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(add).start()


def integrated(spark: SparkSession, folder: str) -> DataFrame:
    return merged_units(spark.read.parquet(f"{folder}/parts"))


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and tumbling window; rows later than `late` drop out of open state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
