"""Global ranks and false-discovery adjustment without sending all rows to one task.

Rows are dealt to ranges of their full order (repartitionByRange samples it), so that ties of the first value are split by
the later ones. Each range is ordered by itself, and the sizes (or minima) of the ranges before or after it are added from
a table with one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.store import settled


def _dealt(df: DataFrame, *order: Column) -> DataFrame:
    """df, written, with __range: ascending in the order, as many ranges as the session has shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))


def _before(sizes: DataFrame) -> DataFrame:
    """(__range, __before, __all) of sizes(__range, __n): the rows of the ranges before it, and of all."""
    ranges = Window.orderBy("__range")
    before = F.coalesce(F.sum("__n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("__n").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sizes.select("__range", before.alias("__before"), every.alias("__all"))


def global_rank(df: DataFrame, first: Column, then: Sequence[Column], name: str, descending: bool = False) -> DataFrame:
    """df with name: 1 for the row that comes first by `first` (ascending unless descending, nulls last), then by `then`.

    then ends with a unique key, which makes the order total.
    """
    order = [(first.desc_nulls_last() if descending else first.asc_nulls_last()), *then]
    dealt = _dealt(df, *order)
    before = _before(dealt.groupBy("__range").agg(F.count("*").alias("__n")))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    ranked = dealt.withColumn("__within", within).join(before, "__range")
    return ranked.withColumn(name, (F.col("__before") + F.col("__within")).cast("int")).drop("__range", "__before", "__all", "__within")


def bh_adjust(df: DataFrame, p: str, name: str, missing_as_one: bool = False) -> DataFrame:
    """df with name: Benjamini-Hochberg adjusted p; a null p stays null (or counts as 1)."""
    held = df.withColumn("__p", F.coalesce(F.col(p), F.lit(1.0)) if missing_as_one else F.col(p))
    # Rows of equal p may be split anywhere: the least raw value of the ranges behind reaches all of them.
    dealt = _dealt(held, F.col("__p").asc_nulls_last(), F.xxhash64(*df.columns))
    before = _before(dealt.filter("__p is not null").groupBy("__range").agg(F.count("*").alias("__n")))
    up = Window.partitionBy("__range").orderBy(F.col("__p").asc_nulls_last())
    ranked = dealt.withColumn("__within", F.row_number().over(up)).join(before, "__range", "left")
    raw = ranked.withColumn("__raw", F.col("__p") * F.col("__all") / (F.col("__before") + F.col("__within")))
    least = raw.filter("__p is not null").groupBy("__range").agg(F.min("__raw").alias("__least"))
    after = least.select("__range", F.min("__least").over(Window.orderBy("__range").rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    down = Window.partitionBy("__range").orderBy(F.col("__within").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = raw.withColumn("__own", F.min("__raw").over(down)).join(after, "__range", "left")
    adjusted = F.when(F.col("__p").isNotNull(), F.least(F.lit(1.0), "__own", F.coalesce("__after", F.lit(1.0))))
    return out.withColumn(name, adjusted).select(*df.columns, name)
