"""Substring search by an index of trigrams: rows whose name may hold a text are found by intersecting postings, then checked.

Rows are numbered and written in blocks of BLOCK. The index is a table (trigram, block, offsets), sorted by trigram within its
files: which rows of a block have a name with the trigram, as numbers within the block. A common trigram's postings are many
rows of bounded size, one for each block. A search reads the postings of its text's trigrams alone (the filter reaches the
Parquet scan), keeps the rows that have all of them, and checks the names of those rows, in their blocks.

Names are compared by their lower case. Null names hold nothing. Texts of fewer than three characters have no trigram: they
are sought in all names, and the empty text is in every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS


def _trigrams(name: Column) -> Column:
    n = F.length(name)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda k: F.substring(name, k, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def build(table: DataFrame, name: str, path: str) -> None:
    """Writes table in numbered blocks, and the index of its names, below path."""
    numbered = table.withColumn("__row", F.monotonically_increasing_id()).withColumn("__block", F.shiftright("__row", BLOCK_BITS))
    numbered.write.partitionBy("__block").parquet(f"{path}/rows")
    table.limit(0).write.parquet(f"{path}/columns")
    rows = _rows(table.sparkSession, path)
    each = rows.select("__block", F.col("__row").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("offset"), F.explode(_trigrams(F.lower(name))).alias("trigram"))
    postings = each.groupBy("trigram", "__block").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
    postings.repartitionByRange("trigram", "__block").sortWithinPartitions("trigram", "__block").write.parquet(f"{path}/postings")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("__row", LongType()).add("__block", LongType())).parquet(f"{path}/rows")


class Substrings:
    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self.rows, self.postings, self.name = _rows(spark, path), spark.read.parquet(f"{path}/postings"), name

    def candidates(self, text: str) -> DataFrame:
        """(__block, __row) of the rows whose names have every trigram of a text of three characters or more."""
        text = text.lower()
        wanted = sorted({text[k : k + 3] for k in range(len(text) - 2)})
        held = self.postings.filter(F.col("trigram").isin(wanted)).select("__block", F.explode("offsets").alias("offset"))
        all_there = held.groupBy("__block", "offset").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
        return all_there.select("__block", (F.shiftleft("__block", BLOCK_BITS) + F.col("offset")).alias("__row"))

    def search(self, text: str) -> DataFrame:
        """The rows whose name holds the text."""
        rows = self.rows if len(text) < 3 else self.rows.join(self.candidates(text), ["__block", "__row"])
        return rows.filter(F.contains(F.lower(self.name), F.lit(text.lower()))).drop("__block", "__row")
