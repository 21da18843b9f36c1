"""An order-statistic index: any page of a ranked table by opening the files that hold it.

The table is written once in the order of its ranks, in files of a bounded number of rows, with a small fence table beside
it: for each file its first and last rank and its bounds. A page reads the fences, names its files (one, or two where it lies
across a border) and reads only those; the last page costs what the first does. Ranks don't change by this: they come from
operators.ranking, which ranks all rows in ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.operators.records import MOST_ON_PAGE

#: Rows of a file.
FILE_ROWS = 100_000


def build(ranked: DataFrame, path: str, rank: str = "rank", rows: int = FILE_ROWS) -> None:
    """Writes ranked (rank: 1, 2, ... without gaps) as an index below path."""
    block = F.expr(f"(`{rank}` - 1) div {rows}").cast("bigint")
    dealt = ranked.withColumn("__block", block).repartitionByRange("__block").sortWithinPartitions("__block", rank)
    dealt.write.partitionBy("__block").parquet(f"{path}/rows")
    ranked.limit(0).write.parquet(f"{path}/columns")  # an empty table has no file that tells
    written = ranked.sparkSession.read.schema(ranked.schema).parquet(f"{path}/rows")
    fences = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(rank).cast("bigint").alias("first"), F.max(rank).cast("bigint").alias("last"), F.count("*").alias("n"))
    fences.coalesce(1).write.parquet(f"{path}/fences")


class Index:
    def __init__(self, spark: SparkSession, path: str, rank: str = "rank") -> None:
        self.spark, self.path, self.rank = spark, path, rank
        self.fences = spark.read.parquet(f"{path}/fences")

    def files(self, first: int, last: int) -> list[str]:
        """The files with ranks from first to last: two at most for a page of at most FILE_ROWS rows."""
        return [r.file for r in self.fences.filter((F.col("first") <= last) & (F.col("last") >= first)).select("file").collect()]

    def rows(self, first: int, last: int) -> DataFrame:
        """The rows of ranks first to last, in order."""
        named = self.files(first, last)
        schema = self.spark.read.parquet(f"{self.path}/columns").schema
        if not named:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*named).filter(F.col(self.rank).between(first, last)).orderBy(self.rank)

    def totals(self, number: int, size: int) -> DataFrame:
        """One row: total_records, total_pages, has_next, page, page_size, from the fences alone."""
        n = F.coalesce(F.sum("n"), F.lit(0))
        return self.fences.agg(n.alias("total_records"), F.ceil(n / size).alias("total_pages"), (n > number * size).alias("has_next")).withColumns({"page": F.lit(number), "page_size": F.lit(size)})

    def page(self, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
        """(the rows of one page, one row of totals), as records.page gives them."""
        number, size = max(1, int(number)), max(1, min(MOST_ON_PAGE, int(size)))
        return self.rows((number - 1) * size + 1, number * size), self.totals(number, size)

    def checked(self) -> bool:
        """Whether the fences are whole: ranks follow each other from 1 on without a gap."""
        order = Window.orderBy("first")  # a row for each file
        gaps = self.fences.withColumn("before", F.coalesce(F.lag("last").over(order), F.lit(0))).filter((F.col("first") != F.col("before") + 1) | (F.col("n") != F.col("last") - F.col("first") + 1))
        return gaps.isEmpty()
