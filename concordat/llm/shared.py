"""What the operators of this subpackage share: the shared folder, written tables and row locators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs
from pyarrow import parquet
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, ROW = "__concordat_file", "__concordat_row"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing (local tests) a folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='concordat-')}"
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, on whatever file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes one file of bounded size to the shared folder, of whatever file system it is; returns its address."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(hadoop).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.getFileSystem(hadoop).makeQualified(path).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: later reads don't compute it again, and a lost executor takes nothing with it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cogrouped(left: DataFrame, right: DataFrame, keys: tuple[str, ...], f: Callable, schema: str) -> DataFrame:
    """f(Arrow table, Arrow table) for each key of either side; both may come of the same table, so their columns are named anew."""
    left, right = (x.toDF(*x.columns) for x in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(f, schema)


def located(docs: DataFrame) -> DataFrame:
    """docs with the columns FILE and ROW, which name each row's place in its file.

    A frame that doesn't come straight from files is written to the shared folder first, so that the place is the same
    each time the plan runs.
    """
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return written(docs, "landed").select("*", *place)


def _marked(docs: DataFrame, places: DataFrame) -> Column:
    """Whether the place of a row of located docs is in places(FILE, ROW).

    places becomes a vector of row numbers for each file of docs, in the shared folder; the task that scans a file looks
    its rows up there. So texts stay where they are read, however many places there are.
    """
    folder = scratch(docs.sparkSession, "places")
    key = F.xxhash64(FILE)
    # Files whose keys collide share a folder, and each has its own rows there.
    narrow = places.select(FILE, ROW).withColumn("key", key).repartition("key").sortWithinPartitions("key", FILE, ROW)
    narrow.write.partitionBy("key").parquet(folder)

    @F.pandas_udf("boolean")
    def there(file: pd.Series, row: pd.Series, where: pd.Series) -> pd.Series:
        out = np.zeros(len(file), bool)
        for (name, k), at in file.groupby([file, where], sort=False).indices.items():
            out[at] = np.isin(row.to_numpy()[at], _rows_of(folder, int(k)).get(name, _NO_ROWS))
        return pd.Series(out)

    return there(FILE, ROW, key)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of located docs whose place isn't in dropped(FILE, ROW), in the columns of docs."""
    return docs.filter(~_marked(docs, dropped)).drop(FILE, ROW)


def only(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of located docs whose place is in places(FILE, ROW), located still."""
    return docs.filter(_marked(docs, places))


_NO_ROWS = np.zeros(0, np.int64)


@lru_cache(maxsize=16)
def _rows_of(folder: str, key: int) -> dict[str, np.ndarray]:
    """The row numbers of each file of one key that _marked has written."""
    system, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/key={key}")
    if system.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return {}
    rows = parquet.read_table(path, filesystem=system, columns=[FILE, ROW], partitioning=None)
    return {name: np.sort(part.to_numpy()) for name, part in rows.to_pandas().groupby(FILE)[ROW]}


def carried(carry: tuple[str, ...], *made: str) -> tuple[str, ...]:
    """The carried columns without those that are named like an output (in any case): the output takes the name."""
    taken = {x.lower() for x in made}
    return tuple(c for c in carry if c.lower() not in taken)


def whole(text: str | Column) -> Column:
    """A text column, null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
