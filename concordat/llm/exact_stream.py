"""Exact deduplication as a stateful stream.

Documents land as narrow rows (digest, identifier, content locator) and stream through an aggregation keyed by the digest.
Its state is kept in RocksDB, on disk, and never expires: for each digest it holds the identifier and locator of the row
that stays, the locator of the row that came first, and the group's size. Each ingest processes what is new and ends; the
state and the landed rows stay in one folder in shared storage, so a later ingest, or a restart after a loss, goes on from
there. An ingest first records the files it reads and counts as landed only with its mark of success. One that was cut off
is taken up where it stood by a call for the same files; a call for others first ends it, from its own files, if its rows
had landed, and else forgets it. Frames that don't come from files have new files each time, so give files to an ingest
that is to be taken up.

A hit (a row whose digest the state already holds under another locator) is checked against the full bytes at the stored
locator, in the file of the earlier ingest where it lies there; no other file is read. Texts of one digest are combined to the least and the
largest before they are shuffled: where both are equal, all are. Should a digest collide, the groups concerned are split
by their whole texts over all ingests, so the result is exact for any digest. The texts of rows without a hit never move.
Earlier inputs must stay readable.

Defined results: null text counts as empty. Of equal texts the row with the largest identifier stays (null identifiers
come last, ties go to the largest locator), so exactly one row of a group is kept, also among repeated rows. An empty
table gives an empty result. Columns beside text and identifier are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concordat.llm.shared import FILE, ROW, exists, located, only, scratch, whole, without, written

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Small stores are many: no space is set aside for each, and a commit writes its changes only.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


# A frame of a Python list runs in Python workers of another kind than the functions' own, which every executor then holds
# beside them (84 MB were measured). These two run in none.


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def paths_of(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"path": pa.array(files, pa.string())}))


def _stays() -> Column:
    """What the state keeps of a row; the largest stays."""
    return F.struct(F.col("id").isNotNull().alias("present"), F.col("id").alias("id"), FILE, ROW)


class Ingest(NamedTuple):
    """One ingest: its number, and its documents with the columns FILE and ROW."""

    number: int
    docs: DataFrame


class ExactDedup:
    """A deduplicating store in a folder of shared storage (a new one under spark.checkpoint.dir by default).

    Its tables: begun/ingest=k and inputs/ingest=k (the files that ingest k reads, at its start and when it has ended),
    landed/ingest=k (id, FILE, ROW, digest), state/epoch=e (what
    a micro-batch changed: digest, stays, first, n, ingest), collided/ingest=k (digests that differing texts share).
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, *, text: str = "text", id_column: str = "doc_id", normalise: Callable[[Column], Column] = lambda x: x, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 100_000) -> None:
        self.files_per_batch, self.spark, self.folder = files_per_batch, spark, folder or scratch(spark, "exact")
        self.text, self.id_column, self.normalise, self.digest = text, id_column, normalise, digest

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the folder, empty where nothing has been written yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return no_rows(self.spark, schema)

    def _rows(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.id_column).alias("id"), FILE, ROW, self.normalise(whole(self.text)).alias("body")).withColumn("digest", self.digest(F.col("body")))

    def _inputs(self) -> DataFrame:
        return self._read("inputs", "path string, ingest int")

    def ingest(self, docs: DataFrame) -> Ingest:
        """Adds docs to the state and checks its hits."""
        number = (self._inputs().agg(F.max("ingest")).first()[0] or 0) + 1
        here = located(docs)
        files = here.inputFiles()
        begun = f"{self.folder}/begun/ingest={number}"
        landed = False
        if exists(self.spark, f"{begun}/_SUCCESS"):
            former = [r.path for r in self.spark.read.schema("path string").parquet(begun).collect()]
            landed = exists(self.spark, f"{self.folder}/landed/ingest={number}/_SUCCESS")
            if landed and set(former) != set(files):
                self._end(number, located(self.spark.read.parquet(*former)), former, True)
                return self.ingest(docs)
        self._list(files, begun)
        return self._end(number, here, files, landed)

    def _list(self, files: list[str], path: str) -> None:
        paths_of(self.spark, files).coalesce(1).write.mode("overwrite").parquet(path)

    def _end(self, number: int, here: DataFrame, files: list[str], landed: bool) -> Ingest:
        """Lands an ingest that hasn't landed, and takes it through to its end."""
        rows = self._rows(here).drop("body")
        self.kind = rows.schema["id"].dataType.simpleString()
        if not landed:  # what a landing that was cut off has left is no row of anything
            rows.write.mode("overwrite").parquet(f"{self.folder}/landed/ingest={number}")
        self._advance()
        one = Ingest(number, here)
        self._collided(one).write.mode("overwrite").parquet(f"{self.folder}/collided/ingest={number}")
        self._list(files, f"{self.folder}/inputs/ingest={number}")
        return one

    def _landed(self) -> DataFrame:
        return self._read("landed", f"id {self.kind}, {FILE} string, {ROW} bigint, digest binary, ingest int")

    def _advance(self) -> None:
        """Runs the stream over all that has landed and isn't in the state yet, then ends."""
        kept = {k: self.spark.conf.get(k, None) for k in _ROCKSDB}
        for k, v in _ROCKSDB.items():
            self.spark.conf.set(k, v)
        try:
            schema = f"id {self.kind}, {FILE} string, {ROW} bigint, digest binary, ingest int"
            stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(f"{self.folder}/landed")
            state = stream.groupBy("digest").agg(F.max(_stays()).alias("stays"), F.min(F.struct("ingest", FILE, ROW)).alias("first"), F.count("*").alias("n"), F.max("ingest").alias("ingest"))

            def store(changed: DataFrame, epoch: int) -> None:
                changed.write.mode("overwrite").parquet(f"{self.folder}/state/epoch={epoch}")

            query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(store).start()
            query.awaitTermination()
        finally:
            for k, v in kept.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

    def _groups(self, since: int) -> DataFrame:
        """(digest, stays, first, n) of the digests of more than one row that ingest `since` or a later one has touched."""
        held = self._read("state", f"digest binary, stays struct<present:boolean,id:{self.kind},{FILE}:string,{ROW}:bigint>, first struct<ingest:int,{FILE}:string,{ROW}:bigint>, n bigint, ingest int, epoch bigint")
        newest = held.filter(F.col("ingest") >= since).groupBy("digest").agg(F.max(F.struct("epoch", "stays", "first", "n")).alias("x"))
        return newest.select("digest", "x.stays", "x.first", "x.n").filter("n > 1")

    def _bodies(self, places: DataFrame) -> DataFrame:
        """(digest, body) at the written places (FILE, ROW) in the files of earlier ingests; only files with a place are read."""
        paths = [r[0] for r in places.select(FILE).distinct().collect()]
        if not paths:
            return no_rows(self.spark, "digest binary, body string")
        earlier = self.spark.read.schema(f"`{self.text}` string").parquet(*paths)
        there = only(located(earlier), places).select(self.normalise(whole(self.text)).alias("body"))
        return there.select(self.digest(F.col("body")).alias("digest"), "body")

    def _collided(self, one: Ingest) -> DataFrame:
        """(digest) of the digests that hits of this ingest share with a differing text."""
        groups = written(self._groups(one.number), "groups")
        mine = self._landed().filter(F.col("ingest") == one.number).join(groups.select("digest"), "digest")
        hits = self._rows(only(one.docs, mine)).select("digest", "body")
        stored = groups.filter(F.col("first.ingest") < one.number).select(f"first.{FILE}", f"first.{ROW}")
        texts = hits.union(self._bodies(written(stored, "stored")))
        found = texts.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).filter("least <> most").select("digest")
        return found.join(groups, "digest", "left_semi")

    def rows(self, one: Ingest) -> DataFrame:
        """Each row of an ingest as the state stands now: (id, FILE, ROW, digest, stays, n); its hits were checked by their bytes."""
        landed = self._landed().filter(F.col("ingest") == one.number).drop("ingest")
        groups = written(self._groups(one.number).select("digest", "stays", "n"), "groups")
        collided = self._read("collided", "digest binary").select("digest").distinct()
        alone = {"stays": F.coalesce("stays", _stays()), "n": F.coalesce("n", F.lit(1).cast("bigint"))}
        named = landed.join(groups, "digest", "left").withColumns(alone)
        if collided.isEmpty():
            return named
        collided = written(collided, "collided")
        clear = named.join(collided, "digest", "left_anti")
        apart = written(self._apart(collided), "apart")
        by_text = apart.groupBy("digest", "body").agg(F.max(_stays()).alias("stays"), F.count("*").alias("n"))
        own = apart.filter(F.col("ingest") == one.number).drop("ingest")
        return clear.unionByName(own.join(by_text, ["digest", "body"]).drop("body"))

    def _apart(self, collided: DataFrame) -> DataFrame:
        """(id, FILE, ROW, digest, ingest, body) of all landed rows of the collided digests."""
        rows = written(self._landed().join(collided, "digest"), "collided-rows")
        paths = [r.path for r in self._inputs().select("path").distinct().collect()]
        all_texts = self.spark.read.schema(f"`{self.text}` string").parquet(*paths)
        there = all_texts.select(self.normalise(whole(self.text)).alias("body"), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        return rows.join(there, [FILE, ROW])


def stayed() -> Column:
    """Whether a row of ExactDedup.rows is the one that stays."""
    return (F.col(FILE) == F.col(f"stays.{FILE}")) & (F.col(ROW) == F.col(f"stays.{ROW}"))


def duplicates(docs: DataFrame, **options) -> DataFrame:
    """Each row of docs: (id, keep_id, group_size, kept, digest). options: see ExactDedup."""
    dedup = ExactDedup(docs.sparkSession, **options)
    rows = dedup.rows(dedup.ingest(docs))
    return rows.select("id", F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"), stayed().alias("kept"), "digest")


def keep_last(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without exact copies: of equal texts the one with the largest identifier."""
    dedup = ExactDedup(docs.sparkSession, **options)
    one = dedup.ingest(docs)
    return without(one.docs, dedup.rows(one).filter(~stayed()))
