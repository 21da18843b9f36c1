"""A provider's paged record lists as a source, in batch and as a stream whose offsets are page cursors.

A page is a JSON file page-00000000.json, ... in a folder: {"total": records of the whole list, "records": [...]}, as a client
of a provider (or a test) puts it there. A stream reads `step` pages with each micro-batch; what it has read is the offset in
its checkpoint, so a restart goes on with the next page, and a batch that was cut off reads the same pages again.

scan() follows the list until one record more than `limit` qualifies, which tells that the list goes on, and says of every
record that it saw why it was kept or left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from concordat.operators.ranking import global_rank
from concordat.sources import ranges
from concordat.store import settled, shared_folder

RECORD = "page bigint, position bigint, total bigint, accession string, taxon string, title string"
FIELDS = ("accession", "taxon", "title")
#: Pages of a micro-batch, and of a task at most.
STEP, TASK = 50, 16

# Why a record is left out.
NOT_A_SERIES, OTHER_ORGANISM, DUPLICATE = "not_a_geo_series", "mixed_or_mismatched_organism", "duplicate_exact_accession"
#: The record that shows that there are more than the limit.
OVERFLOW = "beyond_limit"


def page_name(number: int) -> str:
    return f"page-{number:08d}.json"


@dataclass
class Page(InputPartition):
    """The pages of a task: `count` from number on."""

    number: int
    count: int = 1


def dealt(start: int, end: int) -> list[Page]:
    """The pages from start on, before end, by tasks."""
    return [Page(k, min(TASK, end - k)) for k in range(start, end, TASK)]


class _Pages:
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.step, self.size = options["path"].rstrip("/"), int(options.get("step", STEP)), int(options["size"])

    def available(self) -> int:
        """How many pages there are, in a row from the first."""
        system, root = ranges.located(self.folder)
        n = 0
        while system.get_file_info(f"{root}/{page_name(n + 1023)}").type.name == "File":
            n += 1024
        while system.get_file_info(f"{root}/{page_name(n)}").type.name == "File":
            n += 1
        return n

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        for number in range(partition.number, partition.number + partition.count):
            yield from self.page(number)

    def page(self, number: int) -> Iterator[pa.RecordBatch]:
        with ranges.opened(f"{self.folder}/{page_name(number)}") as file:
            body = json.loads(file.read())
        rows = body["records"]
        if len(rows) < min(self.size, body["total"] - number * self.size):
            raise ValueError(f"page {number} is incomplete: it has {len(rows)} records")
        text = {f: pa.array([None if r.get(f) is None else str(r[f]) for r in rows], pa.string()) for f in FIELDS}
        place = [number * self.size + k for k in range(len(rows))]
        columns = [pa.array([number] * len(rows), pa.int64()), pa.array(place, pa.int64()), pa.array([body["total"]] * len(rows), pa.int64()), *text.values()]
        yield pa.RecordBatch.from_arrays(columns, ["page", "position", "total", *FIELDS])


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return dealt(0, self.available())


class PageStream(_Pages, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.at = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": max(self.at, min(self.at + self.step, self.available()))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = max(self.at, end["page"])
        return dealt(start["page"], end["page"])

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["page"])


class RecordPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_pages"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: object) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema: object) -> PageStream:
        return PageStream(self.options)


def write_pages(records: DataFrame, folder: str, size: int) -> int:
    """Writes records (position: 0, 1, ... without gaps, accession, taxon, title) as pages of `size`; returns how many."""
    total = records.count()

    def run(group: pa.Table) -> pa.Table:
        number = group["page"][0].as_py()
        rows = group.sort_by("position").select(list(FIELDS)).to_pylist()
        ranges.write(f"{folder}/{page_name(number)}", json.dumps({"total": total, "records": rows}).encode())
        return pa.table({"page": [number]})

    paged = records.withColumn("page", F.expr(f"position div {size}"))
    return paged.groupBy("page").applyInArrow(run, "page bigint").count()


class Scan:
    """A scan of a folder of pages that can be cut off and taken up: its state is one folder of shared storage."""

    def __init__(self, spark: SparkSession, pages: str, size: int, species: str, state: str, step: int = STEP) -> None:
        self.spark, self.pages, self.size, self.species, self.state, self.step = spark, pages, size, species, state, step
        spark.dataSource.register(RecordPages)

    def advance(self, step: int | None = None) -> None:
        """Reads the next `step` pages into the state."""
        stream = self.spark.readStream.format("record_pages").option("path", self.pages).option("size", str(self.size)).option("step", str(step or self.step)).load()

        def land(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.state}/records/epoch={epoch}")

        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.state}/checkpoint").foreachBatch(land).start().awaitTermination()

    def seen(self) -> DataFrame:
        """The records that were read: RECORD."""
        return self.spark.read.schema(f"{RECORD}, epoch int").option("ignoreMissingFiles", "true").parquet(f"{self.state}/records").drop("epoch")

    def run(self, limit: int | None = None) -> DataFrame:
        """Reads on until more than limit records qualify or the list ends; gives judged() of what was seen.

        With a limit each step is `step` pages, so that few are read beyond it. Without one all pages are wanted: each step
        takes as many again as were read, so a long list takes few steps, and one that was cut off loses half at most.
        """
        self.advance()
        before, step = -1, self.step
        while True:
            good = F.lit(0) if limit is None else F.count_distinct(F.when(self._fault() == "", F.upper("accession")))
            rows, total, good = self.seen().agg(F.count("*"), F.max("total"), good).first()
            if limit is not None and good > limit or total is None or rows >= total:
                return self.judged(limit)
            if rows == before:
                raise ValueError(f"the list has {total} records, but its pages end after {rows}")
            before = rows
            self.advance(step)
            step = step if limit is not None else 2 * step

    def _fault(self) -> Column:
        series = F.coalesce(F.upper("accession"), F.lit("")).rlike(r"^GSE\d+$")
        return F.when(~series, NOT_A_SERIES).when(F.trim(F.coalesce("taxon", F.lit(""))) != self.species, OTHER_ORGANISM).otherwise("")

    def judged(self, limit: int | None = None) -> DataFrame:
        """(position, accession, taxon, title, reason, rank) of the records up to the first one beyond the limit.

        reason is '' for those that are kept; rank is their place.
        """
        each = self.seen().withColumn("fault", self._fault())
        first = each.filter("fault = ''").groupBy(F.upper("accession").alias("key")).agg(F.min("position").alias("first"))
        named = each.join(first, F.upper("accession") == F.col("key"), "left")
        reason = F.when(F.col("fault") != "", F.col("fault")).when(F.col("position") != F.col("first"), DUPLICATE).otherwise("")
        named = settled(named.select("position", F.upper("accession").alias("accession"), "taxon", "title", reason.alias("reason")))
        kept = settled(global_rank(named.filter("reason = ''").select("position"), F.col("position"), [], "rank"))
        out = named.join(kept, "position", "left")
        if limit is None:
            return out
        stop = kept.filter(F.col("rank") == limit + 1).agg(F.max("position").alias("x")).scalar()
        out = out.filter(F.col("position") <= F.coalesce(stop, F.col("position")))
        over = F.col("rank") > limit
        return out.withColumn("reason", F.when(over, OVERFLOW).otherwise(F.col("reason"))).withColumn("rank", F.when(~over, F.col("rank")))


def counts(judged: DataFrame) -> DataFrame:
    """(reason, n): records kept (reason '') and left out, by reason."""
    return judged.groupBy("reason").agg(F.count("*").alias("n"))


def scan(spark: SparkSession, pages: str, size: int, species: str, limit: int | None = None, step: int = STEP) -> DataFrame:
    """judged() of a scan with a state of its own under the shared folder."""
    return Scan(spark, pages, size, species, f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}", step).run(limit)
