"""Several written tables that change together: immutable files, and one manifest that says which of them count.

A version's tables are written below data/, each under a name of its own, and nothing there is ever changed. The version
begins with its manifest manifests/00000001.json, ..., which is written under a draft's name and renamed, and the rename fails
where the name is taken. So readers see the former version or the new one whole, a writer that stops at any step leaves what
was there, and of two writers that began from one version the second one is told so.

A reader names a version once and keeps to it, whatever is published meanwhile. vacuum() removes what no kept manifest names.

Defined results: a folder without a manifest is version 0 and has no tables. A table that a commit doesn't give stays as the
version before had it; None takes it away.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_MANIFEST = re.compile(r"(\d{8})\.json$")


class Conflict(RuntimeError):
    """Another writer has published the version that this one wanted to."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self._system = self._path("").getFileSystem(self._hadoop)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        """The published versions, in order."""
        place = self._path("manifests")
        if not self._system.exists(place):
            return []
        names = [x.getPath().getName() for x in self._system.listStatus(place)]
        return sorted(int(m[1]) for n in names if (m := _MANIFEST.fullmatch(n)))

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "tables": {name: {"path", "schema"}}, "metadata"} of a version, the latest by default."""
        version = self.latest() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "metadata": {}}
        stream = self._system.open(self._path(f"manifests/{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version; the version is looked up once, so the frame never mixes two."""
        kept = self.manifest(version)["tables"][name]
        return self.spark.read.schema(kept["schema"]).parquet(f"{self.folder}/{kept['path']}")

    def stage(self, tables: dict[str, DataFrame]) -> dict[str, dict]:
        """Writes tables that no version names yet."""
        staged = {}
        for name, table in tables.items():
            path = f"data/{name}-{uuid.uuid4().hex}"
            table.write.parquet(f"{self.folder}/{path}")
            staged[name] = {"path": path, "schema": _ddl(table)}
        return staged

    def publish(self, staged: dict[str, dict | None], base: int, **metadata: object) -> int:
        """Makes the staged tables the version after base; Conflict where there is such a version already."""
        tables = {k: v for k, v in (self.manifest(base)["tables"] | staged).items() if v is not None}
        version = base + 1
        draft = self._path(f"manifests/.draft-{uuid.uuid4().hex}")
        out = self._system.create(draft)
        try:
            out.write(bytearray(json.dumps({"version": version, "tables": tables, "metadata": metadata}, indent=2, sort_keys=True).encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system.getUri(), self._hadoop)
        no_options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, self._path(f"manifests/{version:08d}.json"), no_options)
        except Py4JJavaError as why:
            self._system.delete(draft, False)
            if "FileAlreadyExists" in str(why.java_exception):
                raise Conflict(f"{self.folder} has a version {version} already") from None
            raise
        return version

    def commit(self, tables: dict[str, DataFrame | None], base: int | None = None, **metadata: object) -> int:
        """Writes tables and publishes them together, after the version `base` that they were made from (the latest by default)."""
        base = self.latest() if base is None else base
        given = {k: t for k, t in tables.items() if t is not None}
        return self.publish(self.stage(given) | {k: None for k, t in tables.items() if t is None}, base, **metadata)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the last `keep` versions and what they don't name; for when no writer is at work. Gives what went."""
        kept = self.versions()[-keep:] if keep else []
        named = {t["path"].removeprefix("data/") for v in kept for t in self.manifest(v)["tables"].values()}
        for v in self.versions():
            if v not in kept:
                self._system.delete(self._path(f"manifests/{v:08d}.json"), False)
        place, gone = self._path("data"), []
        for x in self._system.listStatus(place) if self._system.exists(place) else []:
            if (name := x.getPath().getName()) not in named:
                self._system.delete(x.getPath(), True)
                gone.append(name)
        return sorted(gone)


def _ddl(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
