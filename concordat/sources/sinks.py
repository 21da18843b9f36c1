"""Writers: score tables, workbooks, sidecars, catalogs of candidates, staged publication."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import formula_safe
from concordat.operators.serve import capped_evidence
from concordat.sources.ooxml import write_sheets

# Key parts whose values never leave in metadata.
SECRET_KEYS = ("token", "password", "secret", "api_key", "apikey", "authorization", "cookie")
MOST_EVIDENCE = 100_000


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table below folder, by Spark's committer; readers see whole tables only."""
    for name, df in tables.items():
        flat = df.select(*[F.array_join(c, ";").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]) if form == "csv" else df
        getattr(flat.write.mode("overwrite").option("header", True) if form == "csv" else flat.write.mode("overwrite"), form)(f"{folder}/{name}")


def write_sqlite(tables: dict[str, DataFrame], path: str, indexes: dict[str, Iterable[str]] | None = None) -> None:
    """A serving database: rows stream through the driver into a temporary file that replaces the old one whole."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, draft = tempfile.mkstemp(dir=folder, suffix=".sqlite")
    os.close(handle)
    try:
        with sqlite3.connect(draft) as db:
            for name, df in tables.items():
                columns = ", ".join(f'"{c}"' for c in df.columns)
                db.execute(f'create table "{name}" ({columns})')
                rows = ([v if v is None or isinstance(v, int | float | str) else str(v) for v in r] for r in df.toLocalIterator())
                db.executemany(f'insert into "{name}" values ({", ".join("?" * len(df.columns))})', rows)
                for c in (indexes or {}).get(name, ()):
                    db.execute(f'create index "{name}_{c}" on "{name}" ("{c}")')
        db.close()
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.unlink(draft)


def read_sqlite(spark, path: str, table: str) -> DataFrame:
    """A serving table as a DataFrame; small by design, so it is read on the driver."""
    with sqlite3.connect(path) as db:
        if not db.execute("select 1 from sqlite_master where type = 'table' and name = ?", (table,)).fetchone():
            raise KeyError(f"{path} has no table {table}")
        cursor = db.execute(f'select * from "{table}"')
        names = [d[0] for d in cursor.description]
        return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in cursor], ", ".join(f"`{n}` string" for n in names))


def write_workbook(path: str, scores: DataFrame, evidence: DataFrame, summary: dict[str, object], cap: int = MOST_EVIDENCE, top: int = 20) -> None:
    """Summary, first entities, all scores and the first `cap` evidence rows as a workbook; text is never run as a formula."""
    ordered = scores.orderBy("quality_rank")
    capped = capped_evidence(evidence, scores, cap)
    listed = lambda df: (df.columns, [[v if not isinstance(v, list) else ";".join(map(str, v)) for v in r] for r in df.toLocalIterator()])
    write_sheets(path, {"Summary": (["field", "value"], [[k, v if isinstance(v, int | float) else str(v)] for k, v in summary.items()]), "Top": listed(ordered.limit(top)), "Scores": listed(ordered), "Evidence": listed(capped)})


def write_safe_csv(df: DataFrame, folder: str) -> None:
    """CSV whose texts no spreadsheet runs as formulas."""
    safe = [formula_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", True).csv(folder)


def redacted(value, base: str | None = None):
    """Metadata without secrets and without paths outside base."""
    if isinstance(value, dict):
        return {k: "[redacted]" if any(s in str(k).lower() for s in SECRET_KEYS) else redacted(v, base) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [redacted(v, base) for v in value]
    return portable(value, base) if isinstance(value, str) and value.startswith("/") else value


def portable(path: str, base: str | None = None) -> str:
    """A path below base as a relative one; others by their name only."""
    if "://" in path:
        return path
    whole = Path(path)
    if base and whole.is_absolute():
        try:
            return str(whole.relative_to(base))
        except ValueError:
            return f"external:{whole.name}"
    return str(whole) if not whole.is_absolute() else f"external:{whole.name}"


def sidecar(artifact: str, command: str, inputs: Iterable[str] = (), **metadata) -> str:
    """artifact.provenance.json: the command, digests of the artifact and its inputs, metadata without secrets."""

    def digest(path: str) -> str:
        with open(path, "rb") as file:
            return hashlib.file_digest(file, "sha256").hexdigest()

    base = os.path.dirname(os.path.abspath(artifact))
    found = {"artifact": os.path.basename(artifact), "sha256": digest(artifact), "command": command, "inputs": [{"path": portable(p, base), "sha256": digest(p)} for p in inputs], "metadata": redacted(metadata, base)}
    with open(f"{artifact}.provenance.json", "w", encoding="utf-8") as file:
        json.dump(found, file, indent=2, sort_keys=True)
    return f"{artifact}.provenance.json"


def publish(staged: dict[str, str]) -> None:
    """Moves staged files to their places, all or none: what was there before comes back if a move fails."""
    kept: dict[str, str] = {}
    done: list[str] = []
    try:
        for source, target in staged.items():
            if os.path.exists(target):
                kept[target] = f"{target}.before"
                os.replace(target, kept[target])
            shutil.move(source, target)
            done.append(target)
    except OSError:
        for target in done:
            os.unlink(target)
        for target, before in kept.items():
            os.replace(before, target)
        raise
    for before in kept.values():
        os.unlink(before)
