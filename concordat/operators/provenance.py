"""Provenance of written tables: a digest that no partitioning changes, and a catalog held against recorded facts.

A table's digest is a keyed multiset hash: each row's SHA-256 (of a key and the row in a form that spells out columns, nulls
and lengths) is a number, and the numbers are added modulo 2^256. Order and partitions don't matter, a changed, missing or
repeated row does, and digests of parts add up to that of the whole, so an append needs the appended rows alone.

Sums are kept in LIMBS of 16 bits, each a plain sum of longs: no row meets another one but in partial sums.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.sources import ranges
from concordat.sources.sinks import redacted

LIMBS, BITS = 16, 16
MODULUS = 1 << LIMBS * BITS
#: The file of a table's folder that holds its provenance; Spark passes over names like this one.
RECORD = "_provenance.json"

# Fixed value: the only direction of effects that generated tables may have.
DIRECTION = "treatment_minus_control"


def row_text(columns: list[str]) -> Column:
    """A row spelled out: each column by name, its length in bytes and its text, or a dash for null."""
    parts = []
    for c in sorted(columns):
        value = F.col(f"`{c}`").cast("string")
        parts += [F.lit(f"{len(c)}:{c}="), F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")), F.lit(";")]
    return F.concat(*parts)


def digests(table: DataFrame, key: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, n_rows, digest: 64 hexadecimal digits) of a table, or of its groups; columns are taken by name, in any order.

    An empty table has the digest of zeros (and no groups). Columns must cast to text.
    """
    hashed = table.select(*by, F.sha2(F.concat(F.lit(f"{len(key)}:{key};"), row_text(table.columns)), 256).alias("__h"))
    limb = lambda k: F.conv(F.substring("__h", 64 - 4 * k - 3, 4), 16, 10).cast("bigint")  # noqa: E731  the k-th from the least
    summed = hashed.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(limb(k)), F.lit(0)).alias(f"__s{k}") for k in range(LIMBS)])
    # Carries go from limb to limb in one row.
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("text"))
    step = lambda a, x: F.struct(F.shiftright(a["carry"] + x, BITS).alias("carry"), F.concat(F.lpad(F.lower(F.hex((a["carry"] + x).bitwiseAND(F.lit(0xFFFF)))), 4, "0"), a["text"]).alias("text"))
    return summed.select(*by, "n_rows", F.aggregate(F.array(*[f"__s{k}" for k in range(LIMBS)]), start, step)["text"].alias("digest"))


def added(*parts: str) -> str:
    """The digest of the tables with these digests put together."""
    return f"{sum(int(x, 16) for x in parts) % MODULUS:064x}"


def record(spark: SparkSession, path: str, command: str, inputs: dict[str, str] | None = None, key: str = "", **metadata: object) -> dict:
    """Writes and returns the provenance of the Parquet table at path. inputs: digests by name."""
    found = digests(spark.read.parquet(path), key).first()
    kept = {"command": command, "n_rows": found.n_rows, "digest": found.digest, "inputs": inputs or {}, "metadata": redacted(metadata)}
    ranges.write(f"{path.rstrip('/')}/{RECORD}", (json.dumps(kept, indent=2, sort_keys=True) + "\n").encode())
    return kept


def recorded(path: str) -> dict:
    with ranges.opened(f"{path.rstrip('/')}/{RECORD}") as file:
        return json.loads(file.read())


def append(rows: DataFrame, path: str, command: str, key: str = "") -> dict:
    """Appends rows to a table with provenance: its digest grows by that of the rows, and what was there isn't read."""
    before, new = recorded(path), digests(rows, key).first()
    rows.write.mode("append").parquet(path)
    now = before | {"command": command, "n_rows": before["n_rows"] + new.n_rows, "digest": added(before["digest"], new.digest)}
    ranges.write(f"{path.rstrip('/')}/{RECORD}", (json.dumps(now, indent=2, sort_keys=True) + "\n").encode())
    return now


def verified(spark: SparkSession, path: str, key: str = "") -> bool:
    """Whether the table at path is the one that its provenance tells of."""
    found, told = digests(spark.read.parquet(path), key).first(), recorded(path)
    return (found.n_rows, found.digest) == (told["n_rows"], told["digest"])


def _whole(text: str) -> Column:
    """A positive whole number, else null."""
    value = F.trim(F.col(text)).try_cast("double")
    return F.when((value > 0) & (value < 1e15) & (value == F.floor(value)), value.cast("bigint"))


def _blank(text: str) -> Column:
    return F.col(text).isNull() | F.lower(F.trim(F.col(text))).isin("", "nan", "none", "null")


def reconciled(catalog: DataFrame, facts: DataFrame, key: str = "study_id") -> DataFrame:
    """(key, field, declared, recorded, problem): where a catalog and the facts recorded with generated tables disagree.

    catalog: key, n_ctrl, n_treat; facts: key, n_ctrl, n_treat, effect_direction, all as text; facts without counts tell
    nothing about them. Either side may lack a key: a study without facts isn't a generated one and has no problem, facts
    without a study are named.
    """
    ours = catalog.select(key, F.lit(True).alias("here"), *[F.col(c).cast("string").alias(f"d_{c}") for c in ("n_ctrl", "n_treat")])
    theirs = facts.select(key, F.lit(True).alias("there"), *[F.col(c).cast("string").alias(f"r_{c}") for c in ("n_ctrl", "n_treat")], F.trim(F.coalesce(F.col("effect_direction").cast("string"), F.lit(""))).alias("direction"))
    both = ours.join(theirs, key, "full_outer").filter("there")
    silent = F.col("r_n_ctrl").isNull() & F.col("r_n_treat").isNull()
    pair = lambda s: F.concat_ws("/", F.coalesce(f"{s}_n_ctrl", F.lit("")), F.coalesce(f"{s}_n_treat", F.lit("")))
    invalid = F.lit(False)
    for c in ("d_n_ctrl", "d_n_treat", "r_n_ctrl", "r_n_treat"):
        invalid = invalid | _whole(c).isNull()
    counts = (
        F.when(F.col("here").isNull(), "no such study")
        .when(silent, None)
        .when(F.col("r_n_ctrl").isNull() | F.col("r_n_treat").isNull(), "recorded in part")
        .when(_blank("d_n_ctrl") | _blank("d_n_treat"), "blank in the catalog")
        .when(invalid, "not a positive whole number")
        .when((_whole("d_n_ctrl") != _whole("r_n_ctrl")) | (_whole("d_n_treat") != _whole("r_n_treat")), "other counts")
    )
    # As counts that are read at all are judged before it, a direction counts where they are well-formed.
    direction = F.when(counts.isNull() | (counts == "other counts"), F.when(~silent & (F.col("direction") != "") & (F.col("direction") != DIRECTION), "another direction"))
    long = F.array(
        F.struct(F.lit("n_ctrl/n_treat").alias("field"), pair("d").alias("declared"), pair("r").alias("recorded"), counts.alias("problem")),
        F.struct(F.lit("effect_direction").alias("field"), F.lit(DIRECTION).alias("declared"), F.col("direction").alias("recorded"), direction.alias("problem")),
    )
    return both.select(key, F.explode(long).alias("x")).select(key, "x.*").filter("problem is not null")
