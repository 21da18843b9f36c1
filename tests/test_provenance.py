"""Table digests and reconciliation."""

import hashlib
import random

from concordat.operators import provenance
from pyspark.sql import functions as F

KIND = "a string, b bigint, c string"


def plain(rows, key=""):
    total = 0
    for r in rows:
        text = "".join(f"{len(c)}:{c}=" + ("-" if v is None else f"{len(str(v).encode())}:{v}") + ";" for c, v in zip("abc", r))
        total += int(hashlib.sha256(f"{len(key)}:{key};{text}".encode()).hexdigest(), 16)
    return len(rows), f"{total % (1 << 256):064x}"


def of(df, key=""):
    return tuple(provenance.digests(df, key).first())


def test_digests(spark):
    random.seed(1)
    rows = [(random.choice(["x", "é", None, "", "a;b"]), random.choice([None, k]), f"t{k % 7}") for k in range(400)]
    table = spark.createDataFrame(rows, KIND)
    want = plain(rows, "k")
    for other in (table, table.repartition(7), table.orderBy(F.desc("c")), table.select("c", "a", "b"), table.coalesce(1)):
        assert of(other, "k") == want
    assert of(table, "other") != want and of(table.unionAll(table.limit(1)), "k") != want
    changed = [*rows[:-1], (rows[-1][0], -1, rows[-1][2])]
    assert of(spark.createDataFrame(changed, KIND), "k")[1] != want[1]
    assert of(table.filter("false")) == (0, "0" * 64)
    assert provenance.added(plain(rows[:150], "k")[1], plain(rows[150:], "k")[1]) == want[1]
    by = {r.c: (r.n_rows, r.digest) for r in provenance.digests(table, "k", by=("c",)).collect()}
    assert by == {c: plain([r for r in rows if r[2] == c], "k") for c in {r[2] for r in rows}}
    assert provenance.added(*[d for _, d in by.values()]) == want[1]
    # A cell can't run over into its neighbour.
    assert of(spark.createDataFrame([("1:x;1:b=", None, "")], KIND)) != of(spark.createDataFrame([("1:x", None, "")], KIND))


def test_records_of_written_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([("x", 1, "y"), (None, 2, "z")], KIND)
    table.write.parquet(path)
    kept = provenance.record(spark, path, "make t", {"input": "0" * 64}, password="p", n=3)
    assert kept["n_rows"] == 2 and kept["metadata"] == {"password": "[redacted]", "n": 3} and provenance.recorded(path) == kept
    assert provenance.verified(spark, path) and spark.read.parquet(path).count() == 2
    more = spark.createDataFrame([("x", 1, "y")], KIND)
    now = provenance.append(more, path, "make t again")
    assert now["n_rows"] == 3 and provenance.verified(spark, path) and now["digest"] == of(spark.read.parquet(path))[1]
    more.write.mode("append").parquet(path)
    assert not provenance.verified(spark, path)


def test_reconciliation(spark):
    catalog = spark.createDataFrame([("a", "3", "4"), ("b", "3.0", "4"), ("c", "", "4"), ("d", "3", "x"), ("e", "2", "4"), ("f", "2", "4"), ("g", "2", "4"), ("h", "2", "4"), ("i", None, None)], "study_id string, n_ctrl string, n_treat string")
    d = provenance.DIRECTION
    facts = spark.createDataFrame([("a", "3", "4", d), ("b", "3", "4", None), ("c", "3", "4", ""), ("d", "3", "4", "x"), ("e", "3", "4", "reversed"), ("f", None, "4", "x"), ("g", None, None, "x"), ("z", "1", "1", "x"), ("i", "0", "1", "")], "study_id string, n_ctrl string, n_treat string, effect_direction string")
    got = {(r.study_id, r.field): r.problem for r in provenance.reconciled(catalog, facts).collect()}
    n = "n_ctrl/n_treat"
    assert got == {("c", n): "blank in the catalog", ("d", n): "not a positive whole number", ("e", n): "other counts", ("e", "effect_direction"): "another direction", ("f", n): "recorded in part", ("z", n): "no such study", ("i", n): "blank in the catalog"}
    assert provenance.reconciled(catalog.limit(0), facts.limit(0)).count() == 0
