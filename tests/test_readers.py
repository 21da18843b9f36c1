"""Small readers and column functions by name."""

from concordat.operators import classify, harmonize, records
from concordat.sources import ooxml, sinks, tables
from pyspark.sql import functions as F


def test_numeric_share(spark):
    rows = [(["1", " 2.5 ", "x", "", "NA", None, "inf"],), ([],), (["0.5", "2"],)]
    frame = spark.createDataFrame(rows, "v array<string>")
    got = [(r[0], r[1]) for r in frame.select(classify.numeric_share(F.col("v")), classify.numeric_share(F.col("v"), True)).collect()]
    assert got == [(0.5, 0.25), (0.0, 0.0), (1.0, 0.5)]


def test_entity_type_summary(spark):
    frame = spark.createDataFrame([("gene", 1), (" Gene ", 2), ("lnc", 3), (None, 4)], "kind string, k int")
    assert tuple(harmonize.entity_type_summary(frame, "kind", "gene|x").first()) == (True, 4, 2)
    assert tuple(harmonize.entity_type_summary(frame, "kind", " | ").first()) == (False, 4, 4)
    assert [r.k for r in harmonize.filter_entity_type(frame, "kind", "gene").collect()] == [1, 2]


def test_harmonized_files(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1.5, "x", True), ("B", None, "", False)], "gene_symbol string, lfc double, note string, pvalue_was_clipped boolean")
    rows.write.csv(str(tmp_path / "h.csv"), header=True)
    rows.write.parquet(str(tmp_path / "h.parquet"))
    for name in ("h.csv", "h.parquet"):
        got = tables.read_harmonized(spark, str(tmp_path / name))
        assert dict(got.dtypes)["lfc"] == "double" and dict(got.dtypes)["pvalue_was_clipped"] == "boolean"
        assert sorted((r.gene_symbol, r.lfc) for r in got.collect()) == [("A", 1.5), ("B", None)]


def test_matrix_rows(spark):
    text = ["!Series_title\tx", "!series_matrix_table_begin", "ID_REF\tGSM1", "a\t1", "", "!series_matrix_table_end"]
    lines = spark.createDataFrame(list(enumerate(text)), "line int, value string")
    assert [r.value for r in tables.matrix_rows(lines).orderBy("line").collect()] == ["ID_REF\tGSM1", "a\t1"]
    assert [r.value for r in tables.matrix_rows(lines.filter("line >= 2")).orderBy("line").collect()] == ["ID_REF\tGSM1", "a\t1"]


def test_settings_of_a_workbook(tmp_path):
    path = str(tmp_path / "s.xlsx")
    ooxml.write_sheets(path, {"Project": (["key", "value"], [["a", "1"], ["#c", "x"], ["b", None]]), "AdvancedSettings": (["key", "value"], [["a", "2"]]), "Other": (["key", "value"], [["z", "9"]])})
    assert tables.read_settings(path) == {"a": "2", "b": ""}


def test_safe_csv(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 1), ("plain", 2), ("@x", 3)], "t string, k int")
    sinks.write_safe_csv(rows, str(tmp_path / "c"))
    got = {r.k: r.t for r in spark.read.csv(str(tmp_path / "c"), header=True, inferSchema=True).collect()}
    assert got[2] == "plain" and got[1] == "'=1+1" and got[3] == "'@x"


def test_the_first_of_equal_records_counts(spark):
    ready = "struct<tier:string,priority:int,verification_state:string,basis:array<string>>"
    one = lambda c, k, tier, p, basis: (c, k, (tier, p, "v", basis))
    members = spark.createDataFrame([one(1, 2, "likely", 1, ["b"]), one(1, 1, "likely_ready", 1, ["a"]), one(2, 1, "candidate", 2, [])], f"component int, position int, data_readiness {ready}")
    merged = spark.createDataFrame([(1, ("likely", 1, "v", ["c"])), (2, ("verified_ready", 0, "v", ["d"]))], f"component int, data_readiness {ready}")
    got = {r.component: r.data_readiness for r in records.merged_readiness(members, merged).collect()}
    assert (got[1].tier, got[1].basis) == ("likely_ready", ["a", "b", "c"]) and got[2].tier == "verified_ready"


def test_budgets_are_fair(spark):
    import random

    random.seed(8)
    rows = [(s, f"{k:02d}") for s in range(20) for k in range(random.randint(0, 9))]
    frame = spark.createDataFrame(rows, "study int, name string").repartition(5)
    for most, budget in ((6, 40), (6, 1000), (2, 25), (6, 0), (1, 7)):
        got = records.inspection_budget(frame, "study", "study", [F.col("name")], most, budget).collect()
        ranked = sorted((sorted(n for t, n in rows if t == s).index(name) + 1, s, name) for s, name in rows)
        want = [x for x in ranked if x[0] <= most][:budget]
        assert sorted((r["round"], r.study, r.name) for r in got) == want
