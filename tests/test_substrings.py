"""Substring search by trigrams against a search of all names."""

import random

from concordat.operators import substrings
from pyspark.sql import functions as F


def test_search(spark, tmp_path):
    random.seed(3)
    names = ["".join(random.choices("abcé ", k=random.randint(0, 12))) for _ in range(600)] + [None, "", "aaaa", "ABCabc", "%_x"]
    table = spark.createDataFrame(list(enumerate(names)), "id int, name string").withColumn("trigram", F.lit("clash")).repartition(3)
    substrings.build(table, "name", str(tmp_path / "i"))
    index = substrings.Substrings(spark, str(tmp_path / "i"), "name")
    for text in ("abc", "aaa", "aaaa", "é a", "ab", "", "%_x", "none there", "BCA", "caca"):
        got = sorted(r.id for r in index.search(text).collect())
        assert got == [k for k, n in enumerate(names) if n is not None and text.lower() in n.lower()], text
    assert index.search("abc").columns == table.columns
    few = index.candidates("abcabc").count()
    assert 0 < few < 30
    scan = index.candidates("abc")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in scan and "trigram" in scan.split("PushedFilters: [")[1].split("]")[0]
    substrings.build(table.limit(0), "name", str(tmp_path / "none"))
    assert substrings.Substrings(spark, str(tmp_path / "none"), "name").search("abc").count() == 0
