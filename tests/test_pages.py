"""Pages by an order-statistic index."""

import random

import pytest
from concordat.operators import pages, records
from concordat.operators.ranking import global_rank
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def ranked(spark):
    random.seed(4)
    rows = [(k, random.choice([None, "x", "y", f"t{k}"])) for k in range(503)]
    return global_rank(spark.createDataFrame(rows, "id int, title string"), F.col("title"), [F.col("id")], "rank").persist()


@pytest.mark.parametrize("rows", [50, 7, 1000])
def test_pages_equal_the_ranked_table(spark, tmp_path, ranked, rows):
    path = str(tmp_path / "index")
    pages.build(ranked, path, rows=rows)
    index = pages.Index(spark, path)
    assert index.checked()
    for number, size in ((1, 20), (3, 20), (25, 20), (26, 20), (1, 1), (99, 20), (0, 7)):
        want, totals = records.page(ranked, number, size)
        got, told = index.page(number, size)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.select(got.columns).collect()]
        assert told.first().asDict() == totals.first().asDict()
        first = (max(1, number) - 1) * size + 1
        if rows >= size:
            opened = index.files(first, first + size - 1)
            assert len(opened) <= 2 and sorted(x.replace("file:///", "file:/") for x in got.inputFiles()) == sorted(opened)


def test_empty_and_broken(spark, tmp_path, ranked):
    pages.build(ranked.limit(0), str(tmp_path / "none"))
    index = pages.Index(spark, str(tmp_path / "none"))
    assert index.page(1, 20)[0].count() == 0 and index.page(1, 20)[1].first().total_records == 0 and index.checked()
    pages.build(ranked.filter("rank <> 77"), str(tmp_path / "gap"), rows=50)
    assert not pages.Index(spark, str(tmp_path / "gap")).checked()
