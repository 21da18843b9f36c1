"""Paged scans that are cut off between pages, and what they say of each record."""

import json
import random
import re

import pytest
from concordat.sources import paged

KIND = "position bigint, accession string, taxon string, title string"


def plain(rows, species, limit):
    """(position, reason, rank) record by record, up to the first one beyond the limit."""
    out, seen = [], set()
    for k, accession, taxon, _ in rows:
        key = (accession or "").upper()
        if not re.fullmatch(r"GSE\d+", key):
            out.append((k, paged.NOT_A_SERIES, None))
        elif (taxon or "").strip() != species:
            out.append((k, paged.OTHER_ORGANISM, None))
        elif key in seen:
            out.append((k, paged.DUPLICATE, None))
        else:
            seen.add(key)
            over = limit is not None and len(seen) > limit
            out.append((k, paged.OVERFLOW if over else "", None if over else len(seen)))
            if over:
                break
    return out


def made(n, seed):
    random.seed(seed)
    return [(k, random.choice([f"gse{random.randint(1, n)}", f"GSE{k}", "GDS1", None]), random.choice(["Homo sapiens", " Homo sapiens", "Homo sapiens; Mus musculus", None]), None) for k in range(n)]


def rows_of(judged):
    return sorted((r.position, r.reason, r.rank) for r in judged.collect())


@pytest.mark.parametrize("n,size,limit,step", [(95, 10, None, 3), (95, 10, 12, 2), (95, 10, 1000, 50), (20, 7, 1, 1)])
def test_scans(spark, tmp_path, n, size, limit, step):
    rows = made(n, n + size)
    folder = f"file://{tmp_path}/pages"
    assert paged.write_pages(spark.createDataFrame(rows, KIND), folder, size) == -(-n // size)
    scan = paged.Scan(spark, folder, size, "Homo sapiens", f"{tmp_path}/state", step)
    judged = scan.run(limit)
    want = plain(rows, "Homo sapiens", limit)
    assert rows_of(judged) == want
    assert {r.reason: r.n for r in paged.counts(judged).collect()} == {x: sum(r == x for _, r, _ in want) for x in {r for _, r, _ in want}}
    read = scan.seen().agg({"page": "max"}).first()[0] + 1
    needed = want[-1][0] // size + 1
    assert needed <= read <= min(-(-n // size), needed + step)  # no more pages than the micro-batch that ended it


def test_a_restart_neither_loses_nor_repeats(spark, tmp_path, monkeypatch):
    rows = made(60, 5)
    folder = f"{tmp_path}/pages"
    paged.write_pages(spark.createDataFrame(rows, KIND), folder, 10)
    state = f"{tmp_path}/state"
    paged.Scan(spark, folder, 10, "Homo sapiens", state, 2).advance()
    assert paged.Scan(spark, folder, 10, "Homo sapiens", state, 2).seen().count() == 20
    # A micro-batch that fails behind its offset reads the same pages again.
    again = paged.Scan(spark, folder, 10, "Homo sapiens", state, 3)
    real = type(again.spark.range(1).write).parquet
    with monkeypatch.context() as m:
        m.setattr(type(again.spark.range(1).write), "parquet", lambda self, path, *a, **b: (real(self, path, *a, **b), 1 / 0))
        with pytest.raises(Exception, match="ZeroDivision"):
            again.advance()
    again = paged.Scan(spark, folder, 10, "Homo sapiens", state, 3)
    judged = again.run()
    assert rows_of(judged) == plain(rows, "Homo sapiens", None)
    assert again.seen().count() == again.seen().select("position").distinct().count() == 60


def test_lists_that_end_early(spark, tmp_path):
    rows = made(30, 6)
    folder = tmp_path / "pages"
    paged.write_pages(spark.createDataFrame(rows, KIND), str(folder), 10)
    (folder / paged.page_name(2)).unlink()
    with pytest.raises(ValueError, match="30 records"):
        paged.scan(spark, str(folder), 10, "Homo sapiens")
    short = json.loads((folder / paged.page_name(1)).read_text())
    short["records"] = short["records"][:4]
    (folder / paged.page_name(1)).write_text(json.dumps(short))
    with pytest.raises(Exception, match="incomplete"):
        paged.scan(spark, str(folder), 10, "Homo sapiens")


def test_batch_and_empty(spark, tmp_path):
    paged.write_pages(spark.createDataFrame(made(25, 7), KIND), str(tmp_path / "p"), 10)
    spark.dataSource.register(paged.RecordPages)
    got = spark.read.format("record_pages").option("path", str(tmp_path / "p")).option("size", "10").load()
    assert sorted(r.position for r in got.collect()) == list(range(25))
