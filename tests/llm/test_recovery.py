"""Ingests of the deduplicating store that were cut off, and what its hits read."""

import os

import pytest
from concordat.llm import exact_stream, shared
from concordat.llm.shared import FILE, ROW, located, only, scratch, without

KIND = "doc_id bigint, text string"


def stored(spark, rows, files=1):
    path = scratch(spark, "table")
    spark.createDataFrame(rows, KIND).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def as_now(dedup, one):
    return sorted((r.id, r.stays.id, r.n) for r in dedup.rows(one).collect())


class Cut(Exception):
    pass


def cut(*_):
    raise Cut


def test_a_failed_landing_counts_for_nothing(spark):
    dedup = exact_stream.ExactDedup(spark)
    docs = stored(spark, [(1, "a"), (2, "a"), (3, "b")])
    dedup._list(located(docs).inputFiles(), f"{dedup.folder}/begun/ingest=1")
    left = f"{dedup.folder}/landed/ingest=1".removeprefix("file:").replace("///", "/")
    os.makedirs(f"{left}/_temporary/0")
    dedup._rows(located(stored(spark, [(9, "a")]))).drop("body").write.parquet(f"{dedup.folder}/elsewhere")
    for name in os.listdir(at := f"{dedup.folder}/elsewhere".removeprefix("file:").replace("///", "/")):
        if name.startswith("part-"):
            os.rename(f"{at}/{name}", f"{left}/{name}")  # part of a landing that no mark of success ends
    assert as_now(dedup, dedup.ingest(docs)) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


@pytest.mark.parametrize("step", ["_advance", "_collided"])
def test_other_documents_after_a_cut(spark, step, monkeypatch):
    """The ingest that had landed is ended from its own files; the call's documents are the next ingest."""
    dedup = exact_stream.ExactDedup(spark)
    first, second = stored(spark, [(1, "a"), (2, "b"), (3, "c")]), stored(spark, [(7, "a"), (8, "d"), (9, "b")])
    with monkeypatch.context() as m:
        m.setattr(dedup, step, cut)
        with pytest.raises(Cut):
            dedup.ingest(first)
    one = dedup.ingest(second)
    assert one.number == 2 and as_now(dedup, one) == [(7, 7, 2), (8, 8, 1), (9, 9, 2)]
    assert as_now(dedup, exact_stream.Ingest(1, located(first))) == [(1, 7, 2), (2, 9, 2), (3, 3, 1)]


@pytest.mark.parametrize("step", ["_advance", "_collided"])
def test_the_same_documents_after_a_cut(spark, step, monkeypatch):
    dedup = exact_stream.ExactDedup(spark)
    docs = stored(spark, [(1, "a"), (2, "a")])
    with monkeypatch.context() as m:
        m.setattr(dedup, step, cut)
        with pytest.raises(Cut):
            dedup.ingest(docs)
    one = dedup.ingest(docs)
    assert one.number == 1 and as_now(dedup, one) == [(1, 2, 2), (2, 2, 2)]


def test_a_cut_before_landing_forgets_the_ingest(spark, monkeypatch):
    dedup = exact_stream.ExactDedup(spark)
    with monkeypatch.context() as m:
        m.setattr(dedup, "_end", cut)
        with pytest.raises(Cut):
            dedup.ingest(stored(spark, [(1, "a")]))
    one = dedup.ingest(stored(spark, [(7, "a")]))
    assert one.number == 1 and as_now(dedup, one) == [(7, 7, 1)]


def test_hits_open_only_the_files_they_name(spark, monkeypatch):
    """Of two earlier ingests with six files, the third one's hits lie in one."""
    dedup, opened = exact_stream.ExactDedup(spark), []
    dedup.ingest(stored(spark, [(k, f"text {k}") for k in range(30)], 3))
    dedup.ingest(stored(spark, [(k, f"text {k}") for k in range(30, 60)], 3))
    own = dedup._bodies
    monkeypatch.setattr(dedup, "_bodies", lambda places: opened.extend(r[0] for r in places.select(FILE).distinct().collect()) or own(places))
    one = dedup.ingest(stored(spark, [(100, "text 5"), (101, "new")]))
    assert len(opened) == 1 and as_now(dedup, one) == [(100, 100, 2), (101, 101, 1)]


def test_places(spark):
    docs = located(stored(spark, [(k, str(k)) for k in range(100)], 4))
    some = docs.filter("doc_id % 3 = 0").select(FILE, ROW)
    assert sorted(r.doc_id for r in without(docs, some).collect()) == [k for k in range(100) if k % 3]
    assert sorted(r.doc_id for r in only(docs, some).collect()) == list(range(0, 100, 3))
    assert without(docs, some.filter("false")).count() == 100 and only(docs, some.filter("false")).count() == 0
    assert "Exchange" not in without(docs, some)._jdf.queryExecution().executedPlan().toString()
    assert shared._rows_of(scratch(spark, "none"), 1) == {}
