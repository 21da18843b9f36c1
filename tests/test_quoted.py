"""Quoted tables in splits: against the csv module, at every split size."""

import csv
import io
import random

import pytest
from concordat.functions.automaton import Automaton
from concordat.plans.bridge import table
from concordat.sources import quoted, ranges, tables

CELLS = ["", "a", "é", "x,y", 'say "hi"', "two\nlines", "win\r\nlines", '"', '""', "中文,\n\n", " lead", "trail ", "1.5", "\ttab", "semi;colon", "'s"]


def plain(text, mark=","):
    """(line, cells) as the csv module reads them, lines counted by line feeds."""
    out, line = [], 1
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=mark)
    lines = text.split("\n")
    for row in reader:
        if row:
            out.append((line, row))
        line = reader.line_num + 1
    assert line - 1 <= len(lines)
    return out


def made(seed, rows=60, quote=csv.QUOTE_MINIMAL, end="\n"):
    random.seed(seed)
    out = io.StringIO()
    writer = csv.writer(out, quoting=quote, lineterminator=end)
    for _ in range(rows):
        writer.writerow([random.choice(CELLS).replace("\r\n", "\n") for _ in range(random.randint(2, 5))])
    return out.getvalue()


def as_cells(found):
    return [(line, [x or "" for x in cells]) for line, cells in found]


@pytest.mark.parametrize("seed,quote,end", [(1, csv.QUOTE_MINIMAL, "\n"), (2, csv.QUOTE_ALL, "\n"), (3, csv.QUOTE_MINIMAL, "\r\n"), (4, csv.QUOTE_NONNUMERIC, "\n")])
def test_every_split_of_a_file(tmp_path, seed, quote, end):
    text = made(seed, 25, quote, end)
    if seed == 4:
        text = text.rstrip("\n") + "\n\n\n" + "last,row"
    data = text.encode()
    (tmp_path / "t.csv").write_bytes(data)
    want = [(line, row) for line, row in plain(text) if any(row) or len(row) > 1]
    with ranges.opened(str(tmp_path / "t.csv")) as file:
        for size in (1, 3, 7, 50, len(data)):
            state, line, got = quoted.RECORD_START, 1, []
            for at in range(0, len(data), size):
                part = data[at : at + size]
                got += quoted.parsed(file, at, len(part), state, line, b",")
                state = quoted.READER.function(quoted.symbols(part, b","))[state]
                line += part.count(b"\n")
            assert as_cells(got) == want, size


def test_automaton_equals_steps():
    random.seed(9)
    step = [[random.randrange(4) for _ in range(3)] for _ in range(4)]
    machine = Automaton(lambda s, x: step[s][x], 4, 3)
    import numpy as np

    for n in (0, 1, 255, 256, 257, 5000):
        symbols = np.array([random.randrange(3) for _ in range(n)], np.uint8)
        for first in range(4):
            before, now = [], first
            for x in symbols:
                before.append(now)
                now = step[now][x]
            got, last = machine.states(symbols, first)
            assert got.tolist() == before and last == now == machine.function(symbols)[first]


def test_cells():
    assert [quoted.cell(x) for x in (b"", b'""', b'"a""b"', b'"a"b"c', b'a"b', b'""""', b'"open')] == [None, "", 'a"b', 'ab"c', 'a"b', '"', "open"]


def test_records_of_several_files(spark, tmp_path):
    texts = {f"{k}.csv": made(10 + k) for k in range(4)} | {"empty.csv": "", "bom.csv": "﻿a,b\n1,\"x\ny\"\n", "open.csv": 'a,b\n1,"never\nclosed'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    for size in (16, 100_000):
        got = {}
        for r in quoted.records(spark, str(tmp_path), length=size).collect():
            got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line, [x or "" for x in r.cells]))
        for name, text in texts.items():
            assert sorted(got.get(name, [])) == plain(text.removeprefix("﻿")), (name, size)


def test_header_by_line_number(spark, tmp_path):
    lines = '# made by hand\n"a note,\nof two lines"\n\ngene,"desc, long",lfc\nTP53,"x, y",2.0\nVEGFA,"two\nlines",-1\n'
    (tmp_path / "t.csv").write_text(lines)
    got = tables.read_after_header(spark, str(tmp_path / "t.csv"), 5, order=True)
    assert got.columns == ["gene", "desc, long", "lfc", "source_order"]
    assert [tuple(r)[:3] for r in got.orderBy("source_order").collect()] == [("TP53", "x, y", "2.0"), ("VEGFA", "two\nlines", "-1")]
    assert tables.read_after_header(spark, str(tmp_path / "t.csv"), 4).columns == got.columns[:3]  # the next record's line
    assert [r.gene for r in tables.read_after_header(spark, str(tmp_path / "t.csv"), 5).filter("lfc > 0D").collect()] == ["TP53"]
    found = quoted.Table(spark, str(tmp_path / "t.csv"), ",", 5, length=8)  # the header lies behind the splits that begin before its line
    assert found.header == ["gene", "desc, long", "lfc"] and found.sample == ["TP53", "x, y", "2.0"] and found.rows(found.header).count() == 2


def test_documents_round_trip(spark, sf, tmp_path):
    """Whole texts with quotes, delimiters and line breaks, written by Spark and read back in small splits."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    docs.repartition(2).write.csv(str(tmp_path / "d"), header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    found = quoted.Table(spark, [str(p) for p in (tmp_path / "d").glob("part-*")], length=5000)
    got = {int(r.doc_id): (r.text, r.lang) for r in found.rows(found.header).collect()}
    assert got == {r.doc_id: (r.text, r.lang) for r in docs.collect()}
