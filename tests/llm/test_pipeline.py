from array import array
from collections import Counter

import corpus_pipeline
import duckdb
from concordat.llm import queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import test_simhash


def test_stages_by_brute_force(spark):
    """On whole tables each stage's output is what brute force says, and the next one works on it."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    before = []

    def run(name):
        nonlocal docs
        from concordat.llm.shared import written

        before.append(docs)
        docs = written(dict(corpus_pipeline.STAGES)[name](spark, docs, sf), name)
        return docs

    assert run("language").count() == len(rows)  # all documents are in known languages
    last = {}
    for d, r in sorted(rows.items()):
        last[r.text] = d
    assert sorted(r.doc_id for r in run("exact").collect()) == sorted(last.values())
    kept = sorted(last.values())
    values = [brute(rows[d].text) for d in kept]
    roots = test_simhash.brute_roots(values, corpus_pipeline.NEAR_RADIUS)
    near = sorted(set(kept) - brute_later(kept, roots, rows))
    assert len(near) < len(kept) and sorted(r.doc_id for r in run("near").collect()) == near
    assert {r.doc_id for r in run("mix").collect()} == set(near)
    assert Counter(r.doc_id for r in docs.collect()) == readings(before[-1].toPandas())
    assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    own = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    for r in run("encode").collect():
        ids = own.encode(rows[r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == array("I", ids).tobytes()


def readings(documents):
    """How often the mix reads each document, by SQL over the table that the stage was given."""
    with duckdb.connect() as con:
        con.register("documents", documents)
        return dict(con.execute(f"select doc_id, count(*) from ({queries.ORACLE_SQL['op3_temperature_mix']}) group by 1").fetchall())


def brute_later(kept, roots, rows):
    """Documents that follow another of those they reach by exact links within a component of fingerprints."""
    groups = {}
    for d, root in zip(kept, roots):
        groups.setdefault(root, []).append(d)
    gone = set()
    for group in groups.values():
        first = {d: d for d in group}
        for _ in group:
            for a in group:
                for b in group:
                    if first[a] != first[b] and test_simhash.jaccard(rows[a].text, rows[b].text) >= corpus_pipeline.NEAR_SIMILARITY:
                        first[a] = first[b] = min(first[a], first[b])
        gone |= {d for d in group if first[d] != d}
    return gone


def test_odd_rows_pass_through(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns; then empty tables."""
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(None, None, None, None, None), (900_001, None, "en", None, 0), (900_002, "", None, "a", 0), (900_003, "the " * 300_000, "en", "a", 1), (900_003, "x", "en", "a", 1), (900_003, "x", "en", "a", 1)]
    docs = prose.unionByName(spark.createDataFrame(odd, prose.schema))
    for c in ("ids", "n_tokens", "kept", "block", "digest", "row", "vote", "fp"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.unionByName(spark.createDataFrame([(None, None, None)], pages.schema)).write.parquet(f"{tmp_path}/pages.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(got.columns) == sorted([c for c in docs.columns if c != "text"]) and got.count() >= 100
    assert {r.kept for r in got.select("kept").collect()} == {"clash"} and got.filter("doc_id is null or doc_id in (900001, 900002)").count() == 0
    bare = tmp_path / "bare"
    prose.limit(0).write.parquet(f"{bare}/documents.parquet")
    pages.limit(0).write.parquet(f"{bare}/pages.parquet")
    assert corpus_pipeline.run(spark, str(bare)).count() == 0


def brute(text):
    from concordat.llm.simhash import fingerprint

    return fingerprint(text) % (1 << 64)


def test_pipeline_is_a_query(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and 4 <= len(corpus_pipeline.STAGES) <= 5
