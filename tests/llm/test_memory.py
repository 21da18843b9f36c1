"""What an executor holds beside its heap: Python workers of one kind, with a small coder each."""

import os
import subprocess
import sys

from concordat.llm import exact_stream

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Encodes 6,000 texts of 600 words, of which half are new, as a worker does; prints the MB that were added at most.
CODER = """
import random, re, sys
import numpy, pandas, pyarrow as pa, pyspark.worker
from pyspark.sql import functions as F
import public_tokenizers
from concordat.llm import bpe, queries

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Docs:
    def select(self, *columns):
        return self
    class schema:
        fields = [None]
    def mapInArrow(self, run, schema):
        return run

bpe.whole = lambda text: F
F.alias = lambda name: None
lexicon = sys.argv[1] + "/lexicon"
path = public_tokenizers.path(queries.BPE_50K)
open(lexicon, "wb").write(bpe.compile_lexicon({b" the": [262]}))
bpe.SparkFiles.get = lambda name: lexicon
run = bpe._mapped(Docs(), path, "lexicon", "text", (), False)
draw, most, before = random.Random(1), 0, held()

def batches():
    for k in range(6):
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{draw.randrange(20000)}" if draw.random() < 0.5 else f"v{draw.randrange(10**7)}" for _ in range(600)) for _ in range(1000)])], ["text"])

for out in run(batches()):
    most = max(most, held() - before)
print(most)
"""


def python_kinds(monkeypatch, spark, work):
    """The frames that work writes whose plan has a stage of Python's RDDs."""
    kind = type(spark.range(0))
    found, write = [], kind.write.fget

    def seen(frame):
        if "PythonRDD" in frame._jdf.queryExecution().toRdd().toDebugString():
            found.append(frame.columns)
        return write(frame)

    monkeypatch.setattr(kind, "write", property(lambda frame: seen(frame)))
    work()
    return found


def test_an_ingest_has_python_workers_of_one_kind(spark, monkeypatch):
    docs = spark.range(6).selectExpr("id as doc_id", "cast(id % 4 as string) as text")
    dedup = exact_stream.ExactDedup(spark)
    assert python_kinds(monkeypatch, spark, lambda: dedup.rows(dedup.ingest(docs)).write.format("noop").mode("overwrite").save()) == []
    for frame in (exact_stream.no_rows(spark, "a binary, b struct<c:int,d:string>"), exact_stream.paths_of(spark, [])):
        assert frame.count() == 0
    assert exact_stream.no_rows(spark, "a binary, b int").dtypes == [("a", "binary"), ("b", "int")]
    assert [r.path for r in exact_stream.paths_of(spark, ["a", "é#"]).collect()] == ["a", "é#"]


def test_a_coder_is_small(tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)}
    ran = subprocess.run([sys.executable, "-c", CODER, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 100
