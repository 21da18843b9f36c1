"""Each operator does its whole job where it once did less."""

import random

import corpus_pipeline
from concordat.llm import simhash


def five_words(text):
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_alike_by_brute_force():
    rng = random.Random(5)
    for least in (0.5, 0.8, 0.95):
        texts = []
        for _ in range(20):
            base = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice((0, 1, 3, 5, 20, 120)))]
            for _ in range(rng.randrange(1, 7)):
                copy = list(base)
                for _ in range(rng.randrange(0, 4)):
                    if copy:
                        copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(10**6))
                texts.append(" ".join(copy))
        rng.shuffle(texts)
        sets = [five_words(x) for x in texts]
        label = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                if jaccard(sets[a], sets[b]) >= least and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
        assert simhash.alike([simhash.shingles(x, 5) for x in texts], least) == label


def test_near_stage_removes_only_what_is_alike(spark):
    """Every row that the near stage removes has a partner of a five-word similarity of 0.8 or more; rows at six bits and less alike stay."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    last = {r.text: r.doc_id for r in docs.select("doc_id", "text").orderBy("doc_id").collect()}
    sets = {d: five_words(x) for x, d in last.items()}
    from concordat.llm.shared import written

    rows = written(docs.filter(docs.doc_id.isin(list(sets))), "distinct")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, rows, sf).collect()}
    gone = set(sets) - kept
    assert gone and all(max(jaccard(sets[d], s) for k, s in sets.items() if k != d) >= 0.8 for d in gone)
    assert {140, 250, 588} <= kept  # six bits or less from another, 0.72, 0.46 and 0.73 alike
