import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from concordat.llm import queries, simhash
from concordat.llm.components import components

DOCS = "doc_id bigint, text string"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [x for x in words.split(" ") if x]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    values = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_roots(values, radius=3):
    """Each value's smallest reachable index."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(len(values))]


def test_fingerprint_by_hand():
    for text in ("", " \n", "One", "one two", "A b C d e\tf\x0bg", "x " * 500, "é\xa0ß İ word", "ab\x1fcd e f"):
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text), text


def test_fingerprint_of_blocks(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(1000))
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def masks_of(level, radius):
    masks = [0]
    for _ in range(level):
        masks = [m for above in masks for m in simhash.masks_below(above, radius)]
    return masks


@pytest.mark.parametrize("level", [1, 2, 3])
def test_masks_cover_every_pair(level):
    random.seed(level)
    masks = masks_of(level, 3)
    assert len(masks) == 15**level
    for _ in range(300):
        differing = sum({1 << b for b in random.sample(range(64), random.randint(0, 3))})
        assert any(not m & differing for m in masks)


@pytest.mark.parametrize("radius,most", [(3, 8), (6, 15)])
def test_last_level_is_bounded(radius, most):
    """A level's free bits depend on the number of free bits above alone."""
    free = {64}
    for _ in range(3):
        free = {n - m.bit_count() for n in free for m in simhash.covering(list(range(n)), radius)}
    assert max(free) <= most


@pytest.mark.parametrize("radius", [1, 2, 5, 6])
def test_masks_of_other_radii(radius):
    random.seed(radius)
    masks = simhash.covering(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 24
    for _ in range(300):
        differing = sum({1 << b for b in random.sample(range(64), radius)})
        assert any(not m & differing for m in masks)


def test_large_buckets_in_blocks():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 14, 6000).astype(np.uint64))
    links = simhash.local_links(values, 1)
    roots = {b: a for a, b in links}
    assert len(links) == len(roots) <= len(values) - 1
    small = values[:300]
    found = dict((b, a) for a, b in simhash.local_links(small, 3))
    want = brute_roots([int(x) for x in small])
    assert [int(found.get(int(x), int(x))) for x in small] == [int(small[k]) for k in want]


@pytest.mark.parametrize("crowd,radius", [(1024, 3), (4, 3), (2, 3), (1024, 6), (14, 6)])
def test_links_connect_what_brute_force_connects(spark, crowd, radius):
    rng = np.random.default_rng(5)
    values = list(map(int, rng.integers(0, 1 << 63, 60)))
    for v in values[:4]:  # dense groups
        values += [v ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, radius + 2), replace=False)) for _ in range(40)]
    values = sorted(set(values))
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    links = simhash.near_links(frame, radius, crowd=crowd)
    root = {r.node: r.root for r in components(links).collect()}
    ours = [root.get(simhash._signed(v), simhash._signed(v)) for v in values]
    want = brute_roots(values, radius)
    assert len(set(zip(ours, want))) == len(set(ours)) == len(set(want))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    values = [brute_fingerprint(r["text"]) for r in rows]
    roots = brute_roots(values)
    want = {(r["doc_id"], f"{v:016x}", rows[k]["doc_id"]) for r, v, k in zip(rows, values, roots)}
    assert {tuple(r) for r in queries.op7_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "x" * 300_000), (None, "alone here")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}
    assert {c for _, c in by[5]} == {5} and len(by[None]) == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0


def test_keep_first_keeps_one_of_each(spark):
    rows = [(3, "a b c d", 1), (2, "a b c d", 2), (2, "A b c d", 3), (None, "a b c d", 4), (9, "quite another text here", 5)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, first int")).collect()
    assert sorted(r.doc_id for r in kept) == [2, 9] and set(kept[0].asDict()) == {"doc_id", "text", "first"}


def jaccard(a, b, size=5):
    def sets(text):
        words = text.lower().split()
        return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or {tuple(words)}

    return len(sets(a) & sets(b)) / len(sets(a) | sets(b))


@pytest.mark.parametrize("block", [1 << 24, 700])
def test_compared_texts_by_blocks(spark, block, monkeypatch):
    """Links count by the texts themselves, and blocks change nothing. All texts are proposed as one component."""
    from concordat.llm.shared import FILE, ROW
    from pyspark.sql import functions as F

    one = F.struct(F.lit(False).alias("absent"), F.lit(0).alias("id"), F.lit("").alias(FILE), F.lit(0).alias(ROW))
    monkeypatch.setattr(simhash, "classed", lambda rows, **_: rows.withColumn("first", one))
    random.seed(4)
    base = [f"w{random.randint(0, 999)}" for _ in range(60)]
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        words = list(base)
        for at in random.sample(range(60), random.randint(0, 4)):
            words[at] = f"x{k}{at}"
        rows.append((k, " ".join(words)))
    kept = sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string"), similarity=0.8, block=block).collect())
    root = list(range(len(rows)))
    for _ in rows:  # spread the least label along exact links
        for a, x in rows:
            for b, y in rows:
                if jaccard(x, y) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    assert kept == sorted(set(root)) and 1 < len(kept) < 40
