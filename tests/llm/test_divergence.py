"""Source divergence against a plain count, and the trie by itself."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from concordat.llm import divergence, queries, tries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string"


def plain(rows, least=10, most=10):
    """rows: (text, lang, source)."""
    by_doc, count, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(found)
        by_doc.update((lang, t) for t in set(found))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted((t for (x, t), n in by_doc.items() if x == lang and n >= least), key=str.encode)
        own = sorted(s for x, s in groups if x == lang)
        v = len(kept)
        p = {}
        for s in own:
            n = sum(count[lang, s][t] for t in kept)
            p[s] = [1 + 1_000_000_000 * (count[lang, s][t] + 2) // (n + 2 * v) for t in kept]
        total = [sum(count[lang, s][t] for s in own) for t in kept]
        q = [1 + 1_000_000_000 * (c + 2) // (sum(total) + 2 * v) for c in total]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((-sum(map(f, p[s], p[o])), o.encode()) for o in own if o != s))
            out += [(lang, s, "pair", o.decode(), -x, k) for k, (x, o) in enumerate(pairs, 1)]
            best = sorted((-f(a, b), t.encode()) for a, b, t in zip(p[s], q, kept) if a > b and count[lang, s][t])
            out += [(lang, s, "term", t.decode(), -x, k) for k, (x, t) in enumerate(best[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_tries_merge_to_the_trie_of_all():
    random.seed(11)
    docs = [(["".join(random.choices("abé中", k=random.randint(1, 6))).encode() for _ in range(random.randint(0, 40))], f"s{k % 3}") for k in range(300)]
    parts, count, seen = [tries.Counting() for _ in range(4)], Counter(), Counter()
    for k, (words, source) in enumerate(docs):
        cut = random.randint(0, len(words))
        parts[k % 4].add(iter([words[:cut], words[cut:]]), source)
        if k % 50 == 0:
            parts[k % 4].fold()
        count.update((t, source) for t in words)
        seen.update(set(words))
    tables = [p.leaves("x") for p in parts]
    for t in tables:
        assert t["term"].to_pylist() == sorted(t["term"].to_pylist())
    together = pa.concat_tables(tables).sort_by([("lang", "ascending"), ("term", "ascending")])
    for size in (1, 7, 100_000):
        whole = pa.concat_tables(list(tries.merged_stream(iter(together.to_batches(max_chunksize=size)))))
        assert whole["term"].to_pylist() == sorted(seen)
        assert dict(zip(whole["term"].to_pylist(), whole["docs"].to_pylist())) == dict(seen)
        assert {(t, s): n for t, ss, ns in zip(whole["term"].to_pylist(), whole["sources"].to_pylist(), whole["counts"].to_pylist()) for s, n in zip(ss, ns)} == dict(count)
    assert tries.Counting().leaves("x").num_rows == 0 and list(tries.merged_stream(iter([]))) == []


def test_ranges_of_prefixes():
    words = sorted({"".join(random.choices("ab", k=random.randint(1, 5))).encode() for _ in range(40)} | {b"", b"zz"})
    leaves = pa.array(words, pa.binary())
    back = b""
    for word, n in zip(words, tries.shared(leaves).tolist()):
        assert back[:n] + word[n:] == word
        back = word
    for most in (1, 2, 5, 1000):
        starts = tries.prefix_ranges(leaves, most)
        assert starts[0] == 0 and all(0 < b - a <= most for a, b in zip(starts, [*starts[1:], len(words)]))
    assert tries.prefix_ranges(leaves[:0], 5) == []
    two = pa.array([b"aa1", b"aa2", b"aa3", b"b1", b"b2"], pa.binary())
    assert tries.prefix_ranges(two, 4) == [0, 3]


def test_exact_shares():
    import numpy as np

    random.seed(2)
    for _ in range(300):
        b = random.randint(1, 9 * 10**15)
        a = random.randint(0, b)
        assert int(divergence.scaled(np.array([a]), np.array([b]))[0]) == 1 + 10**9 * a // b


@pytest.mark.parametrize("held", [(400_000, 2_000_000, 1 << 22, 512, 1 << 21), (20, 10, 8, 3, 7)])
def test_against_plain(spark, held, monkeypatch):
    """Tiny limits make every task write its tries out, cut texts, pieces and blocks many times."""
    for name, n in zip(("HELD", "LOOSE", "CUT", "PIECE", "BLOCK"), held):
        monkeypatch.setattr(divergence, name, n)
    random.seed(7)
    words = ["été", "The", "the", "x'y", "Ünder", "中文", "a1b", "zoo", "Zoo", "\U00010428", "￿"] + [f"w{c}{d}" for c in "abc" for d in "xyzé"]
    rows = [(" ".join(random.choices(words, k=random.randint(0, 30))), random.choice(["en", "fr"]), random.choice(["a", "b", "c", "é", "Z"])) for _ in range(150)]
    rows += [(None, "en", "none"), ("", None, None), ("only once", "xx", "a"), ("only once", "xx", "b"), ("123 !!", "en", None), ("same " * 50, "en", "a")]
    rows += [("dup text", "yy", "a")] * 12 + [("dup text", "yy", "")] * 2
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], DOCS).selectExpr("*", "'clash' as item", "'clash' as piece", "1 as rank")
    assert rows_of(divergence.audit(frame.repartition(5))) == plain(rows)


def test_no_terms_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b", "en", "x"), (2, None, "en", "y")], DOCS)
    assert rows_of(divergence.audit(frame)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_long_text(spark):
    text = ("Wort " * 300_000) + "e" * 5_000_000
    rows = [(text, "de", "a"), ("Wort", "de", "b")] * 5
    got = rows_of(divergence.audit(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], DOCS), least=5))
    assert got == plain(rows, least=5)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert rows_of(queries.op11_source_divergence(spark, sf)) == plain([(r.text, r.lang, r.source) for r in docs])
