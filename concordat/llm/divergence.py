"""Source divergence audit: how differently the sources of a language use its terms, and which terms mark a source.

Each task counts its documents in byte tries, one for a language, whose leaves have a counter for each source (see
tries.py). Spark deals the leaves of all tries to ranges of (language, term), so the part of every trie that lies between
two prefixes meets in one task, in order; tries merge there leaf by leaf. Kept leaves stay in this order and are cut into
ranges of prefixes, pieces of PIECE terms at most; each piece meets the totals of its language's sources and gives every pair's share of the divergence
and each source's best terms, whose ties the order of traversal breaks.

Memory: a task's tries are written out at HELD terms, LOOSE words are counted at once; merging holds a batch of leaves, a
piece's share PIECE x sources numbers, in blocks of BLOCK. The pairs of sources of a language are the result and so bound
what is summed. A task tells up to 2^20 sources of a language apart before it writes its tries out.

Defined results: null text, language or source count as ''. Every group (language, source) that occurs is compared, also
without terms; a language without kept terms has value 0 for each pair and no terms. Repeated rows count as documents of
their own. Texts are read whole, long ones in cuts at a border of terms. All arithmetic is in integers. An empty table gives
an empty result. Columns other than text, language and source are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.shared import cogrouped, whole, written
from concordat.llm.tries import LEAF, Counting, merged_stream, prefix_ranges

#: Terms that a task holds before its tries are written out, and words that it counts at once.
HELD, LOOSE = 400_000, 2_000_000
#: Bytes of a text that are split at once.
CUT = 1 << 22
#: Sources of a language in one trie at most.
SOURCES = 1 << 20
#: Kept terms of a piece, numbers of a block, and into how many parts the totals of a language are dealt.
PIECE, BLOCK, SALT = 512, 1 << 21, 16
#: p is counted in these parts; each count has this much added.
SCALE, ADDED = 1_000_000_000, 2

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
KEPT = "lang string, piece string, term binary, n bigint, sources array<string>, counts array<bigint>"
SHARE = "lang string, source string, part string, item binary, value bigint"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text's UTF-8 in runs: letters and all beyond ASCII, A-Z lower-cased."""
    text = text.translate(_LETTERS)
    at = 0
    while len(text) - at > CUT:
        to = text.rfind(b" ", at, at + CUT)
        to = to if to > at else text.find(b" ", at + CUT)
        if to < 0:
            break
        yield text[at:to].split()
        at = to
    yield text[at:].split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves of this task's tries."""
    tries: dict[str, Counting] = defaultdict(Counting)

    def leave() -> Iterator[pa.RecordBatch]:
        for lang in sorted(tries):
            yield from tries[lang].leaves(lang).to_batches(max_chunksize=10_000)
        tries.clear()

    for x in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in x.columns)):
            trie = tries[lang]
            trie.add(terms(text), source)
            if trie.loose >= LOOSE:
                trie.fold()
            if sum(len(t.terms) for t in tries.values()) >= HELD or len(trie.sources) >= SOURCES:
                yield from leave()
    yield from leave()


def _merge(least: int):
    """Merges leaves that come in order and keeps the terms of at least so many documents, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        piece = 0
        for leaves in merged_stream(batches):
            kept = leaves.filter(pc.greater_equal(leaves["docs"], least)).combine_chunks()
            if not kept.num_rows:
                continue
            names, lang = [], kept["lang"].to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(lang[1:] != lang[:-1]) + 1).tolist(), len(lang)]
            for a, b in zip(borders, borders[1:]):
                starts = prefix_ranges(kept["term"].slice(a, b - a).combine_chunks(), PIECE)
                for size in np.diff([*starts, b - a]).tolist():
                    names += [f"{task}-{piece}"] * size
                    piece += 1
            counts = kept["counts"].combine_chunks()
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(counts).to_numpy(zero_copy_only=False))])
            total = np.diff(np.concatenate([[0], np.cumsum(counts.flatten().to_numpy())])[bounds])
            columns = [kept["lang"], pa.array(names, pa.string()), kept["term"], pa.array(total), kept["sources"], kept["counts"]]
            yield from pa.table(columns, ["lang", "piece", "term", "n", "sources", "counts"]).to_batches()

    return run


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly: long division by thousands, so nothing exceeds 64 bits below 9e15."""
    found, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + rest // total, rest % total
    return found + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _shares(most: int):
    """Of a piece and its language's groups: each pair's share, and the first terms of each group."""

    def run(piece: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        names = groups["source"].combine_chunks()
        s = len(names)
        if not s:
            return pa.table({n: pa.array([], k) for n, k in (("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64()))})
        lang, name = groups["lang"][0].as_py(), names.to_pylist()
        size, kept, all_size = (groups[c].to_numpy() for c in ("n", "v", "n_lang"))
        piece = piece.sort_by("term")
        total = np.zeros((s, s), np.int64)
        best: list[list[tuple[int, bytes]]] = [[] for _ in name]
        step = max(1, BLOCK // s)
        for at in range(0, piece.num_rows, step):
            part = piece.slice(at, step).combine_chunks()
            term, own = part["term"].to_pylist(), part["sources"].combine_chunks()
            count = np.zeros((len(term), s), np.int64)
            row = np.repeat(np.arange(len(term)), pc.list_value_length(own).to_numpy(zero_copy_only=False))
            count[row, pc.index_in(own.flatten(), value_set=names).to_numpy(zero_copy_only=False)] = part["counts"].combine_chunks().flatten().to_numpy()
            p = scaled(count + ADDED, size + 2 * kept)
            q = scaled(part["n"].to_numpy() + ADDED, all_size[:1] + 2 * kept[:1])[:, None]
            for i in range(s - 1):
                total[i, i + 1 :] += distance(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
            above, value = (count > 0) & (p > q), distance(p, q)
            for i in range(s):
                at_i = np.flatnonzero(above[:, i])
                first = at_i[np.argsort(-value[at_i, i], kind="stable")[:most]]
                best[i] += [(int(value[k, i]), term[k]) for k in first]
        i, j = np.triu_indices(s, 1)
        rows = [(name[a], "pair", name[b].encode(), int(v)) for a, b, v in zip(i.tolist(), j.tolist(), total[i, j].tolist())]
        for a, found in enumerate(best):
            rows += [(name[a], "term", term, v) for v, term in sorted(found, key=lambda x: -x[0])[:most]]
        source, kind, item, value = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(kind, pa.string()), "item": pa.array(item, pa.binary()), "value": pa.array(value, pa.int64())})

    return run


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, most: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" has the other sources of the language, part "term" the first terms.

    least: documents of the language that a kept term needs. most: terms of a group.
    """
    rows = docs.select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).cast("binary").alias("text"))
    tries = written(rows.mapInArrow(_count, LEAF), "tries")
    ordered = tries.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    kept = written(ordered.mapInArrow(_merge(least), KEPT), "kept-terms")

    by_group = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"))
    groups = written(rows.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0), "groups")

    # A piece without terms stands for each language, so that its pairs are there whatever it keeps.
    pieces = kept.select("lang", "piece").distinct().unionAll(groups.select("lang", F.lit("").alias("piece")).distinct())
    dealt = pieces.withColumn("salt", F.pmod(F.hash("piece"), F.lit(SALT)))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    sides = dealt.join(spread, ["lang", "salt"]).select("lang", "piece", "source", "n", "v", "n_lang")
    shares = written(cogrouped(kept, sides, ("lang", "piece"), _shares(most), SHARE), "shares").withColumn("item", F.col("item").cast("string"))

    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    half = shares.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = half.select("lang", "value", both).withColumn("rank", F.row_number().over(ranks)).withColumn("part", F.lit("pair"))
    first = shares.filter("part = 'term'").withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= most)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionAll(first.select(*columns))
