"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit for each bit position that is set in over half of its shingles' XXH64 values. Fingerprints
link at `RADIUS` or fewer differing bits. Bits are spread over the nonzero vectors of F2^(r+1); each of the 2^(r+1) - 1
nonzero vectors v gives a table whose key keeps the bits whose vector isn't orthogonal to v. Up to r differing bits span
at most r dimensions, so some v is orthogonal to all of them: every pair within the radius shares a key in some table.

Work follows distinct fingerprints, never pairs of documents: equal fingerprints become one first. A bucket of two is
compared in place. A bucket of at most CROWD is split into its own components in one sweep and gives one link for each
member at most. The members of a larger bucket agree on the key's bits, so the same covering is applied to the remaining
bits, and again below; three levels leave at most 2^8 different fingerprints a bucket at radius 3, 2^15 at radius 6. A
level's masks follow from the mask above it, where they are needed, so no plan lists them. No bucket is cut.

Where `keep_first` is given a similarity, fingerprints only propose: the texts of each component are compared by the sets
of their word shingles, and only links that hold exactly enter the components that lose rows. Prefixes of the sets, rarest
shingles first, find the pairs to compare without a loss. A task holds two blocks of a component, of BLOCK bytes of text
each (or one text); a larger component is compared block by block, every block with every other.

Defined results: null text counts as empty and has fingerprint 0, which links like any other. Rows that repeat, or share
an id, each get the result. Null ids are passed over by the smallest id of a component; it is null if all are. Ties of ids
are broken by the row's place. An empty table gives an empty result. A carried column named like an output is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.components import components
from concordat.llm.shared import FILE, ROW, carried, located, only, whole, without, written

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Buckets of more fingerprints than this go one level down instead of being compared at once.
CROWD = 1024
#: Tables that are filled and compared in one round.
ROUND = 16
#: Bytes of text of one component that a task holds twice at most when texts are compared.
BLOCK = 16 << 20
_BLOCK = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, A-Z lower-cased, of word shingles with repeats; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    size = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, size, _BLOCK):
        some = min(_BLOCK, size - at)
        starts = words[at : at + some + shingle - 1]
        values = [digest(b" ".join(x), SEED) for x in zip(*(starts[k:] for k in range(shingle)))] if len(words) >= shingle else [digest(b" ".join(words), SEED)]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > size, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """Each row of docs: (*carry, fp) with fp the fingerprint's 64 bits as a bigint."""
    carry = carried(carry, "fp")
    rows = docs.select(*carry, whole(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 1024):
                part = x.slice(at, 1024)
                fp = pa.array([fingerprint(t, shingle) for t in part.column(len(carry)).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], fp], [*carry, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, fp bigint")


def _spread(vectors: list[int], size: int) -> int:
    """The least number of bits that a key keeps under an assignment of vectors."""
    return min(sum((x & v).bit_count() % 2 for x in vectors) for v in range(1, size))


@lru_cache(maxsize=64)
def _vectors(bits: int, radius: int) -> tuple[int, ...]:
    """A nonzero vector of F2^(radius+1) for each of so many bits, such that every key keeps about half of them.

    With as many bits as points of F2^radius, the points themselves behind a leading 1 are a first-order Reed-Muller code,
    whose words all keep half. Otherwise all vectors are dealt in turn, in the stride that keeps most.
    """
    size = 1 << (radius + 1)
    if bits == size // 2:
        return tuple(size // 2 + k for k in range(bits))
    strides = range(1, size - 1) if bits < size - 1 else (1,)
    dealt = [[1 + k * s % (size - 1) for k in range(bits)] for s in strides]
    return tuple(max(dealt, key=lambda x: _spread(x, size)))


def covering(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The masks over these bit positions: each pair that differs in at most radius of them agrees under some mask."""
    vector = dict(zip(bits, _vectors(len(bits), radius)))
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


@lru_cache(maxsize=4096)
def masks_below(mask: int, radius: int) -> tuple[int, ...]:
    """The masks of the tables below the table with this (signed) mask: what it keeps, and a covering of the rest."""
    kept = mask % (1 << 64)
    return tuple(_signed(kept | m) for m in covering([b for b in range(64) if not kept >> b & 1], radius))


def _keyed(rows: DataFrame, level: int, radius: int, tables: range) -> DataFrame:
    """rows (fp, and below the first level the mask above) as (fp, mask, key) for some of each row's tables of the level."""
    if level == 1:
        spread = F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in masks_below(0, radius)[tables.start : tables.stop]])
        return rows.select("fp", F.explode(spread).alias("x")).select("fp", "x.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 4096):
                fp, above = (np.array(c.slice(at, 4096)) for c in x.columns)
                kinds, which = np.unique(above, return_inverse=True)
                below = np.array([masks_below(int(m), radius)[tables.start : tables.stop] for m in kinds], np.int64).reshape(len(kinds), -1)
                masks = below[which]
                wide = np.repeat(fp, masks.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(wide), pa.array(masks.ravel()), pa.array(wide & masks.ravel())], ["fp", "mask", "key"])

    return rows.select("fp", "mask").mapInArrow(run, "fp bigint, mask bigint, key bigint")


def local_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(smallest, member) links that connect what is connected among distinct values within the radius."""
    label = np.arange(len(values))
    step = max(1, (1 << 22) // len(values))  # rows compared at once: bounded memory for any bucket
    while True:
        new = label.copy()
        for at in range(0, len(values), step):
            near = np.bitwise_count(values[at : at + step, None] ^ values[None, :]) <= radius
            new[at : at + step] = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            break
        label = new
    signed = values.view(np.int64)
    return [(int(signed[b]), int(signed[a])) for a, b in enumerate(label) if a != b]


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within the buckets of rows(mask, key, fp), of CROWD members at most or bounded by their free bits."""
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple[np.ndarray, ...] | None = None
        out: list[tuple[int, int]] = []

        def links(columns: tuple[np.ndarray, ...], last: bool) -> tuple[np.ndarray, ...] | None:
            mask, key, fp = columns
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *cut.tolist(), len(fp)]
            for a, b in zip(bounds[: None if last else -1], bounds[1 : None if last else -1]):
                if b - a > 1:
                    out.extend(local_links(fp[a:b].view(np.uint64), radius))
            return None if last else tuple(c[bounds[-2] :] for c in columns)

        def batch() -> pa.RecordBatch:
            pairs = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for x in batches:
            if x.num_rows:
                columns = tuple(np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in x.columns)
                left = links(columns if left is None else tuple(map(np.concatenate, zip(left, columns))), False)
                yield batch()
        if left is not None:
            links(left, True)
            yield batch()

    return dealt.select("mask", "key", "fp").mapInArrow(run, "a bigint, b bigint")


def near_links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) among distinct(fp) that connect all that is connected within the radius; not every pair, but no fewer components.

    Levels below the first run only on the members of larger buckets. Tables are taken ROUND at a time, and a round's shuffle
    files go when it ends, so that disk use doesn't grow with the number of tables.
    """
    spark, cleanup = distinct.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        found: list[DataFrame] = []
        rows = distinct.select("fp")
        for level in (1, 2, 3):
            size, below = (1 << radius + 1) - 1, []
            for start in range(0, size, ROUND):
                keyed = _keyed(rows, level, radius, range(start, min(size, start + ROUND)))
                buckets = keyed.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
                buckets = written(buckets, "buckets")
                pairs = buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
                fits = F.col("n") <= crowd if level < 3 else F.lit(True)
                more = buckets.filter("n > 2").select("mask", "key", "n")
                members = keyed.join(more.filter(fits).drop("n"), ["mask", "key"])
                found.append(written(pairs.union(_bucket_links(members, radius)), "links"))
                crowded = more.filter(~fits)
                if level < 3 and not crowded.isEmpty():
                    below.append(written(keyed.join(crowded.drop("n"), ["mask", "key"]).select("fp", "mask"), "crowded"))
            if not below:
                break
            rows = reduce(DataFrame.union, below)
        return reduce(DataFrame.union, found)
    finally:
        spark.conf.set(cleanup, before)


def _first(id_column: str, place: tuple[str, ...]) -> Column:
    """Orders rows by id, nulls last, then by their place."""
    return F.struct(F.col(id_column).isNull().alias("absent"), F.col(id_column).alias("id"), *place)


def classed(rows: DataFrame, *, id_column: str = "doc_id", place: tuple[str, ...] = (), radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """rows (with fp and id_column) and first: the struct (absent, id, *place) of the first row of each one's component.

    rows must be a written table: its columns are read more than once.
    """
    classes = written(rows.groupBy("fp").agg(F.min(_first(id_column, place)).alias("first")), "classes")
    roots = components(near_links(classes, radius, crowd))
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = written(labelled, "labelled")
    whole_components = labelled.groupBy("root").agg(F.min("first").alias("first"))
    by_class = labelled.select("fp", "root").join(whole_components, "root").select("fp", "first")
    return rows.join(by_class, "fp")


def near_duplicates(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """Each row of docs: (id, fingerprint as 16 hex digits, component_id: the smallest id reachable)."""
    rows = written(fingerprints(docs, text=text, carry=(id_column,), shingle=shingle), "fingerprints")
    named = classed(rows, id_column=id_column, radius=radius, crowd=crowd)
    return named.select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct XXH64 values of a whole text's word shingles, A-Z lower-cased; none for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(size)))] if len(words) >= size else [digest(b" ".join(words), SEED)], np.uint64))


def alike(sets: list[np.ndarray], least: float) -> list[int]:
    """For each set of distinct values the place of the first that it reaches by links of a Jaccard similarity of least or more.

    Two sets that are so alike share one of their first n - ceil(least n) + 1 values in any common order. Sets without
    values are alike. What is connected already isn't compared again.
    """
    label = np.arange(len(sets))
    if len(sets) < 2:
        return label.tolist()
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))  # the rarest first
    single = np.count_nonzero(count == 1)  # ranks below: values of one set alone
    bounds = np.cumsum([0, *map(len, sets)])
    ranks = [np.sort(rank[value[a:b]]) for a, b in zip(bounds, bounds[1:])]
    holders: dict[int, list[int]] = {}
    same: dict[bytes, int] = {}
    for k, own in enumerate(ranks):
        first = same.setdefault(own.tobytes(), k)
        if first != k:
            label[k] = label[first]
            continue
        n = len(own)
        prefix = [x for x in own[: n - math.ceil(least * n - 1e-9) + 1].tolist() if x >= single]
        for other in np.unique(np.array([j for x in prefix for j in holders.get(x, ())], np.int64)).tolist():
            m = len(ranks[other])
            if label[other] != label[k] and min(n, m) >= least * max(n, m) - 1e-9:
                both = len(np.intersect1d(own, ranks[other], assume_unique=True))
                if both >= least * (n + m - both) - 1e-9:
                    a, b = sorted((label[k], label[other]))
                    label[label == b] = a
        for x in prefix:
            holders.setdefault(x, []).append(k)
    return label.tolist()


def _alike_links(bodies: DataFrame, least: float, size: int) -> DataFrame:
    """Links (a, b) of alike rows of bodies(component, one, other, block, node, text), within each pair of blocks (one, other)."""
    dealt = bodies.repartition("component", "one", "other").sortWithinPartitions("component", "one", "other", "node").select("component", "one", "other", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, nodes = None, [], []

        def links() -> pa.RecordBatch:
            found = [(nodes[first], nodes[k]) for k, first in enumerate(alike(sets, least)) if first != k]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["a", "b"])

        for x in batches:
            for *group, node, text in zip(*(c.to_pylist() for c in x.columns)):
                if group != now:
                    yield links()
                    now, sets, nodes = group, [], []
                sets.append(shingles(text, size))
                nodes.append(node)
        yield links()

    return dealt.mapInArrow(run, "a string, b string")


def _blocked(proposed: DataFrame, block: int) -> DataFrame:
    """The rows of proposed(component, node, size, ...) that have a partner, for each pair of blocks (one <= other) they are compared in."""
    several = proposed.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    several = written(several.select("component", F.ceil(F.col("bytes") / block).alias("blocks")), "blocks")
    held = proposed.join(several, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))))
    each = held.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("blocks", F.lit(1)) - 1)))
    return each.withColumns({"one": F.least("block", "x"), "other": F.greatest("block", "x")}).drop("block", "x", "blocks")


def keep_first(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, crowd: int = CROWD, similarity: float | None = None, compared: int = 5, block: int = BLOCK) -> DataFrame:
    """The rows of docs without near-duplicates: exactly one of each component, with the smallest id (then by place).

    similarity: links within the fingerprints' components count only if the sets of shingles of `compared` words are so alike.
    """
    here = located(docs)
    sized = here.withColumn("__size", F.octet_length(whole(text)).cast("bigint"))
    rows = written(fingerprints(sized, text=text, carry=(id_column, FILE, ROW, "__size"), shingle=shingle), "fingerprints")
    named = classed(rows, id_column=id_column, place=(FILE, ROW), radius=radius, crowd=crowd)
    if similarity is None:
        return without(here, named.filter((F.col(FILE) != F.col(f"first.{FILE}")) | (F.col(ROW) != F.col(f"first.{ROW}"))))
    # Two components that share a hash are compared as one, which changes nothing.
    node = F.concat(FILE, F.lit("#"), F.lpad(F.col(ROW).cast("string"), 20, "0"))
    named = written(named.select(FILE, ROW, F.col(id_column).alias("id"), F.col("__size").alias("size"), node.alias("node"), F.xxhash64(f"first.{FILE}", f"first.{ROW}").alias("component")), "proposed")
    # Narrow rows first: only the texts of rows with a proposed partner move, once for each block they are compared with.
    pairs = written(_blocked(named, block), "pairs")
    texts = only(here, pairs.select(FILE, ROW).distinct()).select(FILE, ROW, whole(text).alias("text")).join(pairs.select(FILE, ROW, "node", "component", "one", "other"), [FILE, ROW])
    links = _alike_links(texts, similarity, compared)
    roots = components(written(links, "alike"))
    linked = written(named.select("node", "id", FILE, ROW).join(roots, "node"), "linked")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("absent"), "id", FILE, ROW)).alias("first"))
    later = linked.join(first, "root").filter((F.col(FILE) != F.col(f"first.{FILE}")) | (F.col(ROW) != F.col(f"first.{ROW}")))
    return without(here, later)
