"""Radix tries over bytes in depth-first form, whose leaves count by source.

A trie is its leaves in byte order: each has the bytes that it shares with the leaf before it and its own suffix. An inner
node is a run of leaves that share at least its depth, so a prefix is a slice of the leaves, and tries that cover one range
of prefixes merge by merging their leaves in order. Byte order is the order of UTF-8 strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A leaf: documents that hold its term, and occurrences for each source that has any.
LEAF = "lang string, term binary, docs bigint, sources array<string>, counts array<bigint>"


class Terms(dict):
    """Numbers terms in the order in which they come."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class Counting:
    """The trie of some documents of one language while it is counted: terms by number, words as arrays of numbers."""

    def __init__(self) -> None:
        self.terms, self.sources = Terms(), Terms()
        #: (terms, source) and (distinct terms) of each run of words, added up by fold.
        self.words: list[tuple[np.ndarray, int]] = []
        self.seen: list[np.ndarray] = []
        self.loose = 0
        self.key, self.n, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, runs: Iterator[list[bytes]], source: str) -> None:
        """A document's words, in runs."""
        number, own, parts = self.terms.__getitem__, self.sources[source], []
        for words in runs:
            found = np.fromiter(map(number, words), np.int64, len(words))
            self.words.append((found, own))
            parts.append(found)
            self.loose += len(found)
            if len(parts) > 1:
                parts = [np.unique(np.concatenate(parts))]
        self.seen += [np.unique(x) for x in parts]

    def fold(self) -> None:
        """Adds what is loose to the leaves' counters."""
        if not self.words:
            return
        key = np.concatenate([self.key, *((t << 20 | s) for t, s in self.words)])
        weight = np.concatenate([self.n, np.ones(len(key) - len(self.n), np.int64)])
        self.key, self.n = summed(key, weight)
        docs = np.bincount(np.concatenate(self.seen) if self.seen else np.zeros(0, np.int64), minlength=len(self.terms))
        docs[: len(self.docs)] += self.docs
        self.docs, self.words, self.seen, self.loose = docs, [], [], 0

    def leaves(self, lang: str) -> pa.Table:
        """The leaves in byte order."""
        self.fold()
        term = pa.array(self.terms, pa.binary())
        order = pc.array_sort_indices(term).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key, n = summed(place[self.key >> 20] << 20 | self.key & 0xFFFFF, self.n)
        begin = np.searchsorted(key >> 20, np.arange(len(order) + 1)).astype(np.int32)
        names = pa.array(self.sources, pa.string()).take(pa.array(key & 0xFFFFF))
        columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(order), np.int64))), term.take(pa.array(order)), pa.array(self.docs[order].astype(np.int64)), pa.ListArray.from_arrays(begin, names), pa.ListArray.from_arrays(begin, pa.array(n))]
        return pa.table(columns, ["lang", "term", "docs", "sources", "counts"])


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their weights."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)


def shared(terms: pa.BinaryArray) -> np.ndarray:
    """How many bytes each term of a trie in order shares with the one before it; what isn't shared is the leaf's suffix."""
    words = terms.to_pylist()
    out = np.zeros(len(words), np.int64)
    for k, (a, b) in enumerate(zip(words, words[1:]), 1):
        n = min(len(a), len(b))
        out[k] = next((i for i in range(n) if a[i] != b[i]), n)
    return out


def prefix_ranges(terms: pa.BinaryArray, most: int) -> list[int]:
    """Where to cut a trie into ranges of prefixes of at most `most` leaves: where neighbours share least, so high up."""
    common, starts = shared(terms), [0] if len(terms) else []
    while starts and len(terms) - starts[-1] > most:
        first = starts[-1] + max(1, most // 2)
        starts.append(first + int(np.argmin(common[first : starts[-1] + most + 1])))
    return starts


def merged(leaves: pa.Table) -> pa.Table:
    """Leaves of several tries in one order as those of their sum: equal terms become one leaf."""
    leaves = leaves.combine_chunks()
    if not leaves.num_rows:
        return leaves
    lang, term = leaves["lang"].combine_chunks(), leaves["term"].combine_chunks()
    new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], new]))
    if len(first) == leaves.num_rows:
        return leaves
    leaf = np.cumsum(np.concatenate([[0], new]))
    own, counts = leaves["sources"].combine_chunks(), leaves["counts"].combine_chunks()
    names = own.flatten().dictionary_encode()
    owner = np.repeat(leaf, pc.list_value_length(own).to_numpy(zero_copy_only=False))
    key, n = summed(owner << 20 | names.indices.to_numpy(), counts.flatten().to_numpy())
    begin = np.searchsorted(key >> 20, np.arange(len(first) + 1)).astype(np.int32)
    columns = [lang.take(pa.array(first)), term.take(pa.array(first)), pa.array(np.add.reduceat(leaves["docs"].to_numpy(), first)), pa.ListArray.from_arrays(begin, names.dictionary.take(pa.array(key & 0xFFFFF))), pa.ListArray.from_arrays(begin, pa.array(n))]
    return pa.table(columns, leaves.schema.names)


def merged_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """merged over batches in order; the last leaf of each waits for the next."""
    left: pa.Table | None = None
    for x in batches:
        now = pa.table(x.columns, x.schema.names)
        now = merged(now if left is None else pa.concat_tables([left, now]))
        left = now.slice(max(0, now.num_rows - 1))
        yield now.slice(0, max(0, now.num_rows - 1))
    if left is not None:
        yield left
