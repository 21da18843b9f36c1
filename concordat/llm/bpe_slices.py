"""Byte-level BPE by a rank file: boundaries from arrays (see pretokens.py), then cached merging of the slices.

Every task cuts a block of whole texts into pre-tokens at once. Slices repeat, so a worker remembers the ids of recent
ones; a new slice is merged by the ranks, always the pair of lowest rank and of these the leftmost. Beside the ids a row
keeps where each pre-token ends, in bytes and in ids: decoding cuts by these offsets and can start at any of them.

Defined results: null text counts as empty (no ids, no offsets). No string is a special token. Texts of any length are coded
whole; a pre-token of n bytes is merged in n log n steps. Equal texts have equal ids. An empty table gives an empty result.
A carried column named like an output is left out. An id that the ranks lack raises an error in decoding, null ids decode
to null. Blocks hold BLOCK characters or one text, so memory follows the longest text.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm import pretokens
from concordat.llm.shared import carried, whole

#: Characters of text that are cut at once.
BLOCK = 1 << 21
#: Slices that a worker remembers at most, each of at most KEPT bytes.
MEMO, KEPT = 400_000, 64
#: Slices that are merged together.
TOGETHER = 20_000
#: No rank.
NONE = 1 << 40


class Ranks:
    """The ranks of a vocabulary file: merges slices and decodes ids."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        rank = self.rank = {base64.b64decode(token): int(n) for token, n in pairs}
        missing = [b for b in range(256) if bytes([b]) not in rank]
        if missing:
            raise ValueError(f"{path} lacks the bytes {missing[:5]}")
        self.token = [b""] * (max(rank.values()) + 1)
        for token, n in rank.items():
            self.token[n] = token
        self.known = set(rank.values())
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens that is a token, as left << 32 | right, with that token's rank.
        both = sorted((rank[t[:k]] << 32 | rank[t[k:]], n) for t, n in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank)
        self.pair, self.pair_rank = np.array([*both, (1 << 62, NONE)], np.int64).T.copy()
        self.memo: dict[bytes, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it is no token."""
        want = left << 32 | right
        at = np.searchsorted(self.pair, want)
        return np.where(self.pair[at] == want, self.pair_rank[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of slices; all of them take their next merge together, round by round."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = np.full(len(tokens), NONE, np.int64)  # of each token with the next one of its slice
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inside] = self._ranks(tokens[inside], tokens[inside + 1])
        while len(tokens):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(ranks, heads)
            spread = np.repeat(lowest, np.diff(np.concatenate([heads, [len(tokens)]])))
            over = spread == NONE
            if over.any():
                done.append((owner[over], tokens[over]))
                tokens, owner, ranks, spread = tokens[~over], owner[~over], ranks[~over], spread[~over]
                if not len(tokens):
                    break
            at = np.flatnonzero(ranks == spread)
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]  # the leftmost of each slice
            tokens[at] = ranks[at]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one token less for each merge before
            tokens, owner, ranks = tokens[keep], owner[keep], ranks[keep]
            for k in (at, at[at > 0] - 1):
                pair = k[(k + 1 < len(tokens)) & (owner[k] == owner[np.minimum(k + 1, len(tokens) - 1)])]
                ranks[k] = NONE
                ranks[pair] = self._ranks(tokens[pair], tokens[pair + 1])
        if not done:
            return [b""] * len(pieces)
        owner, tokens = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        flat = tokens[order].astype("<u4").tobytes()
        to = (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        return [flat[a:b] for a, b in zip([0, *to], to)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one slice, by a heap over its pairs: a part is known by where it begins, end[k] is where it ends."""
        n, rank = len(piece), self.rank
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(k: int) -> None:
            if end[k] < n and (r := rank.get(piece[k : end[end[k]]])) is not None:
                heap.append((r, k, end[end[k]])) if filling else heapq.heappush(heap, (r, k, end[end[k]]))

        filling = True
        for k in range(n):
            offer(k)
        heapq.heapify(heap)
        filling = False
        while heap:
            _, k, to = heapq.heappop(heap)
            middle = end[k]
            if middle == 0 or middle >= n or end[middle] != to:  # merged with another part meanwhile
                continue
            end[k], end[middle] = to, 0
            if to < n:
                before[to] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return array("I", (rank[piece[k : end[k]]] for k in range(n) if end[k])).tobytes()

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each slice as little-endian uint32."""
        memo = self.memo
        new = {x for x in pieces if x not in memo}
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set(pieces)
        short = [x for x in new if len(x) <= KEPT]
        long = {x: self.merge_long(x) for x in new if len(x) > KEPT}
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            memo.update(zip(part, self.merge(part)))
        found = [memo[x] if len(x) <= KEPT else long.get(x) for x in pieces] if long else list(map(memo.__getitem__, pieces))
        if len(memo) > MEMO:
            memo.clear()
        return found

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids (little-endian uint32)."""
        found = memoryview(ids).cast("I")
        if not self.known.issuperset(found):
            raise ValueError("an id that the vocabulary lacks")
        return b"".join(map(self.token.__getitem__, found))


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def encode_texts(ranks: Ranks, texts: list[str]) -> Iterator[tuple[bytes, bytes, bytes]]:
    """For each text (ids, ends in bytes, ends in ids) of its pre-tokens, each as little-endian uint32."""
    begin, last = pretokens.starts(texts)
    joined = b"\x00".join(x.encode() for x in texts) + b"\x00"
    at = begin.tolist()
    # Between the last start of a text and the first of the next there is the byte that ends the text: it is no slice.
    gaps = set(last.tolist())
    found = ranks.ids([joined[a:b] for k, (a, b) in enumerate(zip(at, at[1:])) if k not in gaps])
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    first = 0
    for n, to in enumerate(last.tolist()):
        cuts = begin[first : to + 1]
        own = slice(first - n, to - n)
        yield b"".join(found[own]), (cuts[1:] - cuts[0]).astype("<u4").tobytes(), np.cumsum(sizes[own]).astype("<u4").tobytes()
        first = to + 1


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about BLOCK characters."""
    run, size = [], 0
    for x in texts:
        if run and size + len(x) > BLOCK:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x)
    if run:
        yield run


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of docs: (*carry, ids, ends, id_ends), the last three as the bytes of little-endian uint32.

    ends and id_ends have a number for each pre-token: where it ends in the text's UTF-8, and in the ids.
    """
    carry = carried(carry, "ids", "ends", "id_ends")
    rows = docs.select(*carry, whole(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(vocabulary)
        for x in batches:
            at = 0
            for part in blocks(x.column(len(carry)).to_pylist()):
                made = [pa.array(c, pa.binary()) for c in zip(*encode_texts(ranks, part))]
                kept = x.slice(at, len(part)).columns[: len(carry)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*carry, "ids", "ends", "id_ends"])
                at += len(part)

    return rows.mapInArrow(run, f"{_kinds(rows)}ids binary, ends binary, id_ends binary")


def decode(rows: DataFrame, vocabulary: str, *, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row: (*carry, decoded), the bytes of ids as encode gives them."""
    carry = carried(carry, "decoded")
    chosen = rows.select(*carry, F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(vocabulary)
        for x in batches:
            back = [None if i is None else ranks.decode(i) for i in x.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(carry)], pa.array(back, pa.binary())], [*carry, "decoded"])

    return chosen.mapInArrow(run, f"{_kinds(chosen)}decoded binary")


def encode_and_decode(docs: DataFrame, vocabulary: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of docs: (*carry, ids, ends, id_ends, decoded); both ways in one pass over the texts."""
    carry = carried(carry, "ids", "ends", "id_ends", "decoded")
    rows = docs.select(*carry, whole(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(vocabulary)
        for x in batches:
            at = 0
            for part in blocks(x.column(len(carry)).to_pylist()):
                ids, ends, id_ends = zip(*encode_texts(ranks, part))
                made = [pa.array(c, pa.binary()) for c in (ids, ends, id_ends, map(ranks.decode, ids))]
                kept = x.slice(at, len(part)).columns[: len(carry)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*carry, "ids", "ends", "id_ends", "decoded"])
                at += len(part)

    return rows.mapInArrow(run, f"{_kinds(rows)}ids binary, ends binary, id_ends binary, decoded binary")


def span(ranks: Ranks, ids: bytes, ends: bytes, id_ends: bytes, begin: int, end: int) -> bytes:
    """The bytes [begin, end) of a coded text; only the ids of the pre-tokens that they touch are decoded."""
    by_byte, by_id = (np.concatenate([[0], np.frombuffer(x, "<u4")]).astype(np.int64) for x in (ends, id_ends))
    begin, end = max(0, begin), min(end, int(by_byte[-1]))
    if begin >= end:
        return b""
    a, b = int(np.searchsorted(by_byte, begin, "right")) - 1, int(np.searchsorted(by_byte, end))
    return ranks.decode(ids[4 * by_id[a] : 4 * by_id[b]])[begin - int(by_byte[a]) : end - int(by_byte[a])]


def _kinds(rows: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
