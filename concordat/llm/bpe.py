"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The lexicon holds the corpus's frequent units (see units.py) as a minimal acyclic automaton: words share prefixes and
suffixes, each arc carries a number, and the numbers along a word's path add up to the word's place, which leads to its
ids. It is one read-only file that every Python worker of an executor maps into memory. Units that it lacks are encoded
exactly by the vocabulary's merges, so its size changes the speed and never the result.

Word counts cover all documents and are made by Spark; the lexicon keeps the most frequent units of at most LONG
characters, `most` of them at most, which bounds what comes to the driver (most x LONG characters).

Defined results: null text counts as empty (no ids). The vocabulary's added tokens are found in texts first, as the
library does by default. Texts of any length are encoded whole; a unit of any length is merged in n log n steps. Units
that tie at the lexicon's border are in or out together. An empty table gives an empty result. A carried column named like
an output is left out.
"""

from __future__ import annotations

import heapq
import json
import struct
import uuid
from array import array
from collections import ChainMap
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.shared import carried, put_file, whole, written
from concordat.llm.units import LONG, units

#: Fixed value: the pattern by which byte-level vocabularies of this kind split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The native coder's pattern engine fails on about a million white-space characters in a row; runs from here on pass by it.
BLANKS = 100_000
_BLANK_RUN = regex.compile(rf"(?<!\s)\s{{{BLANKS},}}")
STEPS_PER_E = 64
#: Units that a worker remembers at most.
_MEMO = 150_000
#: Texts that a worker cuts into units at once; these are many times the size of their texts.
_AT_ONCE = 64


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def native(coder: tiktoken.Encoding, text: str, added: regex.Pattern | None = None) -> list[int]:
    """The rank coder's ids of a whole text, with the added tokens that the pattern finds; white-space runs of any length.

    The vocabulary's pattern makes one pre-token of a run up to its last character, or of all of it where the text (or the
    part before an added token) ends, so a long run is merged as that pre-token without the pattern engine.
    """
    if len(text) < BLANKS or not _BLANK_RUN.search(text):
        return coder.encode(text, allowed_special="all")
    out: list[int] = []

    def plain(part: str) -> None:
        at = 0
        for m in _BLANK_RUN.finditer(part):
            end = m.end() - (m.end() < len(part))
            out.extend(coder.encode_ordinary(part[at : m.start()]))
            out.extend(coder._encode_single_piece(part[m.start() : end]))
            at = end
        out.extend(coder.encode_ordinary(part[at:]))

    at = 0
    for m in added.finditer(text) if added else ():
        plain(text[at : m.start()])
        out.append(coder.encode_single_token(m[0]))
        at = m.end()
    plain(text[at:])
    return out


class Merges:
    """A vocabulary file's merges: encodes any text exactly and decodes ids."""

    def __init__(self, vocabulary: str) -> None:
        self.vocabulary = vocabulary
        setup = self._setup()
        model, before = setup["model"], setup.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or setup.get("normalizer"):
            raise ValueError(f"{vocabulary} isn't a plain byte-level BPE vocabulary")
        letters = byte_letters()
        self.added = {x["content"]: x["id"] for x in setup["added_tokens"]}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        ids = model["vocab"]
        #: The id of each single byte.
        self.single = [ids[k] for k, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.bytes = {i: bytes(letters[c] for c in k) for k, i in ids.items() if k not in self.added}
        self.bytes |= {i: k.encode() for k, i in self.added.items()}
        made = [ids[a + b] for a, b in self._merged(model)]
        #: Where every merge makes a new id and ids follow ranks, a rank coder merges alike, in native code.
        self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items() if i not in self.added.values()}, special_tokens=self.added) if made == sorted(set(made)) and max(self.single) < made[0] else None

    def _setup(self) -> dict:
        with open(self.vocabulary, encoding="utf-8") as file:
            return json.load(file)

    @staticmethod
    def _merged(model: dict) -> Iterator[list[str]]:
        return (x if isinstance(x, list) else x.split(" ") for x in model["merges"])

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """left id << 32 | right id -> (rank, id of both); only made where there is no rank coder, as each worker would hold it."""
        model = self._setup()["model"]
        ids = model["vocab"]
        return {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(self._merged(model))}

    def token(self, word: bytes) -> list[int]:
        """The ids of one pre-token: always the merge of lowest rank, the leftmost first."""
        now, pairs = [self.single[b] for b in word], self.pairs
        if len(now) > LONG:
            return self._long(now)
        while len(now) > 1:
            best, new = None, 0
            for k, (a, b) in enumerate(zip(now, now[1:])):
                found = pairs.get(a << 32 | b)
                if found and (best is None or found[0] < best):
                    best, new, pair = found[0], found[1], (a, b)
            if best is None:
                break
            out, k, n = [], 0, len(now)
            while k < n:
                if k + 1 < n and now[k] == pair[0] and now[k + 1] == pair[1]:
                    out.append(new)
                    k += 2
                else:
                    out.append(now[k])
                    k += 1
            now = out
        return now

    def _long(self, now: list[int]) -> list[int]:
        """The same with a heap of pairs and links between what is left."""
        n, pairs = len(now), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def look(k: int) -> None:
            if k >= 0 and after[k] < n and (found := pairs.get(now[k] << 32 | now[after[k]])):
                heapq.heappush(heap, (found[0], k, now[k], now[after[k]]))

        for k in range(n):
            look(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            r = after[k]
            if now[k] != a or r >= n or now[r] != b:
                continue
            now[k] = pairs[a << 32 | b][1]
            now[r], after[k] = -1, after[r]
            if after[k] < n:
                before[after[k]] = k
            look(before[k])
            look(k)
        return [x for x in now if x >= 0]

    def encode(self, text: str) -> list[int]:
        return native(self.ranked, text, self.split_added) if self.ranked else self.encode_by_pairs(text)

    def encode_by_pairs(self, text: str) -> list[int]:
        """The same by the list of merges itself."""
        out, at = [], 0
        for m in self.split_added.finditer(text) if self.split_added else ():
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        return [i for m in self.pattern.finditer(text) for i in self.token(m[0].encode())]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The file of a minimal acyclic transducer that leads each word to its ids.

    Sorted words are added one by one; what can no longer change is replaced by an equal state that is there already.
    Layout: "<8I" sizes, then as uint32 the arrays key (of each arc: state << 8 | byte, ascending), target, skip (words
    before the arc), start (of each word's ids) and ids, then final as bytes.
    """
    order = sorted(words)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    open_states = [0]  # along the last word

    def close(down_to: int, word: bytes) -> None:
        while len(open_states) - 1 > down_to:
            state = open_states.pop()
            key = (final[state], tuple(arcs[state].items()))
            arcs[open_states[-1]][word[len(open_states) - 1]] = known.setdefault(key, state)

    last = b""
    for word in order:
        common = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        close(common, last)
        for b in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[open_states[-1]][b] = len(arcs) - 1
            open_states.append(len(arcs) - 1)
        final[open_states[-1]] = True
        last = word
    close(0, last)
    place = {0: 0}
    queue = [0]
    for state in queue:
        for t in arcs[state].values():
            if t not in place:
                place[t] = len(queue)
                queue.append(t)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        todo = [t for t in arcs[state].values() if t not in below]
        if todo:
            stack += todo
        else:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
            stack.pop()
    key, target, skip = array("I"), array("I"), array("I")
    for n, state in enumerate(queue):
        passed = int(final[state])
        for b, t in sorted(arcs[state].items()):
            key.append(n << 8 | b)
            target.append(place[t])
            skip.append(passed)
            passed += below[t]
    start, ids = array("I", [0]), array("I")
    for word in order:
        ids.extend(words[word])
        start.append(len(ids))
    head = struct.pack("<8I", len(queue), len(target), len(order), len(ids), 0, 0, 0, 0)
    return head + b"".join(x.tobytes() for x in (key, target, skip, start, ids)) + bytes(final[s] for s in queue)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, mode="r")
        states, arcs, words, ids = (int(x) for x in data[:16].view(np.uint32))
        at, parts = 32, []
        for n in (arcs, arcs, arcs, words + 1, ids):
            parts.append(data[at : at + 4 * n].view(np.uint32))
            at += 4 * n
        self.key, self.target, self.skip, self.start, self.ids = parts
        self.final = data[at : at + states].astype(bool)
        self.n_words, self.n_states = words, states

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, -1 for a word that isn't in; all words walk one byte at a time together."""
        n = len(words)
        letters = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, n)
        begin = np.cumsum(size) - size
        state, place, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n if len(self.key) else 0)
        for k in range(int(size.max(initial=0))):
            alive = alive[size[alive] > k]
            if not len(alive):
                break
            want = (state[alive] << 8 | letters[begin[alive] + k]).astype(np.uint32)
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            there = self.key[arc] == want
            place[alive[~there]] = -1
            state[alive[~there]] = -1
            alive, arc = alive[there], arc[there]
            place[alive] += self.skip[arc]
            state[alive] = self.target[arc]
        return np.where((state >= 0) & self.final[state], place, -1)

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as little-endian uint32, None for a word that isn't in."""
        start, ids = self.start, self.ids
        return [None if p < 0 else ids[start[p] : start[p + 1]].tobytes() for p in self.places(words).tolist()]


class Coder:
    """Encodes texts by a lexicon, and by merges what it lacks; remembers recent units."""

    def __init__(self, merges: Merges, lexicon: Lexicon) -> None:
        self.merges, self.lexicon = merges, lexicon
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    @cached_property
    def table(self) -> list[bytes]:
        return [self.merges.bytes.get(i, b"") for i in range(max(self.merges.bytes) + 1)]

    def _exact(self, text: str) -> bytes:
        return array("I", self.merges.encode(text)).tobytes()

    def _learn(self, memo: dict[str, bytes], seen: set[str], space: str) -> dict[str, bytes]:
        """Sees to it that memo has the units; returns those that are too long for it."""
        if len(memo) + len(seen) > _MEMO:
            memo.clear()
        new = [x for x in seen if x not in memo]
        short = [x for x in new if len(x) <= LONG]
        for unit, found in zip(short, self.lexicon.find([(space + x).encode() for x in short]), strict=True):
            memo[unit] = self._exact(space + unit) if found is None else found
        return {x: self._exact(space + x) for x in new if len(x) > LONG}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32."""
        parts = [units(x) for x in texts]
        heads = self._learn(self.first, {x[0] for x in parts}, "")
        tails = self._learn(self.later, set(chain.from_iterable(x[1:] for x in parts)), " ")
        first, later = ChainMap(heads, self.first), ChainMap(tails, self.later) if tails else self.later
        return [first[x[0]] + b"".join(map(later.__getitem__, x[1:])) for x in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merges_of(vocabulary: str) -> Merges:
    return Merges(vocabulary)


@lru_cache(maxsize=2)
def coder_of(vocabulary: str, lexicon: str) -> Coder:
    return Coder(merges_of(vocabulary), Lexicon(SparkFiles.get(lexicon)))


def frequent_units(docs: DataFrame, *, text: str = "text", most: int = 32_768, least: int = 3) -> list[str]:
    """The most frequent units of at most LONG characters that occur `least` times or more in all documents.

    A table of how many units reach each step of a fine logarithmic scale (STEPS_PER_E steps for each factor of e, a few
    thousand rows at most) gives the least count with which no more than `most` units come to the driver.
    """
    pieces = docs.select(F.explode(F.split(whole(text), " ")).alias("unit")).filter((F.length("unit") <= LONG) & (F.length("unit") > 0))
    counted = written(pieces.groupBy("unit").count().filter(F.col("count") >= least).withColumn("step", F.floor(F.log("count") * STEPS_PER_E)), "unit-counts")
    total, lowest = 0, None
    for step, n in counted.groupBy("step").count().orderBy(F.desc("step")).toLocalIterator():
        total += n
        if total > most:
            break
        lowest = step
    return [] if lowest is None else [r[0] for r in counted.filter(F.col("step") >= lowest).select("unit").collect()]


def ship_lexicon(docs: DataFrame, vocabulary: str, *, text: str = "text", most: int = 32_768, least: int = 3) -> str:
    """Builds the lexicon of docs in the shared folder, from where every executor fetches it once; returns the file's name."""
    merges = merges_of(vocabulary)
    # The space before a unit is part of it.
    words = {f" {x}".encode(): merges.encode(f" {x}") for x in frequent_units(docs, text=text, most=most, least=least)}
    data = compile_lexicon(words)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    docs.sparkSession.sparkContext.addFile(put_file(docs.sparkSession, name, data))
    return name


def encode(docs: DataFrame, vocabulary: str, lexicon: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of docs: (*carry, ids), ids as the bytes of little-endian uint32."""
    return _mapped(docs, vocabulary, lexicon, text, carry, False)


def encode_and_decode(docs: DataFrame, vocabulary: str, lexicon: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of docs: (*carry, ids, decoded): the ids and the text that they decode to."""
    return _mapped(docs, vocabulary, lexicon, text, carry, True)


def _mapped(docs: DataFrame, vocabulary: str, lexicon: str, text: str, carry: tuple[str, ...], back: bool) -> DataFrame:
    carry = carried(carry, "ids", *["decoded"] * back)
    rows = docs.select(*carry, whole(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary, lexicon)
        for x in batches:
            for at in range(0, x.num_rows, _AT_ONCE):
                part = x.slice(at, _AT_ONCE)
                ids = coder.encode(part.column(len(carry)).to_pylist())
                out = [*part.columns[: len(carry)], pa.array(ids, pa.binary())]
                if back:
                    out.append(pa.array([coder.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [*carry, "ids", *["decoded"] * back])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, ids binary" + ", decoded string" * back)


def decode(rows: DataFrame, vocabulary: str, lexicon: str, *, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row: (*carry, decoded) of ids as encode gives them; null ids decode to null."""
    carry = carried(carry, "decoded")
    chosen = rows.select(*carry, F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary, lexicon)
        for x in batches:
            text = [None if i is None else coder.decode(i) for i in x.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(carry)], pa.array(text, pa.string())], [*carry, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{kinds}, decoded string")
