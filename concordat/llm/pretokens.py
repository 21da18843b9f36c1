"""Pre-tokens of a byte-level vocabulary by arrays: codepoint classes and an associative scan of transition functions.

The pattern (PATTERN in bpe.py) splits a text into words with the space before them, numbers, other characters, white space
and the endings 's 't 're 've 'm 'll 'd. A small automaton does the same: each character is a symbol, each symbol a function
from state to state. Composition of such functions is associative, and the functions that compositions can give are few, so
they are numbered and their products tabled. A scan is then a lookup for each character: lanes of the text compose their
functions side by side, the lanes' totals are composed in turn, and every character gets the state before it.

Windows of WINDOW characters carry the state on, so a text of any length needs memory for its codepoints and one window.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

WINDOW, LANE = 1 << 20, 256

#: Classes of codepoints.
OTHER, LETTER, NUMBER, BLANK = range(4)
#: Symbols: a letter, a number, anything else, an apostrophe that may begin an ending of two or of three characters, white
#: space before more white space (or at the text's end), a space and other white space before something else, a text's end.
S_LETTER, S_NUMBER, S_OTHER, S_ENDING_2, S_ENDING_3, S_BLANKS, S_SPACE, S_BLANK, S_STOP = range(9)
#: States: nothing open, open run of letters, numbers, others, white space; behind the space of the next run; one or two
#: characters of an ending to come.
FREE, LETTERS, NUMBERS, OTHERS, BLANKS, SPACE, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state behind a character, and whether a pre-token begins with it."""
    if symbol == S_STOP:
        return FREE, True
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FREE, False
    if symbol in (S_LETTER, S_NUMBER):
        run = LETTERS if symbol == S_LETTER else NUMBERS
        return run, state not in (run, SPACE)
    if symbol in (S_OTHER, S_ENDING_2, S_ENDING_3):
        if state in (OTHERS, SPACE):
            return OTHERS, False
        return {S_OTHER: OTHERS, S_ENDING_2: ONE_MORE, S_ENDING_3: TWO_MORE}[symbol], True
    if symbol == S_BLANKS:
        return BLANKS, state != BLANKS
    return (SPACE if symbol == S_SPACE else FREE), True


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each symbol's function, product of two functions, function applied to a state, begins[state, symbol])."""
    basic = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {tuple(range(8)): 0}
    for f in basic:
        known.setdefault(f, len(known))
    grown = list(known)
    for f in grown:
        for g in basic:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                grown.append(h)
    n = len(grown)
    product = np.array([[known[tuple(g[x] for x in f)] for g in grown] for f in grown], np.uint16).reshape(-1)
    applied = np.array(grown, np.uint8).reshape(-1)
    begins = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)]).reshape(-1)
    return np.array([known[f] for f in basic], np.uint16), product.reshape(n, n), applied.reshape(n, 8), begins.reshape(8, 9)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each codepoint, in the version of Unicode that the library's patterns follow.

    The library drops what its pattern doesn't match, so coding all codepoints by single bytes leaves those of a class.
    """
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        coder = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[_codepoints(bytes(coder.encode_ordinary(everything)).decode())] = kind
    return table


def _codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _symbols(points: np.ndarray, kinds: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Symbols of a window; the last two positions (codepoint 0, a stop) only serve to look ahead."""
    n = len(points) - 2
    kind, after = kinds[:n], kinds[1 : n + 1]
    symbol = np.where(kind == LETTER, S_LETTER, np.where(kind == NUMBER, S_NUMBER, S_OTHER)).astype(np.uint8)
    blank = np.flatnonzero(kind == BLANK)
    more = (after[blank] == BLANK) | stops[1 : n + 1][blank]
    symbol[blank] = np.where(more, S_BLANKS, np.where(points[blank] == 0x20, S_SPACE, S_BLANK))
    quote = np.flatnonzero(points[:n] == 0x27)
    if len(quote):
        a, b = points[quote + 1], points[quote + 2]
        # 's 't 'm 'd, then 're 've 'll
        symbol[quote[np.isin(a, (0x73, 0x74, 0x6D, 0x64))]] = S_ENDING_2
        symbol[quote[(np.isin(a, (0x72, 0x76)) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))]] = S_ENDING_3
    symbol[stops[:n]] = S_STOP
    return symbol


def _before(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each symbol, and the one behind the last."""
    number, product, applied, _ = _functions()
    n = len(symbols)
    width = -(-n // LANE)
    lanes = np.zeros(width * LANE, np.uint16)  # 0 is the identity
    lanes[:n] = number[symbols]
    lanes = np.ascontiguousarray(lanes.reshape(width, LANE).T)
    for k in range(1, LANE):
        lanes[k] = product[lanes[k - 1], lanes[k]]
    totals, reach = lanes[-1].copy(), 1
    while reach < width:  # each lane's total becomes that of all lanes up to it
        totals[reach:] = product[totals[:-reach], totals[reach:]]
        reach *= 2
    first = np.concatenate([[state], applied[totals[:-1], state]]).astype(np.uint8)
    behind = applied[lanes, first].T.reshape(-1)
    states = np.empty(n, np.uint8)
    states[0], states[1:] = state, behind[: n - 1]
    return states, int(behind[n - 1])


def starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets at which pre-tokens begin, place of each text's end among them), in the UTF-8 of all texts.

    One byte follows each text; its offset is listed too and ends the text's last pre-token.
    """
    joined = _codepoints("\x00".join(texts) + "\x00")
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))) - 1
    stops = np.zeros(len(joined) + 2, bool)
    stops[ends] = True
    begins = _functions()[3]
    begin, stop = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    state, at_byte = FREE, 0
    for at in range(0, len(joined) if texts else 0, WINDOW):
        points = joined[at : at + WINDOW + 2]
        ahead = min(2, max(0, len(joined) - at - WINDOW))
        points = np.concatenate([points, np.zeros(2 - ahead, np.uint32)])
        symbols = _symbols(points, classes()[points], stops[at : at + len(points)])
        points = points[: len(symbols)]
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.cumsum(size) - size + at_byte
        states, state = _before(symbols, state)
        begin.append(offsets[begins[states, symbols]])
        stop.append(offsets[symbols == S_STOP])
        at_byte = int(offsets[-1] + size[-1])
    begin = np.concatenate(begin)
    return begin, np.searchsorted(begin, np.concatenate(stop))
