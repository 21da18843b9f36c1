"""Format-preserving pseudonyms for personal numbers and dates by keyed Feistel permutations.

Candidates are found by pattern and validated: payment cards (13 to 19 digits, Luhn), IBANs (mod 97), North American and
international telephone numbers, social security numbers, IPv4 addresses, calendar dates, and the local part of email
addresses. A valid value is mapped to its number in the set of valid values of its format; the set is permuted by a keyed
Feistel network with cycle walking, and the result is written in the same layout, with check digits made anew. So equal
values get equal pseudonyms in every document, a pseudonym is valid and parses like the value, and whoever has the key can
turn it back. The permutation is P^-1(P(x) + shift), which has no fixed point: no valid value stays as it is. Numbers that
fail validation are left alone.

The work is one pass over whole texts without a shuffle.

Defined results: null text stays null. Repeated rows each get the same result. Overlapping candidates: the earlier wins,
of equal starts the earlier kind in KINDS. An empty table gives an empty result. A carried column named like an output is
left out.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.shared import carried

ROUNDS = 8
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_AREA, _EXCHANGE = 800, 800  # 200 to 999


def feistel(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over the next even number of bits, cycle-walked."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    bytes_of_half = (half + 7) // 8

    def turn(k: int, value: int) -> int:
        data = k.to_bytes(1, "big") + value.to_bytes(bytes_of_half, "big") + tweak.encode()
        return int.from_bytes(hashlib.blake2b(data, digest_size=min(64, bytes_of_half + 4), key=key[:64]).digest(), "big") & mask

    while True:
        left, right = x >> half, x & mask
        if back:
            for k in reversed(range(ROUNDS)):
                left, right = right ^ turn(k, left), left
        else:
            for k in range(ROUNDS):
                left, right = right, left ^ turn(k, right)
        x = left << half | right
        if x < size:
            return x


def permuted(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size) without fixed points (for size > 1)."""
    if size < 2:
        return x
    shift = 1 + int.from_bytes(hashlib.blake2b(tweak.encode(), digest_size=16, key=key[:64]).digest(), "big") % (size - 1)
    return feistel((feistel(x, size, key, tweak) + (-shift if back else shift)) % size, size, key, tweak, back=True)


def luhn_digit(payload: str) -> str:
    """The check digit after a payload."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    """The two check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _laid_out(text: str, digits: str) -> str:
    """The digits in the places of the text's digits."""
    rest = iter(digits)
    return re.sub("[0-9]", lambda _: next(rest), text)


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    digits = re.sub("[^0-9]", "", m[0])
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    # Values of one repeated digit aren't cards; walking on leaves them out of the set.
    x = int(digits[:-1])
    while True:
        x = permuted(x, 10**n, key, f"card{n}", back)
        new = f"{x:0{n}d}"
        if len(set(new + luhn_digit(new))) > 1:
            return _laid_out(m[0], new + luhn_digit(new))


#: The lengths of the registered countries' numbers.
_IBAN_SIZES = {
    k: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in names.split()
}


def _iban_matches(text: str) -> Iterator[re.Match]:
    """What may be a number: each longest match, cut where its country's length ends if that is a token's end."""
    pattern, at = _PATTERNS["iban"], 0
    while m := pattern.search(text, at):
        size, end = _IBAN_SIZES.get(m[0][:2]), None
        if size:
            taken = [k for k, c in enumerate(m[0]) if c != " "]
            if len(taken) >= size:
                end = m.start() + taken[size - 1] + 1
        cut = pattern.fullmatch(text, m.start(), end) if end and (end == len(text) or not (text[end].isascii() and text[end].isalnum())) else None
        found = cut or m
        compact = found[0].replace(" ", "")
        if iban_check(compact[:2], compact[4:]) == compact[2:4]:
            yield found
            at = found.end()
        else:
            at = m.start() + 1  # a number may begin within what was no number


def _iban(m: re.Match, key: bytes, back: bool) -> str | None:
    text = m[0].replace(" ", "")
    country, check, rest = text[:2], text[2:4], text[4:]
    if not 15 <= len(text) <= 34 or iban_check(country, rest) != check:
        return None
    digits = re.sub("[^0-9]", "", rest)
    if not digits:
        return None
    n = len(digits)
    new = _laid_out(rest, f"{permuted(int(digits), 10**n, key, f'iban{country}{n}', back):0{n}d}")
    parts = iter(country + iban_check(country, new) + new)
    return "".join(c if c == " " else next(parts) for c in m[0])


def _american(m: re.Match, key: bytes, back: bool) -> str | None:
    area, exchange, line = int(m["area"]), int(m["exchange"]), int(m["line"])
    if area < 200 or exchange < 200:
        return None
    x = permuted(((area - 200) * _EXCHANGE + exchange - 200) * 10_000 + line, _AREA * _EXCHANGE * 10_000, key, "nanp", back)
    rest, line = divmod(x, 10_000)
    area, exchange = divmod(rest, _EXCHANGE)
    a = m.start("area") - m.start()
    return m[0][:a] + _laid_out(m[0][a:], f"{area + 200}{exchange + 200}{line:04d}")


def _international(m: re.Match, key: bytes, back: bool) -> str | None:
    digits = re.sub("[^0-9]", "", m[0])
    if not 8 <= len(digits) <= 15 or digits[0] == "1":  # +1 is the plan above, valid or not
        return None
    n = len(digits) - 2  # the first two digits stay: country codes begin there
    return _laid_out(m[0], digits[:2] + f"{permuted(int(digits[2:]), 10**n, key, f'tel{digits[:2]}{n}', back):0{n}d}")


def _security(m: re.Match, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(x) for x in m[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(permuted(x, 898 * 99 * 9999, key, "ssn", back), 9999)
    area, group = divmod(rest, 99)
    area += 1
    return f"{area + (area > 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _address(m: re.Match, key: bytes, back: bool) -> str | None:
    octets = m[0].split(".")
    if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in octets):
        return None
    x = permuted(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, "ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _day(year: int, month: int, day: int) -> int | None:
    try:
        n = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    return n if _FIRST <= n <= _LAST else None


def _moved_day(n: int, key: bytes, back: bool, fits: Callable[[datetime.date], bool] = lambda d: True) -> datetime.date:
    """The pseudonym of a day among the days that fit."""
    while True:
        n = permuted(n - _FIRST, _LAST - _FIRST + 1, key, "day", back) + _FIRST
        if fits(found := datetime.date.fromordinal(n)):
            return found


def _iso_date(m: re.Match, key: bytes, back: bool) -> str | None:
    mark = m[0][4]
    n = _day(*(int(x) for x in m[0].split(mark)))
    return None if n is None else _moved_day(n, key, back).strftime(f"%Y{mark}%m{mark}%d")


def _short_date(m: re.Match, key: bytes, back: bool) -> str | None:
    """Month first if that is a date, else day first (where the day is over 12, so that it is read so again).

    Dots mean day first. Parts of one digit make a layout of their own, in which only days that are written with as many
    digits take part.
    """
    a, mark, b, year = m["a"], m["mark"], m["b"], int(m["year"])
    wide = lambda x, text: len(str(x)) == len(text) or len(text) == 2
    as_text = lambda x, text: f"{x:02d}" if len(text) == 2 else str(x)
    month_first = mark != "." and _day(year, int(a), int(b)) is not None
    n = _day(year, int(a), int(b)) if month_first else _day(year, int(b), int(a))
    if n is None:
        return None
    if month_first:
        d = _moved_day(n, key, back, lambda d: wide(d.month, a) and wide(d.day, b))
        return f"{as_text(d.month, a)}{mark}{as_text(d.day, b)}{mark}{d.year}"
    d = _moved_day(n, key, back, lambda d: (mark == "." or d.day > 12) and wide(d.day, a) and wide(d.month, b))
    return f"{as_text(d.day, a)}{mark}{as_text(d.month, b)}{mark}{d.year}"


def _email(m: re.Match, key: bytes, back: bool) -> str | None:
    """Letters and digits of the local part are permuted, each in its class; an address of neither has nothing to hide."""
    local, _, domain = m[0].rpartition("@")
    sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in local]
    x, size = 0, 1
    for c, n in zip(local, sizes):
        if n > 1:
            x, size = x * n + (int(c) if n == 10 else ord(c.lower()) - 97), size * n
    if size < 2:
        return None
    shape = "".join("9" if n == 10 else "a" if n == 26 else c for c, n in zip(local, sizes))
    x = permuted(x, size, key, f"mail{shape}@{domain.lower()}", back)
    out = []
    for c, n in zip(reversed(local), reversed(sizes)):
        x, k = divmod(x, n)
        new = c if n == 1 else str(k) if n == 10 else chr(97 + k)
        out.append(new.upper() if c.isupper() else new)
    return f"{''.join(reversed(out))}@{domain}"


_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: kind: (pattern, the pseudonym of a valid match, else None).
KINDS: dict[str, tuple[str, Callable[[re.Match, bytes, bool], str | None]]] = {
    "email": (r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}@(?:[0-9A-Za-z-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _E, _email),
    "iban": (_B + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?" + _E, _iban),
    "phone": (r"(?:(?<![0-9A-Za-z+(])\+?1[ .-]?)?(?<![0-9A-Za-z])(?P<open>\()?(?P<area>[0-9]{3})(?(open)\)[ .-]?|[ .-])(?P<exchange>[0-9]{3})[ .-](?P<line>[0-9]{4})" + _E, _american),
    "telephone": (r"(?<![0-9A-Za-z+])\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}" + _E, _international),
    "card": (_B + r"(?:[0-9]{13,19}|[0-9]{4}(?P<m>[ -])[0-9]{4}(?P=m)[0-9]{4}(?P=m)[0-9]{1,7}|[0-9]{4}(?P<n>[ -])[0-9]{6}(?P=n)[0-9]{4,5})" + _E, _card),
    "ssn": (_B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E, _security),
    "ipv4": (r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z])(?!\.[0-9])", _address),
    "date": (r"(?<![0-9A-Za-z./-])[0-9]{4}(?P<i>[-/.])[0-9]{2}(?P=i)[0-9]{2}(?![0-9]|[A-SU-Za-z]|[./-][0-9])", _iso_date),
    "short_date": (r"(?<![0-9A-Za-z./-])(?P<a>[0-9]{1,2})(?P<mark>[-/.])(?P<b>[0-9]{1,2})(?P=mark)(?P<year>[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])", _short_date),
}
_PATTERNS = {k: re.compile(p) for k, (p, _) in KINDS.items()}
_DIGIT_OR_AT = re.compile("[0-9@]")


@lru_cache(maxsize=200_000)
def _remembered(kind: str, value: str, key: bytes, back: bool) -> str | None:
    m = _PATTERNS[kind].fullmatch(value)
    return KINDS[kind][1](m, key, back) if m else None


def spans(text: str, key: bytes, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each valid value, in order."""
    if not _DIGIT_OR_AT.search(text):
        return []
    found = []
    for rank, (kind, pattern) in enumerate(_PATTERNS.items()):
        for m in _iban_matches(text) if kind == "iban" else pattern.finditer(text):
            new = _remembered(kind, m[0], key, back)
            if new is not None:
                found.append((m.start(), rank, m.end(), kind, new))
    out, at = [], 0
    for start, _, end, kind, new in sorted(found):
        if start >= at:
            out.append((start, end, kind, new))
            at = end
    return out


def pseudonymised(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
    found, parts, at = spans(text, key, back), [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), found


SPANS = "array<struct<start:int,end:int,kind:string>>"


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """Each row of docs: (*carry, text, spans of the original text). back: undoes it with the same key."""
    carry = carried(carry, "text", "spans")
    rows = docs.select(*carry, F.col(text).alias("__text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 1024):
                part = x.slice(at, 1024)
                done = [(None, []) if t is None else pseudonymised(t, key, back) for t in part.column(len(carry)).to_pylist()]
                found = [[{"start": a, "end": b, "kind": k} for a, b, k, _ in s] for _, s in done]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array([t for t, _ in done], pa.string()), pa.array(found, kind)], [*carry, "text", "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, text string, spans {SPANS}")
