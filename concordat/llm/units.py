"""Text as units that a byte-level BPE encodes one by one: pieces between single spaces.

A byte-level vocabulary splits text with a pattern in which a space belongs to the word after it. So a space between two
characters that aren't white space always starts a new pre-token, and the codes of a text are those of its units put
together. Units repeat, so a memo and a lexicon do most of the work.
"""

from __future__ import annotations

import re

#: White space other than the space and the line feed.
_ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Units of more characters aren't remembered.
LONG = 64


def units(text: str) -> list[str]:
    """The text cut at each space that has other than white space on both sides; units stand without that space.

    A text that begins with a space has an empty first unit.
    """
    if text[-1:] == " " or text[:2] == " \n" or "  " in text or " \n" in text or "\n " in text or _ODD.search(text):
        return _SINGLE.split(text)
    return text.split(" ")
