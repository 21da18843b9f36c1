"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much text are rejected.

Words are runs of anything but ASCII white space; a line is judged only if it has a word. A line fails as
- punctuation: at least `long_line` words and no sentence mark in it, or at least five words and more than one symbol of
  #*$%&|<> for every two words;
- navigation: at least `separators` separators of |>· and kind, and no more than four words for each of them;
- boilerplate: in a line of at most `notice_words` words, a phrase of the fixed lists (A-Z in any case); a repeat of an
  earlier line of the document; or a line that the corpus repeats: of three words or more, found after many different
  lines, at least `common_least` of them, `common_share` of the number of documents, and half of the times it is found.
  Copies of a text repeat its lines after the same lines, so they make none common.

Documents fail the base test below 50 words, or if over half their words stand in a 3-word window found twice or more.
They are rejected if over `max_lost` of their word characters stood in failing lines.

Lines are counted by Spark as digests, combined before the shuffle. Common lines are few at any size: there are as many as
the average document's lines divided by `common_share` at most, and their digests (16 bytes each) are what is broadcast.
The cleaning itself is one pass over whole texts without a shuffle.

Defined results: null text counts as empty (no words, base_failed). Repeated rows each get their result. An empty table
gives an empty result. A carried column named like an output is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.shared import carried, whole, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MARKS = "[.!?;:…。！？]"
SEPARATORS = "[|»›·•]"
#: Phrases of notices in English, French, German and Spanish.
PHRASES = (
    "accept all cookies", "all rights reserved", "back to top", "by continuing to use this site", "click here to",
    "cookie policy", "enable javascript", "forgot your password", "javascript is disabled", "javascript is required",
    "licensed under the", "lorem ipsum", "privacy policy", "released under the", "share on facebook",
    "share on twitter", "sign up for our newsletter", "skip to content", "subscribe to our newsletter", "terms of service",
    "terms of use", "this site uses cookies", "use of cookies", "we use cookies",
    "aller au contenu", "conditions d'utilisation", "mentions legales", "nous utilisons des cookies", "partager sur facebook",
    "politique de cookies", "retour en haut", "tous droits r[ée]serv[ée]s",
    "alle cookies akzeptieren", "alle rechte vorbehalten", "allgemeine gesch[äa]ftsbedingungen", "auf facebook teilen",
    "nach oben scrollen", "newsletter abonnieren", "wir verwenden cookies", "zum inhalt springen",
    "aceptar todas las cookies", "aviso legal", "compartir en facebook", "ir al contenido", "pol[íi]tica de cookies",
    "pol[íi]tica de privacidad", "todos los derechos reservados", "volver arriba",
)
NOTICE = "(?i:" + "|".join(PHRASES) + ")|©"
DEFAULTS = {"long_line": 12, "separators": 3, "notice_words": 40, "max_lost": 0.5, "common_least": 10, "common_share": 0.001, "common_words": 3}

_SYMBOLS, _MARKS, _SEPARATORS, _NOTICE = map(re.compile, (SYMBOLS, MARKS, SEPARATORS, NOTICE.replace("(?i:", "(?ai:")))
_SPACES = re.compile(r"[\x20\x09-\x0D]+")

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_failed_lines bigint, lost_chars bigint, kept boolean, clean_text string"


def line_fault(line: str, n_words: int, rules: dict) -> str | None:
    """The rule that a line with words breaks, by itself."""
    marks = len(_SYMBOLS.findall(line))
    if n_words >= rules["long_line"] and not _MARKS.search(line) or n_words >= 5 and 2 * marks > n_words:
        return "punctuation"
    parts = len(_SEPARATORS.findall(line))
    if parts >= rules["separators"] and n_words <= 4 * parts:
        return "navigation"
    if n_words <= rules["notice_words"] and _NOTICE.search(line):
        return "boilerplate"
    return None


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered, total = 0, 0
    for k, x in enumerate(windows):
        if found[x] > 1:
            total += k + 3 - max(k, covered)
            covered = k + 3
    return total


def clean(text: str, rules: dict, common: frozenset[bytes] = frozenset()) -> tuple:
    """The values of SCHEMA for one text. common: MD5 digests of lines that the corpus repeats."""
    words = text.encode().split()
    n_words, symbols, repeated = len(words), len(_SYMBOLS.findall(text)), repeat_words(words)
    total = lost = duplicates = faults = 0
    seen, left = set(), []
    for line in text.split("\n"):
        chars = len(_SPACES.sub("", line))
        total += chars
        if chars:
            again = line in seen
            seen.add(line)
            duplicates += again
            coded = line.encode()
            if again or line_fault(line, len(coded.split()), rules) or common and hashlib.md5(coded, usedforsecurity=False).digest() in common:
                faults += 1
                lost += chars
                continue
        left.append(line)
    base_failed = n_words < 50 or 100 * repeated > 50 * n_words
    kept = not base_failed and lost <= rules["max_lost"] * total
    return n_words, total, symbols, duplicates, repeated, base_failed, faults, lost, kept, "\n".join(left)


def common_lines(docs: DataFrame, *, text: str = "text", **rules) -> DataFrame:
    """(line: its MD5 digest) of the lines that the corpus repeats after many different lines.

    A document's first line has the digest of nothing before it. Only lines of common_words to notice_words words count.
    """
    settings = DEFAULTS | rules
    lines = F.split(whole(text), "\n", -1)
    hashed = lambda c: F.unhex(F.md5(c))
    least = docs.agg(F.greatest(F.lit(float(settings["common_least"])), F.count("*") * settings["common_share"])).first()[0]  # one number
    # A line can't come after more different lines than it comes at all, so rare ones, nearly all, go before lines are paired.
    words = F.regexp_count("line", F.lit(WORD)).between(settings["common_words"], settings["notice_words"])
    single = docs.select(F.explode(lines).alias("line")).filter(words).groupBy(hashed(F.col("line")).alias("line")).agg(F.count("*").alias("n"))
    often = written(single.filter(F.col("n") >= least).select("line"), "frequent-lines")
    each = F.transform(lines, lambda x, k: F.struct(hashed(x).alias("line"), F.get(lines, k - 1).alias("before")))
    near = docs.select(F.explode(each).alias("x")).select("x.*").join(often, "line", "left_semi").select("line", hashed(F.coalesce("before", F.lit(""))).alias("before"))
    pairs = near.groupBy("line", "before").agg(F.count("*").alias("n"))
    found = pairs.groupBy("line").agg(F.count("*").alias("different"), F.sum("n").alias("n"))
    return found.filter((F.col("different") >= least) & (2 * F.col("different") >= F.col("n"))).select("line")


def clean_lines(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), **rules) -> DataFrame:
    """Each row of docs: (*carry, SCHEMA). clean_text is the text without failing lines, for kept and rejected alike."""
    settings = DEFAULTS | rules
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    carry = carried(carry, *names)
    rows = docs.select(*carry, whole(text).alias("__text"))
    types = [{"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]] for x in SCHEMA.split(", ")]
    # Bounded by lines a document / common_share, whatever the number of documents.
    found = written(common_lines(docs, text=text, **rules), "common-lines").collect()
    held = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.line) for r in found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for x in batches:
            for at in range(0, x.num_rows, 512):
                part = x.slice(at, 512)
                columns = zip(*(clean(t, settings, common) for t in part.column(len(carry)).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *map(pa.array, columns, types)], [*carry, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, {SCHEMA}" if kinds else SCHEMA)
