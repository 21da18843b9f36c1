"""Token counts through a digest cache.

The cache is a table of (version, digest, n_tokens): version names the tokenizer (its file's digest and the counting
rule), digest is the SHA-256 of the normalised text. Counting joins the documents' digests to it, encodes only the
distinct texts that it misses, appends their counts, and reads the counts of all documents from it.

Digests go first: they alone are grouped and asked for. Of each missed digest one row's place is chosen, and only the
texts at these places are read again and encoded, so copies never move, a hit moves no text, and no digest is hot. The
cache is appended by Spark's committer; a lost executor repeats its own tasks.

Defined results: null text counts as empty (0 bytes, 0 tokens). Repeated rows each get their count. Special strings in a
text are handled as the library does by default. Nothing is cut or padded, and no begin or end tokens are added. An empty
table gives an empty result. A carried column named like an output is left out.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.shared import FILE, ROW, carried, located, only, whole, written

RULE = "plain-1"


def version_of(tokenizer: str) -> str:
    """Names the tokenizer: a digest of its file and of the rule by which it is used."""
    with open(tokenizer, "rb") as file:
        return hashlib.sha256(file.read() + RULE.encode()).hexdigest()[:32]


@lru_cache(maxsize=4)
def counter(tokenizer: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts; one per worker process and tokenizer file."""
    if tokenizer.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        from concordat.llm.bpe import PATTERN, native

        with open(tokenizer, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(native(coder, x)) for x in texts]
    from concordat.llm.bpe import merges_of

    try:
        merges = merges_of(tokenizer)
    except ValueError:
        merges = None
    if merges and merges.ranked:  # gives what the library gives, several times faster
        return lambda texts: [len(merges.encode(x)) for x in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(x) for x in own.encode_batch(texts, add_special_tokens=False)]


def _cached(seen: DataFrame, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds of the digests seen; of a cache that has more only these move."""
    try:
        held = seen.sparkSession.read.schema("digest binary, n_tokens bigint").parquet(f"{cache}/version={version}")
    except AnalysisException:
        return seen.sparkSession.createDataFrame([], "digest binary, n_tokens bigint")
    ours = held.join(seen.select("digest"), "digest", "left_semi")
    return ours.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have added the same text


def digest_of(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _seen(here: DataFrame, body: Column) -> DataFrame:
    """(digest, FILE, ROW): one place of each distinct text, a written table."""
    found = here.select(digest_of(body).alias("digest"), F.struct(FILE, ROW).alias("place")).groupBy("digest").agg(F.min("place").alias("place"))
    return written(found.select("digest", f"place.{FILE}", f"place.{ROW}"), "digests")


def _add_misses(here: DataFrame, seen: DataFrame, body: Column, tokenizer: str, cache: str, version: str) -> None:
    """Encodes the texts whose digests the cache misses, each at its one place, and appends their counts."""
    missing = seen.join(_cached(seen, cache, version), "digest", "left_anti")
    texts = only(here, missing).select(digest_of(body).alias("digest"), body.alias("body"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for x in batches:
            for at in range(0, x.num_rows, 512):
                part = x.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    texts.mapInArrow(encode, "digest binary, n_tokens bigint").write.mode("append").parquet(f"{cache}/version={version}")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), normalise: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Each row of docs: (*carry, digest, n_bytes, n_tokens), through the cache at the path cache."""
    version, here, body = version_of(tokenizer), located(docs), normalise(whole(text))
    seen = _seen(here, body)
    _add_misses(here, seen, body, tokenizer, cache, version)
    carry = carried(carry, "digest", "n_bytes", "n_tokens")
    rows = here.select(*carry, digest_of(body).alias("digest"), F.octet_length(body).cast("bigint").alias("n_bytes"))
    # As a written table the counts' size is known: Spark broadcasts them where they are few, else it may split a hot digest.
    counts = written(_cached(seen, cache, version), "counts")
    return rows.join(counts, "digest", "left").select(*carry, "digest", "n_bytes", "n_tokens")
