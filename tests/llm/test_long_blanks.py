"""White-space runs of millions of characters are encoded whole, as the library encodes them."""

import public_tokenizers
import pytest
from concordat.llm import bpe, queries, token_cache
from tokenizers import Tokenizer


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + " " * 2_000_000 + "b", "a " + "\t" * 1_200_000 + "\n" + "b c", "x" + "\n" * 1_200_000, "a" + " \n" * 600_000 + " <|endoftext|>" + " " * 1_200_000 + "<|endoftext|> b", "é" + "　" * 1_200_000 + " é"])
def test_long_blanks(text):
    path = public_tokenizers.path(queries.BPE_50K)
    merges = bpe.merges_of(path)
    own = Tokenizer.from_file(path)
    own.no_truncation()
    want = own.encode(text, add_special_tokens=False).ids
    assert merges.ranked and merges.encode(text) == want
    assert token_cache.counter(path)([text]) == [len(want)]


def test_blank_runs_around_the_limit(monkeypatch):
    """With a low limit every position of a run takes the way of long runs."""
    monkeypatch.setattr(bpe, "BLANKS", 3)
    monkeypatch.setattr(bpe, "_BLANK_RUN", bpe.regex.compile(r"(?<!\s)\s{3,}"))
    merges = bpe.merges_of(public_tokenizers.path(queries.BPE_50K))
    for blank in (" " * 3, " " * 7, "\n\n\n", " \n \t ", "\t\t\t ", "\x1c" * 4, "\x85" * 3 + " "):
        for text in (blank, f"a{blank}", f"{blank}a", f"a{blank}b{blank}'s 12{blank}!", f"<|endoftext|>{blank}<|endoftext|>{blank}a"):
            assert merges.encode(text) == merges.encode_by_pairs(text)


def test_operators_on_a_long_run(spark, tmp_path):
    """Query 9's and query 2's operators return a document with two million spaces with all its ids."""
    path, text = public_tokenizers.path(queries.BPE_50K), "one two" + " " * 2_000_000 + "three four"
    docs = spark.createDataFrame([(1, text), (2, "one two")], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.encode_and_decode(docs, path, bpe.ship_lexicon(docs, path)).collect()}
    own = Tokenizer.from_file(path)
    assert rows[1].decoded == text and len(rows[1].ids) == 4 * len(own.encode(text, add_special_tokens=False).ids)
    counted = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(docs, path, f"file://{tmp_path}/cache").collect()}
    assert counted[1] * 4 == len(rows[1].ids) and counted[2] * 4 == len(rows[2].ids)
