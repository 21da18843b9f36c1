"""Vectorised pre-tokens and cached merging, against the library of the rank file."""

import base64
import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from concordat.llm import bpe_slices, pretokens, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "é", " ", "  ", "\n", "\t", "'", "'s", "'t", "'ll", "'re", "'ve", "'l", "'r", "'m", "'d", "don't", "12", "½", "😀", "中", "́", "_", "\x1f", " ", "\r\n", "S", "s", "e", "l", "\x00", "ͅ", "\U0001e5f0", "Ɤ", "!!", "\U000105c0", "<|endoftext|>", "ſ", "'ſ", "ab"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    random.seed(13)
    some = ["".join(random.choices(PARTS, k=random.randint(0, 60))) for _ in range(3000)]
    return [*some, "a" * 5000, " " * 3000 + "x", "\n" * 2001, "ab" * 3000, "x" * 64, "y" * 65 + "z", "", "'", "'s", " 's", "x 's's", "\n's", "!'s"]


@pytest.mark.parametrize("window", [1, 2, 7, 1000, 1 << 20])
def test_ids_equal_the_library(library, texts, window, monkeypatch):
    monkeypatch.setattr(pretokens, "WINDOW", window)
    some = texts if window > 100 else texts[:200]
    ranks = bpe_slices.ranks_of(PATH)
    for x, (ids, ends, id_ends) in zip(some, bpe_slices.encode_texts(ranks, some), strict=True):
        assert array("I", ids).tolist() == library.encode_ordinary(x), x
        assert ranks.decode(ids) == x.encode() and len(ends) == len(id_ends)


def test_spans_by_offsets(texts):
    ranks = bpe_slices.ranks_of(PATH)
    random.seed(5)
    for x, coded in list(zip(texts, bpe_slices.encode_texts(ranks, texts)))[::7]:
        whole = x.encode()
        a, b = random.randint(0, len(whole)), random.randint(0, len(whole) + 3)
        assert bpe_slices.span(ranks, *coded, a, b) == whole[a:b]
        assert bpe_slices.span(ranks, *coded, 0, len(whole)) == whole


def test_forgetful_memo(library, texts, monkeypatch):
    monkeypatch.setattr(bpe_slices, "MEMO", 10)
    monkeypatch.setattr(bpe_slices, "TOGETHER", 3)
    ranks = bpe_slices.Ranks(PATH)
    for block in bpe_slices.blocks(texts[:300]):
        assert [array("I", x[0]).tolist() for x in bpe_slices.encode_texts(ranks, block)] == [library.encode_ordinary(x) for x in block]


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "No id."), (4, "x" * 200_000 + " " * 200_000), (5, "twice"), (5, "twice"), (6, " \n\t "), (7, "naïve 😀\r\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "-1 as ids", "'x' as decoded", "0 as other")
    got = bpe_slices.encode_and_decode(docs, PATH, carry=tuple(c for c in docs.columns if c != "text")).collect()
    assert got[0].asDict().keys() == {"doc_id", "other", "ids", "ends", "id_ends", "decoded"}
    for (key, text), r in zip(rows, sorted(got, key=lambda r: [k for k, t in rows].index(r.doc_id))):
        assert r.doc_id == key and bytes(r.decoded) == (text or "").encode() and array("I", bytes(r.ids)).tolist() == library.encode_ordinary(text or "")
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe_slices.encode(empty, PATH).count() == 0
    back = bpe_slices.decode(bpe_slices.encode(docs, PATH).selectExpr("doc_id", "if(doc_id = 7, null, ids) as ids"), PATH)
    assert {r.doc_id: r.decoded for r in back.collect()}[7] is None


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_bpe_slices(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
