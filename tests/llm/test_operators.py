import hashlib
import random
import re

import public_tokenizers
import pytest
from concordat.llm import bpe, exact_stream, langid, line_clean, mixing, pseudonym, queries, simhash, token_cache, units, url_reputation, warc
from concordat.llm.shared import scratch
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, "Some words here. And more.", "en", None, 5), (4, "x" * 200_000, "en", "a", 1),
    (5, "the same text twice", "en", "a", 2), (5, "the same text twice", "en", "a", 2), (6, " \n\t ", "fr", "b", 3), (7, "naïve café\u00a0<|endoftext|> 😀\r\n", "fr", "b", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("digest", F.lit("clash")).withColumn("n_tokens", F.lit(-1)).withColumn("kept", F.lit(False)).withColumn("block", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(rows=200):
    import pyarrow.parquet as pq

    random.seed(3)
    alphabet = ["a", "é", "  ", " ", "\n", "\t", "'s", "don't", "12", "½", "😀", "<|endoftext|>", "中文", "\u0301", "_", "\x1f", "\u00a0", "\r\n"]
    made = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(500)]
    return pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:rows] + made + ["a" * 5000, " " * 300, "x" * 70 + " y", " lead", "trail "]


# 1: url reputation


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = re.split(r"[?#]", rest[cut:])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def test_rules(spark):
    urls = [None, "", "no scheme", "http://A.COM/x", "http://a.com", "http://www.example.com/en/1", "x://m.example.com/en/?q", "http://notexample.com/en/", "https://a.net/es/#f", "https://a.net/de/", "http://a.net?x=/fr/", "http://É.net/fr/", "a://b://c.com/", "http://example.com/en"]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string")
    got = url_reputation.judge(frame, spark.createDataFrame([], "host string, bad int"), queries.URL_RULES).collect()
    rules = {(t.split("/")[0], "/" + t.split("/", 1)[1]): (t, k) for k, t in queries.URL_RULES}
    assert len(got) == len(urls)
    for r in got:
        host, path = host_and_path(urls[r.page_id])
        fits = sorted(((len(t), t, k) for (h, p), (t, k) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)), reverse=True)
        assert (r.host, r.path, r.rule) == (host, path, fits[0][1] if fits else None)
        assert r.verdict == (fits[0][2] if fits else "allow")


def test_reputation_shrinks(spark):
    hosts = [("bad.one.org", 1)] * 60 + [("good.one.org", 0)] * 60 + [("new.two.org", 1)] + [("fine.two.org", 0)] * 30 + [("x.co.uk", None)]
    outcomes = spark.createDataFrame(hosts, "host string, bad int")
    known = spark.createDataFrame([("unseen.one.org",), ("bad.one.org",), ("",)], "host string")
    got = {r.host: r for r in url_reputation.reputation(outcomes, known).collect()}
    assert got["bad.one.org"].verdict == "block" and got["good.one.org"].verdict == "allow"
    assert got["new.two.org"].bad_share < 1 and got["new.two.org"].verdict == "allow"  # one bad page doesn't convict a host
    assert got["unseen.one.org"].n_labelled == 0 and got["good.one.org"].bad_share < got["unseen.one.org"].bad_share < got["bad.one.org"].bad_share
    assert "x.co.uk" in got and got[""].n_labelled == 0


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_reputation.judge(pages, spark.createDataFrame([("a.org", 1)], "host string, bad int"), queries.URL_RULES).count() == 0


# 2: token cache


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_counts_equal_the_library(name):
    path, some = public_tokenizers.path(name), texts(40)
    got = token_cache.counter(path)(some)
    if name.endswith(".json"):
        assert got == [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    elif name.endswith(".model"):
        import sentencepiece

        assert got == [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(x)) for x in some]
    else:
        assert all(n > 0 for n, x in zip(got, some) if x)


def test_cache_encodes_misses_once(spark, odd, empty):
    cache = scratch(spark, "cache")
    first = token_cache.count_tokens(odd, VOCABULARY, cache).collect()
    assert len(first) == len(ODD)
    own = Tokenizer.from_file(VOCABULARY)
    want = sorted((d, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ODD if d)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in first if r.doc_id) == want
    held = spark.read.parquet(cache)
    distinct = len({t or "" for _, t, *_ in ODD})
    assert held.count() == distinct
    more = spark.createDataFrame([(9, "the same text twice"), (10, "new")], "doc_id bigint, text string")
    assert token_cache.count_tokens(more, VOCABULARY, cache).count() == 2
    assert spark.read.parquet(cache).count() == distinct + 1
    assert token_cache.count_tokens(empty, VOCABULARY, scratch(spark, "cache")).count() == 0


def test_op2_over_a_warm_cache(spark, sf):
    """The query equals the library, from an empty cache and from one that holds some texts already."""
    own = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, len((r.text or "").encode()), len(own.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    cache = scratch(spark, "cache")
    token_cache.count_tokens(docs.filter("doc_id % 3 = 0"), VOCABULARY, cache)
    spark.conf.set("spark.concordat.tokenCache", cache)
    try:
        held = spark.read.parquet(cache).count()
        for _ in range(2):
            got = queries.op2_token_counts(spark, sf).collect()
            assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 512) for r in got)
        assert 0 < held < spark.read.parquet(cache).count() == docs.select("text").distinct().count()
    finally:
        spark.conf.unset("spark.concordat.tokenCache")


def test_clashing_names_are_left_out(spark, odd, tmp_path):
    """Carried columns named like outputs give way to them, in every operator that carries."""
    docs = odd.withColumns({c: F.lit("x") for c in ("ids", "decoded", "spans", "clean_text", "language", "posterior", "n_bytes", "fp")}).withColumn("n_words", F.lit("x"))
    every = tuple(c for c in docs.columns if c != "text")
    lexicon = bpe.ship_lexicon(docs, VOCABULARY, least=1)
    for frame in (
        token_cache.count_tokens(docs, VOCABULARY, scratch(spark, "cache"), carry=every), pseudonym.pseudonymise(docs, KEY, carry=every), line_clean.clean_lines(docs, carry=every),
        bpe.encode_and_decode(docs, VOCABULARY, lexicon, carry=every), langid.identify(docs, None, ("en", "fr"), carry=every), simhash.fingerprints(docs, carry=every),
        url_reputation.judge(docs.withColumn("url", F.col("text")).withColumn("host", F.lit("x")), spark.createDataFrame([], "host string, bad int"), queries.URL_RULES, carry=(*every, "host")),
    ):
        assert len(set(frame.columns)) == len(frame.columns) and len(frame.collect()) == len(ODD)


# 3: mixing


def test_mix_meets_its_targets(spark):
    rows = [(k, "w " * (5 + k % 7), "big" if k % 10 < 7 else f"s{k % 10}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("epoch", F.lit(0))
    plan = mixing.plan(docs, entropy=0.95, repetition=3.0, block_bits=6)
    got = mixing.mix(docs, plan, block_bits=6).join(docs.select("doc_id", mixing.words_of("text").alias("n")), "doc_id")
    shares = {r.source: r for r in plan.collect()}
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs"), F.max("epoch").alias("most")).collect()}
    for s, r in shares.items():
        assert r.tokens <= by[s].n <= r.wanted and r.wanted - by[s].n <= 12  # short of the budget by less than one row
        assert by[s].docs == sum(x[2] == s for x in rows) and by[s].most <= 3
    weights = [r.weight for r in shares.values()]
    assert sum(weights) == pytest.approx(1) and 0 < shares["big"].exponent < 1
    import math

    assert -sum(w * math.log(w) for w in weights) / math.log(len(weights)) == pytest.approx(0.95, abs=1e-4) or max(r.wanted / r.tokens for r in shares.values()) == pytest.approx(3.0, abs=1e-3)
    assert got.filter("position < 0 or position >= 1").count() == 0


def test_fixed_budget_cuts(spark):
    docs = spark.createDataFrame([(k, "a b c d", "x" if k % 4 else "y") for k in range(400)], "doc_id bigint, text string, source string")
    got = mixing.mix(docs, mixing.plan(docs, entropy=1.0, repetition=None, budget=800, block_bits=4), block_bits=4)
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {"x": 100, "y": 100}
    assert got.count() == got.select("doc_id").distinct().count()


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mix(odd, mixing.plan(odd, **queries.MIX), carry=tuple(odd.columns))
    assert got.count() >= len(ODD) and {r["source"] for r in got.collect()} == {None, "a", "b"}
    assert mixing.mix(empty, mixing.plan(empty, **queries.MIX)).count() == 0


# 4: pseudonyms

KEY = b"test"
VALUES = ["4111 1111 1111 1111", "378282246310005", "+1 (743) 555-3824", "212-555-0123", "+44 20 7946 0958", "123-45-6789", "10.0.0.255", "2020-02-29", "1/2/2003", "25/12/2020", "05.06.2019", "GB82 WEST 1234 5698 7654 32", "jane.doe-9@mail.example.com"]


@pytest.mark.parametrize("value", VALUES)
def test_pseudonyms_keep_the_format(value):
    new, found = pseudonym.pseudonymised(f"see {value}, and {value}!", KEY)
    assert len(found) == 2 and found[0][3] == found[1][3] != value
    shape = lambda x: re.sub("[0-9]", "9", x)
    if "@" not in value and "." not in value[:4]:
        assert shape(found[0][3]) == shape(value)
    again, second = pseudonym.pseudonymised(new, KEY)
    assert [x[2] for x in second] == [x[2] for x in found]  # a pseudonym is as valid as its value
    assert pseudonym.pseudonymised(new, KEY, back=True)[0] == f"see {value}, and {value}!"
    assert pseudonym.pseudonymised(new, b"other", back=True)[0] != f"see {value}, and {value}!"


def test_permutation_is_one_to_one_without_fixed_points():
    for size in (2, 3, 10, 97, 1000):
        image = [pseudonym.permuted(x, size, KEY, "t") for x in range(size)]
        assert sorted(image) == list(range(size)) and all(x != y for x, y in enumerate(image))
        assert [pseudonym.permuted(y, size, KEY, "t", back=True) for y in image] == list(range(size))


def test_invalid_numbers_stay():
    text = "4111111111111112 and 999-99-9999, 300.1.1.1, 2021-02-30, version 2.0, 13/13/2020, +1 (143) 555-3824, 1234567"
    assert pseudonym.pseudonymised(text, KEY) == (text, [])


def test_pseudonyms_of_odd_rows(odd, empty):
    got = pseudonym.pseudonymise(odd, KEY).collect()
    assert len(got) == len(ODD) and [r.text for r in got if r.doc_id == 1] == [None]
    assert pseudonym.pseudonymise(empty, KEY).count() == 0


def test_op4_round_trip(spark):
    """The query's texts turn back into the originals; values link across documents; nothing outside the spans changes."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    links = {}
    rows = queries.op4_feistel_pii(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_values for r in rows) > 0
    key = queries.TEST_KEY.encode()
    for r in rows:
        text = texts[r.doc_id]
        assert pseudonym.pseudonymised(r.text or "", key, back=True)[0] == (text or "")
        at, out = 0, 0
        for k, span in enumerate(r.spans):
            assert r.text[out : out + span.start - at] == text[at : span.start]
            new = pseudonym.spans(text, key)[k][3]
            value = text[span.start : span.end]
            assert new != value and links.setdefault((span.kind, value), new) == new
            out, at = out + span.start - at + len(new), span.end
        assert (r.text or "")[out:] == (text or "")[at:]
    assert len(set(links.values())) == len(links)
    # Every value that plain validity tests find is in a span.
    for doc, text in texts.items():
        for m in re.finditer(r"(?<![0-9A-Za-z])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])", text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
                assert ("card", m[0]) in links


# 5: line rules


def test_line_rules():
    faults = lambda line: line_clean.line_fault(line, len(line.split()), line_clean.DEFAULTS)
    assert faults("Home | News | Sport | About us") == "navigation"
    assert faults("All rights reserved.") == faults("© 2020 Someone") == "boilerplate"
    assert faults("some words that run on and on without any mark at the end of it") == "punctuation"
    assert faults("### $$$ *** odd %%% line") == "punctuation"
    assert faults("A short heading") is None and faults("This is a sentence, and it ends as one should.") is None


def test_common_lines_by_brute_force(spark):
    random.seed(6)
    notice, copied = "Read this notice of ours.", [f"Line {k} of a copied text here." for k in range(6)]
    rows = [(k, f"Own words number {k}.\n{notice}\nAnd {k} more follow.") for k in range(12)] + [(100 + k, "\n".join(copied)) for k in range(30)]
    rows += [(200, None), (201, ""), (202, notice), (203, "\n\n" + notice + "\n")]
    docs = spark.createDataFrame(rows, DOCS.split(", lang")[0])
    before, found = {}, {}
    for _, text in rows:
        lines = (text or "").split("\n")
        for k, line in enumerate(lines):
            if 3 <= len(line.split()) <= 40:
                before.setdefault(line, set()).add(lines[k - 1] if k else "")
                found[line] = found.get(line, 0) + 1
    want = {hashlib.md5(x.encode()).digest() for x in before if len(before[x]) >= 10 and 2 * len(before[x]) >= found[x]}
    assert {bytes(r.line) for r in line_clean.common_lines(docs).collect()} == want == {hashlib.md5(notice.encode()).digest()}
    got = {r.doc_id: r for r in line_clean.clean_lines(docs).collect()}
    assert got[3].clean_text == "Own words number 3.\nAnd 3 more follow." and got[105].clean_text == "\n".join(copied)


def test_notices_in_four_languages():
    for line in ("Tous droits réservés.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.", "All rights reserved."):
        assert line_clean.line_fault(line, len(line.split()), line_clean.DEFAULTS) == "boilerplate"


def test_repeated_windows_by_brute_force():
    random.seed(1)
    for _ in range(200):
        words = random.choices([b"a", b"b", b"c"], k=random.randint(0, 25))
        found = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        assert line_clean.repeat_words(words) == len({k + d for k, x in enumerate(found) if found.count(x) > 1 for d in range(3)})


def test_cleaning(spark, odd, empty):
    random.seed(2)
    prose = "\n".join(" ".join("".join(random.choices("aeioulnrst", k=5)) for _ in range(9)).capitalize() + "." for _ in range(12))
    junk = "\n".join("Home | Shop | Cart | Help | Login" for _ in range(30))
    got = {r.doc_id: r for r in line_clean.clean_lines(spark.createDataFrame([(1, prose), (2, prose + "\n" + junk), (3, prose + "\nAll rights reserved.")], "doc_id bigint, text string")).collect()}
    assert got[1].kept and got[1].clean_text == prose and got[3].kept and got[3].clean_text == prose
    assert not got[2].kept and got[2].n_dup_lines == 29 and got[2].lost_chars > got[1].word_chars
    assert len(line_clean.clean_lines(odd).collect()) == len(ODD) and line_clean.clean_lines(empty).count() == 0


# 6: WARC

PAGE = '<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><script src="/a.js"></script><style>p{}</style></head><body><!-- gone --><p>One<b>two</b> &lt;3</p><div>Three<a href="/x?a=1&amp;b=2">four</a></div><script>var a="<p>no</p>"</script><br>end</body></html>'


def test_derived_records_link_back(spark):
    rows = [("<urn:uuid:1>", "http://h.org/p", "2020-01-01T00:00:00Z", [("Content-Type", "text/html"), ("X-A", "b")], PAGE.encode()), (None, None, None, None, None), ("<urn:uuid:2>", "http://h.org/i", "2020-01-01T00:00:00Z", [("Content-Type", "image/png")], b"\x89PNG")]
    kind = "record_id string, target_uri string, warc_date string, http_headers array<struct<name:string,value:string>>, payload binary"
    got = warc.build(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r.warc_type for r in got) == ["conversion", "conversion", "metadata", "metadata", "metadata"]
    one = {r.warc_type: r for r in got if r.refers_to == "<urn:uuid:1>"}
    assert one["conversion"].block == "Onetwo <3\nThreefour\nend"
    assert one["metadata"].payload_digest == one["conversion"].payload_digest == warc.sha1(PAGE.encode())
    for line in ("title: T & t", "language: en", "http-x-a: b", "outlink: http://h.org/x?a=1&b=2 a", "outlink: http://h.org/a.js script"):
        assert line in one["metadata"].block.split("\r\n")
    for r in got:
        (fields, block), *rest = warc.parse(bytes(r.record))
        assert not rest and fields["warc-refers-to"] == r.refers_to and fields["warc-record-id"] == r.record_id and fields["warc-block-digest"] == warc.sha1(block) and block.decode() == r.block
    again = warc.build(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r.record_id for r in again) == sorted(r.record_id for r in got)


def test_reading_warc_files(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + PAGE.encode()
    records = [warc.to_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x"), warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Target-URI", "http://h.org/"), ("WARC-Date", "2020-01-01T00:00:00Z")], http)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = warc.build(warc.read_responses(spark, str(tmp_path))).filter("warc_type = 'conversion'").collect()
    assert [r.block for r in got] == ["Onetwo <3\nThreefour\nend"] * 2


def test_warc_keeps_source_fields_and_undoes_encodings(spark, tmp_path):
    import gzip

    page = b"<html><p>One</p></html>"
    chunked = b"5\r\n" + page[:5] + b"\r\n%x;x=1\r\n" % len(page[5:]) + page[5:] + b"\r\n0\r\n\r\n"
    bodies = [(page, ""), (gzip.compress(page), "Content-Encoding: gzip"), (gzip.compress(page[:4]) + gzip.compress(page[4:]), "Content-Encoding: gzip"), (chunked, "Transfer-Encoding: chunked"), (page, "Content-Encoding: gzip"), (b"\xff\x00", "Content-Encoding: br"), (b"<p>One\r\n\r\nWARC/1.0\r\nx</p>", "")]
    records = [warc.to_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x")]
    for k, (body, header) in enumerate(bodies):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + (header.encode() + b"\r\n" if header else b"") + b"\r\n" + body
        records.append(warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<r{k}>"), ("WARC-Target-URI", "http://h.org/"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Payload-Digest", f"sha1:D{k}"), ("WARC-Date", "2020-01-01T00:00:00Z")], http))
    (tmp_path / "whole.warc").write_bytes(b"".join(records[:-1]))
    (tmp_path / "cut.warc").write_bytes(b"".join(records))
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = warc.build(warc.read_responses(spark, str(tmp_path)), fields="warc_fields").collect()
    text = {k: sorted(r.block for r in got if r.warc_type == "conversion" and r.refers_to == f"<r{k}>") for k in range(len(bodies))}
    assert text == {**{k: ["One"] * 3 for k in range(5)}, 5: [], 6: ["One WARC/1.0 x"] * 2}
    assert all(r.payload_digest == f"sha1:D{r.refers_to[2:-1]}" for r in got) and len(got) == 6 + 5 + 7 + 6 + 7 + 6
    assert all("warc-ip-address: 10.0.0.1" in r.block.split("\r\n") for r in got if r.warc_type == "metadata")


def test_op6_by_brute_force(spark):
    """The query's records for each page, by a reader of HTML that knows the tables' markup only."""
    import html

    sf = "/root/testdata/sf0.01"
    got = {}
    for r in queries.op6_warc_derivatives(spark, sf).collect():
        got.setdefault(r.page_id, {})[r.warc_type] = r
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        kept = re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>|<head.*?</head>", "", page.html, flags=re.S)
        blocks = re.split(r"</?(?:article|body|br|div|footer|h1|h2|header|html|li|nav|p|section|table|td|tr|ul|main|aside|ol|hr)\b[^>]*>", kept.replace("\n", " "))
        lines = [re.sub("[ \\t\\xa0]+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in blocks]
        one = got[page.page_id]
        assert one["conversion"].block.split("\n") == [x for x in lines if x], page.page_id
        assert one["conversion"].refers_to == one["metadata"].refers_to and one["metadata"].target_uri == page.url
        assert one["metadata"].payload_digest == warc.sha1(page.html.encode())
        wanted = [html.unescape(a or b) for a, b in re.findall(r"""<a [^>]*?href=(?:"([^"]*)"|'([^']*)')""", re.sub(r"<!--.*?-->|<script.*?</script>", "", page.html, flags=re.S))]
        found = [x.split(" ")[1] for x in one["metadata"].block.split("\r\n") if x.startswith("outlink: ") and x.endswith(" a")]
        from urllib.parse import urljoin

        assert found == list(dict.fromkeys(urljoin(page.url, x.strip()) for x in wanted if x.strip() and not x.lower().startswith(("javascript:", "data:"))))


def test_pages_become_records(spark, empty):
    assert warc.build(warc.as_responses(empty.selectExpr("doc_id as page_id", "text as url", "lang as html"), carry=("page_id",)), carry=("page_id",)).count() == 0
    long = spark.createDataFrame([(1, "http://a.b/", "<p>" + "x y " * 500_000, 3)], "page_id bigint, url string, html string, block int")
    clash = warc.build(warc.as_responses(long, carry=("page_id", "block")), carry=("page_id", "block")).collect()
    assert [len(r.block) for r in clash if r.warc_type == "conversion"] == [4 * 500_000 - 1]

    pages = spark.createDataFrame([(1, None, None), (2, "http://a.b/", ""), (2, "http://a.b/", "")], "page_id bigint, url string, html string")
    assert warc.build(warc.as_responses(pages, carry=("page_id",)), carry=("page_id",)).count() == 6


# 8: exact deduplication


def brute_copies(rows):
    groups = {}
    for k, (d, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((d is not None, d, k))
    return {t: (max(x for _, x, _ in g if x is not None) if any(p for p, *_ in g) else None, len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("digest", [exact_stream.sha256, lambda body: F.unhex(F.substring(F.sha2(body, 256), 1, 2))])
def test_exact_copies(spark, digest):
    rows = [(k, f"text {k % 37}") for k in range(150)] + [(d, t) for d, t, *_ in ODD]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(0)).repartition(4)
    got = exact_stream.duplicates(frame, digest=digest).collect()
    want = brute_copies(rows)
    assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == sorted((str(d), *map(str, want[t or ""][:1]), want[t or ""][1]) for d, t in rows)
    assert sum(r.kept for r in got) == len(want)


@pytest.mark.parametrize("digest", [exact_stream.sha256, lambda body: F.unhex(F.lit("00"))])
def test_state_goes_on(spark, digest):
    """Three ingests equal brute force, also where all texts share a digest; each is asked for alone."""
    random.seed(1)
    dedup = exact_stream.ExactDedup(spark, digest=digest)
    ingests, groups = [], {}
    for k in range(3):
        rows = [(100 * k + i, f"text {random.randint(0, 30)}") for i in range(30)] + [(None, "text 3"), (7, None), (7, "")]
        ingests.append((rows, dedup.ingest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))))
        for d, t in rows:
            groups.setdefault(t or "", []).append(d)
    for rows, one in ingests:
        got = sorted((str(r.id), str(r.stays.id), r.n) for r in dedup.rows(one).collect())
        assert got == sorted((str(d), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""])) for d, t in rows)
    assert sum(dedup.rows(one).filter(exact_stream.stayed()).count() for _, one in ingests) == len(groups)


def test_a_cut_off_ingest_is_taken_up(spark):
    dedup = exact_stream.ExactDedup(spark)
    docs = scratch_table(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string"))
    dedup._rows(exact_stream.located(docs)).drop("body").write.parquet(f"{dedup.folder}/landed/ingest=1")  # landed, then lost
    one = dedup.ingest(docs)
    assert one.number == 1 and sorted((r.id, r.stays.id, r.n) for r in dedup.rows(one).collect()) == [(1, 2, 2), (2, 2, 2)]


def test_keep_last(odd, empty):
    kept = exact_stream.keep_last(odd).collect()
    assert len(kept) == len({t or "" for _, t, *_ in ODD}) and kept[0].digest == "clash"
    assert exact_stream.duplicates(empty).count() == 0


# 9: BPE


def test_units_put_together_are_the_text():
    for x in texts(20):
        parts = units.units(x)
        assert " ".join(parts) == x
        assert all(not a[-1:].isspace() and not b[:1].isspace() and a and b for a, b in zip(parts[1:], parts[2:]))


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é", ""])}
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(tmp_path / "lexicon"))
    assert lexicon.find(list(words)) == [bpe.array("I", v).tobytes() for v in words.values()]
    assert lexicon.find([b"ta", b"tapss", b"x", b"\xc3"]) == [None] * 4
    # States of the minimal automaton are the distinct sets of what may follow.
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert lexicon.n_states == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})
    (tmp_path / "none").write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(tmp_path / "none")).find([b"a"]) == [None]


def test_merges_equal_the_library():
    merges, own, some = bpe.merges_of(VOCABULARY), Tokenizer.from_file(VOCABULARY), texts(60)
    for x, e in zip(some, own.encode_batch(some, add_special_tokens=False)):
        assert merges.encode(x) == e.ids == merges.encode_by_pairs(x)
        assert merges.decode(e.ids) == own.decode(e.ids, skip_special_tokens=False)


def test_encoding_query_round_trip(spark, odd, empty):
    own = Tokenizer.from_file(VOCABULARY)
    for most in (1000, 0):
        lexicon = bpe.ship_lexicon(odd, VOCABULARY, most=most, least=1)
        got = bpe.encode_and_decode(odd, VOCABULARY, lexicon, carry=("doc_id", "text")).collect()
        for r in got:
            ids = own.encode(r.text or "", add_special_tokens=False).ids
            assert bytes(r.ids) == bpe.array("I", ids).tobytes() and r.decoded == own.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(odd, VOCABULARY, lexicon), VOCABULARY, lexicon).count() == len(ODD)
    assert bpe.encode(empty, VOCABULARY, bpe.ship_lexicon(empty, VOCABULARY)).count() == 0


def test_op9_equals_the_library(spark, sf):
    own = Tokenizer.from_file(VOCABULARY)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_bpe_lexicon(spark, sf).collect():
        ids = own.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(bpe.array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 10: language


def test_held_out_accuracy(spark):
    """Rows that the model wasn't fitted on, with pages and without."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learnt = langid.chosen_rows(docs, queries.LANGUAGES).select(F.col("id").alias("doc_id"))
    paged = queries.language_evidence(spark, sf).select("doc_id", F.lit(True).alias("paged")).distinct()
    got = queries.op10_language_fusion(spark, sf).join(learnt, "doc_id", "left_anti").join(docs.select("doc_id", "lang"), "doc_id").join(paged, "doc_id", "left")
    right = {r["paged"]: (r["n"], r["hit"]) for r in got.groupBy("paged").agg(F.count("*").alias("n"), F.count_if(F.expr("language = lang and kept")).alias("hit")).collect()}
    assert set(right) == {None, True} and sum(n for n, _ in right.values()) == 9600
    assert all(hit >= 0.99 * n for n, hit in right.values()), right


def test_fusion_by_brute_force(spark):
    import math

    random.seed(5)
    languages = ("en", "fr")
    rows = []
    for k in range(80):
        good = random.randrange(3)
        rows.append((k, 100 + k % 70, random.choice(["a", "b", None]), [-random.random() * 20 - (0 if j == good else 8) for j in range(3)], random.choice([0, 5, 60])))
    pages = [(100 + random.randrange(75), random.choice(["en", "fr", "", None]), random.choice(["com", "fr"]), random.choice(["en", ""]), d, f"h{random.randrange(3)}.{d}") for d in random.choices(["x.com", "y.fr", "z.fr"], k=60)] + [(None, "en", "com", "", "x.com", "h.x.com")]
    frame = spark.createDataFrame(rows, "row bigint, id bigint, source string, scores array<double>, n_trigrams bigint")
    got = {r.row: r for r in langid.fuse(scratch_table(frame), spark.createDataFrame(pages, langid.EVIDENCE), languages, carry=("row",)).collect()}
    vote = {r[0]: max(range(3), key=lambda j: (r[3][j], -j)) if r[4] else None for r in rows}
    own = {}
    for row, d, source, *_ in rows:
        mine = [p for p in pages if p[0] == d]
        own[row] = {f: {p[k] or "" for p in mine} or {""} for k, f in ((1, "declared"), (2, "suffix"), (3, "folder"))} | {"hosts": {(p[5], p[4]) for p in mine} or {(f"source:{source or ''}", "source")}}
    pairs = lambda f: [(row, v) for row, x in own.items() for v in x[f]]
    count = lambda some, j: sum(vote[row] == j for row, _ in some)
    for row, _, _, scores, n in rows:
        logs = []
        for j in range(3):
            mine = int(vote[row] == j)
            total = scores[j]
            for f in langid.FEATURES:
                every = pairs(f)
                for v in own[row][f]:
                    total += math.log((count([p for p in every if p[1] == v], j) - mine + 0.5) / (count(every, j) - mine + 0.5 * len({v for _, v in every})))
            hosts, priors = pairs("hosts"), []
            voted = int(vote[row] is not None)
            for host, domain in own[row]["hosts"]:
                p = (count(hosts, j) - mine + 1) / (sum(count(hosts, i) for i in range(3)) - voted + 3)
                for some in ([x for x in hosts if x[1][1] == domain], [x for x in hosts if x[1] == (host, domain)]):
                    p = (count(some, j) - mine + 5 * p) / (sum(count(some, i) for i in range(3)) - voted + 5)
                priors.append(math.log(p))
            logs.append(total + sum(priors) / len(priors))
        top = max(logs)
        want = ("en", "fr", "und")[logs.index(top)] if n else "und"
        assert got[row].language == want, row
        assert got[row].posterior == pytest.approx(1 / sum(math.exp(x - top) for x in logs) if n else 0.0)


def scratch_table(frame):
    from concordat.llm.shared import written

    return written(frame, "test")


def test_language_of_odd_rows(spark, odd, empty):
    got = langid.identify(odd, None, ("en", "fr")).collect()
    assert len(got) == len(ODD) and {r.language for r in got if r.doc_id in (1, 2, 6)} == {"und"} and not any(r.kept for r in got if r.doc_id in (1, 2, 6))
    assert langid.keep_known(empty, None, ("en", "fr")).count() == 0
    assert langid.keep_known(odd, None, ("en", "fr")).columns == odd.columns


def test_declared_language(spark):
    pages = [('<html lang="de-AT">', "de"), ("<HTML class=x LANG=FR>", "fr"), ("<html>", ""), ("", "")]
    got = [r[0] for r in spark.createDataFrame(pages, "html string, want string").select(langid.declared_of(F.col("html"))).collect()]
    assert got == [w for _, w in pages]
