"""The queries of this subpackage's operators, with their production parameters and oracle SQL."""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import bpe, bpe_slices, divergence, exact_stream, hard_negatives, langid, line_clean, mixing, pseudonym, simhash, token_cache, url_reputation, warc
from concordat.llm.shared import scratch, table

BPE_50K = "byte_bpe_50k.json"
BPE_MULTI = "byte_bpe_multi_50k.tiktoken"

#: The rules that decide before any reputation does: (verdict, host/path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Below these names anyone gets a host of their own, so each host's owner is one label further down.
HOSTED = ("example.com", "example.net", "example.org")
URL_OPTIONS = {"two_label": (*url_reputation.TWO_LABEL_SUFFIXES, *HOSTED), "max_bad": 0.2}
#: A page's path names the document that was made of it.
DOCUMENT_OF_PAGE = "^/[^/]*/([0-9]{1,18})(?:[^0-9]|$)"

LANGUAGES = ("en", "fr", "de", "es")
MIX = {"entropy": 0.9, "repetition": 2.0, "budget": "cover"}
#: The setting that holds the key of a deployment; Spark keeps settings with such a name out of its logs and pages.
PII_KEY = "spark.concordat.pii.secret"
#: The query's key where there is none: for tests and comparable runs only. The operator itself has no default.
TEST_KEY = "concordat: a key for comparable runs"


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = table(spark, sf_dir, "labels").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    document = F.regexp_extract(url_reputation.path_of(F.col("url")), DOCUMENT_OF_PAGE, 1).try_cast("bigint")
    outcomes = pages.select(url_reputation.host_of(F.col("url")).alias("host"), document.alias("doc_id")).join(bad, "doc_id").select("host", "bad")
    return url_reputation.judge(pages, outcomes, URL_RULES, **URL_OPTIONS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A deployment names its lasting cache; without one, a run begins with an empty one.
    cache = spark.conf.get("spark.concordat.tokenCache", None) or scratch(spark, "token-cache")
    counts = token_cache.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_50K), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.plan(docs, **MIX))


def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, None)
    if key is None:
        warnings.warn(f"{PII_KEY} isn't set: pseudonyms are made by a key that anyone can read", stacklevel=2)
        key = TEST_KEY
    rows = pseudonym.pseudonymise(table(spark, sf_dir, "documents"), key.encode())
    return rows.select("doc_id", "text", "spans", F.size("spans").cast("bigint").alias("n_values"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_clean.clean_lines(table(spark, sf_dir, "documents"))
    return rows.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build(warc.as_responses(table(spark, sf_dir, "pages"), carry=("page_id",)), carry=("page_id",))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_stream.duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = public_tokenizers.path(BPE_50K)
    rows = bpe.encode_and_decode(docs, vocabulary, bpe.ship_lexicon(docs, vocabulary))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), language_evidence(spark, sf_dir), LANGUAGES).withColumn("posterior", F.round("posterior", 6))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=10, most=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


def op13_bpe_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe_slices.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_MULTI))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages made of documents declare about their language."""
    pages = table(spark, sf_dir, "pages")
    host, path = url_reputation.host_of(F.col("url")), url_reputation.path_of(F.col("url"))
    document = F.regexp_extract(path, DOCUMENT_OF_PAGE, 1).try_cast("bigint")
    two_label = URL_OPTIONS["two_label"]
    return langid.page_evidence(pages, document, host, url_reputation.domain_of(host, two_label), url_reputation.suffix_of(host), path)


QUERIES = {f.__name__: f for f in (op1_url_reputation, op2_token_counts, op3_temperature_mix, op4_feistel_pii, op5_line_rules, op6_warc_derivatives, op7_simhash, op8_exact_stream, op9_bpe_lexicon, op10_language_fusion, op11_source_divergence, op12_hard_negatives, op13_bpe_slices)}


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _url_sql() -> str:
    two = _quoted(URL_OPTIONS["two_label"])
    rules = sorted(URL_RULES, key=lambda x: (-len(x[1]), x[1]))
    fits = {text: f"((host = '{text.partition('/')[0]}' or ends_with(host, '.{text.partition('/')[0]}')) and starts_with(path, '/{text.partition('/')[2]}'))" for _, text in rules}
    strength = "select greatest(1.0, least(1000.0, case when r is null then 10.0 when r <= 0 then 1000.0 else 1 / r - 1 end)) as m from (select sum(s - pq * (pm - 1)) / nullif(sum(pq * d), 0) as r from (select sum(c.n * power(c.k / c.n - pk / pn, 2)) as s, sum((1 - c.n / pn) * (c.n - 1)) as d, any_value((pk / pn) * (1 - pk / pn)) as pq, any_value(pm) as pm from {child} c join (select {parent} as parent, sum(n) as pn, sum(k) as pk, count(*) as pm from {child} where n > 0 group by 1) p on c.{parent} = p.parent where c.n > 0 group by c.{parent}))"
    return rf"""
with split as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
bad as (select doc_id, 1 - min(quality) as bad from labels group by 1),
counted as (
  select host, count(*) as n, sum(bad) as k
  from split join bad on try_cast(regexp_extract(path, '{DOCUMENT_OF_PAGE}', 1) as bigint) = doc_id group by 1),
bare as (select distinct host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as p from split),
level as (
  select b.host, 1 as root,
    case when array_to_string(p[-2:], '.') in ({two}) then array_to_string(p[-3:], '.') else array_to_string(p[-2:], '.') end as domain,
    case when array_to_string(p[-2:], '.') in ({two}) then array_to_string(p[-2:], '.') else array_to_string(p[-1:], '.') end as suffix,
    coalesce(n, 0)::double as n, coalesce(k, 0)::double as k
  from bare b left join counted c on b.host = c.host),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from level group by 1, 2),
suffixes as (select suffix, 1 as root, sum(n) as n, sum(k) as k from domains group by 1),
prior as (select (sum(k) + 0.5) / (sum(n) + 5) as p,
  ({strength.format(child='suffixes', parent='root')}) as ms,
  ({strength.format(child='domains', parent='suffix')}) as md,
  ({strength.format(child='level', parent='domain')}) as mh from suffixes),
suffix_means as (select suffix, (k + ms * p) / (n + ms) as sm, md, mh from suffixes, prior),
means as (select domain, mh, (k + md * sm) / (n + md) as dm from domains join suffix_means using (suffix)),
beta as (select host, k + mh * dm as a, n - k + mh * (1 - dm) as b from level join means using (domain)),
known as (select host, a / (a + b) - 1.6448536269514722 * sqrt(a * b / (a + b + 1)) / (a + b) as bound from beta)
select page_id, host, path,
  case {' '.join(f"when {fits[t]} then '{t}'" for _, t in rules)} end as rule,
  case {' '.join(f"when {fits[t]} then '{k}'" for k, t in rules)} when bound > {URL_OPTIONS['max_bad']} then 'block' else 'allow' end as verdict,
  round(bound, 6) as bad_bound
from split join known using (host)"""


def _line_sql() -> str:
    r = line_clean.DEFAULTS
    word, notice = line_clean.WORD.replace(r"\x20\x09-\x0D", r"\x{20}\x{09}-\x{0D}"), line_clean.NOTICE.replace("'", "''")
    return rf"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select r, unnest(regexp_extract_all(text, '{word}')) as w, generate_subscripts(regexp_extract_all(text, '{word}'), 1) as i from texts),
windows as (select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as x from words window o as (partition by r order by i)),
repeated as (select r, i from windows where x is not null qualify count(*) over (partition by r, x) > 1),
covered as (select r, count(distinct i + d) as n from repeated, (values (0), (1), (2)) t(d) group by 1),
lines as (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from texts),
judged as (
  select r, i, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as chars,
    len(regexp_extract_all(line, '{word}')) as n,
    len(regexp_extract_all(line, '{line_clean.SYMBOLS}')) as symbols,
    len(regexp_extract_all(line, '{line_clean.SEPARATORS}')) as parts,
    row_number() over (partition by r, line order by i) > 1 as again,
    coalesce(lag(line) over (partition by r order by i), '') as above from lines),
common as (
  select line from judged where n between {r['common_words']} and {r['notice_words']} group by 1
  having count(distinct above) >= greatest({r['common_least']}, (select count(*) from documents) * {r['common_share']}) and 2 * count(distinct above) >= count(*)),
faults as (
  select *, chars > 0 and (again
    or n >= {r['long_line']} and not regexp_matches(line, '{line_clean.MARKS}') or n >= 5 and 2 * symbols > n
    or parts >= {r['separators']} and n <= 4 * parts
    or n <= {r['notice_words']} and regexp_matches(line, '{notice}')
    or line in (select line from common)) as fault from judged),
by_text as (
  select r, sum(chars) as total, count(*) filter (again and chars > 0) as dups, count(*) filter (fault) as failed,
    coalesce(sum(chars) filter (fault), 0) as lost, coalesce(string_agg(line, chr(10) order by i) filter (not fault), '') as clean
  from faults group by 1),
counts as (
  select t.r, doc_id, len(regexp_extract_all(text, '{word}')) as n_words, total, len(regexp_extract_all(text, '{line_clean.SYMBOLS}')) as symbols, dups, coalesce(c.n, 0) as rep, failed, lost, clean
  from texts t join by_text b on t.r = b.r left join covered c on t.r = c.r)
select doc_id, n_words::bigint as n_words, total::bigint as word_chars, symbols::bigint as n_symbols, dups::bigint as n_dup_lines, rep::bigint as n_repeat_words,
  n_words < 50 or 100 * rep > 50 * n_words as base_failed, failed::bigint as n_failed_lines, lost::bigint as lost_chars,
  not (n_words < 50 or 100 * rep > 50 * n_words) and lost <= {r['max_lost']} * total as kept, sha256(clean) as clean_sha256
from counts"""


_EXACT_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""

_MIX_SQL = rf"""
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) as n,
    ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 8))::bigint as h from documents),
rows as (select *, h // {1 << 20} as block from docs),
sources as (select source, sum(n)::double as tokens from rows group by 1),
share as (select tokens / sum(tokens) over () as p from sources where tokens > 0),
enough as (select ln(count(*)) * {MIX['entropy']} as e from share),
even(k, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select k + 1, case when e >= (select e from enough) then mid else lo end, case when e >= (select e from enough) then hi else mid end
  from (select k, lo, hi, (lo + hi) / 2 as mid, (select ln(sum(power(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(power(p, (lo + hi) / 2) * ln(p)) / sum(power(p, (lo + hi) / 2)) from share) as e from even where k < 40)),
often(k, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select k + 1, case when r > {MIX['repetition']} then mid else lo end, case when r > {MIX['repetition']} then hi else mid end
  from (select k, lo, hi, (lo + hi) / 2 as mid, (select max(power(p, (lo + hi) / 2 - 1)) / min(power(p, (lo + hi) / 2 - 1)) from share) as r from often where k < 40)),
found as (
  select round_even(greatest(
    case when (select -sum(p * ln(p)) from share) >= (select e from enough) then 1.0 else (select lo from even where k = 40) end,
    case when (select max(1 / p) / min(1 / p) from share) <= {MIX['repetition']} then 0.0 else (select lo from often where k = 40) end) * 1e6, 0) / 1e6 as t),
raised as (select source, tokens, case when tokens > 0 then power(tokens, t) else 0 end as z from sources, found),
weights as (select source, tokens, coalesce(z / nullif(sum(z) over (), 0), 0) as weight from raised),
wanted as (select *, greatest(tokens, round_even(coalesce(weight * max(case when weight > 0 then tokens / weight end) over (), 0), 0))::bigint as wanted from weights),
planned as (select source, tokens::bigint as tokens, weight, wanted, case when tokens > 0 then wanted // tokens::bigint else 1 end as epochs, case when tokens > 0 then wanted % tokens::bigint else 0 end as rest from wanted),
blocks as (
  select r.source, block, sum(r.n)::bigint as n, any_value(epochs) as epochs, any_value(rest) as rest from rows r join planned p on r.source is not distinct from p.source group by 1, 2),
ordered as (
  select *, ('0x' || substr(md5('17|' || coalesce(source, '') || '|' || epochs || '|' || block), 1, 8))::bigint * 65536 + block as o from blocks),
summed as (select *, coalesce(sum(n) over (partition by source order by o rows between unbounded preceding and 1 preceding), 0) as before from ordered),
border as (select source, min(o) as o from summed where before + n > rest group by 1),
edge as (select s.* from summed s join border b on s.source is not distinct from b.source and s.o = b.o),
close as (select r.source, h, before, rest, sum(r.n) over (partition by r.source order by h) as so_far from rows r join edge e on r.source is not distinct from e.source and r.block = e.block),
cut as (select source, max(h) as h from close where before + so_far <= rest group by 1),
read as (
  select r.doc_id, r.source, p.weight, p.epochs, r.block, p.wanted, p.tokens,
    coalesce(o.o < b.o or o.o = b.o and r.h <= coalesce(c.h, -1), false) as partly
  from rows r join planned p on r.source is not distinct from p.source
  join ordered o on r.source is not distinct from o.source and r.block = o.block
  left join border b on r.source is not distinct from b.source left join cut c on r.source is not distinct from c.source)
select doc_id, source, round(weight, 9) as weight, epoch, block,
  round((epoch - 1 + ('0x' || substr(md5('17|' || coalesce(source, '') || '|' || epoch || '|' || block), 1, 8))::bigint / 4294967296.0) / ceil(coalesce(wanted::double / nullif(tokens, 0), 1.0)), 9) as position
from (select *, unnest(generate_series(1, epochs + partly::int)) as epoch from read)"""

_DIVERGENCE_SQL = r"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (
  select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) as term
  from docs),
kept as (select lang, term, count(*) as n from words group by 1, 2 having count(distinct r) >= 10),
counted as (select w.lang, w.source, w.term, count(*) as n from words w join kept k on w.lang = k.lang and w.term = k.term group by 1, 2, 3),
langs as (select lang, count(*) as v, sum(n) as n from kept group by 1),
groups as (
  select g.lang, g.source, coalesce(c.n, 0) as n, coalesce(l.v, 0) as v, coalesce(l.n, 0) as all_n
  from (select distinct lang, source from docs) g
  left join (select lang, source, sum(n) as n from counted group by 1, 2) c on g.lang = c.lang and g.source = c.source
  left join langs l on g.lang = l.lang),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) as p,
    1 + (1000000000::hugeint * (k.n + 2)) // (g.all_n + 2 * g.v) as q
  from groups g join kept k on g.lang = k.lang left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
all_pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from shares where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from all_pairs union all select * from terms))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 10"""

_NEGATIVES_SQL = """
with rows as (
  select row_number() over () as r, vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.r, a.id as anchor_id, b.r as b, b.id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from rows a join rows b on a.r <> b.r where a.id % 50 = 0),
positives as (select *, row_number() over (partition by r order by score desc, id) as k from scored where same qualify k <= 5),
fits as (
  select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.r, p.k order by n.score desc, n.id) as rank
  from positives p join scored n on p.r = n.r and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from fits where rank <= 3"""

ORACLE_SQL = {"op11_source_divergence": _DIVERGENCE_SQL, "op12_hard_negatives": _NEGATIVES_SQL, "op1_url_reputation": _url_sql(), "op3_temperature_mix": _MIX_SQL, "op5_line_rules": _line_sql(), "op8_exact_stream": _EXACT_SQL}
