"""Language identification by Bayesian evidence fusion.

For each document the log posterior of a language is the sum of
- the text's likelihood under a model of byte trigrams (A-Z lower-cased, whole text), tempered: overlapping trigrams
  repeat each other, so a text counts as `weight` trigrams at most;
- the likelihoods of the declared markup language, the address suffix and the address's language folder, from their
  grouped counts per language;
- a prior of the document's host, smoothed hierarchically: all documents -> registered domain -> host.

All pages of a document speak: each distinct value of each feature adds its likelihood, and the priors of its distinct
hosts are averaged as logs. A document without pages declares nothing (the value ""), and its source stands for its host;
labels are never evidence.

Counts behind the likelihoods and priors are grouped aggregations over all pairs of a document and one of its values, by
the language that the text alone suggests; a pair's own vote is taken out again before it is judged. "und" (none of the
languages) competes with a flat model of trigrams. The trigram model is fitted on a bounded sample of labelled rows:
`sample` rows for each language, chosen by hash (see chosen_rows).

Only counts are shuffled, never texts: hosts and values are combined before each shuffle, a document's pages before they
meet it.

Defined results: a null text, or one without letters, has language "und" and is rejected. Null declarations and addresses
count as the value "". Repeated rows each count and get the same result. Of languages that tie, the first of the list
wins. Without labelled rows all texts are "und". An empty table gives an empty result. A carried column named like an
output is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.shared import FILE, ROW, carried, located, lower_ascii, whole, without, written

UNKNOWN = "und"
FEATURES = ("declared", "suffix", "folder")
#: What page_evidence gives of each page.
EVIDENCE = "doc_id bigint, declared string, suffix string, folder string, domain string, host string"
BUCKETS = 1 << 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def trigrams(text: str) -> np.ndarray:
    """The buckets of a text's byte trigrams that hold a letter."""
    data = np.frombuffer(text.encode().lower(), np.uint8)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    letters = _LETTER[data]
    wide = data.astype(np.uint32)
    bucket = (wide[:-2] * 0x9E5F + wide[1:-1] * 0x1F3 + wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return bucket[letters[:-2] | letters[1:-1] | letters[2:]].astype(np.int64)


def chosen_rows(docs: DataFrame, languages: tuple[str, ...], *, label: str = "lang", id_column: str = "doc_id", sample: int = 100) -> DataFrame:
    """(id, language) of `sample` labelled rows of each language at most, by the hash of their id: what fit learns from."""
    primary = F.split_part(lower_ascii(F.col(label)), F.lit("-"), F.lit(1))
    keyed = docs.select(F.col(id_column).alias("id"), primary.alias("language"), F.xxhash64(id_column).alias("h")).filter(F.col("language").isin(*languages) & F.col("id").isNotNull())
    order = Window.partitionBy("language").orderBy("h", "id")
    return keyed.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("id", "language")


def fit(docs: DataFrame, languages: tuple[str, ...], *, text: str = "text", label: str = "lang", id_column: str = "doc_id", sample: int = 100) -> np.ndarray:
    """Log probabilities (bucket, language + flat) from `sample` labelled rows of each language.

    At most sample x languages ids are chosen; their trigram counts, languages x BUCKETS at most, come to the driver.
    """
    chosen = chosen_rows(docs, languages, label=label, id_column=id_column, sample=sample)
    bodies = docs.select(F.col(id_column).alias("id"), whole(text).alias("body")).join(F.broadcast(chosen), "id").select("language", "body")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {x: np.zeros(BUCKETS, np.int64) for x in languages}
        for x in batches:
            for language, body in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                totals[language] += np.bincount(trigrams(body), minlength=BUCKETS)
        for language, n in totals.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(there), pa.string()), pa.array(there), pa.array(n[there])], ["language", "bucket", "n"])

    counted = bodies.mapInArrow(count, "language string, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    model = np.zeros((BUCKETS, len(languages) + 1))
    for r in counted.toLocalIterator():
        model[r.bucket, languages.index(r.language)] = r.n
    seen = model.sum(axis=0)
    model[:, :-1] = np.log((model[:, :-1] + 0.02) / (seen[:-1] + 0.02 * BUCKETS))
    model[:, :-1][:, seen[:-1] == 0] = -math.log(BUCKETS) - 20  # a language without rows is never chosen
    model[:, -1] = -math.log(BUCKETS)
    return model.astype(np.float32)


def score_texts(docs: DataFrame, model: np.ndarray, languages: tuple[str, ...], *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), weight: int = 60) -> DataFrame:
    """Each row of docs: (*carry, scores: the tempered log likelihood of each language and of UNKNOWN, n_trigrams)."""
    rows = docs.select(*carry, whole(text).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for x in batches:
            for at in range(0, x.num_rows, 1024):
                part = x.slice(at, 1024)
                scores, sizes = [], []
                for body in part.column(len(carry)).to_pylist():
                    found = trigrams(body)
                    n = len(found)
                    total = sum((table[found[k : k + 65536]].sum(axis=0, dtype=np.float64) for k in range(0, n, 65536)), np.zeros(table.shape[1]))
                    scores.append((total * (min(n, weight) / n) if n else total).tolist())
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(scores, pa.list_(pa.float64())), pa.array(sizes, pa.int64())], [*carry, "scores", "n_trigrams"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, scores array<double>, n_trigrams bigint")


def _counts(value: str, size: int) -> Column:
    """An array of how many votes of a group go to each language."""
    return F.array(*[F.count_if(F.col(value) == k) for k in range(size)])


def _of(array: str, k: int) -> Column:
    return F.get(array, F.lit(k))


def _feature_logs(pairs: DataFrame, size: int, alpha: float) -> DataFrame:
    """(row, l0, l1, ...): the summed log likelihoods of a row's values. pairs: a written (row, vote, feature, value)."""
    held = written(pairs.groupBy("feature", "value").agg(_counts("vote", size).alias("c")), "votes")
    totals = held.groupBy("feature").agg(F.count("*").alias("kinds"), F.array(*[F.sum(_of("c", k)) for k in range(size)]).alias("all"))
    known = written(held.join(totals, "feature"), "likelihoods")
    own = lambda k: F.when(F.col("vote") == k, 1).otherwise(0)
    terms = [F.log((_of("c", k) - own(k) + alpha) / (_of("all", k) - own(k) + alpha * F.col("kinds"))) for k in range(size)]
    return pairs.join(known, ["feature", "value"]).groupBy("row").agg(*[F.sum(x).alias(f"l{k}") for k, x in enumerate(terms)])


def _host_logs(pairs: DataFrame, size: int, strength: float) -> DataFrame:
    """(row, p0, p1, ...): the mean log prior of a row's hosts. pairs: a written (row, vote, host, domain)."""
    hosts = written(pairs.groupBy("host", "domain").agg(_counts("vote", size).alias("host_votes")), "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(_of("host_votes", k)) for k in range(size)]).alias("domain_votes"))
    every = hosts.agg(*[F.coalesce(F.sum(_of("host_votes", k)), F.lit(0)).alias(f"v{k}") for k in range(size)]).first()  # size numbers
    known = written(hosts.join(domains, "domain").select("host", "domain", "host_votes", "domain_votes"), "host-votes")
    voted = F.when(F.col("vote").isNotNull(), 1).otherwise(0)
    own = lambda k: F.when(F.col("vote") == k, 1).otherwise(0)
    prior = [(F.lit(every[k]) - own(k) + 1) / (F.lit(sum(every)) - voted + size) for k in range(size)]
    out = pairs.join(known, ["host", "domain"]).withColumn("prior", F.array(*prior))
    for level in ("domain_votes", "host_votes"):
        others = F.aggregate(level, F.lit(0).cast("bigint"), lambda a, b: a + b) - voted
        out = out.withColumn("prior", F.array(*[(_of(level, k) - own(k) + strength * _of("prior", k)) / (others + strength) for k in range(size)]))
    return out.groupBy("row").agg(*[F.avg(F.log(_of("prior", k))).alias(f"p{k}") for k in range(size)])


def fuse(rows: DataFrame, pages: DataFrame, languages: tuple[str, ...], *, carry: tuple[str, ...], strength: float = 5.0, alpha: float = 0.5) -> DataFrame:
    """Each row of rows: (*carry, language, posterior, text_language).

    rows: (*carry, row: a unique number, id, source, scores, n_trigrams), a written table; pages: see page_evidence.
    """
    names = [*languages, UNKNOWN]
    size = len(names)
    best = lambda scores: F.array_position(scores, F.array_max(scores)).cast("int") - 1
    # A text without trigrams votes for nothing.
    voted = rows.select("row", "id", F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("own_host"), F.when(F.col("n_trigrams") > 0, best(F.col("scores"))).alias("vote"))
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    values = F.array(*[F.struct(F.lit(c).alias("feature"), plain(c).alias("value")) for c in FEATURES])
    by_page = written(pages.filter("doc_id is not null").select("doc_id", F.explode(values).alias("x")).select("doc_id", "x.*").distinct(), "page-values")
    by_host = written(pages.filter("doc_id is not null").select("doc_id", plain("host").alias("host"), plain("domain").alias("domain")).distinct(), "page-hosts")
    voted = written(voted, "votes")
    without_page = voted.join(by_host.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")
    nothing = without_page.select("row", "vote", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("").alias("value")) for c in FEATURES])).alias("x")).select("row", "vote", "x.*")
    feature_pairs = written(voted.join(by_page, F.col("id") == F.col("doc_id")).select("row", "vote", "feature", "value").union(nothing), "feature-pairs")
    host_pairs = written(voted.join(by_host, F.col("id") == F.col("doc_id")).select("row", "vote", "host", "domain").union(without_page.select("row", "vote", F.col("own_host").alias("host"), F.lit("source").alias("domain"))), "host-pairs")
    out = rows.join(_feature_logs(feature_pairs, size, alpha), "row").join(_host_logs(host_pairs, size, strength), "row")
    out = out.withColumn("__logs", F.array(*[_of("scores", k) + F.col(f"l{k}") + F.col(f"p{k}") for k in range(size)]))
    top = F.array_max("__logs")
    norm = F.aggregate(F.transform("__logs", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    label = F.array(*map(F.lit, names))
    seen = F.col("n_trigrams") > 0
    return out.select(
        *carry,
        F.when(seen, F.element_at(label, best(F.col("__logs")) + 1)).otherwise(UNKNOWN).alias("language"),
        F.when(seen, 1 / norm).otherwise(0.0).alias("posterior"),
        F.when(seen, F.element_at(label, best(F.col("scores")) + 1)).otherwise(UNKNOWN).alias("text_language"),
    )


def declared_of(html: Column) -> Column:
    """The primary language that the html element declares."""
    return lower_ascii(F.regexp_extract(html, r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1))


def page_evidence(pages: DataFrame, document: Column, host: Column, domain: Column, suffix: Column, path: Column, *, html: str = "html") -> DataFrame:
    """(doc_id, declared, suffix, folder, domain, host) of every page that names a document."""
    folder = lower_ascii(F.regexp_extract(path, "^/([A-Za-z]{2})(?:/|$)", 1))
    each = pages.select(document.alias("doc_id"), declared_of(F.col(html)).alias("declared"), suffix.alias("suffix"), folder.alias("folder"), domain.alias("domain"), host.alias("host"))
    return each.filter(F.col("doc_id").isNotNull())


def identify(docs: DataFrame, evidence: DataFrame | None, languages: tuple[str, ...], *, text: str = "text", label: str = "lang", source: str = "source", id_column: str = "doc_id", carry: tuple[str, ...] = (), sample: int = 100, weight: int = 60, least: float = 0.5) -> DataFrame:
    """Each row of docs: (id, *carry, language, posterior, text_language, kept).

    evidence: see page_evidence; None: no document has a page. label is read for the fitted sample only. A row is kept if
    its language is one of languages with a posterior of at least `least`.
    """
    carry = carried(carry, id_column, "language", "posterior", "text_language", "kept")
    model = fit(docs, languages, text=text, label=label, id_column=id_column, sample=sample)
    named = {f"__c{k}": c for k, c in enumerate(carry)}
    plain = docs.select(F.col(id_column).alias("id"), F.col(source).cast("string").alias("source"), *[F.col(c).alias(n) for n, c in named.items()], whole(text).alias("body"))
    scored = score_texts(plain, model, languages, text="body", carry=("id", "source", *named), weight=weight)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "text-scores")  # written: a row keeps its number
    if evidence is None:
        evidence = scored.sparkSession.createDataFrame([], EVIDENCE)
    fused = fuse(scored, evidence, languages, carry=("id", *named))
    kept = F.col("language").isin(*languages) & (F.col("posterior") >= least)
    return fused.withColumn("kept", kept).select(F.col("id").alias(id_column), *[F.col(n).alias(c) for n, c in named.items()], "language", "posterior", "text_language", "kept")


def keep_known(docs: DataFrame, evidence: DataFrame | None, languages: tuple[str, ...], **options) -> DataFrame:
    """The rows of docs in one of the languages. options: see identify."""
    here = located(docs)
    return without(here, identify(here, evidence, languages, carry=(FILE, ROW), **options).filter(~F.col("kept")))
