"""Discovery over tables of publication records: identity, readiness, selection, order, paging and flat exports.

Records are rows with typed columns; their candidates are arrays of structs. Everything is columns and groupBys, so a
search of any size is one job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.text import accession, doi, field, literal_map, pmid
from concordat.operators.classify import filename_class
from concordat.operators.ranking import global_rank
from concordat.store import settled

# Priorities of readiness states, and of file availability; places of file roles and tiers.
READINESS = {"verified_ready": 0, "target_species_verified": 0, "mixed_rescued": 0, "likely_ready": 1, "likely": 1, "candidate": 2, "mixed_quarantined": 3, "metadata_only": 4, "unknown": 5}
FILE_AVAILABILITY = {"author_deg_likely": 4, "tabular_candidate": 3, "matrix_fallback": 2, "not_detected": 1, "unresolved": 0}
ROLE_ORDER = {"deg_table": 0, "unknown_table": 1, "archive": 2, "count_matrix": 3, "normalized_expression_matrix": 4, "unknown_matrix": 5}
TIER_ORDER = {"strong": 0, "weak": 1, "archive_candidate": 2, "upstream": 3}
FILE_ORDER = {"strong": 0, "weak": 1, "upstream": 2}
REVIEWABLE = ("ready_for_review", "candidate_header", "requires_lfc_confirmation", "requires_pvalue_mapping")
MOST_TERMS, LONGEST_QUERY, LONGEST_TERM, MOST_ON_PAGE = 12, 200, 64, 20

CANDIDATE = "struct<candidate_id:string,provider:string,accession:string,source_url:string,name:string,role:string,tier:string,record_type:string>"


def query_terms(query: str) -> list[str]:
    """The words of a search: letters and digits with inner hyphens and apostrophes; the syntax of search engines is dropped."""
    text = query.strip()
    if not text or len(text) > LONGEST_QUERY or any(ord(c) < 32 for c in text):
        raise ValueError(f"a query must have 1 to {LONGEST_QUERY} characters, none of them control characters")
    terms = [x[:LONGEST_TERM] for x in re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", text)]
    if not 1 <= len(terms) <= MOST_TERMS:
        raise ValueError(f"a query must have 1 to {MOST_TERMS} words")
    return terms


def entrez_query(query: str, organism: str) -> str:
    """A series search for all words, one organism and expression assays."""
    words = " AND ".join(f'"{x}"[All Fields]' for x in query_terms(query))
    assays = " OR ".join(f'"Expression profiling by {x}"[Filter]' for x in ("high throughput sequencing", "array"))
    return f'({words}) AND gse[ETYP] AND "{organism}"[Organism] AND ({assays})'


def _least(values: Column, normal) -> Column:
    """The least normalised value of an array, null without one."""
    return F.array_min(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normal), lambda x: x.isNotNull() & (x != "")))


def canonical_id(pmids: Column, dois: Column, accessions: Column, provider_ids: Column, title: Column) -> Column:
    """A record's best identifier: PMID, DOI, accession, provider's id, title. All but title are arrays of strings."""
    text = field(title)
    return F.coalesce(
        F.concat(F.lit("pmid:"), _least(pmids, pmid)),
        F.concat(F.lit("doi:"), _least(dois, doi)),
        F.concat(F.lit("accession:"), _least(accessions, accession)),
        F.concat(F.lit("provider:"), _least(provider_ids, field)),
        F.concat(F.lit("title:"), F.lower(text)),
        F.lit("record:unknown"),
    )


def source_unit_id(explicit: Column, pmids: Column, dois: Column, accessions: Column, canonical: Column) -> Column:
    """The independent unit that a publication stands for."""
    return F.coalesce(field(explicit), F.concat(F.lit("PMID:"), _least(pmids, pmid)), F.concat(F.lit("DOI:"), _least(dois, doi)), _least(accessions, accession), canonical)


def with_ids(candidates: Column) -> Column:
    """An array of CANDIDATE with the ids that are missing: 16 digits of a digest of what names the file."""
    parts = ("provider", "accession", "source_url", "name", "role")
    made = lambda c: F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c[p], F.lit("")) for p in parts]), 256), 1, 16)
    return F.transform(candidates, lambda c: c.withField("candidate_id", F.coalesce(field(c["candidate_id"]), made(c))))


def has_file(candidates: Column) -> Column:
    """Whether a candidate has an address, or a name and a role."""
    good = lambda c: field(c["source_url"]).isNotNull() | (field(c["name"]).isNotNull() & field(c["role"]).isNotNull())
    return F.coalesce(F.exists(candidates, good), F.lit(False))


def _sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != ""))))


def readiness(decision: Column, file: Column, has_accession: Column, tier: Column | None = None, state: Column | None = None, basis: Column | None = None, inspected: Column | None = None) -> Column:
    """struct(tier, priority, verification_state, basis): how near a record is to being usable.

    tier, state and basis: what the record says already, which stands where nothing else decides.
    """
    none = F.lit(None).cast("string")
    tier0 = F.coalesce(field(none if tier is None else tier), field(none if state is None else state), F.lit("unknown"))
    state0 = F.coalesce(field(none if state is None else state), tier0)
    basis0 = F.coalesce(F.array().cast("array<string>") if basis is None else basis, F.array().cast("array<string>"))
    file, seen = F.coalesce(file, F.lit(False)), F.lit(True) if inspected is None else F.coalesce(inspected, F.lit(True))
    verified = (decision.isin("target_species_verified", "mixed_rescued") | state0.isin("verified_ready", "target_species_verified")) & file
    cases = [  # fits, tier, reason
        (decision == "mixed_quarantined", "mixed_quarantined", F.lit("mixed_species_without_target_file_verification")),
        (verified, "verified_ready", F.when(decision == "mixed_rescued", "mixed_species_target_file_verified").otherwise("target_species_verified")),
        (file, "likely_ready", F.lit("public_data_candidate_present_unverified")),
        (F.coalesce(has_accession, F.lit(False)), "candidate", F.when(seen, "repository_record_without_tabular_file").otherwise("repository_record_not_inspected")),
        (tier0 == "unknown", "metadata_only", F.lit("publication_metadata_only")),
    ]
    new_tier, new_state, reason = tier0, state0, none
    for fits, t, r in reversed(cases):
        new_tier, new_state, reason = F.when(fits, t).otherwise(new_tier), F.when(fits, t).otherwise(new_state), F.when(fits, r).otherwise(reason)
    places = literal_map(READINESS)
    priority = F.coalesce(F.try_element_at(places, new_state), F.try_element_at(places, new_tier), F.lit(5))
    return F.struct(new_tier.alias("tier"), priority.alias("priority"), new_state.alias("verification_state"), _sorted(F.array_append(basis0, reason)).alias("basis"))


def merged_readiness(members: DataFrame, merged: DataFrame, component: str = "component", ready: str = "data_readiness", order: str = "position") -> DataFrame:
    """(component, data_readiness): the readiness of least priority among a component's members and the merged record.

    Of equal ones that of the first member counts, by the column order of members, and the merged record comes last. Reasons
    are united. A merged record that mixes species is quarantined whatever its members were.
    """
    last = F.lit(None).cast(members.schema[order].dataType).alias("order")
    both = members.select(component, F.col(ready).alias("r"), F.lit(0).alias("own"), F.col(order).alias("order")).unionByName(merged.select(component, F.col(ready).alias("r"), F.lit(1).alias("own"), last))
    best = both.groupBy(component).agg(
        F.min_by("r", F.struct("r.priority", "own", "order")).alias("best"),
        _sorted(F.flatten(F.collect_set("r.basis"))).alias("basis"),
        F.max_by("r", "own").alias("whole"),
    )
    chosen = F.when(F.col("whole.tier") == "mixed_quarantined", F.col("whole")).otherwise(F.col("best"))
    return best.select(component, chosen.withField("basis", F.col("basis")).alias(ready))


def resolution_state(events: Column, has_resolvers: Column) -> Column:
    """What became of looking a record's files up: events is an array of struct(status)."""
    found = F.exists(events, lambda e: e["status"] == "found")
    failed = F.exists(events, lambda e: e["status"].isin("error", "candidate_error", "unavailable"))
    found, failed = (F.coalesce(x, F.lit(False)) for x in (found, failed))
    return F.when(found & ~failed, "resolved_candidates").when(found, "partial").when(failed, "unavailable").when(has_resolvers, "resolved_no_candidate").otherwise("no_resolver")


def merged_events(records: DataFrame, by: str, events: str = "resolution_events") -> DataFrame:
    """(by, events): the distinct events of each group's records, in order."""
    return records.select(by, F.explode(events).alias("e")).groupBy(by).agg(F.array_sort(F.collect_set("e")).alias(events))


def exact_taxon(summary: Column, taxa: Column, target: str) -> Column:
    """struct(fits, reason): whether the taxa that a record names are the target alone."""
    seen = _sorted(F.array_append(F.coalesce(taxa, F.array().cast("array<string>")), summary))
    seen = F.array_sort(F.array_distinct(F.transform(seen, lambda x: F.trim(x))))
    fits = seen == F.array(F.lit(target))
    reason = F.when(fits, target).when(F.size(seen) == 0, "organism metadata is missing").otherwise(F.concat(F.lit("mixed or other organisms: "), F.array_join(seen, ", ")))
    return F.struct(fits.alias("fits"), reason.alias("reason"))


def species_exclusion(decision: Column, flags: dict[str, Column], evidence_text: Column, species_evidence: Column, target: str, key: str) -> Column:
    """Why a record can't be prepared for a species, "" where nothing speaks against it.

    flags: blocked, quarantined, rescued, verified (boolean columns). target and key: names of the species in lower case.
    """
    on = {k: F.coalesce(c, F.lit(False)) for k, c in flags.items()}
    said = F.lower(F.trim(F.coalesce(decision, F.lit(""))))
    said = F.when(on["blocked"], "mixed_blocked").otherwise(said)
    evidence = F.lower(F.coalesce(species_evidence, F.lit("")))
    unproven = ~on["verified"] | field(evidence_text).isNull()
    other = (evidence != "") & ~F.contains(evidence, F.lit(target.lower())) & ~F.contains(evidence, F.lit(key.lower()))
    return (
        F.when(on["quarantined"] | (said == "mixed_quarantined"), "a quarantined mixed record")
        .when(said == "mixed_blocked", "a blocked mixed record")
        .when((on["rescued"] | (said == "mixed_rescued")) & unproven, "a rescued mixed record without a verified target and textual evidence")
        .when(said.isin("target_species_verified", "target_species_likely", "likely_ready", "verified_ready", ""), "")
        .when(other, "the species evidence doesn't name the species")
        .otherwise("")
    )


def partition(records: DataFrame, exclusion: Column, accessions: Column, candidates: Column) -> DataFrame:
    """records with route (series, direct or excluded) and reason."""
    series = F.coalesce(F.exists(accessions, lambda x: F.upper(F.trim(x)).rlike(r"^GSE[0-9]+$")), F.lit(False))
    direct = F.coalesce(F.exists(candidates, lambda c: field(c["source_url"]).isNotNull()), F.lit(False))
    held = records.withColumn("reason", exclusion)
    route = F.when(F.col("reason") != "", "excluded").when(series, "series").when(direct, "direct").otherwise("excluded")
    held = held.withColumn("route", route)
    return held.withColumn("reason", F.when((F.col("route") == "excluded") & (F.col("reason") == ""), "neither a series accession nor a direct file").otherwise(F.col("reason")))


def select_unique(records: DataFrame, key: str, position: str, most: int) -> DataFrame:
    """records with reason: "" for the first of each key, up to `most` of them in order of position (a unique number)."""
    first = records.groupBy(key).agg(F.min(position).alias("__first"))
    held = records.join(first, key).withColumn("__again", F.col(position) != F.col("__first"))
    ranked = global_rank(held, F.when(~F.col("__again"), F.col(position)), [F.col(position)], "__rank")
    reason = F.when(F.col("__again"), "a duplicate record").when(F.col("__rank") > most, "beyond the record limit").otherwise("")
    return ranked.withColumn("reason", reason).drop("__first", "__again", "__rank")


def page(ranked: DataFrame, number: int = 1, size: int = MOST_ON_PAGE, rank: str = "rank") -> tuple[DataFrame, DataFrame]:
    """(the rows of one page by their rank, one row of totals): all rows are ordered before one page is cut."""
    number, size = max(1, int(number)), max(1, min(MOST_ON_PAGE, int(size)))
    rows = ranked.filter(F.col(rank).between((number - 1) * size + 1, number * size)).orderBy(rank)
    n = F.count("*")
    totals = ranked.agg(n.alias("total_records"), F.ceil(n / size).alias("total_pages"), (n > number * size).alias("has_next")).withColumns({"page": F.lit(number), "page_size": F.lit(size)})
    return rows, totals


def series_order(studies: DataFrame, value: str | None, descending: bool = False, relevance: str = "relevance_rank", key: str = "accession") -> DataFrame:
    """studies with rank: by value where there is one, the others last by relevance; value None: by relevance itself."""
    relevant = F.coalesce(F.col(relevance), F.lit(1_000_000_000))
    if value is None:
        return global_rank(studies, relevant, [F.col(key).desc() if descending else F.col(key)], "rank", descending=descending)
    return global_rank(studies, F.col(value), [relevant, F.col(key)], "rank", descending=descending)


def candidate_order(candidate: Column) -> Column:
    """The place of a CANDIDATE among others: struct(role, tier, name, address), author tables first."""
    signal = F.coalesce(field(candidate["name"]), field(candidate["source_url"]), F.lit(""))
    by_name = filename_class(signal)
    role = F.lower(F.coalesce(field(candidate["role"]), by_name["role"]))
    tier = F.lower(F.coalesce(field(candidate["tier"]), by_name["tier"]))
    path = F.lower(F.regexp_replace(F.coalesce(field(candidate["source_url"]), signal), r"[?#].*$", ""))
    role = F.when((role == "archive") | path.endswith(".zip"), "archive").otherwise(role)
    place = lambda values, x: F.coalesce(F.try_element_at(literal_map(values), x), F.lit(8))
    return F.struct(place(ROLE_ORDER, role).alias("role"), place(TIER_ORDER, tier).alias("tier"), F.lower(signal).alias("name"), F.coalesce(candidate["source_url"], F.lit("")).alias("url"))


def file_order(tier: Column, name: Column) -> Column:
    return F.struct(F.coalesce(F.try_element_at(literal_map(FILE_ORDER), tier), F.lit(9)).alias("tier"), name.alias("name"))


def file_availability(names: Column) -> Column:
    """struct(tier, priority, deg_like, tabular, matrix): what an array of file names promises, without opening any."""
    classes = F.transform(names, lambda x: filename_class(x))
    n = lambda tier: F.size(F.filter(classes, lambda c: (c["tier"] == tier) & c["inspectable"]))
    deg, table, matrix = n("strong"), n("weak"), n("upstream")
    tier = F.when(names.isNull(), "unresolved").when(deg > 0, "author_deg_likely").when(table > 0, "tabular_candidate").when(matrix > 0, "matrix_fallback").otherwise("not_detected")
    counts = [F.when(names.isNull(), 0).otherwise(x).alias(k) for k, x in (("deg_like", deg), ("tabular", table), ("matrix", matrix))]
    return F.struct(tier.alias("tier"), F.element_at(literal_map(FILE_AVAILABILITY), tier).alias("priority"), *counts)


def with_publication(studies: DataFrame, publications: DataFrame, pmids: str = "pubmed_ids") -> DataFrame:
    """studies with the publication of their first PMID: publications(pmid, title, authors, year, ...)."""
    own = studies.withColumn("__pmid", pmid(F.get(pmids, F.lit(0))))
    named = publications.select(F.col("pmid").alias("__pmid"), *[F.col(c).alias(f"publication_{c}") for c in publications.columns if c != "pmid"])
    return own.join(named, "__pmid", "left").drop("__pmid")


def bound(publications: DataFrame, resolved: DataFrame, key: str = "record_id", column: str = "candidates") -> DataFrame:
    """publications with the candidates that a resolver found for them, behind their own, each once."""
    found = resolved.groupBy(key).agg(F.flatten(F.collect_list(column)).alias("__found"))
    nothing = F.array().cast(publications.schema[column].dataType)
    both = F.array_distinct(F.concat(F.coalesce(column, nothing), F.coalesce("__found", nothing)))
    return publications.join(found, key, "left").withColumn(column, both).drop("__found")


def publication_rows(records: DataFrame) -> DataFrame:
    """One flat row for each record, arrays joined by "; "."""
    text = lambda c: F.array_join(c, "; ") if records.schema[c].dataType.simpleString().startswith("array") else F.col(c)
    plain = [c for c in ("paper_title", "authors", "journal", "year", "canonical_id", "species", "species_decision", "pubmed_ids", "doi", "pmcid", "geo_accessions", "source_unit_id", "resolution_state", "relevance_rank") if c in records.columns]
    ready = [F.col("data_readiness.tier").alias("readiness_tier"), F.col("data_readiness.priority").alias("readiness_priority"), F.col("data_readiness.verification_state").alias("verification_state"), F.array_join("data_readiness.basis", "; ").alias("readiness_basis")]
    count = F.greatest(F.size("candidates"), F.lit(0)).alias("candidate_count")
    return records.select(*[text(c).alias(c) for c in plain], *ready, count)


def dataset_rows(records: DataFrame) -> DataFrame:
    """(canonical_id, provider, accession, landing_url) of each record's accessions and of its sources (arrays of structs)."""
    own = records.select("canonical_id", F.lit("NCBI GEO").alias("provider"), F.explode("geo_accessions").alias("accession"), F.lit(None).cast("string").alias("landing_url")).filter(F.trim("accession") != "")
    return own.unionByName(records.select("canonical_id", F.explode("sources").alias("s")).select("canonical_id", "s.provider", "s.accession", "s.landing_url"))


def candidate_rows(records: DataFrame) -> DataFrame:
    """One row for each candidate of each record."""
    return records.select("canonical_id", F.explode(with_ids(F.col("candidates"))).alias("c")).select("canonical_id", "c.*")


def study_files(studies: DataFrame, files: str = "files") -> DataFrame:
    """studies x files with n: the place of each among all, by study position and place in the array.

    studies: position (unique), accession, species, source_unit_id, and files: array of struct(name, source_url, inspection).
    """
    each = studies.select(*[c for c in studies.columns if c != files], F.posexplode(files).alias("at", "f"))
    flat = each.select(*[c for c in each.columns if c not in ("f",)], F.col("f.name").alias("filename"), "f.source_url", "f.inspection", filename_class(F.col("f.name")).alias("by_name"))
    flat = flat.withColumns({"filename_tier": F.col("by_name.tier"), "filename_reason": F.col("by_name.reason")}).drop("by_name")
    return global_rank(flat, F.col("position"), [F.col("at")], "n").drop("at")


def draft_catalog(files: DataFrame) -> DataFrame:
    """Catalog rows of study_files that a person can review; their numbers count the files that aren't, too."""
    good = files.filter(F.col("inspection.status").isin(*REVIEWABLE))
    return good.select(
        F.concat_ws("_", "species", "accession", F.format_string("%03d", F.col("n"))).alias("study_id"), F.col("source_unit_id").alias("paper_id"), "source_unit_id", "source_url",
        *[F.coalesce(F.col(f"inspection.{c}"), F.lit("")).alias(f"{'gene' if c == 'gene' else c}_column") for c in ("gene", "lfc", "p", "padj")],
        F.lit("author_deg_table_candidate").alias("source_input_type"), F.lit("auto").alias("table_scope"), F.lit("no").alias("include_in_analysis"), F.lit("requires_manual_review").alias("curation_status"),
    )


def metadata_rows(values: DataFrame, column: str = "metadata") -> DataFrame:
    """(field, value) rows of a map column."""
    return values.select(F.explode(column).alias("field", "value"))




#: Files of one study and of all studies that are inspected.
MOST_FILES, BUDGET = 6, 40


def inspection_budget(files: DataFrame, study: str, position: str, order: list[Column], most: int = MOST_FILES, budget: int = BUDGET) -> DataFrame:
    """The files to inspect, with round: a fair share of a budget, filled round by round.

    Within a study files stand in the given order (total), `most` at most take part. The first round takes each study's first
    file, the second one its second, and so on; a round that the budget ends in is filled by the studies' position (unique), so
    no study has a second file before every study has its first. Equal files of repeated rows each count.

    Rounds are counted (`most` rows), and only the round in which the budget ends is ranked, in ranges of the position.
    """
    place = F.row_number().over(Window.partitionBy(study).orderBy(*order))
    held = settled(files.withColumn("round", place).filter(F.col("round") <= most))
    counts = {r["round"]: r["n"] for r in held.groupBy("round").agg(F.count("*").alias("n")).collect()}  # `most` numbers
    left, whole, border = budget, [], None
    for k in sorted(counts):
        if counts[k] > left:
            border = k
            break
        whole.append(k)
        left -= counts[k]
    chosen = held.filter(F.col("round").isin(whole))
    if border is None or left <= 0:
        return chosen
    last = global_rank(held.filter(F.col("round") == border), F.col(position), [F.col(study)], "__rank").filter(F.col("__rank") <= left)
    return chosen.unionByName(last.drop("__rank"))
