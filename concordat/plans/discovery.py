"""Queries over record tables: headers, samples, species, readiness, selection, order, exports and inspection.

Records are made of the TPC-H-like tables; the SQL restates each rule over the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import classify, harmonize, inspection, linkage, pages, records, substrings
from concordat.plans.bridge import table
from concordat.plans.queries import query
from concordat.sources import tables
from concordat.store import shared_folder
from concordat.streaming import incremental

WORDS = (
    "gene", "Gene.Symbol", "ensembl_id", "probe_set", "log2FoldChange", "logFC", "fold_change", "beta", "pvalue", "P.Value", "p", "padj", "FDR",
    "adj.P.Val", "baseMean", "control_1", "wt", "treated rep2", "GSM123", "start", "age", "s1", "stat", "AveExpr", "description", "nan", " ", "donor-7", "xyz",
)
NAMES = ("_deseq2_results.csv", "_raw_counts.txt.gz", "_RAW.tar", "_tpm.tsv", "_processed.xlsx", ".bam", "_notes.pdf", "_table.csv", "_fpkm.pdf", ".zip")


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _pick(values, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(?i){pattern}')"


def _matching(names: str, pattern: str) -> str:
    return f"list_filter({names}, lambda x: {_like('x', pattern)})"


_HEAD = f"select p_partkey, list_filter(list_transform([0, 1, 2, 3, 4, 5], lambda k: trim(({_list(WORDS)})[(p_partkey * 7 + k * (5 + p_partkey % 11)) % {len(WORDS)} + 1])), lambda x: x <> '' and lower(x) <> 'nan') as names from part"
_PRIORITY = f"case when {_like('x', 'symbol|hgnc|hugo|gene[_. ]?name')} then 0 when {_like('x', 'ensembl|gene[_. ]?id|geneid')} then 1 when lower(x) = 'gene' then 2 when lower(x) = 'id_ref' then 3 else 4 end"


@query(f"""select p_partkey, case when whole and len(p) > 0 then case when len(clear) + len(unclear) > 1 or len(p) > 1 then 'requires_column_mapping' when len(clear) > 0 then 'candidate_header' else 'requires_lfc_confirmation' end
    when whole and len(padj) > 0 then 'requires_pvalue_mapping' else 'not_deg_table' end as status, gene, lfc, p[1] as p, padj[1] as padj, array_to_string(genes, '|') as gene_columns, array_to_string(list_concat(clear, unclear), '|') as lfc_columns, len(clear) > 0 as lfc_scale_explicit
from (select *, gene is not null and lfc is not null as whole from (
  select *, coalesce(clear[1], unclear[1]) as lfc, (list_sort(list_transform(genes, lambda x: struct_pack(p := {_PRIORITY}, l := lower(x), k := list_position(genes, x), x := x))))[1].x as gene from (
    select p_partkey, {_matching('names', classify.LFC_CLEAR)} as clear, list_filter(names, lambda x: {_like('x', classify.LFC_UNCLEAR)} and not {_like('x', classify.LFC_CLEAR)}) as unclear,
      {_matching('names', classify.PADJ)} as padj, list_filter(names, lambda x: {_like('x', classify.PVALUE)} and not {_like('x', classify.PADJ)}) as p,
      case when len({_matching('names', classify.GENE_EXACT)}) > 0 then {_matching('names', classify.GENE_EXACT)} else {_matching('names', classify.GENE_LOOSE)} end as genes
    from ({_HEAD}))))""")
def header_class(spark, sf):
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    names = F.array(*[_pick(WORDS, (k * 7 + n * (5 + k % 11)) % len(WORDS)) for n in range(6)])
    found = part.select("p_partkey", classify.header_class(names).alias("h"))
    return found.select("p_partkey", "h.status", "h.gene", "h.lfc", "h.p", "h.padj", F.array_join("h.gene_columns", "|").alias("gene_columns"), F.array_join("h.lfc_columns", "|").alias("lfc_columns"), "h.lfc_scale_explicit")


@query(f"select p_partkey, name, trim(name) <> '' and not {_like('trim(name)', classify.NOT_SAMPLE)} and ({_like('trim(name)', classify.SAMPLE)} or regexp_matches(trim(name), '[0-9]')) as sample from (select p_partkey, ({_list(WORDS)})[p_partkey % {len(WORDS)} + 1] || case p_partkey % 3 when 0 then '' when 1 then '_' || p_partkey % 7 else '.b' end as name from part)")
def sample_names(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("_"), (k % 7).cast("string"))).otherwise(".b")
    rows = table(spark, sf, "part").select("p_partkey", F.concat(_pick(WORDS, k % len(WORDS)), tail).alias("name"))
    return rows.withColumn("sample", classify.looks_like_sample(F.col("name")))


_CLASS = " ".join(f"when {_like('n', p)} then '{t}'" for p, t in ((classify.REJECTED, "reject:unsupported"), (classify.COUNTS, "upstream:count_matrix"), (classify.EXPRESSION, "upstream:normalized_expression_matrix"), (classify.STRONG, "strong:deg_table"), (classify.TABULAR, "weak:unknown_table")))
_FILES = f"'p' || p_partkey || ({_list(NAMES)})[p_partkey % {len(NAMES)} + 1]"


@query(f"select p_partkey, split_part(c, ':', 1) as tier, split_part(c, ':', 2) as role, {_like('n', classify.TABULAR)} and c <> 'reject:unsupported' as inspectable from (select *, case {_CLASS} else 'unsupported:unsupported' end as c from (select p_partkey, lower({_FILES}) as n from part))")
def filename_classes(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.lit("https://example.org/a%20b/p"), k.cast("string"), _pick(NAMES, k % len(NAMES)), F.lit("?x=1#y"))
    return table(spark, sf, "part").select("p_partkey", classify.filename_class(name).alias("c")).select("p_partkey", "c.tier", "c.role", "c.inspectable")


_ORDER_FLAGS = "o_orderkey % 3 = 0 as verified, o_orderkey % 5 = 0 as quarantined, o_orderkey % 11 = 0 as blocked, case when o_orderkey % 2 = 0 then 'text' end as evidence, list_filter([case o_orderkey % 4 when 0 then 'Human' when 1 then 'Mouse' when 2 then 'Human' end, case when o_orderkey % 7 = 0 then 'Mouse' end], lambda x: x is not null) as labels"
_DECISION = """case when blocked then 'mixed_quarantined' when verified and (len(list_distinct(labels)) > 1 or quarantined) then case when evidence is not null then 'mixed_rescued' else 'mixed_quarantined' end
  when quarantined then 'mixed_quarantined' when verified then 'target_species_verified' when len(labels) = 0 then 'unknown'
  when list_contains(labels, 'Human') then case when len(list_distinct(labels)) = 1 then 'target_species_likely' else 'mixed_quarantined' end else 'non_target' end"""
_READY = f"""select *, case when decision = 'mixed_quarantined' then 'mixed_quarantined' when (decision in ('target_species_verified', 'mixed_rescued') or said = 'verified_ready') and has_file then 'verified_ready'
    when has_file then 'likely_ready' when has_accession then 'candidate' when said is null then 'metadata_only' else said end as tier from (
  select o_orderkey, o_custkey, {_DECISION} as decision, o_orderkey % 13 < 4 as has_file, o_orderkey % 13 < 9 as has_accession, case when o_orderkey % 17 = 0 then 'verified_ready' when o_orderkey % 17 = 1 then 'likely' end as said
  from (select *, {_ORDER_FLAGS} from orders))"""


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    labels = F.array(F.when(k % 4 == 0, "Human").when(k % 4 == 1, "Mouse").when(k % 4 == 2, "Human"), F.when(k % 7 == 0, "Mouse"))
    decision = classify.species_decision(labels, "Human", k % 3 == 0, k % 5 == 0, k % 11 == 0, F.when(k % 2 == 0, "text"))
    said = F.when(k % 17 == 0, "verified_ready").when(k % 17 == 1, "likely")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", decision.alias("decision"), records.readiness(decision, k % 13 < 4, k % 13 < 9, tier=said).alias("data_readiness"))


@query(f"select o_orderkey, {_DECISION} as decision from (select *, {_ORDER_FLAGS} from orders)")
def species_decisions(spark, sf):
    return _decided(spark, sf).select("o_orderkey", "decision")


_PLACE = "case tier when 'verified_ready' then 0 when 'likely_ready' then 1 when 'likely' then 1 when 'candidate' then 2 when 'mixed_quarantined' then 3 else 4 end"
_BASIS = "case when tier = 'mixed_quarantined' then 'mixed_species_without_target_file_verification' when tier = 'verified_ready' and has_file then case when decision = 'mixed_rescued' then 'mixed_species_target_file_verified' else 'target_species_verified' end when tier = 'likely_ready' then 'public_data_candidate_present_unverified' when tier = 'candidate' then 'repository_record_without_tabular_file' when tier = 'metadata_only' then 'publication_metadata_only' end"


@query(f"select o_orderkey, tier, {_PLACE} as priority, coalesce({_BASIS}, '') as basis from ({_READY})")
def readiness_tiers(spark, sf):
    return _decided(spark, sf).select("o_orderkey", "data_readiness.tier", "data_readiness.priority", F.array_join("data_readiness.basis", ";").alias("basis"))


@query(f"""select o_custkey as component, case when bool_or(o_orderkey = first and tier = 'mixed_quarantined') then 'mixed_quarantined' else arg_min(tier, priority * 1000000000000 + o_orderkey) end as tier, array_to_string(list_sort(list_distinct(list(basis) filter (basis is not null))), ';') as basis
from (select *, {_PLACE} as priority, {_BASIS} as basis, min(o_orderkey) over (partition by o_custkey) as first from ({_READY})) group by 1""")
def readiness_merged(spark, sf):
    members = _decided(spark, sf).withColumnRenamed("o_custkey", "component")
    merged = members.groupBy("component").agg(F.min_by("data_readiness", "o_orderkey").alias("data_readiness"))
    basis = F.col("data_readiness.basis")
    # A component of which no member has a reason has no basis, as in SQL, and not an empty one.
    return records.merged_readiness(members, merged, order="o_orderkey").select("component", "data_readiness.tier", F.array_join(F.when(F.size(basis) > 0, basis), ";").alias("basis"))


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'a quarantined mixed record' when o_orderkey % 7 = 0 then 'a blocked mixed record' when o_orderkey % 3 = 0 and o_orderkey % 2 > 0 then 'a rescued mixed record without a verified target and textual evidence'
    when o_orderstatus = 'F' then case when o_orderkey % 13 < 6 or o_orderkey % 13 < 9 then '' else 'neither a series accession nor a direct file' end
    when o_orderpriority like '1%' then 'the species evidence doesn''t name the species' when o_orderkey % 13 < 9 then '' else 'neither a series accession nor a direct file' end as reason,
  case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 or o_orderkey % 3 = 0 and o_orderkey % 2 > 0 or o_orderstatus <> 'F' and o_orderpriority like '1%' then 'excluded' when o_orderkey % 13 < 6 then 'series' when o_orderkey % 13 < 9 then 'direct' else 'excluded' end as route from orders""")
def record_partition(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders")
    flags = {"blocked": k % 7 == 0, "quarantined": k % 5 == 0, "rescued": k % 3 == 0, "verified": F.lit(True)}
    said = F.when(F.col("o_orderstatus") == "F", "target_species_likely").otherwise("unclear")
    evidence = F.when(F.col("o_orderpriority").startswith("1"), "mouse only").otherwise("Homo sapiens cells")
    why = records.species_exclusion(said, flags, F.when(k % 2 == 0, "text"), evidence, "homo sapiens", "human")
    accessions = F.when(k % 13 < 6, F.array(F.concat(F.lit("gse"), k.cast("string"))))
    files = F.when(k % 13 < 9, F.array(F.struct(F.concat(F.lit("http://h/"), k.cast("string")).alias("source_url"))))
    return records.partition(rows, why, accessions, files).select("o_orderkey", "reason", "route")


@query("select o_orderkey, case when again then 'a duplicate record' when row_number() over (order by again, o_orderkey) > 50 then 'beyond the record limit' else '' end as reason from (select *, row_number() over (partition by o_custkey order by o_orderkey) > 1 as again from orders)")
def record_selection(spark, sf):
    return records.select_unique(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 50).select("o_orderkey", "reason")


@query("select o_orderkey, row_number() over (order by v desc nulls last, r, o_orderkey)::int as rank from (select o_orderkey, case when o_orderkey % 4 > 0 then o_totalprice end as v, coalesce(case when o_orderkey % 3 > 0 then o_custkey end, 1000000000) as r from orders)")
def series_order(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("v"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("r"))
    return records.series_order(rows, "v", descending=True, relevance="r", key="o_orderkey").select("o_orderkey", "rank")


_PAGE = "select p_partkey, row_number() over (order by lower(p_name) desc, p_partkey)::int as rank from part order by rank limit 20 offset 40"


def _ranked_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"), *[F.lit(None).cast("int").alias(c) for c in ("priority", "relevance_rank", "year")])
    return classify.publication_rank(rows, "title", descending=True).select("p_partkey", "rank")


@query(_PAGE)
def publication_page(spark, sf):
    return records.page(_ranked_parts(spark, sf), 3, 20)[0]


@query(_PAGE)
def indexed_page(spark, sf):
    """The same page by an index: the ranked table is written once, and a page opens the one or two files that hold it."""
    path = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    pages.build(_ranked_parts(spark, sf), path, rows=50)
    return pages.Index(spark, path).page(3, 20)[0]


def _candidates(k: Column) -> Column:
    url = F.concat(F.lit("http://h/"), k.cast("string"), _pick(NAMES, k % len(NAMES)))
    one = lambda n, name, role: F.struct(F.lit(None).cast("string").alias("candidate_id"), F.lit("geo").alias("provider"), F.concat(F.lit("gse"), (k % 5 + n).cast("string")).alias("accession"), F.when(k % 3 != n, url).alias("source_url"), name.alias("name"), role.alias("role"), F.lit(None).cast("string").alias("tier"), F.lit("file").alias("record_type"))
    name = F.concat(F.lit("p"), k.cast("string"), _pick(NAMES, (k + 3) % len(NAMES)))
    return F.array(one(0, name, F.lit(None).cast("string")), one(1, F.when(k % 2 == 0, name), F.when(k % 4 == 0, "deg_table").otherwise(F.lit(None).cast("string"))))


_URL = f"'http://h/' || p_partkey || ({_list(NAMES)})[p_partkey % {len(NAMES)} + 1]"
_NAME = f"'p' || p_partkey || ({_list(NAMES)})[(p_partkey + 3) % {len(NAMES)} + 1]"
_EACH = f"""select p_partkey, 0 as pos, 'gse' || p_partkey % 5 as accession, case when p_partkey % 3 <> 0 then {_URL} end as source_url, {_NAME} as name, null as role from part
  union all select p_partkey, 1, 'gse' || (p_partkey % 5 + 1), case when p_partkey % 3 <> 1 then {_URL} end, case when p_partkey % 2 = 0 then {_NAME} end, case when p_partkey % 4 = 0 then 'deg_table' end from part"""


@query(f"select p_partkey as canonical_id, accession, source_url, name, role, substr(sha256('geo|' || accession || '|' || coalesce(source_url, '') || '|' || coalesce(name, '') || '|' || coalesce(role, '')), 1, 16) as candidate_id from ({_EACH})")
def candidate_export(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("canonical_id"), _candidates(F.col("p_partkey")).alias("candidates"))
    return records.candidate_rows(rows).select("canonical_id", "accession", "source_url", "name", "role", "candidate_id")


@query(f"""select p_partkey, pos, case when path like '%.zip' then 2 else case r when 'deg_table' then 0 when 'unknown_table' then 1 when 'count_matrix' then 3 when 'normalized_expression_matrix' then 4 else 8 end end as role_place,
  case t when 'strong' then 0 when 'weak' then 1 when 'upstream' then 3 else 8 end as tier_place, signal as name
from (select *, coalesce(role, split_part(c, ':', 2)) as r, split_part(c, ':', 1) as t from (select *, case {_CLASS} else 'unsupported:unsupported' end as c from (
  select *, lower(coalesce(name, source_url, '')) as signal, lower(coalesce(source_url, name, '')) as path, lower(regexp_replace(coalesce(name, source_url, ''), '^.*/', '')) as n from ({_EACH}))))""")
def candidate_places(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(_candidates(F.col("p_partkey"))).alias("pos", "c"))
    return rows.select("p_partkey", "pos", records.candidate_order(F.col("c")).alias("o")).select("p_partkey", "pos", F.col("o.role").alias("role_place"), F.col("o.tier").alias("tier_place"), "o.name")


@query(f"select p_partkey % 50 as g, upper(accession) as accession, lower(coalesce(name, '')) as name, coalesce(source_url, '') as source_url, coalesce(role, '') as role, min(p_partkey) as first_part from ({_EACH}) group by 1, 2, 3, 4, 5")
def candidates_merged(spark, sf):
    k = F.col("p_partkey")
    kind = F.transform(_candidates(k), lambda c: c.withField("first_part", k.cast("string")))
    rows = table(spark, sf, "part").select((k % 50).alias("g"), kind.alias("candidates"), k)
    merged = linkage.candidates(rows, "g", [F.col("p_partkey")])
    return merged.select("g", "accession", F.lower(F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("source_url", F.lit("")).alias("source_url"), F.coalesce("role", F.lit("")).alias("role"), F.col("first_part").cast("bigint").alias("first_part"))


_STATUSES = ("ready_for_review", "candidate_header", "not_deg_table", "requires_lfc_confirmation", "requires_column_mapping", "requires_pvalue_mapping")


@query(f"""select 'Human_GSE' || l_orderkey || '_' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') as study_id, 'PMID:' || l_orderkey as source_unit_id, 'http://h/' || l_orderkey || '/' || pos as source_url, 'no' as include_in_analysis
from (select *, row_number() over (order by l_orderkey, pos) as n, ({_list(_STATUSES)})[(l_orderkey + pos) % {len(_STATUSES)} + 1] as status from (select l_orderkey, unnest(range(1, count(*) + 1)) as pos from lineitem group by 1)) where status in {records.REVIEWABLE}""")
def draft_catalog(spark, sf):
    """Orders as studies and their lines as files: the numbers of a draft count all files and have three digits or more."""
    each = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("m"))
    k = F.col("l_orderkey")
    blank = [F.lit("x").alias(c) for c in ("gene", "lfc", "p", "padj")]
    files = F.transform(F.sequence(F.lit(1).cast("bigint"), "m"), lambda at: F.struct(F.lit("a.csv").alias("name"), F.concat(F.lit("http://h/"), k.cast("string"), F.lit("/"), at.cast("string")).alias("source_url"), F.struct(_pick(_STATUSES, (k + at) % len(_STATUSES)).alias("status"), *blank).alias("inspection")))
    studies = each.select(k.alias("position"), F.lit("Human").alias("species"), F.concat(F.lit("GSE"), k.cast("string")).alias("accession"), F.concat(F.lit("PMID:"), k.cast("string")).alias("source_unit_id"), files.alias("files"))
    return records.draft_catalog(records.study_files(studies)).select("study_id", "source_unit_id", "source_url", "include_in_analysis")


@query(f"""select l_orderkey, case when deg > 0 then 'author_deg_likely' when tab > 0 then 'tabular_candidate' when mat > 0 then 'matrix_fallback' else 'not_detected' end as tier, deg::int as deg_like, tab::int as tabular, mat::int as matrix
from (select l_orderkey, count(*) filter (t and c like 'strong%') as deg, count(*) filter (t and c like 'weak%') as tab, count(*) filter (t and c like 'upstream%') as mat from (
  select *, {_like('n', classify.TABULAR)} and c not like 'reject%' as t from (select *, case {_CLASS} else 'unsupported:' end as c from (select l_orderkey, 'f' || l_partkey || ({_list(NAMES)})[l_partkey % {len(NAMES)} + 1] as n from lineitem))) group by 1)""")
def file_availability(spark, sf):
    name = F.concat(F.lit("f"), F.col("l_partkey").cast("string"), _pick(NAMES, F.col("l_partkey") % len(NAMES)))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(name).alias("names"))
    return rows.select("l_orderkey", records.file_availability(F.col("names")).alias("a")).select("l_orderkey", "a.tier", "a.deg_like", "a.tabular", "a.matrix")


@query("""select o_orderkey, coalesce('pmid:' || case when o_orderkey % 5 = 0 then least(o_orderkey::varchar, o_custkey::varchar) end, 'doi:' || case when o_orderkey % 5 = 1 then '10.1/x' || o_orderkey end, 'accession:' || case when o_orderkey % 5 = 2 then 'GSE' || o_orderkey end, 'title:' || case when o_orderkey % 5 = 3 then 'a title ' || o_custkey end, 'record:unknown') as canonical_id,
  coalesce(case when o_orderkey % 5 = 0 then 'PMID:' || least(o_orderkey::varchar, o_custkey::varchar) when o_orderkey % 5 = 1 then 'DOI:10.1/x' || o_orderkey when o_orderkey % 5 = 2 then 'GSE' || o_orderkey when o_orderkey % 5 = 3 then 'title:a title ' || o_custkey end, 'record:unknown') as source_unit_id from orders""")
def canonical_ids(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    pmids = F.when(k % 5 == 0, F.array(F.concat(F.lit("PMID "), k.cast("string")), c, F.lit("none")))
    dois = F.when(k % 5 == 1, F.array(F.concat(F.lit("https://doi.org/10.1/X"), k.cast("string"), F.lit("."))))
    series = F.when(k % 5 == 2, F.array(F.concat(F.lit(" gse"), k.cast("string")), F.lit("")))
    title = F.when(k % 5 == 3, F.concat(F.lit("A Title "), c))
    whole = records.canonical_id(pmids, dois, series, F.array().cast("array<string>"), title)
    return table(spark, sf, "orders").select("o_orderkey", whole.alias("canonical_id"), records.source_unit_id(F.lit(None).cast("string"), pmids, dois, series, whole).alias("source_unit_id"))


@query("""select l_orderkey, case when found and not failed then 'resolved_candidates' when found then 'partial' when failed then 'unavailable' when l_orderkey % 2 = 0 then 'resolved_no_candidate' else 'no_resolver' end as state, n_events
from (select l_orderkey, bool_or(l_returnflag = 'A') as found, bool_or(l_linestatus = 'O' and l_linenumber = 1) as failed, count(distinct case when l_returnflag = 'A' then 'found' when l_linestatus = 'O' and l_linenumber = 1 then 'error' else 'empty' end) as n_events from (select l_orderkey, l_returnflag, l_linenumber, case when l_returnflag = 'A' then '-' else l_linestatus end as l_linestatus from lineitem) group by 1)""")
def resolution_states(spark, sf):
    status = F.when(F.col("l_returnflag") == "A", "found").when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), "error").otherwise("empty")
    each = table(spark, sf, "lineitem").select("l_orderkey", F.array(F.struct(status.alias("status"))).alias("resolution_events"))
    merged = records.merged_events(each, "l_orderkey")
    return merged.select("l_orderkey", records.resolution_state(F.col("resolution_events"), F.col("l_orderkey") % 2 == 0).alias("state"), F.size("resolution_events").cast("bigint").alias("n_events"))


@query("""with named as (select 'GSM' || s_suppkey as sample, unnest(['gsm' || s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g'), 'ns' || s_nationkey]) as k from supplier),
keys as (select k, min(sample) as sample from named where length(k) >= 3 group by 1 having count(distinct sample) = 1),
cols as (select distinct case p_partkey % 4 when 0 then 'gsm' || p_partkey when 1 then 'Supplier_' || lpad((p_partkey % 150)::varchar, 9, '0') when 2 then 'Supplier 00000' || p_partkey % 40 || '_rep' else 'NS' || p_partkey % 30 end as "column" from part),
plain as (select *, regexp_replace(lower("column"), '[^a-z0-9]+', '', 'g') as c from cols),
own as (select "column", upper("column") as sample from plain where upper("column") in (select 'GSM' || s_suppkey from supplier)),
equal as (select "column", sample from plain join keys on c = k where "column" not in (select "column" from own)),
near as (select "column", min(sample) as sample from plain join keys on length(k) >= 4 and (starts_with(c, k) or starts_with(k, c)) where length(c) >= 4 and "column" not in (select "column" from own union all select "column" from equal) group by 1 having count(distinct sample) = 1)
select "column", sample from cols left join (select * from own union all select * from equal union all select * from near) using ("column")""")
def matched_samples(spark, sf):
    k = F.col("p_partkey")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    named = F.when(k % 4 == 0, text("gsm", k)).when(k % 4 == 1, text("Supplier_", F.lpad((k % 150).cast("string"), 9, "0"))).when(k % 4 == 2, text("Supplier 00000", k % 40, "_rep")).otherwise(text("NS", k % 30))
    labels = table(spark, sf, "supplier").select(text("GSM", F.col("s_suppkey")).alias("sample"), F.col("s_name").alias("title"), text("N.S. ", F.col("s_nationkey")).alias("source"))
    return linkage.match_samples(table(spark, sf, "part").select(named.alias("column")).distinct(), labels)


@query("select c_nationkey as component, arg_min(c_custkey, c_custkey) as c_custkey, arg_max(c_name, (length(trim(c_name)), c_name)) as c_name, max(c_acctbal) as c_acctbal, min(c_mktsegment) as c_mktsegment, bool_or(c_custkey % 100 = 0) as flag, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ';') as segments, count(*) as n_records from customer group by 1")
def merged_records(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("component"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment", (F.col("c_custkey") % 100 == 0).alias("flag"), F.array("c_mktsegment").alias("segments"))
    got = linkage.merge(rows, [F.col("c_custkey")], texts=["c_name"], unions=["segments"], largest=["c_acctbal"], least=["c_mktsegment"], any_true=["flag"])
    return got.withColumn("segments", F.array_join("segments", ";"))


@query("select o_custkey as record, 'GSM' || o_orderkey as sample, o_orderpriority as title, o_orderstatus as source, 'age: ' || o_orderkey % 90 || ';sex: ' || case when o_orderkey % 2 = 0 then 'f' else 'm' end as characteristics from orders")
def soft_samples(spark, sf):
    k = F.col("o_orderkey")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    lines = F.array(text("^SAMPLE = GSM", k), text("!Sample_title = ", F.col("o_orderpriority")), text("!Sample_source_name_ch1 = ", F.col("o_orderstatus")), text("!Sample_characteristics_ch1 = age: ", k % 90), text("!Sample_characteristics_ch1 = sex: ", F.when(k % 2 == 0, "f").otherwise("m")), F.lit("!Sample_other = x"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("record"), "o_orderkey", F.posexplode(lines).alias("at", "value")).withColumn("line", k * 10 + F.col("at"))
    return tables.soft_samples(rows).withColumn("characteristics", F.array_join("characteristics", ";"))


@query("""select o_custkey % 300 as g, min(o_orderkey) as first_id from orders group by 1""")
def accession_owners(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_custkey") % 300).alias("accessions"))
    return linkage.accession_owners(rows, "o_orderkey", "accessions", [F.col("o_orderkey")]).select(F.col("accession").alias("g"), F.col("o_orderkey").alias("first_id"))


@query("select distinct 'n' || p_size as name, 'http://h/' || p_size as url from part union select distinct '', 'http://d/' || p_size % 9 from part")
def json_links(spark, sf):
    size = F.col("p_size").cast("string")
    payload = F.concat(F.lit('{"a": {"url": "http://h/'), size, F.lit('", "name": "n'), size, F.lit('"}, "b": [[{"x": {"href": "http://d/'), (F.col("p_size") % 9).cast("string"), F.lit('"}}]], "url": 3}'))
    return tables.links(table(spark, sf, "part").select(payload.alias("payload")))


_ROWS = "select l_orderkey as t, l_linenumber as v, l_discount as d, l_tax * 20 as p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as r from lineitem"
_BAD = "({x} % 3 = 0 and v % 2 = 0)"


def _table_lines(spark: SparkSession, sf: str, head: Column, cells: Column) -> DataFrame:
    """A note, a header and then the order's lines, for each order as a table."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    body = table(spark, sf, "lineitem").withColumn("r", F.row_number().over(order))
    first = body.select("l_orderkey").distinct()
    notes = first.select(F.col("l_orderkey").alias("table"), F.explode(F.array(F.struct(F.lit(1).alias("line"), F.array(F.lit("a note")).alias("cells")), F.struct(F.lit(2).alias("line"), head.alias("cells")))).alias("x")).select("table", "x.*")
    return notes.unionByName(body.select(F.col("l_orderkey").alias("table"), (F.col("r") + 2).alias("line"), cells.alias("cells")))


@query(f"""select t as "table", case when n >= 2 and lfc >= 0.5 and p >= 0.5 then 'ready_for_review' else 'candidate_header' end as status, 2 as header_row, round_even(lfc * 1000, 0) / 1000 as lfc_numeric_fraction, round_even(p * 1000, 0) / 1000 as p_unit_interval_fraction, n as sample_rows
from (select t, count(*) as n, coalesce(count(*) filter (not {_BAD.format(x='t')} ) / nullif(count(*), 0), 0) as lfc, count(*) filter (p <= 1) / count(*) as p from (select * from ({_ROWS}) where r <= 20) group by 1)""")
def inspected_rows(spark, sf):
    found = inspection.inspect_rows(inspected_text_rows(spark, sf))
    return found.select("table", "status", "header_row", "lfc_numeric_fraction", "p_unit_interval_fraction", F.col("sample_rows").cast("bigint").alias("sample_rows"))


def inspected_text_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(table, line, cells): an order's lines as an author's table."""
    k = F.col("l_orderkey")
    lfc = F.when((k % 3 == 0) & (F.col("l_linenumber") % 2 == 0), "none given").otherwise(F.col("l_discount").cast("string"))
    head = F.array(F.lit("gene"), F.lit("log2FoldChange"), F.lit("pvalue"))
    return _table_lines(spark, sf, head, F.array(F.concat(F.lit("G"), F.col("l_partkey").cast("string")), lfc, (F.col("l_tax") * 20).cast("string")))


@query(f"""select t as "table", 2 as header_row, case when n >= 2 and t % 4 > 0 then 'upstream_matrix_ready_for_contrast' else 'not_upstream_matrix' end as status, case when t % 4 = 0 then 'ctrl_1;ctrl_2;treated_1' else 'ctrl_1;ctrl_2;treated_1;wt' end as sample_columns, n as sample_rows
from (select t, count(*) as n from (select * from ({_ROWS}) where r <= 20) group by 1)""")
def inspected_matrices(spark, sf):
    k = F.col("l_orderkey")
    head = F.array(F.lit("ID_REF"), F.lit("ctrl_1"), F.lit("ctrl_2"), F.lit("treated_1"), F.when(k % 4 == 0, "baseMean").otherwise("wt"), F.lit('"description"'))
    numbers = [F.col(c).cast("string") for c in ("l_quantity", "l_tax", "l_discount", "l_extendedprice")]
    found = inspection.inspect_matrix(_table_lines(spark, sf, head, F.array(F.concat(F.lit("G"), F.col("l_partkey").cast("string")), *numbers, F.lit("words"))))
    return found.select("table", "header_row", "status", F.array_join("sample_columns", ";").alias("sample_columns"), F.col("sample_rows").cast("bigint").alias("sample_rows"))


@query("select o_orderkey, o_orderkey % 3 = 0 as fits from orders")
def exact_taxa(spark, sf):
    k = F.col("o_orderkey")
    taxa = F.when(k % 3 == 0, F.array(F.lit("Homo sapiens"), F.lit(" Homo sapiens"))).when(k % 3 == 1, F.array(F.lit("Homo sapiens"), F.lit("Mus musculus")))
    summary = F.when(k % 2 == 0, F.when(k % 3 != 2, "Homo sapiens"))
    return table(spark, sf, "orders").select("o_orderkey", records.exact_taxon(summary, taxa, "Homo sapiens")["fits"].alias("fits"))


@query("select o_orderkey, c_name as publication_title, c_nationkey as publication_year from orders left join customer on case when o_orderkey % 4 > 0 then o_custkey end = c_custkey")
def publication_lookup(spark, sf):
    studies = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.array(F.concat(F.lit("PMID:"), F.col("o_custkey").cast("string")), F.lit("1"))).alias("pubmed_ids"))
    publications = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("pmid"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("year"))
    return records.with_publication(studies, publications).drop("pubmed_ids")


@query(f"""select l_orderkey, array_to_string(list(n order by case split_part(c, ':', 1) when 'strong' then 0 when 'weak' then 1 when 'upstream' then 2 else 9 end, n), ';') as names
from (select *, case {_CLASS} else 'unsupported:unsupported' end as c from (select distinct l_orderkey, 'f' || l_partkey || ({_list(NAMES)})[l_partkey % {len(NAMES)} + 1] as n from lineitem)) group by 1""")
def file_orders(spark, sf):
    """The files of each order, the most telling ones first."""
    name = F.concat(F.lit("f"), F.col("l_partkey").cast("string"), _pick(NAMES, F.col("l_partkey") % len(NAMES)))
    rows = table(spark, sf, "lineitem").select("l_orderkey", name.alias("n")).distinct()
    place = records.file_order(classify.filename_class(F.col("n"))["tier"], F.col("n"))
    ordered = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("x"))
    return ordered.select("l_orderkey", F.array_join(F.transform("x", lambda x: x["name"]), ";").alias("names"))


@query("select true as applied, count(*) as rows_before, count(*) filter (lower(trim(o_orderpriority)) in ('1-urgent', '5-low')) as rows_after from orders")
def entity_types(spark, sf):
    return harmonize.entity_type_summary(table(spark, sf, "orders"), "o_orderpriority", " 1-URGENT|5-low ")


@query("select time_bucket(interval '5 minutes', ts) as start, event_type, count(*) as n, round_even(sum(value) * 1000, 0) / 1000 as total from events group by 1, 2")
def event_windows(spark, sf):
    found = incremental.event_counts(table(spark, sf, "events"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.rint(F.col("total") * 1000) / 1000).alias("total"))


def _budget_sql(most: int, budget: str) -> str:
    named = f"select distinct l_orderkey, 'f' || l_partkey || ({_list(NAMES)})[l_partkey % {len(NAMES)} + 1] as n from lineitem"
    ranked = f"select *, row_number() over (partition by l_orderkey order by case split_part(c, ':', 1) when 'strong' then 0 when 'weak' then 1 when 'upstream' then 2 else 9 end, n) as round from (select *, case {_CLASS} else 'unsupported:unsupported' end as c from ({named}))"
    return f"select l_orderkey, n as name, round::int as round from (select *, row_number() over (order by round, l_orderkey) as k from ({ranked}) where round <= {most}) where k <= {budget}"


def _named_files(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("l_partkey").cast("string"), _pick(NAMES, F.col("l_partkey") % len(NAMES)))
    return table(spark, sf, "lineitem").select("l_orderkey", name.alias("n")).distinct()


def _order_of_files() -> list[Column]:
    return [records.file_order(classify.filename_class(F.col("n"))["tier"], F.col("n"))]


@query(_budget_sql(6, "40"))
def inspection_budget(spark, sf):
    """Which forty files are inspected, of all orders' as studies: with many studies, the first files of the first ones."""
    found = records.inspection_budget(_named_files(spark, sf), "l_orderkey", "l_orderkey", _order_of_files())
    return found.select("l_orderkey", F.col("n").alias("name"), "round")


@query(_budget_sql(6, "(select count(*) * 2 // 3 from lineitem)"))
def inspection_shares(spark, sf):
    """The same with a budget of two thirds of all files, which ends within a later round."""
    budget = table(spark, sf, "lineitem").count() * 2 // 3
    found = records.inspection_budget(_named_files(spark, sf), "l_orderkey", "l_orderkey", _order_of_files(), budget=budget)
    return found.select("l_orderkey", F.col("n").alias("name"), "round")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ed wid')")
def indexed_names(spark, sf):
    """Parts whose name holds a text, by the index of trigrams: names that lack one of its trigrams aren't read."""
    path = f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}"
    substrings.build(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", path)
    return substrings.Substrings(spark, path, "p_name").search("ed wid")
