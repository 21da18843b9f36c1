"""Queries of table digests and of a catalog held against recorded facts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from concordat.operators import provenance
from concordat.plans.bridge import table
from concordat.plans.queries import query
from concordat.sources.snapshots import Snapshots
from concordat.store import shared_folder

KEY = "concordat"
_COLUMNS = ("doc_id", "lang", "n_chars", "source", "text")
_TEXT = " || ".join(f"'{len(c)}:{c}=' || coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-') || ';'" for c in _COLUMNS)
_LIMBS = ", ".join(f"sum(('0x' || substr(h, {64 - 4 * k - 3}, 4))::bigint)::bigint as s{k}" for k in range(provenance.LIMBS))


def _carried() -> str:
    """The sums' digits: each limb hands its carry on to the next."""
    inner = f"select source, n_rows, s0 as v0, {', '.join(f's{k}' for k in range(1, provenance.LIMBS))} from limb_sums"
    for k in range(1, provenance.LIMBS):
        inner = f"select *, s{k} + (v{k - 1} >> 16) as v{k} from ({inner})"
    digits = " || ".join(f"lpad(lower(to_hex(v{k} & 65535)), 4, '0')" for k in reversed(range(provenance.LIMBS)))
    return f"select source, n_rows, {digits} as digest from ({inner})"


@query(f"with limb_sums as (select source, count(*) as n_rows, {_LIMBS} from (select source, sha256('{len(KEY)}:{KEY};' || {_TEXT}) as h from documents) group by 1) {_carried()}")
def table_digests(spark, sf):
    """The digest of each source's documents, over whole texts."""
    return provenance.digests(table(spark, sf, "documents").select(*_COLUMNS), KEY, by=("source",))


_DECLARED = "case when {k} % 10 = 0 then null when {k} % 10 = 1 then ' nan' when {k} % 10 = 2 then '2.5' else ({k} % 4 + 1)::varchar || case when {k} % 3 = 0 then '.0' else '' end end"
_RECORDED = "case when {k} % 7 = 0 then null when {k} % 7 = 1 then '-1' else ({k} % 4 + 1 + case when {k} % 6 = 0 then 1 else 0 end)::varchar end"
_WHOLE = "case when try_cast(trim({x}) as double) > 0 and try_cast(trim({x}) as double) = floor(try_cast(trim({x}) as double)) then try_cast(trim({x}) as double) end"


@query(f"""with both_sides as (
  select 'S' || o.k as study_id, c.k is not null as here, c.d_ctrl, c.d_treat, o.r_ctrl, o.r_treat, o.direction
  from (select o_orderkey as k, {_RECORDED.format(k='o_orderkey')} as r_ctrl, case when o_orderkey % 11 = 0 then null when o_orderkey % 7 = 0 and o_orderkey % 2 = 0 then null else (o_orderkey % 3 + 1)::varchar end as r_treat,
    case o_orderkey % 5 when 0 then '' when 1 then 'control_minus_treatment' else ' treatment_minus_control' end as direction from orders where o_orderkey % 3 > 0) o
  left join (select o_orderkey as k, {_DECLARED.format(k='o_orderkey')} as d_ctrl, (o_orderkey % 3 + 1)::varchar as d_treat from orders where o_orderkey % 8 > 0) c on o.k = c.k),
judged as (
  select *, case when not here then 'no such study' when r_ctrl is null and r_treat is null then null when r_ctrl is null or r_treat is null then 'recorded in part'
    when d_ctrl is null or trim(d_ctrl) = 'nan' then 'blank in the catalog' when {_WHOLE.format(x='d_ctrl')} is null or {_WHOLE.format(x='r_ctrl')} is null then 'not a positive whole number'
    when d_ctrl::double <> r_ctrl::double or d_treat <> r_treat then 'other counts' end as counts from both_sides)
select study_id, 'n_ctrl/n_treat' as field, coalesce(d_ctrl, '') || '/' || coalesce(d_treat, '') as declared, coalesce(r_ctrl, '') || '/' || coalesce(r_treat, '') as recorded, counts as problem from judged where counts is not null
union all
select study_id, 'effect_direction', 'treatment_minus_control', trim(direction), 'another direction' from judged
where (counts is null or counts = 'other counts') and not (r_ctrl is null and r_treat is null) and trim(direction) not in ('', 'treatment_minus_control')""")
def reconciled_facts(spark, sf):
    """Orders as studies: what a catalog declares of them, and what was recorded as their tables were made."""
    k = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    orders = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("S"), text(k)).alias("study_id"))
    declared = F.when(k % 10 == 0, None).when(k % 10 == 1, " nan").when(k % 10 == 2, "2.5").otherwise(F.concat(text(k % 4 + 1), F.when(k % 3 == 0, ".0").otherwise("")))
    catalog = orders.filter(k % 8 > 0).select("study_id", declared.alias("n_ctrl"), text(k % 3 + 1).alias("n_treat"))
    control = F.when(k % 7 == 0, None).when(k % 7 == 1, "-1").otherwise(text(k % 4 + 1 + F.when(k % 6 == 0, 1).otherwise(0)))
    treated = F.when(k % 11 == 0, None).when((k % 7 == 0) & (k % 2 == 0), None).otherwise(text(k % 3 + 1))
    direction = F.when(k % 5 == 0, "").when(k % 5 == 1, "control_minus_treatment").otherwise(" treatment_minus_control")
    facts = orders.filter(k % 3 > 0).select("study_id", control.alias("n_ctrl"), treated.alias("n_treat"), direction.alias("effect_direction"))
    return provenance.reconciled(catalog, facts)


@query("""with good as (select doc_id from "labels" group by 1 having min(quality) = 1)
select 1 as version, lang, count(*) as n_documents, count(l.doc_id) as n_labelled from documents d left join (select distinct doc_id from "labels") l using (doc_id) group by 2
union all select 2, lang, count(*), count(*) from documents join good using (doc_id) group by 2""")
def snapshot_versions(spark, sf):
    """Two tables published together twice: each version's documents are read with its own labels."""
    store = Snapshots(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    first = store.commit({"documents": docs, "labels": labels})
    good = store.read("labels", first).filter("quality = 1")
    second = store.commit({"documents": store.read("documents", first).join(good, "doc_id", "left_semi"), "labels": good}, base=first)
    found = []
    for version in (first, second):
        marked = store.read("labels", version).select("doc_id", F.lit(1).alias("there"))
        rows = store.read("documents", version).join(marked, "doc_id", "left")
        found.append(rows.groupBy("lang").agg(F.count("*").alias("n_documents"), F.count("there").alias("n_labelled")).withColumn("version", F.lit(version)))
    return found[0].unionByName(found[1]).select("version", "lang", "n_documents", "n_labelled")
