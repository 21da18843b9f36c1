"""Queries over matrices, serving tables, linkage and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import text as tx
from concordat.functions.special import rounded
from concordat.operators import classify, linkage, matrix, serve
from concordat.operators.ranking import bh_adjust
from concordat.plans.bridge import table
from concordat.plans.oracle import r6
from concordat.plans.queries import harmonized, query, scored

CONTROL, TREATMENT = ("0", "1", "2"), ("3", "4", "5")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    """Part by supplier nation: summed quantities, in long form."""
    line, suppliers = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    each = line.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return matrix.summed(each.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene_symbol"), F.col("s_nationkey").cast("string").alias("sample"), F.col("l_quantity").alias("value")))


_COUNTS = "select 'P' || l_partkey as gene_symbol, s_nationkey::varchar as sample, sum(l_quantity) as value from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2"
_PASS = f"select gene_symbol from ({_COUNTS}) group by 1 having count(*) filter (value >= 10) >= 2"
_CPM = f"select gene_symbol, sample, log2(value / sum(value) over (partition by sample) * 1e6 + 1) as value from ({_COUNTS}) where gene_symbol in ({_PASS})"


@query(f"select gene_symbol, count(*) filter (value >= 10) >= 2 as passes from ({_COUNTS}) group by 1")
def low_count_filter(spark, sf):
    return matrix.low_counts(_counts(spark, sf))


def _cpm(spark, sf):
    counts = _counts(spark, sf)
    return matrix.log_cpm(counts.join(matrix.low_counts(counts).filter("passes"), "gene_symbol", "left_semi"))


@query(f"select gene_symbol, sample, {r6('value')} as value from ({_CPM})")
def count_matrix_logcpm(spark, sf):
    return _cpm(spark, sf).withColumn("value", rounded(F.col("value")))


@query(f"select gene_symbol, sample, {r6('median(v)')} as value from (select 'P' || l_partkey as gene_symbol, l_returnflag as sample, l_quantity as v from lineitem) group by 1, 2")
def matrix_median(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene_symbol"), F.col("l_returnflag").alias("sample"), F.col("l_quantity").alias("value"))
    return matrix.median(rows).withColumn("value", rounded(F.col("value")))


_GROUPS = f"select gene_symbol, avg(value) filter (sample in {CONTROL}) as mc, avg(value) filter (sample in {TREATMENT}) as mt, var_samp(value) filter (sample in {CONTROL}) as vc, var_samp(value) filter (sample in {TREATMENT}) as vt, count(*) filter (sample in {CONTROL}) as nc, count(*) filter (sample in {TREATMENT}) as nt from ({_CPM}) where sample in {CONTROL + TREATMENT} group by 1"


@query(f"select gene_symbol, {r6('mt - mc')} as lfc, {r6('(mt - mc) / nullif(sqrt(vc / nc + vt / nt), 0)', 5)} as t from ({_GROUPS})")
def welch_stats(spark, sf):
    got = matrix.welch(_cpm(spark, sf), CONTROL, TREATMENT)
    return got.select("gene_symbol", rounded(F.col("lfc")).alias("lfc"), rounded(F.col("t"), 5).alias("t"))


@query()
def welch_test(spark, sf):
    """The whole lane with p-values, which SQL can't express."""
    return matrix.welch(_cpm(spark, sf), CONTROL, TREATMENT)


_GENES = "select gene_symbol, n_source_units, quality_score, composite_score, quality_rank::int as quality_rank, case when qz > 0 then 'up' when qz < 0 then 'down' else 'flat' end as quality_direction from ranked"


@query(f"select gene_symbol, quality_rank, quality_score from ({_GENES}) where contains(gene_symbol, '1') and quality_direction = 'up' and n_source_units >= 3 and quality_score >= 10 order by quality_score desc, quality_rank, gene_symbol limit 50 offset 10")
def gene_page(spark, sf):
    return serve.entity_page(scored(spark, sf, "quality_rank", "quality_score", "quality_direction", "n_source_units").scores, sort="quality_score", descending=True, limit=50, offset=10, q="1", direction="up", min_units=3, min_score=10).select("gene_symbol", "quality_rank", "quality_score")


@query(f"select e.gene_symbol, e.source_unit_id, {r6('e.signed_z')} as signed_z, r.quality_rank::int as quality_rank from evid e left join ranked r on e.gene_symbol = r.gene_symbol where e.gene_symbol = 'P7'")
def gene_detail(spark, sf):
    done = scored(spark, sf, "quality_rank", "quality_score")
    return serve.entity_detail(done.scores, done.evidence, "p7").select("gene_symbol", "source_unit_id", rounded(F.col("signed_z")).alias("signed_z"), "quality_rank")


def _panel(spark, sf):
    return table(spark, sf, "part").filter("p_size <= 5").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene_symbol"))


_PANEL = "(select 'P' || p_partkey as gene_symbol from part where p_size <= 5)"


@query(f"select p.gene_symbol, r.quality_rank::int as quality_rank, coalesce(r.quality_rank <= 10, false) as in_top_10, coalesce(r.quality_rank <= 20, false) as in_top_20, coalesce(r.quality_rank <= 50, false) as in_top_50, coalesce(r.quality_rank <= 100, false) as in_top_100 from {_PANEL} p left join ranked r on p.gene_symbol = r.gene_symbol")
def gold_lookup(spark, sf):
    return serve.panel_lookup(_panel(spark, sf), scored(spark, sf, "quality_rank", "quality_score", "quality_direction").scores).drop("quality_score", "quality_direction")


@query(f"select k, count(*) as n_positives, count(*) filter (quality_rank <= k) as n_recovered, count(*) filter (quality_rank <= k) / count(*) as recall from {_PANEL} p left join ranked r on p.gene_symbol = r.gene_symbol, (values (10), (20), (50), (100)) t(k) group by 1")
def recall_at_k(spark, sf):
    return serve.recall_at(scored(spark, sf, "quality_rank").scores, _panel(spark, sf))


@query("select count(*) as n_entities, arg_min(gene_symbol, quality_rank) as top_entity, (select count(distinct source_unit_id) from evid) as n_source_units, (select count(*) from evid) as n_evidence_rows from ranked")
def health_counts(spark, sf):
    done = scored(spark, sf, "quality_rank")
    return serve.health(done.scores, done.evidence)


@query("select study_id, min(source_unit_id) as source_unit_id, min(table_scope) as table_scope, min(pipeline) as pipeline, min(source_input_type) as source_input_type, count(*) as n_rows from harm group by 1")
def studies(spark, sf):
    return serve.study_table(harmonized(spark, sf))


@query("select case when trim(o_orderpriority) = '' then 'unknown' else trim(o_orderpriority) end as label, count(*) as n from orders group by 1")
def label_counts(spark, sf):
    return serve.label_counts(table(spark, sf, "orders"), "o_orderpriority")


_EACH = "(select distinct gene_symbol, source_unit_id from bridge)"


@query(f"select s.source_unit_id, s.n as n_entities, coalesce(b.n, 0) as best_overlap, coalesce(b.n, 0) < 0.01 * s.n as suspicious from (select source_unit_id, count(*) as n from {_EACH} group by 1) s left join (select u, max(n) as n from (select a.source_unit_id as u, b.source_unit_id as o, count(*) as n from {_EACH} a join {_EACH} b on a.gene_symbol = b.gene_symbol and a.source_unit_id <> b.source_unit_id group by 1, 2) group by 1) b on s.source_unit_id = b.u")
def identifier_overlap(spark, sf):
    return serve.identifier_overlap(harmonized(spark, sf))


@query("select gene_symbol, count(distinct source_input_type) as units from bridge group by 1 having count(distinct source_input_type) = (select count(distinct source_input_type) from bridge)")
def in_all_units(spark, sf):
    """Nation by nation no entity is everywhere in these tables, so the units are kinds of sources, one to a region."""
    return serve.in_all_units(harmonized(spark, sf), "source_input_type")


@query("""with recursive ids as (select doc_id, unnest(['t' || md5(text), 'n' || source || '|' || n_chars]) as v from documents where text is not null and source is not null and n_chars is not null),
edges as (select distinct a.doc_id as a, b.doc_id as b from ids a join ids b on a.v = b.v),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edges e on r.b = e.a)
select a as doc_id, min(b) as component from reach group by 1""")
def link_components(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("same_text"), F.concat_ws("|", "source", F.col("n_chars").cast("string")).alias("same_size"))
    return linkage.link(docs, "doc_id", ["same_text", "same_size"]).select("doc_id", "component")


@query("select o_orderkey, length(t) >= 24 and o_custkey % 7 = 0 and count(distinct o_orderpriority) filter (o_custkey % 7 = 0) over (partition by t) >= 2 as shared_submission from (select *, regexp_replace(lower('a title of customer number ' || o_custkey), '[^a-z0-9]+', '', 'g') as t from orders)")
def shared_title_flag(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("A title of customer number "), F.col("o_custkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("source_unit_id"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("pmid"))
    return linkage.shared_submissions(rows).select("o_orderkey", "shared_submission")


@query("select p_partkey, case p_partkey % 6 when 0 then 'MARCHF' || (p_partkey % 11 + 1) when 1 then 'SEPTIN' || (p_partkey % 9 + 1) when 2 then 'BHLHE40' when 3 then 'SEPTIN7' when 4 then 'GENE' || p_partkey else null end as symbol from part")
def gene_clean(spark, sf):
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, F.concat((k % 11 + 1).cast("string"), F.lit("-Mar"))).when(k % 6 == 1, F.concat(F.lit(" Sep-"), (k % 9 + 1).cast("string"), F.lit(" "))).when(k % 6 == 2, "dec1").when(k % 6 == 3, "2007-09-01 00:00:00").when(k % 6 == 4, F.concat(F.lit("gene"), k.cast("string"), F.lit(".12"))).otherwise("nan")
    return part.select("p_partkey", tx.clean_gene(raw).alias("symbol"))


@query("select distinct o_custkey as k, t as type, i as identifier from (select o_custkey, 'o_orderpriority' as t, o_orderpriority as i from orders union all select o_custkey, 'o_orderstatus', o_orderstatus from orders) where i <> ''")
def identifier_unpivot(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority", "o_orderstatus")
    return classify.identifiers(rows, "k", ("o_orderpriority", "o_orderstatus"))


@query("select p_partkey as record_id, row_number() over (order by p_size % 5, p_size, year desc nulls last, p_partkey)::int as rank from (select *, case when p_size % 3 > 0 then 2000 + p_size end as year from part)")
def publication_rank(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), (F.col("p_size") % 5).alias("priority"), F.col("p_size").alias("relevance_rank"), F.when(F.col("p_size") % 3 > 0, 2000 + F.col("p_size")).alias("year"), F.col("p_name").alias("title"))
    return classify.publication_rank(rows).select("record_id", "rank")


@query("select event_id, round_even(adj * 1e9, 0) / 1e9 as adjusted from (select event_id, least(1.0, min(p * n_all / rn) over (order by rn desc rows between unbounded preceding and current row)) as adj from (select *, row_number() over (order by p, event_id) as rn, count(*) over () as n_all from (select event_id, coalesce(case when event_id % 10 > 0 then (event_id % 997) / 997.0e0 end, 1.0e0) as p from events)))")
def bh_missing_as_one(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 > 0, (F.col("event_id") % 997) / F.lit(997.0)).alias("p"))
    return bh_adjust(rows, "p", "adjusted", missing_as_one=True).select("event_id", rounded(F.col("adjusted"), 9).alias("adjusted"))
