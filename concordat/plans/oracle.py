"""DuckDB SQL for the integration queries: named common table expressions, and one final SELECT for each query."""

from __future__ import annotations

from concordat.functions.special import isf_sql, log_factorials, log_sf_sql, round6_sql, t_quantile

N_UNITS = 25  # nations at most


def r6(x: str, digits: int = 6) -> str:
    return round6_sql(x, digits, "round_even")


def clip(x: str, low: str = "0.05") -> str:
    return f"least(greatest({x}, {low}), 1.0)"


def signed(x: str) -> str:
    return f"(case when {x} > 0 then 1 when {x} < 0 then -1 else 0 end)"


def concordance(z: str, up: str = "up", down: str = "down") -> str:
    return f"coalesce((case when {z} > 0 then {up} when {z} < 0 then {down} else 0 end) / nullif({up} + {down}, 0), 0)"


def geometric(weights: dict[str, float], prefix: str = "") -> str:
    total = sum(weights.values())
    return "100 * exp((" + " + ".join(f"{w}e0 * ln({clip(prefix + c, '1e-6')})" for c, w in weights.items()) + f") / {total}e0)"


MAIN = {"support_score": 0.30, "direction_score": 0.25, "evidence_score": 0.20, "rank_score_component": 0.15, "effect_score": 0.10}
PRIORITY = {"direction_score": 0.25, "evidence_score": 0.30, "rank_score_component": 0.30, "effect_score": 0.15}
BH = "least(1.0, min({p} * n_all / rn) over (order by rn desc rows between unbounded preceding and current row))"

CTES = {
    "bridge": """
  select 'P' || l_partkey as gene_symbol, 'N' || s_nationkey as source_unit_id, 'N' || s_nationkey || '_' || l_returnflag as study_id,
    case when abs((l_discount - 0.05e0) * 60) < 1e-9 then 0e0 else (l_discount - 0.05e0) * 60 end as lfc, p as pvalue,
    case when abs(l_tax) > 1e-9 then least(1e0, 2 * p) end as padj, (1 + s_nationkey % 4)::double as n_ctrl, (2 + s_nationkey % 3)::double as n_treat,
    (['author_deg_table', 'limma_full_table', 'derived_count_table', 'normalized_expression_matrix', 'other_table'])[n_regionkey + 1] as source_input_type,
    (['mean', 'early', 'late', 'peak', 'mean'])[n_regionkey + 1] as time_course_mode,
    case l_returnflag when 'A' then 'full_results' when 'N' then 'auto' else 'deg_only' end as table_scope,
    case l_returnflag when 'A' then '4h' when 'N' then '12h' else '24h' end as duration_h,
    case when l_returnflag not in ('A', 'N') then 30000e0 end as declared_universe,
    case l_returnflag when 'A' then 'edger' when 'N' then 'deseq2' else 'limma' end as pipeline, l_suppkey, l_orderkey, l_linenumber
  from (select *, case when abs(l_tax - 0.08e0) < 1e-9 then 1e0 else share * share * share end as p
    from (select *, ((l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber * 13) % 9973 + 1)::double / 9974e0 as share from lineitem) l)
  join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    "valid": "select * replace (greatest(least(pvalue, 1e0), 1e-300) as pvalue) from bridge where gene_symbol is not null and lfc is not null and pvalue is not null",
    "best": """
  select * exclude (k) from (select *, count(*) over (partition by study_id, gene_symbol) as n_source_rows,
    row_number() over (partition by study_id, gene_symbol order by pvalue, abs(lfc) desc, padj asc nulls last, lfc, l_suppkey, l_orderkey, l_linenumber) as k from valid) where k = 1""",
    "zed": f"select *, case when lfc <> 0 and pvalue < 1 then sign(lfc) * {isf_sql('q')} end as signed_z from (select *, greatest(pvalue, 1e-300) / 2 as q from best)",
    "scope": """
  select *, case assessment when 'declared' then declared when 'full_results_likely' then 'full_results' when 'deg_only_likely' then 'deg_only' else 'ambiguous' end as effective from (
    select *, case when declared <> 'auto' then 'declared' when n_values = 0 then 'auto_ambiguous'
      when n_rows >= 10000 and above >= 100 and most >= 0.5 or above >= greatest(100, floor(0.1 * n_rows)) and most >= 0.2 then 'full_results_likely'
      when below / n_values >= 0.98 and most <= 0.05 or n_rows < 5000 and below / n_values >= 0.95 and most <= 0.1 then 'deg_only_likely'
      else 'auto_ambiguous' end as assessment
    from (select study_id, any_value(table_scope) as declared, any_value(c) as value_column, count(*) as n_rows, count(v) as n_values,
        count(*) filter (v <= 0.05) as below, count(*) filter (v > 0.05) as above, max(v) as most, max(declared_universe) as declared_universe
      from (select *, case when c = 'padj' then padj else pvalue end as v from (
        select *, case when count(padj) over (partition by study_id) > 0 then 'padj' else 'pvalue' end as c from bridge)) group by 1))""",
    "harm": """
  select *, case when signed_z is not null then average / universe end as normalized_rank, universe as n_genes from (
    select z.* replace (effective as table_scope), assessment, value_column, n_rows as n_source_table_rows, below,
      rank() over (partition by z.study_id order by abs(signed_z) desc nulls last) + (count(*) over (partition by z.study_id, abs(signed_z)) - 1) / 2e0 as average,
      count(*) over (partition by z.study_id) as observed, greatest(coalesce(z.declared_universe, 0), count(*) over (partition by z.study_id)) as universe
    from zed z join scope s on z.study_id = s.study_id)""",
    "elig": """
  select * from (select *, least(case when n_ctrl + n_treat > 0 then sqrt(n_ctrl + n_treat) else 1 end, 4e0) as w,
      min(hours) over g as first_h, max(hours) over g as last_h, count(*) over g as n_mode,
      row_number() over (partition by gene_symbol, source_unit_id, mode order by abs(signed_z) desc, study_id, normalized_rank) as k_mode
    from (select *, case time_course_mode when 'peak' then 'peak_mean' else time_course_mode end as mode, try_cast(regexp_extract(duration_h, '([-+]?\\d*\\.?\\d+)', 1) as double) as hours from harm where signed_z is not null)
    window g as (partition by gene_symbol, source_unit_id, mode))
  where mode = 'mean' or mode = 'early' and hours = first_h or mode = 'late' and hours = last_h
    or mode = 'peak_mean' and k_mode <= case when n_mode <= 2 then n_mode else greatest(2, ceil(n_mode * 0.5)) end""",
    "units": """
  select * replace (case when abs(signed_z) < 1e-12 then 0 else signed_z end as signed_z, case when abs(lfc) < 1e-12 then 0 else lfc end as lfc) from (
  select gene_symbol, source_unit_id, min(study_id) as study_id, sum(w * signed_z) / sum(w) as signed_z, sum(w * lfc) / sum(w) as lfc,
    avg(normalized_rank) as normalized_rank, max(n_genes)::int as n_genes_in_study, avg(w) as weight, count(*)::int as n_contrast_rows, count(distinct study_id)::int as n_studies_in_source_unit
  from elig group by 1, 2)""",
    "sums": """
  select gene_symbol, count(*)::int as n_studies, sum(weight * signed_z) / sqrt(sum(weight * weight)) as z, sum(weight * signed_z) / sum(weight) as m, sum(weight * lfc) / sum(weight) as weighted_lfc,
    coalesce(sum(least(abs(signed_z), 8)) filter (signed_z > 0), 0) as up, coalesce(sum(least(abs(signed_z), 8)) filter (signed_z < 0), 0) as down,
    count(*) filter (signed_z > 0) as n_up, count(*) filter (signed_z < 0) as n_down,
    exp(avg(ln(least(greatest(normalized_rank, 2.2250738585072014e-308), 1)))) as rank_product
  from units group by 1 having count(*) >= 2""",
    "het": "select s.gene_symbol, sum(weight * (signed_z - m) * (signed_z - m)) as q from units u join sums s on u.gene_symbol = s.gene_symbol group by 1",
    "stouffer": f"""
  select s.*, q as heterogeneity_q, case when q > 0 then greatest(0, (q - (n_studies - 1)) / q) else 0 end as heterogeneity_i2, least(0e0, ln(2e0) + {log_sf_sql('a')}) as log_p, {concordance('z')} as sign_concordance
  from (select *, abs(z) as a from sums) s join het h on s.gene_symbol = h.gene_symbol""",
    "consensus": f"select *, exp(log_p) as p, {BH.format(p='exp(log_p)')} as padj from (select *, row_number() over (order by log_p, gene_symbol) as rn, count(*) over () as n_all from stouffer)",
    "labels": """
  select source_unit_id, string_agg(distinct source_input_type, ';' order by source_input_type) as source_input_type, string_agg(distinct table_scope, ';' order by table_scope) as table_scope, string_agg(distinct pipeline, ';' order by pipeline) as pipeline from elig group by 1""",
    "evid0": f"""
  select u.*, l.source_input_type, l.table_scope, l.pipeline, e.n_ctrl, e.n_treat, e.min_p, e.min_padj, e.studies, e.durations, {clip('tw * sw * rw')} as static_quality, case when lfc > 0 then 'up' when lfc < 0 then 'down' else 'flat' end as direction
  from units u join labels l on u.source_unit_id = l.source_unit_id
  join (select source_unit_id, list_min([case x when 'author_deg_table' then 1.0e0 when 'limma_full_table' then 0.9e0 when 'derived_count_table' then 0.85e0 when 'normalized_expression_matrix' then 0.35e0 else 0.7e0 end for x in string_split(source_input_type, ';')]) as tw,
      list_min([case x when 'full_results' then 1.0e0 when 'auto' then 0.9e0 when 'ambiguous' then 0.75e0 when 'deg_only' then 0.65e0 else 0.85e0 end for x in string_split(table_scope, ';')]) as sw from labels) q on u.source_unit_id = q.source_unit_id
  join (select gene_symbol, source_unit_id, min(n_ctrl) as n_ctrl, min(n_treat) as n_treat, min(pvalue) as min_p, min(padj) as min_padj, string_agg(distinct study_id, ';' order by study_id) as studies, string_agg(distinct duration_h, ';' order by duration_h) as durations,
      case when least(min(n_ctrl), min(n_treat)) >= 3 then 1e0 when least(min(n_ctrl), min(n_treat)) >= 2 then 0.85e0 when least(min(n_ctrl), min(n_treat)) >= 1 then 0.5e0 else 0.35e0 end as rw from elig group by 1, 2) e
    on u.gene_symbol = e.gene_symbol and u.source_unit_id = e.source_unit_id""",
    "pairs": f"""
  select source_a, source_b, count(*) as overlap, avg((sx * sy > 0)::int) as sign_agreement,
    case when count(*) >= 3 and count(distinct x) > 1 and count(distinct y) > 1 then corr(rx, ry) end as rho
  from (select *, rank() over (partition by source_a, source_b order by x) + (count(*) over (partition by source_a, source_b, x) - 1) / 2e0 as rx,
      rank() over (partition by source_a, source_b order by y) + (count(*) over (partition by source_a, source_b, y) - 1) / 2e0 as ry, sign(x) as sx, sign(y) as sy
    from (select a.source_unit_id as source_a, b.source_unit_id as source_b, {r6('a.lfc', 9)} as x, {r6('b.lfc', 9)} as y from evid0 a join evid0 b on a.gene_symbol = b.gene_symbol and a.source_unit_id < b.source_unit_id))
  group by 1, 2""",
    "diag": f"""
  select *, {clip('quality * coherence')} as recommended, {clip('(0.65e0 + trust * ' + clip('quality * coherence') + ') / (1 + trust)')} as reliability from (
    select *, case when odd then 0.5e0 else 1e0 end as coherence, greatest(1e0, least(6e0, ln(1e0 + n_genes) / 2) + least(3e0, comparisons)) as trust from (
      select *, comparisons >= 2 and quality < 0.6e0 and coalesce(median_rho < 0.05e0, false) as odd from (
        select e.source_unit_id, count(distinct gene_symbol)::int as n_genes, median(static_quality) as quality, max(source_input_type) as source_input_type,
          coalesce(any_value(c), 0)::int as comparisons, any_value(mr) as median_rho, any_value(lr) as least_rho, any_value(ms) as median_sign
        from evid0 e left join (select s, count(rho) as c, median(rho) as mr, min(rho) as lr, median(sign_agreement) as ms from (select source_a as s, * from pairs union all select source_b, * from pairs) group by 1) a on e.source_unit_id = a.s group by 1)))""",
    "evid": "select e.*, d.quality, d.reliability, d.odd from evid0 e join diag d on e.source_unit_id = d.source_unit_id",
    "totals": "select count(*) as u, sum(reliability) as rel from diag",
    "qual": f"""
  select *, {clip("ln(1 + wsum) / ln(1 + (select rel from totals))", '0')} as quality_support_score, {concordance('qz', 'qup', 'qdown')} as quality_direction_score,
    {clip('1 - exp(-abs(qz) / 8)', '0')} as quality_evidence_score, {clip('1 - qrank', '0')} as quality_rank_score_component, {clip('1 - exp(-abs(qlfc) / 2)', '0')} as quality_effect_score
  from (select gene_symbol, sum(e * signed_z) / sqrt(sum(e * e)) as qz, sum(e * lfc) / sum(e) as qlfc, exp(sum(e * ln(least(greatest(normalized_rank, 2.2250738585072014e-308), 1))) / sum(e)) as qrank, sum(greatest(reliability, 0.05)) as wsum,
      coalesce(sum(e * least(abs(signed_z), 8)) filter (signed_z > 0), 0) as qup, coalesce(sum(e * least(abs(signed_z), 8)) filter (signed_z < 0), 0) as qdown,
      coalesce(sum(greatest(reliability, 0.05)) filter (signed_z > 0), 0) as rup, coalesce(sum(greatest(reliability, 0.05)) filter (signed_z < 0), 0) as rdown
    from (select *, greatest(weight * reliability, 0.05) as e from evid) group by 1)""",
    "supp": "select gene_symbol, count(distinct source_unit_id)::int as n_source_units, string_agg(distinct source_unit_id, ';' order by source_unit_id) as source_units from evid group by 1",
    "parts": f"""
  select c.*, coalesce(n_source_units, 0) as n_source_units, source_units, {clip('ln(1e0 + coalesce(n_source_units, 0)) / (select case when u > 1 then ln(1e0 + u) else 1 end from totals)', '0')} as support_score,
    {clip('sign_concordance', '0')} as direction_score, {clip('1 - exp(-abs(z) / 8)', '0')} as evidence_score, {clip('1 - rank_product', '0')} as rank_score_component, {clip('1 - exp(-abs(coalesce(weighted_lfc, 0)) / 2)', '0')} as effect_score
  from consensus c left join supp s on c.gene_symbol = s.gene_symbol""",
    "confid": """
  select gene_symbol, (1e0 + case when z > 0 then n_up when z < 0 then n_down else 0.5e0 * (n_up + n_down) end) / (2e0 + n_up + n_down) as confidence from sums""",
    "main0": f"""
  select p.*, q.* exclude (gene_symbol), {r6(geometric(MAIN))} as composite_score, {r6(geometric(PRIORITY))} as priority_score, {r6(geometric(MAIN, 'quality_'))} as quality_score, {r6('confidence')} as direction_confidence_index, {r6('quality_direction_score')} as quality_sign_concordance,
    {r6('(1e0 + case when qz > 0 then rup when qz < 0 then rdown else 0.5e0 * (rup + rdown) end) / (2e0 + rup + rdown)')} as quality_confidence
  from parts p join qual q on p.gene_symbol = q.gene_symbol join confid c on p.gene_symbol = c.gene_symbol""",
    "ranked": """
  select *, row_number() over (order by composite_score desc, n_source_units desc, sign_concordance desc, gene_symbol) as composite_rank,
    row_number() over (order by quality_score desc, n_source_units desc, quality_sign_concordance desc, gene_symbol) as quality_rank,
    row_number() over (order by priority_score desc, n_source_units desc, direction_confidence_index desc, gene_symbol) as priority_rank, count(*) over () as n_scored from main0""",
    "re": f"""
  select *, least(1e0, 2 * exp({log_sf_sql('a')})) as re_p from (select *, abs(re_z) as a from (select gene_symbol, z / sqrt(1 + {clip('heterogeneity_i2', '0')} * greatest(n_source_units - 1, 0)) as re_z, sqrt(1 + {clip('heterogeneity_i2', '0')} * greatest(n_source_units - 1, 0)) as factor, n_source_units from parts))""",
    "ordered": "select gene_symbol, least(greatest(normalized_rank, 2.2250738585072014e-308), 1) as x, row_number() over (partition by gene_symbol order by normalized_rank) as k, count(*) over (partition by gene_symbol) as n_lists, (select u from totals) as u from evid",
    "rra": f"""
  select gene_symbol, min(lr) as log_rho from (
    select gene_symbol, k, case when x >= 1 then 0 else least(0, max(t) + ln(sum(exp(t - top)))) end as lr from (
      select *, max(t) over (partition by gene_symbol, k) as top from (
        select gene_symbol, x, k, j, f[u::int + 1] - f[j::int + 1] - f[(u - j)::int + 1] + j * ln(x) + case when j = u then 0 else (u - j) * ln(1 - case when x >= 1 then 0 else x end) end as t
        from (select *, {log_factorials(N_UNITS)} as f, unnest(range(k, u + 1)) as j from ordered where n_lists >= 2)))
    group by gene_symbol, k, x) group by 1""",
    "effects": """
  select *, case when c > 0 then greatest(0, (q - (k - 1)) / c) else 0 end as tau2, case when q > 0 then greatest(0, (q - (k - 1)) / q) else 0 end as i2 from (
    select gene_symbol, max(k) as k, sum((y - fixed) * (y - fixed) / v) as q, sum(1 / v) - sum(1 / (v * v)) / sum(1 / v) as c, list({'y': y, 'v': v}) as m from (
      select *, sum(y / v) over g / sum(1 / v) over g as fixed, count(*) over g as k from (select gene_symbol, lfc as y, (lfc / signed_z) * (lfc / signed_z) as v from evid where lfc <> 0 and signed_z <> 0) window g as (partition by gene_symbol))
    where k >= 2 group by 1)""",
    "pooled": f"""
  select gene_symbol, k, tau2, i2, pooled, greatest(sqrt(sum((y - pooled) * (y - pooled) / (v + tau2)) / ((k - 1) * sw)), sqrt(1 / sw)) as se, ({[0.0] + [t_quantile(d) for d in range(1, N_UNITS + 1)]})[k::int] as t
  from (select *, sum(y / (v + tau2)) over (partition by gene_symbol) / sum(1 / (v + tau2)) over (partition by gene_symbol) as pooled, sum(1 / (v + tau2)) over (partition by gene_symbol) as sw from (select * exclude (m), unnest(m).y as y, unnest(m).v as v from effects))
  group by gene_symbol, k, tau2, i2, pooled, sw""",
    "folds": "select distinct source_unit_id as fold from evid",
    "fold_sums": """
  select fold, gene_symbol, count(*)::int as n, sum(weight * signed_z) / sqrt(sum(weight * weight)) as z, sum(weight * lfc) / sum(weight) as lfc, exp(avg(ln(least(greatest(normalized_rank, 2.2250738585072014e-308), 1)))) as rp,
    coalesce(sum(least(abs(signed_z), 8)) filter (signed_z > 0), 0) as up, coalesce(sum(least(abs(signed_z), 8)) filter (signed_z < 0), 0) as down, count(*) filter (signed_z > 0) as n_up, count(*) filter (signed_z < 0) as n_down
  from evid join folds on source_unit_id <> fold group by 1, 2 having count(*) >= 2""",
    "fold_ranks": f"""
  select fold, gene_symbol, row_number() over (partition by fold order by {r6(geometric(PRIORITY))} desc, n desc, {r6('confidence')} desc, gene_symbol) as fold_rank from (
    select *, {clip(concordance('z'), '0')} as direction_score, {clip('1 - exp(-abs(z) / 8)', '0')} as evidence_score, {clip('1 - rp', '0')} as rank_score_component, {clip('1 - exp(-abs(coalesce(lfc, 0)) / 2)', '0')} as effect_score,
      (1e0 + case when z > 0 then n_up when z < 0 then n_down else 0.5e0 * (n_up + n_down) end) / (2e0 + n_up + n_down) as confidence from fold_sums)""",
    "loo": """
  select r.gene_symbol, u::int as total, coalesce(n, 0)::int as evaluable, med, iqr, top50, top100, case when n > 0 then greatest(0, 1 - least(1, abs(list_aggregate(list_resize(l, u, (n_scored + 1)::double), 'median') - priority_rank) / n_scored)) end as stability
  from (select gene_symbol, priority_rank, n_scored, (select u from totals) as u from ranked) r left join (
    select gene_symbol, count(*) as n, median(fold_rank) as med, quantile_cont(fold_rank, 0.75) - quantile_cont(fold_rank, 0.25) as iqr, avg((fold_rank <= 50)::int) as top50, avg((fold_rank <= 100)::int) as top100, list(fold_rank::double) as l from fold_ranks group by 1) f on r.gene_symbol = f.gene_symbol""",
    "reliable": f"""
  select r.gene_symbol, {r6("case when stability is not null then " + geometric({"support_score": .25, "quality_support_score": .25, "direction_confidence_index": .25, "stability": .25}) + " else " + geometric({"support_score": .25, "quality_support_score": .25, "direction_confidence_index": .25}) + " end")} as evidence_reliability_score from ranked r join loo l on r.gene_symbol = l.gene_symbol""",
}


def sql(final: str) -> str:
    """A query with those expressions that its final SELECT needs, directly or through others."""
    needed: list[str] = []

    def need(text: str) -> None:
        import re

        for name in CTES:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                need(CTES[name])
                if name not in needed:
                    needed.append(name)

    need(final)
    order = [c for c in CTES if c in needed]
    return "with " + ",\n".join(f"{c} as ({CTES[c]})" for c in order) + "\n" + final if order else final
