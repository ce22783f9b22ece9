"""DuckDB SQL of the matrix, classification and label-transfer queries and of the steps between larger operators."""

from __future__ import annotations

from protospan.plans.analytics import _CELL, _FILLED, _LX, _MARK, _PROF, _SCALED, _SIM, _SPEC, _TOP, _TYPES
from protospan.plans.relations import REP

W = f"with recursive {REP}, "


def _softmax(x: str, t: str) -> str:
    return f"exp(({x} - max({x}) over (partition by run)) / {t}) / sum(exp(({x} - mx_{x}) / {t})) over (partition by run)"


def _tail(universe: str, marked: str, drawn: str, hits: str) -> str:
    """Upper hypergeometric tail, 1 for degenerate cases."""
    c = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"
    terms = f"list_sum(list_transform(range(cast(greatest({hits}, {drawn} + {marked} - {universe}) as bigint), cast(least({marked}, {drawn}) + 1 as bigint)), lambda k: exp({c(marked, 'k')} + {c(f'({universe} - {marked})', f'({drawn} - k)')} - {c(universe, drawn)})))"
    return f"case when {marked} <= 0 or {drawn} <= 0 or {hits} <= 0 or {marked} > {universe} or {drawn} > {universe} then 1.0 else least(1.0, coalesce({terms}, 0.0)) end"


def _chi2(x: str, df: str) -> str:
    """Upper tail of chi-squared by the series of the lower one."""
    return f"case when {x} <= 0 or {df} <= 0 then 1.0 else greatest(0.0, 1 - list_sum(list_transform(range(0, 600), lambda n: exp(-{x} / 2.0 + ({df} / 2.0 + n) * ln({x} / 2.0) - lgamma({df} / 2.0 + n + 1))))) end"


def _adjusted(p: str, source: str, tie: str, keys: str = "") -> str:
    by = f"partition by {keys} " if keys else ""
    return f"select *, least(1.0, min({p} * n__ / r__) over ({by}order by r__ rows between current row and unbounded following)) q from (select *, row_number() over ({by}order by {p}, {tie}) r__, count(*) over ({by.strip()}) n__ from {source})"


_PAIRS = "pairs as (select run, cell_type from (select distinct run from cell), (select distinct cell_type from prof))"
_RHO = """rk as (select run, cell_type, rank() over (partition by run, cell_type order by "value") + (count(*) over (partition by run, cell_type, "value") - 1) / 2.0 a, rank() over (partition by run, cell_type order by median) + (count(*) over (partition by run, cell_type, median) - 1) / 2.0 b from cell join prof using (gene) where median > 0),
rh as (select run, cell_type, case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) else 0 end rho from rk group by 1, 2)"""
_ENRICH = f"""seen as (select * from cell where gene in (select gene from prof)), h as (select run, cell_type, count(*) hits from seen join mark using (gene) group by 1, 2), sz as (select cell_type, count(*) markers from mark group by 1), dr as (select run, count(distinct gene) drawn from seen group by 1),
en0 as (select p.run, p.cell_type, coalesce(markers, 0) markers, coalesce(drawn, 0) drawn, coalesce(hits, 0) hits, (select count(distinct gene) from prof) universe from pairs p left join sz using (cell_type) left join dr using (run) left join h on h.run = p.run and h.cell_type = p.cell_type),
en as (select run, cell_type, {_tail('universe', 'markers', 'drawn', 'hits')} p, case when markers > 0 then hits / markers else 0 end coverage from en0)"""
_STANDARD = f"""{_PROF}, {_SPEC}, {_MARK}, {_CELL}, {_PAIRS}, {_RHO}, {_ENRICH},
sp as (select run, cell_type, sum(spec * ln(median + 1) * ln("value" + 1)) / sqrt(count(*)) s from cell join prof using (gene) join spec using (gene) where median > 0 group by 1, 2),
ch as (select p.run, p.cell_type, coalesce(rho, 0) rho, coalesce(s, 0) spec, en.p, -log10(greatest(en.p, 1e-300)) logp, coverage from pairs p left join rh using (run, cell_type) left join sp using (run, cell_type) join en using (run, cell_type)),
md as (select run, list_sort(list(spec))[1 + cast(floor(count(*) / 2) as int)] m from ch group by 1),
mx as (select *, max(rho) over w mx_rho, max(spec) over w mx_spec, max(logp) over w mx_logp, max(coverage) over w mx_coverage, greatest(0.2 * m, 1.0) / 2 t from ch join md using (run) window w as (partition by run)),
std as (select run, cell_type, rho, spec, p, coverage, (exp((rho - mx_rho) / 0.1) / sum(exp((rho - mx_rho) / 0.1)) over w + exp((spec - mx_spec) / t) / sum(exp((spec - mx_spec) / t)) over w + exp((logp - mx_logp) / 2.0) / sum(exp((logp - mx_logp) / 2.0)) over w + exp((coverage - mx_coverage) / 0.15) / sum(exp((coverage - mx_coverage) / 0.15)) over w) / 4 score from mx window w as (partition by run))"""
_REWEIGHT = "select run, cell_type, round(score * exp(coalesce(adj, 0)) / sum(score * exp(coalesce(adj, 0))) over (partition by run), 6) as score from std left join adj using ({on})"
_SIGN = """sg0 as (select cell_type, gene, case when (select max(median) from prof) <= 40 then median else log2(median + 1) end x, coalesce(pct, 1.0) det from prof),
sg1 as (select *, max(x) over g top, coalesce(list_reverse_sort(list(x) over g)[2], 0.0) as "second", sum(x) over g total, (select count(distinct cell_type) from prof) n from sg0 window g as (partition by gene)),
sg2 as (select cell_type, gene, (x - case when x = top then "second" else top end) * det weight, case when top > 0 and n > 1 then (n - total / top) / (n - 1) else 0.0 end tau from sg1),
sig as (select cell_type, gene, weight, tau from (select *, row_number() over (partition by cell_type order by weight desc, gene) r from sg2 where weight > 0) where r <= 150)"""
_CHANNELS = f"""{_PROF}, {_CELL}, {_PAIRS}, {_RHO}, {_SIGN},
pl as (select run, gene, row_number() over (partition by run order by "value", gene) / count(*) over (partition by run) place, rank() over (partition by run order by "value") + (count(*) over (partition by run, "value") - 1) / 2.0 rank from cell),
s1 as (select run, cell_type, sum(weight * place) s, sum(rank) r, count(*) k from pl join sig using (gene) group by 1, 2), tw as (select cell_type, sum(weight) t from sig group by 1), rn as (select run, count(*) n from cell group by 1),
det as (select cell_type, gene, greatest(0.01, least(0.99, pct)) p from prof where gene in (select gene from prof where pct is not null group by 1 having max(pct) - min(pct) >= 0.3) and pct is not null),
bs as (select cell_type, sum(ln(1 - p)) b from det group by 1), gn as (select run, cell_type, sum(ln(p / (1 - p))) g from (select distinct run, gene from cell) join det using (gene) group by 1, 2),
chn as (select p.run, p.cell_type, coalesce(rho, 0) spearman, coalesce(s1.s / t, 0) signature, case when k > 0 and n - k > 0 then (r - k * (k + 1) / 2) / (k * (n - k)) else 0.5 end auroc, coalesce(b, 0) + coalesce(g, 0) likelihood
 from pairs p left join rh using (run, cell_type) left join s1 using (run, cell_type) left join tw using (cell_type) left join rn using (run) left join bs using (cell_type) left join gn using (run, cell_type))"""
_FUSED = "z as (select run, cell_type, " + ", ".join(f"case when stddev_samp({c}) over w >= 1e-12 then ({c} - avg({c}) over w) / stddev_samp({c}) over w end z{i}" for i, c in enumerate(("spearman", "signature", "auroc", "likelihood"))) + " from chn window w as (partition by run)), lp as (select run, cell_type, " + " + ".join(f"coalesce(z{i} - ln(sum(exp(z{i})) over w), 0)" for i in range(4)) + " lg from z window w as (partition by run)), fu as (select run, cell_type, exp(lg - max(lg) over (partition by run)) e from lp), fused as (select run, cell_type, e / sum(e) over (partition by run) score from fu)"
_XLAB = f"{_SCALED}, {_TOP}, xl as (select run, cell_type label, protein gene, x from sx join lab using (run) where protein in (select protein from top))"
_FOLD = "row_number() over (partition by {rep}label order by md5(run || '|' || {repeat} || '|42'), run) - 1"


def _centroid(train: str, test: str, keys: list[str], name: str) -> str:
    """Nearest centroid of rows (keys, run, label, gene, x) in ``test`` by those of ``train``."""
    k, on = "".join(f"{x}, " for x in keys), f"using ({', '.join(keys)})" if keys else "on true"
    return f"""{name}_c as (select {k}label, gene, avg(x) c from {train} group by {k}label, gene), {name}_g as (select {k}count(distinct gene) g from {train} {'group by ' + ', '.join(keys) if keys else ''}),
{name}_n as (select {k}run, truth from (select {k}run, label truth, count(distinct gene) n from {test} group by {k}run, label) join {name}_g {on} where n >= 0.2 * g),
{name}_s as (select {k}run, label, case when count(*) >= 3 and sum(x * x) > 0 and sum(c * c) > 0 then sum(x * c) / sqrt(sum(x * x) * sum(c * c)) else 0 end sim from (select {k}run, gene, x from {test}) join {name}_c using ({k}gene) group by {k}run, label),
{name}_r as (select *, row_number() over (partition by {k}run order by sim desc, label) r from {name}_s),
{name} as (select {k}run, truth, a.label predicted, a.sim similarity, a.sim - coalesce(b.sim, 0) confidence from (select * from {name}_r where r = 1) a left join (select {k}run, sim from {name}_r where r = 2) b using ({k}run) join {name}_n using ({k}run))"""


_CV = f"{_XLAB}, fo as (select run, rep, ({_FOLD.format(rep='rep, ', repeat='rep')}) % 5 own from (select distinct run, label from xl), (select unnest(range(0, {{repeats}})) rep)), tg as (select rep, fold, own, xl.* from xl join fo using (run), (select unnest(range(0, 5)) fold)), tr as (select * from tg where own <> fold), te as (select * from tg where own = fold), {_centroid('tr', 'te', ['rep', 'fold'], 'nc')}"
_FOLDS = f"fo as (select run, ({_FOLD.format(rep='', repeat='0')}) % 5 own from (select distinct run, label from xl))"
_LEFT_OUT = f"lt as (select r.run one, xl.* from xl, (select distinct run from xl) r where xl.run <> r.run), le as (select run one, xl.* from xl), {_centroid('lt', 'le', ['one'], 'lo')}"
_NATURAL = "array_to_string(list_transform(regexp_extract_all(lower({c}), '\\d+|\\D+'), lambda x: case when regexp_matches(x, '^\\d') then '0' || lpad(cast(length(ltrim(x, '0')) as varchar), 10, '0') || ltrim(x, '0') else x end), '')"
_FIRST = "(select {cols} from (select *, row_number() over (partition by {key} order by (loaded_at is null), loaded_at, {ties}) r from {t} where {key} is not null) where r = 1)"
_FILES = "files as (select plate_id, raw_file_id file_id, raw_file_name \"name\" from " + _FIRST.format(cols="*", key="raw_file_id", t="raw_files", ties="plate_id nulls first, raw_file_name nulls first") + " where plate_id is not null)"
_CELLS = "cells as (select cell_id, plate_id, drop_no, target_well from " + _FIRST.format(cols="*", key="cell_id", t="isolated_cells", ties="plate_id nulls first, drop_no nulls first, target_well nulls first") + ")"
_WINDOWED = f"files_n as (select plate_id, file_id, row_number() over (partition by plate_id order by {_NATURAL.format(c='name')} nulls first, file_id) place from files)"
_ROWS = "coalesce(" + ", ".join(f"try_strptime(t, '{f}')" for f in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %H:%M", "%I:%M %p - %m/%d/%Y", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%Y%m%d", "%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y")) + ")"
_BY_LABEL = "dl as (select run, case when tic >= (select median(tic) from scal) then 'deep' else 'shallow' end label from scal)"


def _marker_stats(labels: str) -> str:
    return f"""sg as (select protein, label, count(*) n, median(x) m, count(*) / any_value(c) det from lx join {labels} using (run) join (select label, count(*) c from {labels} group by 1) using (label) group by 1, 2),
so as (select *, row_number() over (partition by protein order by m desc, label) r from sg),
ms as (select a.protein, a.label best, b.label as "second", a.m - coalesce(b.m, 0) delta, (a.m - coalesce(b.m, 0)) * a.det + 0.5 * (a.det - coalesce(b.det, 0)) weighted, a.det detection, a.n >= 3 robust from so a left join so b on b.protein = a.protein and b.r = 2 where a.r = 1)"""


def _kruskal(labels: str) -> str:
    return f"""kr as (select protein, label, rank() over (partition by protein order by x) + (count(*) over (partition by protein, x) - 1) / 2.0 r from lx join {labels} using (run)), kg as (select protein, label, sum(r) s, count(*) n from kr group by 1, 2),
kh as (select protein, count(*) - 1 as df, case when count(*) > 1 then greatest(0, 12.0 / (sum(n) * (sum(n) + 1.0)) * sum(s * s / n) - 3 * (sum(n) + 1.0)) else 0 end h from kg group by 1), kp as (select *, {_chi2('h', 'df')} p from kh), kw as ({_adjusted('p', 'kp', 'protein')})"""


_OVERALL = "ov as (select protein, count(distinct run) / (select count(*) from scal) rate from lx group by 1)"
_MARKERS = f"{_LX}, {_BY_LABEL}, {_marker_stats('dl')}, {_kruskal('dl')}, {_OVERALL}, cand as (select ms.*, p, q, rate from ms join kw using (protein) join ov using (protein))"
_ROUNDED = 'protein, best, "second", round(delta, 6) as delta, round(weighted, 5) as weighted, round(detection, 6) as detection, robust, round(p, 6) as p, round(q, 6) as q, round(rate, 6) as rate'
_PASS = "q <= 0.05 and detection >= {det} and delta >= {delta} and robust and rate >= 0.3"
_ALL = _SIM.replace("select distinct raw_file_name run from raw_files where raw_file_id % 20 = 0", "select distinct run from lx")
_NEAR = f"{_ALL}, nr as (select *, count(*) over (partition by query) k from (select query, run, round(0.7 * cosine + 0.3 * jaccard, 9) similarity, row_number() over (partition by query order by round(0.7 * cosine + 0.3 * jaccard, 9) desc, run) r from sim where 0.7 * cosine + 0.3 * jaccard >= 0.1) where r <= 10), near as (select query, run, similarity from nr where k >= 3)"
_PRIOR = f"{_TYPES}, pk as (select label, row_number() over (order by count(*) desc, label) rank from typ group by 1), pr as (select label, rank, pow(0.6, rank - 1) / (select sum(pow(0.6, rank - 1)) from pk) prior from pk)"
_VOTES = f"""{_NEAR}, {_PRIOR}, vo as (select query, label, similarity from near join typ using (run)), pe as (select query, label, sum(similarity) actual from vo group by 1, 2), su as (select query, sum(similarity) total, 0.5 * (1 - avg(similarity)) eff from vo group by 1),
vt as (select su.query, pr.label, coalesce(actual, 0) * (1 - eff / 2) + eff * prior / (select max(prior) from pr) * total vote from su cross join pr left join pe on pe.query = su.query and pe.label = pr.label),
vr as (select *, row_number() over (partition by query order by round(vote, 9) desc, label) r from vt),
win as (select a.query, a.label winner, a.vote / (a.vote + coalesce(b.vote, 0)) confidence, coalesce(p.actual / su.total, 0) support from (select * from vr where r = 1) a left join (select * from vr where r = 2) b using (query) join su using (query) left join typ t on t.run = a.query left join pe p on p.query = a.query and p.label = t.label)"""
_TERMS = "tm as (select distinct protein term, trim(unnest(regexp_split_to_array(genes, '[;,]'))) gene from gmap), tk as (select term, gene from tm where gene <> ''), ts as (select term, count(*) marked from tk group by 1 having count(*) >= 2)"

SQL = {
    "j11_ordinal_pairs": f"with {_FILES}, {_CELLS}, {_WINDOWED}, cn as (select plate_id, cell_id, row_number() over (partition by plate_id order by drop_no nulls first, cell_id) place from cells) select plate_id, cast(place as int) as place, cell_id, file_id from cn full join files_n using (plate_id, place)",
    "w13_natural_order": f"with {_FILES}, {_WINDOWED} select file_id, plate_id, cast(place as int) as place from files_n",
    "j10_greedy_pairs": f"""with recursive {_FILES}, {_CELLS},
cand as (select cell_id, file_id, case when list_contains(regexp_split_to_array("name", '[^A-Za-z0-9]+'), cast(drop_no as varchar)) then 0.9 else 0.6 end score from cells join files using (plate_id)
 where list_contains(regexp_split_to_array("name", '[^A-Za-z0-9]+'), cast(drop_no as varchar)) or (regexp_replace(target_well, '[^A-Za-z0-9]', '', 'g') <> '' and contains(lower(regexp_replace("name", '[^A-Za-z0-9]', '', 'g')), lower(regexp_replace(target_well, '[^A-Za-z0-9]', '', 'g'))))),
o as materialized (select *, row_number() over (order by score desc, cell_id, file_id) i from cand),
g as (select 0::bigint i, []::bigint[] cs, []::bigint[] fs, null::bigint cell_id, null::bigint file_id, null::double score
 union all select o.i, case when ok then list_append(cs, o.cell_id) else cs end, case when ok then list_append(fs, o.file_id) else fs end, case when ok then o.cell_id end, case when ok then o.file_id end, case when ok then o.score end
 from (select o.*, g.cs, g.fs, not list_contains(g.cs, o.cell_id) and not list_contains(g.fs, o.file_id) ok from g join o on o.i = g.i + 1) o)
select cell_id, file_id, cast(score as double) as score from g where cell_id is not null""",
    "x6_dates": f"select cellenone_run_id, run_date, coalesce(strftime({_ROWS}, '%Y-%m-%dT%H:%M:%S'), run_date) as iso from (select *, regexp_replace(trim(run_date), '(:\\d\\d)\\.\\d+Z?$', '\\1') t from cellenone_runs)",
    "x12_tails": f"{W}{_LX}, {_TYPES}, {_kruskal('typ')} select protein, round(h, 6) as h, df, round(p, 6) as p, round(q, 6) as q from kw",
    "c5_enrichment": f"{W}{_PROF}, {_SPEC}, {_MARK}, {_CELL}, {_PAIRS}, {_ENRICH} select run, cell_type, round(p, 6) as p from en",
    "c7_standard": f"{W}{_STANDARD} select run, cell_type, round(rho, 5) as rho, round(spec, 5) as spec, round(p, 6) as p, round(coverage, 6) as coverage, round(score, 6) as score from std",
    "c8_key_markers": f"""{W}{_STANDARD}, key as (select cell_type, gene from (select *, row_number() over (partition by cell_type order by median desc, gene) r from mark join prof using (cell_type, gene)) where r <= 10), um as (select run, list_sort(list("value"))[1 + cast(floor(count(*) / 2) as int)] m from cell group by 1),
adj as (select um.run, cell_type, sum(case when c."value" is null then -0.1 when c."value" > m then 0.3 else 0.1 end) adj from um cross join key left join cell c on c.run = um.run and c.gene = key.gene group by 1, 2) {_REWEIGHT.format(on='run, cell_type')}""",
    "c9_priors": f"{W}{_STANDARD}, wt as (select cell_type, greatest(count(*), 0.01) w from lab group by 1), adj as (select cell_type, ln(w / (select sum(w) from wt) * (select count(*) from wt)) adj from wt) {_REWEIGHT.format(on='cell_type')}",
    "c10_signatures": f"{W}{_PROF}, {_SIGN} select cell_type, gene, round(weight, 6) as weight, round(tau, 6) as tau from sig",
    "c11_channels": f"{W}{_CHANNELS} select run, cell_type, round(spearman, 5) as spearman, round(signature, 5) as signature, round(auroc, 5) as auroc, round(likelihood, 4) as likelihood from chn",
    "c12_quantitative": f"""{W}{_CHANNELS}, {_FUSED}, fr as (select *, row_number() over (partition by run order by score desc, cell_type) r from fused) select a.run, a.cell_type, round(a.score, 5) as score, b.cell_type as "second", round(a.score - coalesce(b.score, 0), 5) as margin from (select * from fr where r = 1) a left join (select * from fr where r = 2) b using (run)""",
    "c13_channel_weights": f"{W}{_CHANNELS}, lo as (unpivot (select run, cell_type, spearman, signature, auroc, likelihood from chn) on spearman, signature, auroc, likelihood into name channel value s), be as (select channel, run, arg_min(cell_type, (-round(s, 9), cell_type)) p from lo group by 1, 2), ac as (select channel, avg(cast(p = cell_type as int)) accuracy, (select count(distinct cell_type) from prof) n from be join lab using (run) group by 1) select channel, round(accuracy, 6) as accuracy, round(greatest(0, (accuracy - 1 / n) / (1 - 1 / n)), 6) as weight from ac",
    "c18_otsu": """with v as (select intensity x from isolated_cells where intensity > 0 and intensity <= 255), e as (select min(x) lo, (max(x) - min(x)) / 100 width from v), b as (select least(cast(floor((x - lo) / width) as int), 99) bin, count(*) n from v, e group by 1),
m as (select bin, n, lo + bin * width + width / 2 mid from b, e), s as (select *, sum(n) over w w0, sum(n * mid) over w s0, sum(n) over () wa, sum(n * mid) over () sa from m window w as (order by bin))
select round(arg_min(mid, (-round(case when wa > w0 then w0 * (wa - w0) * pow(s0 / w0 - (sa - s0) / (wa - w0), 2) else 0 end, 6), bin)), 6) as threshold from s""",
    "c19_nearest_centroid": f"{W}{_XLAB}, {_centroid('xl', 'xl', [], 'nc')} select run, truth, predicted, round(similarity, 6) as similarity, round(confidence, 6) as confidence from nc",
    "c20_cross_validation": f"{W}{_CV.format(repeats=1)} select cast(rep as int) as repeat, cast(fold as int) as fold, count(*) as n, round(avg(cast(truth = predicted as int)), 6) as accuracy from nc group by 1, 2",
    "c21_repeated_validation": f"""{W}{_CV.format(repeats=10)}, a as (select rep, count(*) n, avg(cast(truth = predicted as int)) p, 1.96 z from nc group by 1)
select cast(rep as int) as repeat, n, round(p, 6) as accuracy, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 5) as low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 5) as high from a""",
    "c21_leave_one_out": f"{W}{_XLAB}, {_LEFT_OUT} select run, truth, predicted, round(similarity, 6) as similarity, round(confidence, 6) as confidence from lo",
    "c21_learning_curve": f"{W}{_XLAB}, {_FOLDS}, lv as (select level, own, xl.* from xl join fo using (run), (select unnest(range(1, 5)) level)), lt as (select * from lv where own > 0 and own <= level), le as (select * from lv where own = 0), {_centroid('lt', 'le', ['level'], 'nc')} select cast(level as int) as level, count(*) as n, round(avg(cast(truth = predicted as int)), 6) as accuracy from nc group by 1",
    "c23_confidence_map": f"{W}{_XLAB}, {_centroid('xl', 'xl', [], 'nc')}, sz150 as (select count(distinct run) <= 150 small from xl), lt as (select r.run one, xl.* from xl, sz150, (select distinct run from xl) r where xl.run <> r.run and small), le as (select run one, xl.* from xl), {_centroid('lt', 'le', ['one'], 'lo')}, {_FOLDS}, tg as (select fold, own, xl.* from xl join fo using (run), (select unnest(range(0, 5)) fold)), tr as (select * from tg where own <> fold), te as (select * from tg where own = fold), {_centroid('tr', 'te', ['fold'], 'cv')} select nc.run, nc.truth as label, nc.predicted as on_reference, round(nc.confidence, 6) as confidence, case when (select small from sz150) then lo.predicted else cv.predicted end as held_out from nc left join lo using (run) left join cv using (run)",
    "c22_channel_sweep": f"""{W}{_STANDARD}, zs as (select run, cell_type, """ + ", ".join(f"case when stddev_samp({x}) over w > 1e-12 then ({x} - avg({x}) over w) / stddev_samp({x}) over w else 0 end {y}" for x, y in (("rho", "k0"), ("spec", "k1"), ("-log10(greatest(p, 1e-300))", "k2"), ("coverage", "k3"))) + """ from std window w as (partition by run)),
ma as (select run, cell_type, mask, (mask & 1) * k0 + ((mask >> 1) & 1) * k1 + ((mask >> 2) & 1) * k2 + ((mask >> 3) & 1) * k3 s from zs, (select unnest(range(1, 16)) mask)), bm as (select mask, run, arg_min(cell_type, (-round(s, 9), cell_type)) p from ma group by 1, 2)
select cast(mask as int) as mask, round(avg(cast(p = cell_type as int)), 6) as accuracy, cast(bit_count(mask) as int) as channels from bm join lab using (run) group by mask""",
    "t5_interaction_boost": f"""{W}{_SIM}, ga as (select distinct protein, trim(unnest(regexp_split_to_array(genes, '[;,]'))) g from gmap), ed as (select distinct a.g src, b.g dst from ga a join ga b using (protein) where a.g <> b.g and a.g <> '' and b.g <> ''), gr as (select run, count(*) n from gval group by 1),
hi as (select a.run query, b.run, count(*) pairs from gval a join ed on ed.src = a.gene join gval b on b.gene = ed.dst where a.run in (select query from sim) group by 1, 2)
select s.query, s.run, round(least(1, (0.7 * cosine + 0.3 * jaccard) * (1 + 0.2 * least(1, coalesce(pairs, 0) / sqrt(na.n * nb.n)))), 6) as similarity from sim s left join hi on hi.query = s.query and hi.run = s.run join gr na on na.run = s.query join gr nb on nb.run = s.run""",
    "t7_votes": f"{W}{_VOTES} select query, winner, round(confidence, 6) as confidence, round(support, 6) as support from win",
    "t8_relabel": f"""{W}{_VOTES}, de as (select query, t.label as "before", winner, confidence, case when winner = t.label then 'same' when rank <= 2 then 'protected' when confidence < 0.6 and support < 0.2 then 'unassigned' when confidence < 0.6 then 'kept' else 'relabelled' end as action from win join typ t on t.run = query left join pr on pr.label = t.label)
select query, "before", case action when 'relabelled' then winner when 'unassigned' then 'Unassigned' else "before" end as "after", action, round(confidence, 6) as confidence from de""",
    "t10_informative": f"""{W}{_LX}, st as (select protein, count(*) n, coalesce(var_samp(x), 0) v, count(*) / (select count(*) from scal) rate from lx group by 1 having count(*) >= 3), fl as (select case when count(*) filter (rate >= 0.3) >= 100 then 0.3 when count(*) filter (rate >= 0.2) >= 100 then 0.2 when count(*) filter (rate >= 0.1) >= 100 then 0.1 else 0.05 end f from st),
kp as (select *, row_number() over (order by round(v * rate, 9) desc, protein) r, count(*) over () k from st, fl where rate >= f) select protein from kp where r <= greatest(50, cast(floor(k * 0.5) as int))""",
    "t14_markers": f"""{W}{_MARKERS} select {_ROUNDED} from cand where {_PASS.format(det=0.3, delta=0.5)}""",
    "t17_relaxed": f"{W}{_MARKERS}, sp as (select cand.*, i, count(*) over (partition by i) k from cand, (select unnest(range(0, 6)) i) where {_PASS.format(det='0.3 - 0.15 * i / 5', delta='0.5 - 0.25 * i / 5')}), ch as (select coalesce(min(i) filter (k >= 20), 5) i from sp) select {_ROUNDED} from sp join ch using (i)",
    "m1_prepared": f"""{W}{_SCALED}, {_TOP}, md as (select run, median(x) m from sx where protein in (select protein from top) group by 1), c as (select protein, run, x - m x from sx join md using (run) where protein in (select protein from top)),
fi as (select p.protein, r.run, coalesce(c.x, p.m) x from (select protein, avg(x) m from c group by 1) p cross join (select run from scal) r left join c on c.protein = p.protein and c.run = r.run), dd as (select run, protein_count - (select avg(protein_count) from scal) dep from scal),
b as (select protein, case when var_pop(dep) > 0 then covar_pop(x, dep) / var_pop(dep) else 0 end b from fi join dd using (run) group by 1), rg as (select protein, run, x - b * dep x from fi join dd using (run) join b using (protein)), s as (select protein, avg(x) m, stddev_pop(x) s from rg group by 1)
select protein, run, round(case when s > 1e-9 then greatest(-10, least(10, (x - m) / s)) else 0 end, 4) as z from rg join s using (protein)""",
    "m14_purity": """with e as (select vec_id, label, cast(embedding as double[]) v from embeddings where embedding is not null), n as (select a.vec_id q, b.vec_id r, a.label la, b.label lb, row_number() over (partition by a.vec_id order by round(list_distance(a.v, b.v), 9), b.vec_id) k from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
p as (select q, avg(cast(la = lb as int)) p from n where k <= 10 and la is not null and lb is not null group by 1) select count(*) as queries, round(avg(p), 6) as purity from p""",
    "m7_smooth": """with e as (select vec_id, cast(embedding as double[]) v from embeddings where embedding is not null), n as (select a.vec_id run, b.vec_id nb, round(list_distance(a.v, b.v), 9) d, row_number() over (partition by a.vec_id order by round(list_distance(a.v, b.v), 9), b.vec_id) k from e a join e b on a.vec_id <> b.vec_id),
s as (select run, greatest(max(d), 1e-9) s from n where k <= 5 group by 1), w as (select run, nb, exp(-pow(d / s, 2)) w from n join s using (run) where k <= 5 union all select run, run, 1.0 from s), t as (select run, nb, w / sum(w) over (partition by run) w from w),
x as (select vec_id, unnest(v) x, generate_subscripts(v, 1) - 1 i from e) select cast(i as int) as protein, t.run, round(sum(w * x), 5) as x from t join x on x.vec_id = t.nb group by 1, 2""",
    "x16_term_enrichment": f"""{W}{_TERMS}, dn as (select run, count(*) drawn from gval where gene in (select gene from tk) group by 1), hs as (select run, term, marked, count(*) hits from gval join tk using (gene) join ts using (term) group by 1, 2, 3 having count(*) >= 2), uv as (select count(distinct gene) u from tk),
pv as (select run, term, hits, {_tail('u', 'marked', 'drawn', 'hits')} p from hs join dn using (run), uv), aj as ({_adjusted('p', 'pv', 'term', 'run')}) select run, term, hits, round(p, 6) as p, round(q, 6) as q from aj where round(q, 9) <= 0.05""",
    "sk8_presence": f"{W}{_PROF} select * from (pivot (select gene, cell_type, round(pct, 6) pct from prof) on cell_type using first(pct) group by gene)",
    "sk11_sparse_lines": f"""{W}nm as (select protein, row_number() over (order by lower(protein), protein) dim from (select distinct protein from quant where intensity > 0)), cl as (select cell_type, row_number() over (order by cell_type) cls from (select distinct cell_type from lab))
select run, cls || ' ' || string_agg(dim || ':' || cast(cast(round(intensity, 2) as decimal(24, 2)) as varchar), ' ' order by dim) as line from quant join nm using (protein) join lab using (run) join cl using (cell_type) where intensity > 0 group by run, cls""",
}
