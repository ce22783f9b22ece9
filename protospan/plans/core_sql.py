"""DuckDB SQL that states the general problems' results on the same tables."""

from __future__ import annotations

from protospan.functions.missing import NO_VALUE
from protospan.plans.core_problems import FEATURES, WHOLE

_WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in NO_VALUE)


def _none(c: str) -> str:
    return f"({c} is null or lower(trim({c}, ' \t\r\n')) in ({_WORDS}))"


def _measured(c: str) -> str:
    return f"({c} is not null and not isnan({c}) and not isinf({c}) and {c} > 0)"


_NAMES = ", ".join(f"('{f}', '{f.lower().replace('_', '')}')" for f in FEATURES)

_FEATURE_CELLS = f"""
names(name, full_name) as (values {_NAMES}),
spelled as (
  select feature, case when strlen(k) > 5 and starts_with(k, 'cells') then substr(k, 6) else k end k
  from (select distinct feature, regexp_replace(lower(feature), '[^a-z0-9]', '', 'g') k from cell_features where feature is not null)),
hits as (
  select s.feature, n.name, case when n.full_name = s.k then 1 when suffix(n.full_name, s.k) then 2 else 3 end how
  from spelled s join names n on n.full_name = s.k or (suffix(n.full_name, s.k) and strlen(s.k) >= 4) or (starts_with(n.full_name, s.k) and strlen(s.k) >= 8)),
named as (select feature, min(name) name from hits h where how = (select min(how) from hits g where g.feature = h.feature) group by feature having count(*) = 1),
cells as (
  select c.cell_id, coalesce(n.name, trim(c.feature)) attribute, max(c.value) value
  from cell_features c left join named n using (feature)
  where c.feature is not null and c.value is not null and not isnan(c.value) and not isinf(c.value) group by 1, 2)"""

_PIVOT = ", ".join((f"cast(round(max(value) filter (attribute = '{f}')) as bigint)" if f in WHOLE else f"max(value) filter (attribute = '{f}')") + f' as "{f}"' for f in FEATURES)

_REFS = [("isolated_cells", "cell_id", "raw_file_id", "raw_files", "raw_file_id"), ("cell_images", "image_id", "cell_id", "isolated_cells", "cell_id"), ("cellenone_runs", "cellenone_run_id", "plate_id", "plates", "plate_id"), ("cell_detections", "detection_id", "cellenone_run_id", "cellenone_runs", "cellenone_run_id")]


def _orphans(t: str, record: str, column: str, parent: str, key: str) -> str:
    return f"""
select '{t}' as table_name, c.id as record_id, c.seen, case when p.k is null then 'missing' when p.gone then 'deleted' else 'late' end as reason
from (select distinct r.{record} id, r.{column} ref, f.seen from {t} r join (select {record} id, min(loaded_at) seen from {t} group by 1) f on f.id = r.{record} where r.{column} is not null) c
left join (select {key} k, min(loaded_at) since, bool_or(deleted_at is not null) gone from {parent} group by 1) p on p.k = c.ref
where p.k is null or p.gone or p.since > c.seen"""


_ALL_ORPHANS = " union all ".join(_orphans(*r) for r in _REFS)

_KEY = """regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}-]+', ';', 'g'), '^;+|;+$', '', 'g')"""

_FILL = f"""
with t as (
  select report_row, "Run.Index" ri, "Precursor.Id" pre,
    case when not {_none('"Run"')} then "Run" end run, case when not {_none('"Protein.Group"')} then "Protein.Group" end pg,
    case when {_measured('"PG.MaxLFQ"')} then "PG.MaxLFQ" end q
  from diann_report),
k as (select *, {_KEY.format(c="pg")} pk from t),
g as (select pre, arg_min(pk, (-n, pg)) pk from (select pre, pg, min(pk) pk, count(*) n from k where pg is not null and pre is not null group by 1, 2) group by 1),
w as (select k.*, coalesce(k.pk, g.pk) fk, g.pk gk from k left join g using (pre))
select report_row, 'Run' as field_name from w where run is null and ri in (select ri from t where run is not null)
union all select report_row, 'Protein.Group' from w where pg is null and gk is not null
union all select report_row, 'PG.MaxLFQ' from w where q is null and fk in (select pk from k where q is not null and pk is not null)"""

_WHOLE = [c for c in ("report_row", "Run.Index", "Precursor.Id", "Stripped.Sequence", "Precursor.Charge", "Protein.Ids", "Genes", "RT", "Precursor.Quantity", "Q.Value", "PG.Q.Value")]


def _filled(support: int) -> str:
    """Values filled by groups of at least ``support`` values, with flags and levels."""
    passed = ", ".join(f'd."{c}"' for c in _WHOLE)
    return f"""
with d as (select * from diann_report),
t as (select report_row, "Run.Index" ri, "Precursor.Id" pre, case when not {_none('"Run"')} then "Run" end run, case when not {_none('"Protein.Group"')} then "Protein.Group" end pg, case when {_measured('"PG.MaxLFQ"')} then "PG.MaxLFQ" end q from d),
k as (select *, {_KEY.format(c="pg")} pk from t),
rs as (select ri, arg_min(run, (-n, run)) s from (select ri, run, count(*) n from t where run is not null and ri is not null group by 1, 2) group by 1 having sum(n) >= {support}),
gs as (select pre, arg_min(pg, (-n, pg)) s from (select pre, pg, count(*) n from t where pg is not null and pre is not null group by 1, 2) group by 1 having sum(n) >= {support}),
w as (select k.*, rs.s frun, gs.s fpg, coalesce(k.pk, {_KEY.format(c="gs.s")}) wk from k left join rs using (ri) left join gs using (pre)),
q1 as (select ri, pk, quantile_disc(q, 0.5) s from k where q is not null and pk is not null and ri is not null group by 1, 2 having count(*) >= {support}),
q2 as (select pk, quantile_disc(q, 0.5) s from k where q is not null and pk is not null group by 1 having count(*) >= {support}),
f as (select w.*, q1.s s1, q2.s s2 from w left join q1 on q1.ri = w.ri and q1.pk = w.wk left join q2 on q2.pk = w.wk)
select {passed}, case when f.run is null then f.frun else d."Run" end as "Run", case when f.pg is null then f.fpg else d."Protein.Group" end as "Protein.Group", case when f.q is null then coalesce(f.s1, f.s2) else d."PG.MaxLFQ" end as "PG.MaxLFQ",
 f.run is null and f.frun is not null as "Run__filled", case when f.run is null and f.frun is not null then 1 end as "Run__level", f.pg is null and f.fpg is not null as "Protein.Group__filled", case when f.pg is null and f.fpg is not null then 1 end as "Protein.Group__level",
 f.q is null and coalesce(f.s1, f.s2) is not null as "PG.MaxLFQ__filled", case when f.q is null then case when f.s1 is not null then 1 when f.s2 is not null then 2 end end as "PG.MaxLFQ__level"
from d join f using (report_row)"""


_UNPACK = f"""
with t as (select report_row, unnest(['Protein.Group', 'Protein.Ids', 'Genes']) field_name, unnest(["Protein.Group", "Protein.Ids", "Genes"]) v from diann_report),
u as (select report_row, field_name, unnest(a) tok, generate_subscripts(a, 1) i from (
  select report_row, field_name, regexp_extract_all(v, '"[^"]*"|''[^'']*''|[\\p{{L}}\\p{{N}}-]+|[^\\s]') a from t where not {_none("v")} and regexp_matches(v, '[^\\p{{L}}\\p{{N}}-]'))),
m as (select *, regexp_matches(tok, '^("[^"]*"|''[^'']*''|[\\p{{L}}\\p{{N}}-]+)$') is_value from u),
p as (select *, lag(is_value, 1, false) over w prev from m window w as (partition by report_row, field_name order by i)),
c as (select *, 1 + sum(case when not is_value or prev then 1 else 0 end) over (partition by report_row, field_name order by i) pos from p),
x as (select report_row, field_name, pos, trim(regexp_replace(tok, '^("([^"]*)"|''([^'']*)'')$', '\\2\\3')) item from c where is_value)
select report_row, field_name, cast(pos as int) as position, item from (select *, count(*) over (partition by report_row, field_name) n from x where item <> '') where n >= 2"""

SQL = {
    "p2_found": f"""with {_FEATURE_CELLS}
select 'cell_features' as table_name, cast(cell_id as varchar) as entity, attribute from cells
union all select distinct 'diann_report', "Run", "Protein.Group" from diann_report
where not {_none('"Run"')} and not {_none('"Protein.Group"')} and {_measured('"PG.MaxLFQ"')}""",
    "p2_cell_features_wide": f"with {_FEATURE_CELLS} select cell_id, {_PIVOT} from cells group by cell_id",
    "p3_found": f"select distinct table_name, record_id from ({_ALL_ORPHANS})",
    "p3_report": f"select table_name, strftime(seen, '%Y-%m') as month, reason, count(distinct record_id) as orphans from ({_ALL_ORPHANS}) group by 1, 2, 3",
    "p4_found": _UNPACK,
    "p5_found": _FILL,
    "p5_filled": _filled(1),
    "p5_supported": _filled(5),
}
