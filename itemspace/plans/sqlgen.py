"""DuckDB text for the oracle side of iterative or composed queries
(k-means unrolled round by round, intrinsic metrics over predictions)."""

from __future__ import annotations

from collections.abc import Sequence


def md5_rank(seed, expr: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws(':', '{seed}', cast({expr} as varchar))), 1, 8) as bigint)"


def long_vectors(vec_sql: str, key: str = "subject", col: str = "v") -> str:
    return (f"select {key} as subject, generate_subscripts({col}, 1) - 1 as d, unnest({col}) as x "
            f"from ({vec_sql})")


def kmeans_ctes(vec_long_sql: str, ks: Sequence[int], rounds: int = 5, seed: int = 42,
                prefix: str = "km") -> tuple[str, str]:
    """CTE list (no WITH) defining ``{prefix}_pred(k, subject, prediction, dist)``
    and ``{prefix}_v(subject, d, x)``; returns (ctes, pred_name)."""
    p = prefix
    out = [f"{p}_v as ({vec_long_sql})",
           f"{p}_ks as (select unnest([{', '.join(str(k) for k in ks)}]) as k)",
           f"{p}_rank as (select subject, row_number() over (order by {md5_rank(seed, 'subject')}, subject) - 1 as r "
           f"from (select distinct subject from {p}_v))",
           f"{p}_c0 as (select ks.k, r.r as cid, v.d, v.x from {p}_ks ks join {p}_rank r on r.r < ks.k "
           f"join {p}_v v on v.subject = r.subject)"]
    for t in range(1, rounds + 2):
        out.append(
            f"{p}_a{t} as (select k, subject, cid as prediction, dist from ("
            f"select v.subject, c.k, c.cid, sum((v.x - c.x) * (v.x - c.x)) as dist "
            f"from {p}_v v join {p}_c{t - 1} c on v.d = c.d group by v.subject, c.k, c.cid) "
            f"qualify row_number() over (partition by k, subject order by dist, cid) = 1)")
        if t <= rounds:
            out.append(
                f"{p}_c{t} as (select o.k, o.cid, o.d, coalesce(n.x, o.x) as x from {p}_c{t - 1} o left join ("
                f"select a.k, a.prediction as cid, v.d, sum(v.x) / count(*) as x from {p}_a{t} a "
                f"join {p}_v v on a.subject = v.subject group by a.k, a.prediction, v.d) n "
                f"on o.k = n.k and o.cid = n.cid and o.d = n.d)")
    return ",\n".join(out), f"{p}_a{rounds + 1}"


def metric_ctes(pred: str, vlong: str, vec_arrays: str, p: str = "m") -> str:
    """CTEs computing ``{p}_db``, ``{p}_ch``, ``{p}_sil`` and ``{p}_sz`` per k
    from ``pred(k, subject, prediction)``, long vectors and array vectors
    ``(subject, v)``."""
    return f""",
{p}_cs as (select a.k, a.prediction as label, v.d, avg(v.x) as c from {pred} a join {vlong} v using (subject)
          group by a.k, a.prediction, v.d),
{p}_sz as (select k, prediction as label, count(*) as size from {pred} group by k, prediction),
{p}_pd as (select a.k, a.subject, a.prediction as label, sum((v.x - c.c) * (v.x - c.c)) as d2
          from {pred} a join {vlong} v using (subject)
          join {p}_cs c on c.k = a.k and c.label = a.prediction and c.d = v.d group by a.k, a.subject, a.prediction),
{p}_st as (select k, label, avg(sqrt(d2)) as scatter, sum(d2) as sse from {p}_pd group by k, label),
{p}_cd as (select a.k, a.label as li, b.label as lj, sqrt(sum((a.c - b.c) * (a.c - b.c))) as dc
          from {p}_cs a join {p}_cs b on a.k = b.k and a.d = b.d and a.label <> b.label group by a.k, a.label, b.label),
{p}_dbi as (select cd.k, cd.li, max(case when dc > 0 then (si.scatter + sj.scatter) / dc end) as r,
           max(dc) as mdc, max(si.scatter) as si
           from {p}_cd cd join {p}_st si on si.k = cd.k and si.label = cd.li
           join {p}_st sj on sj.k = cd.k and sj.label = cd.lj group by cd.k, cd.li),
{p}_db as (select k, case when max(si) = 0 or max(mdc) = 0 then 0.0 else avg(coalesce(r, 0.0)) end
           as davies_bouldin_score from {p}_dbi group by k),
{p}_gm as (select c.k, c.d, sum(c.c * z.size) / sum(z.size) as m from {p}_cs c join {p}_sz z using (k, label)
           group by c.k, c.d),
{p}_ch as (select t.k, case when t.within = 0 then 1.0 else b.btw * (t.n - t.nl) / (t.within * (t.nl - 1)) end
           as calinski_harabasz_score
           from (select k, sum(size) as n, count(*) as nl, sum(sse) as within from {p}_st join {p}_sz using (k, label)
                 group by k) t
           join (select c.k, sum(z.size * (c.c - g.m) * (c.c - g.m)) as btw from {p}_cs c
                 join {p}_sz z using (k, label) join {p}_gm g on g.k = c.k and g.d = c.d group by c.k) b using (k)),
{p}_pair as (select a.subject as s, b.subject as o, list_distance(a.v, b.v) as pdist
             from {vec_arrays} a join {vec_arrays} b on a.subject <> b.subject),
{p}_ps as (select pa.k, pr.s, pa.prediction as own, pb.prediction as ol, sum(pr.pdist) as ds, count(*) as cnt
           from {p}_pair pr join {pred} pa on pa.subject = pr.s join {pred} pb on pb.subject = pr.o and pb.k = pa.k
           group by pa.k, pr.s, pa.prediction, pb.prediction),
{p}_pw as (select k, s, max(case when ol = own then ds / cnt end) as a,
                  min(case when ol <> own then ds / cnt end) as b from {p}_ps group by k, s),
{p}_sil as (select k, avg(case when a is null or b is null or greatest(a, b) = 0 then 0.0
                              else (b - a) / greatest(a, b) end) as silhouette_score
            from (select pw.* from {p}_pw pw) group by k)"""


def md5_u32(seed, *exprs: str) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"cast({e} as varchar)" for e in exprs])
    return f"cast('0x' || substr(md5(concat_ws(':', {inner})), 1, 8) as bigint)"


def _ari(src: str, keys: str) -> str:
    """ARI over a contingency relation ``src(keys..., la, lb, n)``."""
    return f"""(select s.*, ra.sa, cb.sb from
  (select {keys}, sum(cast(n as double) * (n - 1) / 2) as sc, cast(sum(n) as double) as nn from {src} group by {keys}) s
  join (select {keys}, sum(a * (a - 1) / 2) as sa from
        (select {keys}, la, cast(sum(n) as double) as a from {src} group by {keys}, la) group by {keys}) ra using ({keys})
  join (select {keys}, sum(b * (b - 1) / 2) as sb from
        (select {keys}, lb, cast(sum(n) as double) as b from {src} group by {keys}, lb) group by {keys}) cb using ({keys}))"""


def ari_expr() -> str:
    e = "(sa * sb / (nn * (nn - 1) / 2))"
    return f"case when (sa + sb) / 2 = {e} then 1.0 else (sc - {e}) / ((sa + sb) / 2 - {e}) end"


def compare_ctes(pred: str, reps: int = 10, seed: int = 42) -> str:
    """CTEs (no WITH; the caller must start with WITH RECURSIVE) over
    ``pred(run_id, k, subject, prediction)`` defining cmp_cont, cmp_ari,
    cmp_map, cmp_base and cmp_scores."""
    K = "run_a, run_b, k"
    return f""",
cmp_rr_rng as (select run_id, min(prediction) as lo, max(prediction) as hi from {pred} group by run_id),
cmp_rr as (select p.run_id as run_a, p.k, p.subject, p.prediction as la,
                  cast(lo + {md5_u32(seed, "'randomGuess'", "p.run_id", "p.k", "p.subject")} % (hi - lo + 1) as integer) as lb
           from {pred} p join cmp_rr_rng using (run_id)),
cmp_cont as (select a.run_id as run_a, b.run_id as run_b, a.k, a.prediction as la, b.prediction as lb, count(*) as n
             from {pred} a join {pred} b on a.k = b.k and a.subject = b.subject and a.run_id < b.run_id
             group by a.run_id, b.run_id, a.k, a.prediction, b.prediction
             union all
             select run_a, 'randomGuess' as run_b, k, la, lb, count(*) as n from cmp_rr group by run_a, k, la, lb),
cmp_ari as (select {K}, nn as n, {ari_expr()} as randindex from {_ari("cmp_cont", K)}),
cmp_dims as (select {K}, greatest(max(la), max(lb)) + 1 as m from cmp_cont group by {K}),
cmp_perm({K}, m, lst) as (
  select {K}, m, cast([] as integer[]) from cmp_dims
  union all
  select p.run_a, p.run_b, p.k, p.m, list_append(p.lst, cast(j.j as integer))
  from cmp_perm p join (select unnest(range(0, 64)) as j) j on j.j < p.m
  where len(p.lst) < p.m and not list_contains(p.lst, cast(j.j as integer))),
cmp_full as (select * from cmp_perm where len(lst) = m),
cmp_pscore as (select f.run_a, f.run_b, f.k, f.lst, coalesce(sum(c.n), 0) as score
               from (select *, unnest(range(0, m)) as i from cmp_full) f
               left join cmp_cont c on c.run_a = f.run_a and c.run_b = f.run_b and c.k = f.k
                                  and c.la = f.i and c.lb = f.lst[f.i + 1]
               group by f.run_a, f.run_b, f.k, f.lst),
cmp_best as (select * from cmp_pscore qualify row_number() over (partition by {K} order by score desc, lst) = 1),
cmp_map as (select b.run_a, b.run_b, b.k, cast(i as integer) as la, b.lst[i + 1] as lb,
                   i in (select c.la from cmp_cont c where c.run_a = b.run_a and c.run_b = b.run_b and c.k = b.k)
                     as la_present, cast(b.score as bigint) as matched
            from (select *, unnest(range(0, len(lst))) as i from cmp_best) b),
cmp_rng as (select {K}, min(lb) as lo, max(lb) as hi from cmp_map where la_present group by {K}),
cmp_rngs as (select distinct run_a as run_id, k, lo, hi from cmp_rng),
cmp_draws as (select p.run_id, p.k, r.lo, r.hi, rp.rep, p.prediction as la,
                     cast(r.lo + {md5_u32(seed, "p.run_id", "p.k", "rp.rep", "p.subject")} % (r.hi - r.lo + 1) as integer) as lr
              from {pred} p join cmp_rngs r on p.run_id = r.run_id and p.k = r.k
              cross join (select unnest(range(0, {reps})) as rep) rp),
cmp_crand as (select run_id, k, lo, hi, rep, la, lr as lb, count(*) as n from cmp_draws
              group by run_id, k, lo, hi, rep, la, lr),
cmp_ari_r as (select run_id, k, lo, hi, avg({ari_expr()}) as randindex_vs_randint
              from {_ari("cmp_crand", "run_id, k, lo, hi, rep")} group by run_id, k, lo, hi),
cmp_pm as (select m.run_a, m.run_b, m.k, r.lo, r.hi, m.la, m.lb from cmp_map m join cmp_rng r using ({K})),
cmp_f1_r as (select pm.run_a, pm.run_b, pm.k, pm.lo, pm.hi, avg(coalesce(h.hits, 0) / t.nn) as f1_vs_randint
             from (select distinct run_a, run_b, k, lo, hi from cmp_pm) pm
             join (select run_id, k, lo, hi, rep, cast(sum(n) as double) as nn from cmp_crand
                   group by run_id, k, lo, hi, rep) t on t.run_id = pm.run_a and t.k = pm.k and t.lo = pm.lo and t.hi = pm.hi
             left join (select q.run_a, q.run_b, q.k, c.rep, sum(c.n) as hits from cmp_crand c
                        join cmp_pm q on q.run_a = c.run_id and q.k = c.k and q.lo = c.lo and q.hi = c.hi
                                     and q.la = c.la and q.lb = c.lb group by q.run_a, q.run_b, q.k, c.rep) h
               on h.run_a = pm.run_a and h.run_b = pm.run_b and h.k = pm.k and h.rep = t.rep
             group by pm.run_a, pm.run_b, pm.k, pm.lo, pm.hi),
cmp_base as (select f.run_a, f.run_b, f.k, a.randindex_vs_randint, f.f1_vs_randint from cmp_f1_r f
             join cmp_ari_r a on a.run_id = f.run_a and a.k = f.k and a.lo = f.lo and a.hi = f.hi),
cmp_scores as (select a.run_a, a.run_b, a.k, a.n, a.randindex, m.matched / a.n as f1,
                      b.randindex_vs_randint, b.f1_vs_randint,
                      a.randindex - b.randindex_vs_randint as perf_randindex_raw,
                      m.matched / a.n - b.f1_vs_randint as perf_f1_raw
               from cmp_ari a join (select distinct {K}, matched from cmp_map) m using ({K})
               join cmp_base b using ({K}))"""
