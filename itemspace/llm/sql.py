"""DuckDB text of the llm queries that SQL can express."""

from __future__ import annotations

from itemspace.llm import quality_rules as qr

SQL: dict[str, str] = {}

SQL["op7_chat_format"] = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *,
    regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') as et,
    regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') as er
  from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>' || er || '<|im_sep|>' || et || '<|im_end|>'))::bigint as formatted_chars
from e group by conv_id"""


def _rules_sql() -> str:
    out = []
    for r in qr.RULES:
        whole = "1" if r.whole == "one" else r.whole
        for op, bound in ((">=", r.low), ("<=", r.high)):
            if bound is not None:
                short = f" or n_words < {r.from_words}" if r.from_words else ""
                out.append(f"({r.part} * 1000 {op} {whole} * {bound}{short})")
    return " and ".join(out)


SQL["op8_quality_rules"] = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
g as (select r, i, hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) as h
      from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
dup as (select r, i from (select r, i, count(*) over (partition by r, h) as c from g) where c > 1),
rep as (select r, sum(least(5, coalesce(nxt - i, 5)))::bigint as n_repeat_words
        from (select r, i, lead(i) over (partition by r order by i) as nxt from dup) group by r),
l as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
m as (select d.r, doc_id, len(w) as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(translate(text, '{qr.SYMBOLS}', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    len(list_filter(w, lambda x: trim(translate(x, '{qr.UPPER}', '{qr.LOWER}'), '{qr.EDGES}')
        in ({", ".join(f"'{x}'" for x in dict.fromkeys(qr.STOP_WORDS))}))) as n_stop,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[{qr.BULLETS[0]}*-]'))) as n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|{qr.ELLIPSES[1]})[\x20\x09-\x0D]*$'))) as n_ellipsis_lines
  from d join w using (r) join l using (r) left join rep using (r)),
b as (select *, n_words < 10 or n_repeat_words * 100 > n_words * 20 as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, n_lines, n_bullet_lines, n_ellipsis_lines, base_failed,
  not base_failed and {_rules_sql()} as kept
from b"""


def _license_sql() -> str:
    from itemspace.llm import licenses as lic
    rows = ", ".join(f"({k}, '{name}', [{', '.join(repr(x) for x in b)}])"
                     for k, (name, b) in enumerate(lic.compiled(lic.TEMPLATES)))
    t = lic.THRESHOLD
    return rf"""
with t(rank, name, b) as (values {rows}),
d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{lic.UPPER}', '{lic.LOWER}') as x
      from documents),
s as (select r, doc_id, list_filter(string_split(x, chr(10)) || list_filter(
        regexp_split_to_array(x, '\n[ \t\r]*\n'), lambda p: contains(p, chr(10)))
        || case when contains(x, chr(10)) then [x] else [] end, lambda p: p <> '') as segs from d),
w as (select r, k, regexp_extract_all(seg, '[a-z0-9]+') as w
      from (select r, unnest(segs) as seg, unnest(range(len(segs))) as k from s)),
g as (select r, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b
      from w where len(w) between 2 and 400),
m as (select r, k, rank, name, len(list_intersect(g.b, t.b)) * 2 / (len(g.b) + len(t.b)) as dice
      from g join t on len(g.b) * {t} <= len(t.b) * {200 - t} and len(g.b) * {200 - t} >= len(t.b) * {t}),
h as (select r, k, max_by(name, (dice, -rank)) as name, max(dice) as dice, max_by(-rank, (dice, -rank)) as nrank
      from m where dice * 100 >= {t} group by r, k),
p as (select r, count(*) as n_hits, max_by(name, (dice, nrank, name)) as license, round(max(dice), 6) as score,
        string_agg(distinct name, ',' order by name) as licenses from h group by r)
select doc_id, len(segs) as n_segments, coalesce(n_hits, 0) as n_hits, license, score,
  coalesce(licenses, '') as licenses
from s left join p using (r)"""


SQL["op3_license_scan"] = _license_sql()


SQL["op10_lm_score"] = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
x as (select r, i, w[i] as w, case when i > 1 then w[i - 1] end as v
      from (select r, w, unnest(range(1, len(w) + 1)) as i from d)),
c1 as (select w, count(*) as c from x group by w),
c2 as (select v, w, count(*) as c from x where v is not null group by v, w),
n as (select count(*) as n from x),
s as (select r, case when x.v is null then ln(a.c / n.n) when b.c >= 2 then ln(b.c / z.c)
                     else ln(0.4 * a.c / n.n) end as s,
        case when x.v is not null and b.c < 2 then 1 else 0 end as k
      from x cross join n join c1 a on a.w = x.w left join c2 b on b.v = x.v and b.w = x.w
      left join c1 z on z.w = x.v),
t as (select r, count(*) as n_words, sum(k)::bigint as n_backoff, sum(s) as s from s group by r)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_backoff, 0) as n_backoff,
  round(coalesce(s, 0.0), 3) as log_score, round(s / n_words, 6) as word_score
from d left join t using (r)"""


def _merkle_sql() -> str:
    def leaf(n_chars: str) -> str:
        fields = ["cast(doc_id as varchar)", "source", "lang", n_chars, "text"]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"
    # crc32 of the decimal id, a byte at a time
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''),
      lambda c: ascii(c)::bigint)), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)),
      lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"""

    def tree(name: str, base: str) -> str:
        return f"""{name} as (select k, 0 as l, i, h, n from {base} union all
  select k, l + 1, i // 2, sha256(h || coalesce(nx, '')), (n + 1) // 2
  from (select *, lead(h) over (partition by k order by i) as nx from {name} where n > 1) where i % 2 = 0)"""

    def fold(name: str, base: str, nodes: str) -> str:
        return f"""{name} as (select r, k, 0 as l, i, n, h, path from {base} union all
  select r, k, l + 1, i // 2, (n + 1) // 2,
    sha256(case when i % 2 = 1 then s || h else h || coalesce(s, '') end), path || coalesce(s, '')
  from (select f.*, t.h as s from {name} f left join {nodes} t on t.k = f.k and t.l = f.l and t.i = xor(f.i, 1)
        where f.n > 1))"""
    return rf"""
with recursive d as (select doc_id, coalesce('=' || lang, '-') as k, {leaf("cast(n_chars as varchar)")} as h,
    case when {crc} % 7 = 0 then {leaf("cast(n_chars + 1 as varchar)")} end as changed from documents),
leaf as (select *, row_number() over () as r, row_number() over (partition by k order by doc_id nulls first, h) - 1 as i,
    count(*) over (partition by k) as n from d),
{tree("t", "leaf")},
sub as (select k, h, row_number() over (order by k) - 1 as j, count(*) over () as m from t where n = 1),
top as (select '' as k, j as i, h, m as n from sub),
{tree("u", "top")},
low as (select r, k, i, n, coalesce(changed, h) as h, '' as path from leaf),
{fold("f", "low", "t")},
mid as (select f.r, '' as k, sub.j as i, sub.m as n, f.h, f.path from f join sub using (k) where f.n = 1),
{fold("g", "mid", "u")}
select leaf.doc_id, leaf.h as leaf, sub.h as subroot, root.h as root, sha256(g.path) as proof_sha256,
  g.h as folded_root, g.h = root.h as verified
from leaf join g on g.r = leaf.r and g.n = 1 join sub on sub.k = leaf.k cross join (select h from u where n = 1) root"""


SQL["op13_merkle_manifest"] = _merkle_sql()


# Every pair of a label, and reachability over the links.
SQL["op12_embedding_near_dedup"] = r"""
with recursive v as (select row_number() over () as r, vec_id, label, cast(embedding as double[]) as e from embeddings),
able as (select * from v where label is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
         and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (select a.r as a, b.r as b from able a join able b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
         where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select r, r as c from v union select reach.r, link.b from reach join link on link.a = reach.c),
comp as (select reach.r, min(v.vec_id) as component_id from reach join v on v.r = reach.c group by reach.r),
deg as (select a as r, count(*) as n from link group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
from v join comp using (r) left join deg using (r)"""


SQL["op11_hard_negatives"] = r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) as q
  from embeddings where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
    cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as r
                     from s where same) where r <= 5),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same
    and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from n where rank <= 3"""
