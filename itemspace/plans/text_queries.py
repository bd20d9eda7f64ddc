"""Codebook readers, sentence cleaning, windows and encoders over the text
tables (benchmark = codebook items, documents = long texts, pages = html)."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspace.functions import text as T
from itemspace.operators import encode as E
from itemspace.operators import vectors as V
from itemspace.plans.catalog import query
from itemspace.plans.sqlgen import md5_u32
from itemspace.sources import fixtures as fx
from itemspace.sources import line_tables as LT
from itemspace.sources import readers as RD

HASH_DIMS = 64
WIN = 256


def _docs(spark, sf):
    return fx.sentences(spark, sf)


def _items(spark, sf):
    return fx.items(spark, sf)


_CLEAN = "regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), ' {{2,}}', ' ', 'g')"


def clean_sql(x: str) -> str:
    return _CLEAN.format(x=x)


@query("clean_sentence", f"""
select doc_id, cast(length(c) as integer) as n_chars, md5(c) as md5 from (
  select doc_id, {clean_sql("replace(text, chr(10), '  ')")} as c from documents)""")
def q_clean_sentence(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.clean_sentence(F.regexp_replace("text", "\n", "  ")).alias("c"))
    return d.select("doc_id", F.length("c").alias("n_chars"), F.md5("c").alias("md5"))


@query("flag_multiline", """
select item_id, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) > 1 as is_multiline from benchmark""")
def q_flag_multiline(spark, sf):
    return _items(spark, sf).select("item_id", T.flag_multiline("sentence").alias("is_multiline"))


_W, _N23 = WIN - 1, (2 * WIN) // 3
_STEP = max(1, _W - _N23)


@query("split_long_sentences", f"""
with w as (select doc_id, string_split(text, ' ') as words from documents),
m as (select doc_id, words, len(words) as n,
             case when len(words) > {WIN} then cast(ceil((len(words) - {WIN}) / {_STEP}) as integer) else 0 end as m
      from w),
s as (select doc_id, words, n, m, unnest(range(0, m * {_STEP} + 1, {_STEP})) as st from m)
select doc_id, cast(st / {_STEP} as integer) as win,
       len(case when st / {_STEP} < m then words[st + 1: st + {_W}] else words[st + 1: n] end) as n_words,
       md5(array_to_string(case when st / {_STEP} < m then words[st + 1: st + {_W}] else words[st + 1: n] end, ' '))
         as md5
from s""")
def q_split_long_sentences(spark, sf):
    w = E.split_long_sentences(_docs(spark, sf), "doc_id", "text", WIN)
    return w.select("doc_id", F.col("win").cast("int").alias("win"),
                    F.size(F.split("window_text", " ")).alias("n_words"), F.md5("window_text").alias("md5"))


_TOK = "(select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) as tok from benchmark)"
_HASH_SQL = f"""
with t as {_TOK},
c as (select item_id, cast({md5_u32(7, "tok")} % {HASH_DIMS} as integer) as b, cast(count(*) as double) as c
      from t group by item_id, b),
n as (select item_id, sqrt(sum(c * c)) as nr from c group by item_id),
full_ as (select i.item_id, d.d from (select distinct item_id from t) i, (select unnest(range(0, {HASH_DIMS})) as d) d)
select f.item_id, cast(f.d as integer) as d, round(coalesce(c.c, 0.0) / n.nr, 6) as value
from full_ f join n using (item_id) left join c on c.item_id = f.item_id and c.b = f.d"""


@query("encode_hashing", _HASH_SQL)
def q_encode_hashing(spark, sf):
    return V.to_long(E.encode_hashing(_items(spark, sf), "item_id", "sentence", HASH_DIMS), key="item_id")


@query("encode_random", f"""
with r as (select item_id, d, {md5_u32(42, "item_id", "d")} / 4294967296.0 as x
           from (select distinct item_id from benchmark), (select unnest(range(0, 16)) as d)),
n as (select item_id, sqrt(sum(x * x)) as nr from r group by item_id)
select item_id, cast(d as integer) as d, round(x / nr, 6) as value from r join n using (item_id)""")
def q_encode_random(spark, sf):
    return V.to_long(E.encode_random(_items(spark, sf), "item_id", 16), key="item_id")


@query("embed_incremental", f"""
with t as {_TOK},
c as (select item_id, cast({md5_u32(7, "tok")} % {HASH_DIMS} as integer) as b, cast(count(*) as double) as c
      from t group by item_id, b),
n as (select item_id, sqrt(sum(c * c)) as nr from c group by item_id)
select (select count(distinct text) from benchmark where item_id in (select item_id from c)) as n_sentences,
       (select count(distinct item_id) from c) * {HASH_DIMS} as n_values,
       round(sum(c.c / n.nr), 6) as total
from c join n using (item_id)""")
def q_embed_incremental(spark, sf):
    """Encode the even items first (the stored table), then only the missing
    sentences; the union covers every item once."""
    items = _items(spark, sf)

    def enc(df):
        return E.encode_hashing(df, "_k", "sentence", HASH_DIMS)
    empty = spark.createDataFrame([], "model string, sha string, v array<double>")
    stored = E.embed_incremental(items.where(F.col("item_id") % 2 == 0), "item_id", "sentence", empty, enc)
    full = E.embed_incremental(items, "item_id", "sentence", stored, enc)
    per_item = items.select(F.sha2("sentence", 256).alias("sha")).join(full, "sha")
    return per_item.agg(F.count_distinct("sha").alias("n_sentences"),
                        (F.count("*") * HASH_DIMS).alias("n_values"),
                        F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))


@query("codebook_lines", f"""
select item_id, cast(line_no as integer) as line_no, trim(split_part(line, ' ', 1)) as code,
       {clean_sql("coalesce(nullif(substr(line, length(split_part(line, ' ', 1)) + 2), ''), '')")} as sentence
from (select item_id, unnest(string_split(text, chr(10))) as line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from benchmark)""")
def q_codebook_lines(spark, sf):
    return RD.codebook_lines(fx.table(spark, sf, "benchmark"), "item_id", "text")


@query("codebook_html", """
with r as (select page_id, unnest(regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1)) as row,
                  generate_subscripts(regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1), 1) - 1 as row_no
           from pages)
select page_id, cast(row_no as integer) as row_no,
       trim(replace(replace(replace(regexp_replace(
         regexp_extract_all(row, '(?s)<a\\b[^>]*>(.*?)</a>', 1)[1], '<[^>]+>', '', 'g'),
         '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) as link_text,
       regexp_extract_all(row, 'href="([^"]*)"', 1)[1] as href
from r""")
def q_codebook_html(spark, sf):
    r = RD.html_rows(fx.table(spark, sf, "pages"), "page_id", "html", row_tag="li", cell_tag="a")
    return r.select("page_id", "row_no", F.col("cells")[0].alias("link_text"), F.col("hrefs")[0].alias("href"))


_STITCH_SQL = f"""
with l as (select doc_id, pos, line from (
             select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) as line,
                    generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: x <> ''), 1) as pos
             from documents)),
g as (select doc_id, pos, line,
             sum(case when regexp_matches(line, '^[0-9]') or pos = 1 then 1 else 0 end)
               over (partition by doc_id order by pos) - 1 as rec from l),
r as (select doc_id, rec, string_agg(line, '' order by pos) as rec_text from g group by doc_id, rec)
select doc_id, cast(rec as integer) as rec_no,
       md5({clean_sql("regexp_replace(rec_text, '^([0-9.]\\s*)*', '')")}) as md5
from r"""


@query("stitch_numbered_lines", _STITCH_SQL)
def q_stitch_numbered_lines(spark, sf):
    s = RD.stitch_numbered_lines(_docs(spark, sf))
    return s.select("doc_id", "rec_no", F.md5("sentence").alias("md5"))


@query("stitch_line_table", _STITCH_SQL)
def q_stitch_line_table(spark, sf):
    """The same from a table of lines, whatever the partitions that hold a document."""
    s = LT.stitch_line_table(LT.line_table(_docs(spark, sf)))
    return s.select("doc_id", "rec_no", F.md5("sentence").alias("md5"))


@query("maxpool_windows", f"""
with w as (select doc_id, string_split(text, ' ') as words from documents),
m as (select doc_id, words, len(words) as n,
             case when len(words) > {WIN} then cast(ceil((len(words) - {WIN}) / {_STEP}) as integer) else 0 end as m
      from w),
s as (select doc_id, cast(st / {_STEP} as integer) as win,
             array_to_string(case when st / {_STEP} < m then words[st + 1: st + {_W}] else words[st + 1: n] end, ' ')
               as wt
      from (select doc_id, words, n, m, unnest(range(0, m * {_STEP} + 1, {_STEP})) as st from m)),
t as (select doc_id, win, unnest(list_filter(regexp_split_to_array(lower(wt), '\\s+'), lambda t: t <> '')) as tok
      from s),
c as (select doc_id, win, cast({md5_u32(7, "tok")} % {HASH_DIMS} as integer) as b, cast(count(*) as double) as c
      from t group by doc_id, win, b),
n as (select doc_id, win, sqrt(sum(c * c)) as nr from c group by doc_id, win),
v as (select c.doc_id, c.b, max(c.c / n.nr) as x from c join n using (doc_id, win) group by c.doc_id, c.b),
select doc_id, cast(b as integer) as d, round(x, 6) as value from v""")
def q_maxpool_windows(spark, sf):
    """Long texts: windows -> hashing encoder -> element-wise max over the
    windows of each text (one vector per document)."""
    w = E.split_long_sentences(_docs(spark, sf), "doc_id", "text", WIN)
    enc = E.encode_hashing(w.select(F.concat_ws(":", "doc_id", "win").alias("wk"), "window_text"),
                           "wk", "window_text", HASH_DIMS)
    enc = enc.withColumn("doc_id", F.split("wk", ":")[0].cast("long"))
    pooled = V.pool_groups(enc, "doc_id", "max", dims=HASH_DIMS)
    long = V.to_long(pooled, key="doc_id")
    return long.where(F.col("value") > 0)


def shape_encoder(sentences: list[str]):
    """A tiny deterministic encoder used to exercise the encoder hook:
    [words, characters, lines] of each sentence."""
    import numpy as np
    return np.array([[len(s.split(" ")), len(s), len(s.split("\n"))] for s in sentences], dtype=float)


@query("encode_sentences", """
select item_id, cast(d as integer) as d, value from (
  select item_id, unnest([cast(len(string_split(text, ' ')) as double), cast(length(text) as double),
                          cast(len(string_split(text, chr(10))) as double)]) as value,
         unnest([0, 1, 2]) as d
  from benchmark)""")
def q_encode_sentences(spark, sf):
    """The pluggable encoder hook over the distinct codebook sentences."""
    enc = E.encode_sentences(_items(spark, sf), "item_id", "sentence", shape_encoder, 3)
    return V.to_long(enc, key="item_id")


@query("codebook_table", """
with r as (select item_id, 0 as row_no, 'Q' || item_id as code, text from benchmark)
select item_id, 1 as row_no, code, """ + clean_sql("replace(text, chr(10), ' ')") + """ as sentence from r
union all select item_id, 2, code || 'b', null from r
union all select item_id, 3, code || 'c', null from r""")
def q_codebook_table(spark, sf):
    """Table codebooks made of the items: a heading, a row with the item's whole text
    quoted, a row without quotes and a short row."""
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    html = F.concat(
        F.lit("<table><tr><th>id</th></tr><tr><td>Q"), F.col("item_id"), F.lit('</td><td>x</td><td>say "'), line,
        F.lit('" please</td></tr><tr><td>Q'), F.col("item_id"), F.lit("b</td><td>x</td><td>unquoted</td></tr><tr><td>Q"),
        F.col("item_id"), F.lit("c</td></tr></table>"))
    return RD.codebook_html(fx.table(spark, sf, "benchmark").select("item_id", html.alias("html")), "item_id", "html")


def _pipe_docs(spark, sf):
    """Grid tables made of the items: a record over two lines that holds the item's
    whole text, a record with a missing cell, and an open tail that is dropped."""
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    text = F.concat(F.lit("-----\n|Q"), F.col("item_id"), F.lit("|"), line, F.lit(" |yes|\n| |more|no|\n-----\n|R"),
                    F.col("item_id"), F.lit("|only a question|\n-----\n|tail|open|x|"))
    return fx.table(spark, sf, "benchmark").select("item_id", text.alias("text"))


_PIPE_SQL = """
select item_id, 1 as rec, 'Q' || item_id as code, """ + clean_sql("replace(text, chr(10), ' ') || ' more'") + """ as sentence,
       'yesno' as values
from benchmark
union all select item_id, 2, 'R' || item_id, 'only a question', '' from benchmark"""


@query("parse_pipe_table", _PIPE_SQL)
def q_parse_pipe_table(spark, sf):
    return RD.parse_pipe_table(_pipe_docs(spark, sf), "item_id", "text")


@query("parse_pipe_line_table", _PIPE_SQL)
def q_parse_pipe_line_table(spark, sf):
    """The same from a table of lines."""
    return LT.parse_pipe_line_table(LT.line_table(_pipe_docs(spark, sf), "item_id", "text"), "item_id")


@query("split_numbered_blocks", """
select item_id, n as item, case n when 1 then """ + clean_sql("regexp_replace(text, '[0-9]', '', 'g')") + """ else 'the end' end as sentence
from benchmark, (values (1), (22)) t(n)""")
def q_split_numbered_blocks(spark, sf):
    text = F.concat(F.lit("preface\n1\n"), F.col("text"), F.lit("\n 22 \nthe 3 end".replace("3 ", "")))
    return RD.split_numbered_blocks(fx.table(spark, sf, "benchmark").select("item_id", text.alias("text")), "item_id", "text")


@query("parse_mode", """
select distinct event_type, starts_with(m, 'llm_') as embedding, ends_with(m, '_no_norm') as no_norm,
       try_cast(regexp_extract(m, '^llm_random_([0-9]+)(_no_norm)?$', 1) as integer) as dims
from (select event_type, unnest(['feat_raw', 'feat_agg_no_norm', 'llm_random_768', 'llm_random_8_no_norm',
                                 'llm_random_x', 'llm_' || event_type]) as m from events)""")
def q_parse_mode(spark, sf):
    """Mode names made with the event types."""
    from itemspace.functions.text import parse_mode
    modes = F.array(*[F.lit(x) for x in ("feat_raw", "feat_agg_no_norm", "llm_random_768", "llm_random_8_no_norm",
                                         "llm_random_x")], F.concat(F.lit("llm_"), F.col("event_type")))
    named = fx.table(spark, sf, "events").select("event_type").distinct().select("event_type", F.explode(modes).alias("m"))
    source, no_norm, dims = parse_mode("m")
    return named.select("event_type", (source == "embedding").alias("embedding"), no_norm.alias("no_norm"),
                        dims.alias("dims")).distinct()
