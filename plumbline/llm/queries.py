"""One query per operator over the supplied tables, with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    conversation_trie, exact_dedup, jaccard_join, mixing, packing, personal_data, pieces,
    quality_rules, recurrent_lm, spelling, substring_dedup, toxicity, url_filters,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Fixed values of the URL contract: host, path prefix, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_piece_lattice")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.vocabulary()).drop("ids")


@query("op2_suffix_array_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


@query("op3_sainte_lague_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("draw")


@query("op4_recompression", r"""
with w as (
  select row_number() over () as rid, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
g as (select rid, doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w where len(ws) >= 50),
k as (select rid, doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) as h from g),
m as (select h, min(doc_id) as lo from k group by h),
hit as (select distinct rid, unnest(range(p, p + 50)) as p from k join m using (h) where doc_id > lo),
gone as (select rid, list(p) as ps from hit group by rid)
select doc_id, len(ws) as n_words, coalesce(len(ps), 0) as n_removed,
       sha256(case when ps is null then array_to_string(ws, ' ') else array_to_string(
         [ws[i] for i in range(1, len(ws) + 1) if not list_contains(ps, i)], ' ') end) as kept_sha256
from w left join gone using (rid)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op5_skip_chain_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data.find(docs, personal_data.fit(docs))


@query("op6_exact_dedup", r"""
with t as (
  select row_number() over () as rid, doc_id, length(coalesce(text, '')) as chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
k as (
  select *, row_number() over (partition by norm order by chars desc, doc_id nulls last, rid) as place,
         count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by chars desc, doc_id nulls last, rid) as keep_id
  from t)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from k
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


@query("op7_convolutional_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1)
        .alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "cut", "rejected")


# The tables hold no canonical or refresh elements, so classes are spellings here;
# tests/llm compares linked pages with a brute-force search.
@query("op8_url_redirect_classes", r"""
with recursive p as (
  select page_id, url, coalesce(html, '') as html,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
rules(rh, rp, rv) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                             ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (
  select distinct url, rh || rp as rule, rv,
         row_number() over (partition by url order by length(rh || rp) desc) as place
  from (select distinct url, host, path from p) join rules
    on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)),
named as (
  select p.*, f.rule, f.rv,
         regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
         regexp_replace(regexp_replace(regexp_extract(coalesce(p.url, ''), '^[^?#]*(\?[^#]*)', 1, 's'),
           '([?&])(?:(?:utm_[a-zA-Z]+|gclid|fbclid)=[^&#]*&?)+', '\1', 'gi'), '[?&]$', '') as page
  from p left join fit f on p.url = f.url and f.place = 1),
stance as (
  select page, max(case rv when 'allow' then 2 when 'block' then 1 else 0 end) as s
  from named where contains(url, '://') group by page)
select page_id, host, path, rule,
       coalesce(rv, case when s = 1 then 'block' else 'allow' end) as verdict
from named left join stance using (page)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("component")


@query("op9_multi_order_join", r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, md5(array_to_string(ws[p:p + 3], ' ')) as h
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as p from w
        where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i
      from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b
      where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, min(b) as least from r group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) as component_id
from w left join n using (doc_id) left join m using (doc_id)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = jaccard_join.join(table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.drop("class_id")


@query("op10_recurrent_language_model")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(table(spark, sf_dir, "documents"))


@query("op11_linear_grouping_pack")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    pieces_of = packing.tokenise(table(spark, sf_dir, "documents"),
                                 public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces_of.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


#: CRC-32 in SQL: the table from its rule, then one step per byte.
CRC_SQL = """
crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1
              then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b) as tab
  from range(256) as t(b))"""


def crc_sql(data: str) -> str:
    """The unsigned CRC-32 of a list of bytes, beside ``tab`` of ``crc_table``."""
    return (f"xor(list_reduce({data}, lambda c, b: "
            "xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)")


@query("op12_permuterm_variants", f"""
with recursive {CRC_SQL},
r as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
d as (select doc_id, run, count(*) as n from r group by all),
b as (select run, n, coalesce(cast(doc_id as varchar), '') || ':' || run as s from d),
h as (
  select run, n, {crc_sql("""flatten(list_transform(string_split(s, ''), lambda ch:
      case when unicode(ch) < 128 then [unicode(ch)::bigint]
           else [195::bigint, unicode(ch)::bigint - 64] end))""")} as h
  from b, crc_table),
k as (select n, case when h % 199 = 0 then left(run, h % length(run)) ||
             substr(run, h % length(run) + 2) else run end as word from h),
w as (select word, sum(n)::bigint as n from k where length(word) >= 6 group by word having sum(n) >= 5),
c as (select word, n, unnest(range(1, length(word) + 1)) as p from w),
m as (select word, n, left(word, p - 1) || '*' || substr(word, p + 1) as mask,
             left(word, p - 1) || substr(word, p + 1) as gone from c),
pairs as (
  select a.word as a, b.word as b from m a join m b on a.mask = b.mask and a.word <> b.word
  union select m.word, w.word from m join w on m.gone = w.word
  union select w.word, m.word from m join w on m.gone = w.word),
e as (
  select x.word, x.n, count(p.b) as n_near,
         first(y.word order by y.n desc, y.word) as best, max(y.n) as best_n
  from w x left join pairs p on p.a = x.word left join w y on y.word = p.b group by all),
f as (select word, n, n_near, case when best_n >= 5 * n then best end as form,
             case when best_n >= 5 * n then best_n end as form_n from e),
walk(word, root) as (
  select word, word from f
  union all select walk.word, f.form from walk join f on f.word = walk.root where f.form is not null)
select f.word, form, walk.root, n, n_near, form_n from f join walk on walk.word = f.word
where not exists (select 1 from f g where g.word = walk.root and g.form is not null)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.vocabulary(table(spark, sf_dir, "documents")))


@query("op13_collapsed_trie", f"""
with {CRC_SQL},
t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first,
                                     coalesce(role, ''), coalesce(text, '')) as p,
         {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as turn
  from conversations where conv_id is not null),
o as (select conv_id, list(turn order by p) as turns from t group by conv_id),
h as (
  select conv_id, turns, {crc_sql("""list_transform(string_split(conv_id::varchar, ''),
      lambda ch: unicode(ch)::bigint)""")} % 9 as h from o, crc_table),
s as (
  select c.conv_id, list_concat(coalesce(b.turns, [])[:c.h], c.turns[c.h + 1:]) as turns
  from h c left join o b on b.conv_id = c.conv_id - c.conv_id % 5),
x as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from s),
m as (select conv_id, depth, turns[:depth] as node, depth = len(turns) as done from x),
n as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id)
                         filter (where done), '')) as ends_sha256
  from m group by node, depth),
g as (select node[:depth - 1] as node, count(*) as n_children from n where depth > 0 group by 1),
q as (
  select n.*, coalesce(g.n_children, 0) as n_children,
         case when n.depth = 0 then 0 else (n_convs - 1) * strlen(n.node[n.depth].t) end as value
  from n left join g on g.node = n.node),
up as (select node, unnest(range(0, depth + 1)) as a, value, n_children from q),
sub as (select node[:a] as node, sum(value)::bigint as saved_tokens,
               count(*) filter (where n_children = 0) as n_leaves from up group by 1)
select q.conv_id, q.depth, f.conv_id as parent_conv_id, q.n_convs, q.n_children, sub.n_leaves,
       sub.saved_tokens, q.ends_sha256
from q join sub on sub.node = q.node
left join q f on q.depth > 0 and f.node = q.node[:q.depth - 1]
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))
