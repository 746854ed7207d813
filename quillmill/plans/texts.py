"""Text rules, terms and scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import arrays as A
from quillmill.functions import scalar as S
from quillmill.functions import text as T
from quillmill.functions import text_udf as U
from quillmill.operators import relational as R
from quillmill.operators import terms as O
from quillmill.plans import sqltext as Q
from quillmill.plans.registry import query
from quillmill.sources import books as B

LINES = r"(select doc_id, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) as pos, unnest(string_split_regex(text, '\r?\n')) as line from documents)"


@query("SC2_markdown_chapters", rf"""
with md as (select doc_id, regexp_replace(text, '(^|\n)([A-Z][^\n.]*\.)', '\1## \2' || chr(10), 'g') as t from documents),
l as (select doc_id, unnest(range(1, len(string_split_regex(t, '\r?\n')) + 1)) as pos, unnest(string_split_regex(t, '\r?\n')) as line from md),
h as (select *, regexp_matches(line, '^#{{1,3}}\s+(.+?)\s*$') as head from l), s as (select *, sum(head::int) over (partition by doc_id order by pos) as sec from h),
b as (select doc_id, sec, max(case when head then regexp_extract(line, '^#{{1,3}}\s+(.+?)\s*$', 1) end) as title, trim(string_agg(case when not head then line end, chr(10) order by pos), ' ' || chr(9) || chr(10) || chr(13)) as body from s group by all)
select doc_id, row_number() over (partition by doc_id order by sec) as idx, coalesce(title, '') as title, md5(body) as body from b where body <> ''
""")
def _(t):
    md = t.documents.select("doc_id", F.regexp_replace("text", r"(^|\n)([A-Z][^\n.]*\.)", "$1## $2\n").alias("t"))
    return B.chapters_of(md, "doc_id", "t", "md").select("doc_id", F.col("idx").cast("long").alias("idx"), "title", F.md5("body").alias("body"))


@query("SC3_txt_chapters", rf"""
with l as (select doc_id, pos, case when length(line) < 60 then 'Chapter ' || pos || ': ' || line else line end as line from {LINES}),
h as (select *, regexp_matches(line, '^\s*Chapter\s+\d+') as head from l), s as (select *, sum(head::int) over (partition by doc_id order by pos) as sec from h),
t as (select *, trim(regexp_extract(line, '^\s*(Chapter\s+\d+)\s*[:：]?\s*(.*)$', 2)) as rest, regexp_extract(line, '^\s*(Chapter\s+\d+)', 1) as mark from s),
b as (select doc_id, sec, max(case when head then case when rest <> '' then rest else mark end end) as title, trim(string_agg(case when not head then line end, chr(10) order by pos), ' ' || chr(9) || chr(10) || chr(13)) as body from t group by all)
select doc_id, row_number() over (partition by doc_id order by sec) as idx, coalesce(title, '') as title, md5(body) as body from b where body <> ''
""")
def _(t):
    line = F.when(F.length("line") < 60, F.concat(F.lit("Chapter "), F.col("pos").cast("string"), F.lit(": "), F.col("line"))).otherwise(F.col("line"))
    text = t.lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"]), "\n").alias("t"))
    return B.chapters_of(text, "doc_id", "t", "txt").select("doc_id", F.col("idx").cast("long").alias("idx"), "title", F.md5("body").alias("body"))


@query("SC11_lexicon", "select n_name || case when n_nationkey < 3 then ' two' else '' end as term, case when n_nationkey < 10 then 'user' else 'cached' end as part, case when n_nationkey < 3 then lower(n_name) end as alias from nation where n_nationkey >= 3 union all select n_name || ' two', 'user', null from nation where n_nationkey < 3 union all select n_name || ' two', 'user', 'alias' || n_nationkey from nation where n_nationkey < 3".replace("n_name", "replace(n_name, '_', ' ')"))
def _(t):
    n = t.nation.select("n_nationkey", "n_name")
    line = F.when(F.col("n_nationkey") < 3, F.concat(F.col("n_name"), F.lit(" two = alias"), F.col("n_nationkey").cast("string"), F.lit(", ,"))).when(F.col("n_nationkey") == 10, F.concat(F.lit("# 系统缓存\n\n"), F.col("n_name"))).otherwise(F.col("n_name"))
    text = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda s: s["l"]), "\n").alias("text"))
    return B.read_lexicon(text)


@query("TX3_english_terms", f"select doc_id, len({Q.words('text')}) as n, array_to_string(list_filter({Q.words('text')}, lambda x: x not in ({Q.STOP}))[1:20], ' ') as first from documents")
def _(t):
    return t.documents.select("doc_id", F.size(T.raw_words(F.col("text"))).cast("long").alias("n"), F.array_join(F.slice(T.english_words(F.col("text")), 1, 20), " ").alias("first"))


@query("TX2_han_bigrams", "select page_id, 0::bigint as n from pages")
def _(t):
    return t.pages.select("page_id", F.size(T.han_bigrams(F.col("html"))).cast("long").alias("n"))


@query("TX4_query_tokens", "select item_id, token from (select item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*'))) as token from benchmark)")
def _(t):
    return t.benchmark.select("item_id", F.explode(T.query_tokens(F.col("text"))).alias("token"))


@query("TX5_cluster_name", "select doc_id, trim(regexp_replace(text, '[^一-鿿A-Za-z0-9]+', ' ', 'g')) as name from documents")
def _(t):
    return t.documents.select("doc_id", T.clean_cluster_name(F.col("text")).alias("name"))


@query("TX6_profile_name", r"select doc_id, trim(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]+', ' ', 'g')) as name from documents")
def _(t):
    return t.documents.select("doc_id", T.clean_profile_name(F.col("text")).alias("name"))


@query("TX7_clean_title", r"select p_partkey, regexp_replace(regexp_replace(p_name || ' (' || p_brand || ') [x]_' || p_type, '[（(【\[].*?[）)】\]]', ' ', 'g'), '_+', ' ', 'g') as title from part")
def _(t):
    raw = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") [x]_"), F.col("p_type"))
    return t.part.select("p_partkey", T.clean_title(raw).alias("title"))


@query("TX8_strip_latex", r"""select item_id, regexp_replace(regexp_replace('\frac{a1}{b} ' || text || ' \alpha {x{y}}', '\{[^{}\n]*[A-Za-z0-9\\][^{}\n]*\}', ' ', 'g'), '\\[A-Za-z]+', ' ', 'g') as t from benchmark""")
def _(t):
    return t.benchmark.select("item_id", T.strip_latex(F.concat(F.lit("\\frac{a1}{b} "), F.col("text"), F.lit(" \\alpha {x{y}}"))).alias("t"))


@query("TX10_fragments")
def _(t):
    text = F.col("text")
    every = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(f"[{T.HAN}]+|[A-Za-z][A-Za-z0-9_]*"), F.lit(0)), T.han_bigrams(text)))
    terms = t.documents.select(F.explode(every).alias("term")).distinct()
    return terms.select("term", T.is_fragment(F.col("term")).alias("fragment"), F.size(T.inner_bigrams(F.col("term"))).cast("long").alias("inner_"))


@query("TX11_blank_pages", r"select doc_id, pos, case when line = '' then false when regexp_replace(lower(line), '[^0-9a-z一-鿿]', '', 'g') = '' then true when length(regexp_replace(lower(line), '[^0-9a-z一-鿿]', '', 'g')) > 20 then false else regexp_matches(regexp_replace(lower(line), '[^0-9a-z一-鿿]', '', 'g'), 'blank|empty|nocontent') end as blank from " + LINES)
def _(t):
    return t.lines.select("doc_id", F.col("pos").cast("long").alias("pos"), T.is_blank_page(F.col("line")).alias("blank"))


@query("TX14_numbered_paragraphs", r"select doc_id, md5(string_agg('【第' || n || '段】' || p, chr(10) order by n)) as h from (select doc_id, trim(line, ' ' || chr(9) || chr(13)) as p, row_number() over (partition by doc_id order by pos) as n from " + LINES + " where trim(line, ' ' || chr(9) || chr(13)) <> '') group by doc_id")
def _(t):
    return t.documents.select("doc_id", T.numbered_paragraphs(F.col("text")).alias("n")).filter("n <> ''").select("doc_id", F.md5("n").alias("h"))


@query("TX17_page_chunks", "select page_id, 'page ' || page_id as title, md5(trim(html)) as text from pages where trim(html) <> ''")
def _(t):
    p = t.pages.filter((F.trim("html") != "") & ~T.is_blank_page(F.col("html")))
    return p.select("page_id", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.md5(F.trim("html")).alias("text"))


@query("TX18_citations", "select event_id, u.c as chapter, u.p as para from events, (select unnest([0, 1]) as k) x, lateral (select case when k = 0 then 5 else user_id::int end as c, case when k = 0 then '2-3' else '页' end as p) u")
def _(t):
    said = F.concat(F.lit("see 【《x》第 5 章 第 2-3 段】 and 【第 "), F.col("user_id").cast("string"), F.lit(" 页】 【第页】"))
    return t.events.select("event_id", F.explode(T.citations(said)).alias("c")).select("event_id", "c.chapter", "c.para")


@query("TX19_json_block", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def _(t):
    said = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return t.events.select("event_id", F.from_json(T.json_block(said), "k int")["k"].alias("k"))


@query("TX20_snippet", """
select doc_id, case when strpos(text, 'tion') > 0 then (case when strpos(text, 'tion') > 31 then '…' else '' end) || substr(text, greatest(1, strpos(text, 'tion') - 30), least(length(text), strpos(text, 'tion') + 33) - greatest(1, strpos(text, 'tion') - 30) + 1) || (case when strpos(text, 'tion') + 33 < length(text) then '…' else '' end) else left(text, 60) end as s from documents
""")
def _(t):
    return t.documents.select("doc_id", T.snippet(F.col("text"), "tion").alias("s"))


@query("TX21_search_words", r"""select item_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(text, '["*():^~+\-<>{}\[\]]', ' ', 'g')), '\s+'), lambda w: length(w) >= 3)[1:8], '|') as w from benchmark""")
def _(t):
    return t.benchmark.select("item_id", F.array_join(T.search_words(F.col("text")), "|").alias("w"))


@query("TX22_highlight", r"select item_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(tion|the)', '<mark>\1</mark>', 'g') as h from benchmark")
def _(t):
    return t.benchmark.select("item_id", T.highlight(F.col("text"), ["tion", "the"]).alias("h"))


@query("TX23_quote_position", r"select doc_id, strpos(regexp_replace(text, '\s+', ' ', 'g'), 'the of')::int as p from documents")
def _(t):
    return t.documents.select("doc_id", T.quote_position(F.col("text"), F.lit(" the \n of ")).alias("p"))


@query("TX24_plain_display", r"select item_id, '# ' || text as raw, text || ' b' as plain from benchmark")
def _(t):
    raw = F.concat(F.lit("# "), F.col("text"))
    return t.benchmark.select("item_id", raw.alias("raw"), T.strip_markdown(F.concat(raw, F.lit(" **b**"))).alias("plain"))


@query("TX26_first_meaningful", f"""
with t as (select doc_id, term, row_number() over (partition by doc_id order by count(*) desc, term) as rank from (select doc_id, unnest({Q.words('text')}) as term from documents) where term not in ({Q.STOP}) group by doc_id, term)
select doc_id, term from t qualify row_number() over (partition by doc_id order by case when term in ('tion', 'eau') then 0 when term in ('ung', 'des') then 1 when term not in ('les', 'sur') then 2 else 3 end, rank) = 1
""")
def _(t):
    c = O.term_counts(t.documents, ["doc_id"], "text", 1 << 30).withColumn("term", F.col("term"))
    level = F.when(F.col("term").isin("tion", "eau"), 0).when(F.col("term").isin("ung", "des"), 1).when(~F.col("term").isin("les", "sur"), 2).otherwise(3)
    return R.first_rows(c, ["doc_id"], [level, F.desc("n"), F.col("term")]).select("doc_id", "term")


@query("TX27_mask", "select c_custkey, left(c_name, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) as k, case when length(c_mktsegment) <= 8 then repeat('*', length(c_mktsegment)) else left(c_mktsegment, 3) || repeat('*', length(c_mktsegment) - 7) || right(c_mktsegment, 4) end as s from customer")
def _(t):
    return t.customer.select("c_custkey", T.mask_key(F.col("c_name")).alias("k"), T.mask_key(F.col("c_mktsegment")).alias("s"))


# every text ends with a character beyond the basic plane, which is two code units
TX28_UNITS = "flatten(list_transform(string_split({}, ''), lambda c: case when ord(c) > 65535 then [(55296 + (ord(c) - 65536) // 1024)::bigint, (56320 + (ord(c) - 65536) % 1024)::bigint] else [ord(c)::bigint] end))"


@query("TX28_hashes", f"""
with d as (select doc_id, text || chr(128214) as text from documents),
p as (select doc_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda x: x || ','), '') as paras from d)
select doc_id, sha256(text) as sha, list_reduce({TX28_UNITS.format("text")}, lambda h, c: (h * 31 + c) % 4294967296, 0::bigint) as h31,
  list_reduce({TX28_UNITS.format("paras")}, lambda h, c: (h * 33 + c) % 4294967296, 5381::bigint) as djb2 from p
""")
def _(t):
    d = t.documents.select("doc_id", F.concat("text", F.lit("\U0001f4d6")).alias("text"))
    return d.select("doc_id", F.sha2("text", 256).alias("sha"), T.rolling_hash(F.col("text"), 0, 31).alias("h31"), T.list_fingerprint(F.split("text", "\n", -1)).alias("djb2"))


@query("TX29_session_keys", "select conv_id, turn, role, case when turn > 0 then 'book:' || turn || ':' || role else 'global:' || conv_id end as k from conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", "role", T.session_key(F.when(F.col("turn") > 0, F.col("turn")), F.col("role"), F.col("conv_id")).alias("k"))


@query("TX30_unescape", "select page_id, length(replace(replace(html, '\"', '\\\"'), '\\\"', '\"'))::int as n from pages")
def _(t):
    return t.pages.select("page_id", F.length(T.unescape_quotes(F.replace("html", F.lit('"'), F.lit('\\"')))).alias("n"))


@query("TX31_theorem_lines", "select doc_id, pos, regexp_matches(line, '定理|定义|引理|推论|公理|命题|证明|Theorem|Definition|Lemma|Corollary|Axiom|Proposition|Proof') as theorem from " + LINES)
def _(t):
    return t.lines.select("doc_id", F.col("pos").cast("long").alias("pos"), T.is_theorem(F.col("line")).alias("theorem"))


@query("TX32_profile_prompt", """
with l as (select user_id, list(event_type order by ts, event_id) as e from events group by user_id)
select user_id, 'recent: ' || array_to_string(list_slice(e, -8, -1), '; ') || chr(10) || 'first: ' || array_to_string(list_transform(e[1:3], lambda x: left(x, 4)), ', ') as prompt from l
""")
def _(t):
    l = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    e = F.transform("l", lambda s: s["event_type"])
    first = F.transform(F.slice(e, 1, 3), lambda x: F.left(x, F.lit(4)))
    return l.select("user_id", F.concat(F.lit("recent: "), F.array_join(A.tail(e, 8), "; "), F.lit("\nfirst: "), F.array_join(first, ", ")).alias("prompt"))


@query("TX35_light_text", r"select doc_id, md5(left(string_agg('第' || pos || '章：' || line, chr(10) order by pos), 3000)) as h from " + LINES + " group by doc_id")
def _(t):
    line = F.concat(F.lit("第"), F.col("pos").cast("string"), F.lit("章："), F.col("line"))
    got = t.lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("l"))
    return got.select("doc_id", F.md5(F.left(F.array_join(F.transform("l", lambda s: s["l"]), "\n"), F.lit(3000))).alias("h"))


@query("TX36_new_material", "select conv_id, string_agg(left(text, 300), chr(10) order by turn, role, text) as t from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc, role desc, text desc) <= 20) group by conv_id")
def _(t):
    last = R.first_rows(t.conversations, ["conv_id"], [F.desc("turn"), F.desc("role"), F.desc("text")], 20)
    got = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    return got.select("conv_id", F.array_join(F.transform("l", lambda s: F.left(s["text"], F.lit(300))), "\n").alias("t"))


@query("TX37_context_blocks", "select q.page_id, string_agg('[' || p.page_id || '] ' || p.html, chr(10) order by p.page_id) as block from pages q join pages p on p.page_id between q.page_id - 1 and q.page_id + 1 group by q.page_id")
def _(t):
    q = t.pages.select(F.col("page_id").alias("q"), F.explode(F.sequence(F.col("page_id") - 1, F.col("page_id") + 1)).alias("page_id"))
    line = F.concat(F.lit("["), F.col("page_id").cast("string"), F.lit("] "), F.col("html"))
    got = q.join(t.pages, "page_id").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("page_id", line.alias("l")))).alias("l"))
    return got.select(F.col("q").alias("page_id"), F.array_join(F.transform("l", lambda s: s["l"]), "\n").alias("block"))


@query("TX39_cache_keys", "select event_type, count(*) as n from events where starts_with(event_type, 'p') or starts_with(event_type, 'v') group by all")
def _(t):
    gone = t.events.filter(~(F.startswith("event_type", F.lit("p")) | F.startswith("event_type", F.lit("v")))).select("event_id")
    return R.without(t.events, gone, ["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("TX40_lexicon_append", "select distinct trim(p_name) as term from part where p_name not in ('red widget', 'small ring')")
def _(t):
    lex = t.spark.createDataFrame([("red widget",)], "term string")
    generic = t.spark.createDataFrame([("small ring",)], "term string")
    return B.append_to_lexicon(lex, t.part.select(F.col("p_name").alias("term")), generic)


@query("TX41_profile_lines", "select user_id, array_to_string(list_slice(list(left(event_type || ':' || event_id, 80) order by ts, event_id), -3, -1), '; ') as lines from events group by user_id")
def _(t):
    line = F.left(F.concat_ws(":", "event_type", F.col("event_id").cast("string")), F.lit(80))
    got = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("l")))).alias("l"))
    return got.select("user_id", F.array_join(A.tail(F.transform("l", lambda s: s["l"]), 3), "; ").alias("lines"))


# without a twin: parsers and states ----------------------------------------------------------------------------


@query("TX9_profile_terms")
def _(t):
    lexicon, stop = frozenset(["tion", "eau", "ung"]), frozenset(T.STOPWORDS_ENGLISH + T.STOPWORDS_HAN)

    @F.pandas_udf("array<struct<term:string,w:double>>")
    def run(s):
        return s.map(lambda x: [{"term": a, "w": float(b)} for a, b in U.profile_terms(x, lexicon, stop, {"des": "du"})])

    return t.documents.select("doc_id", F.explode(run("text")).alias("t")).select("doc_id", "t.*")


@query("TX12_html_text")
def _(t):
    return t.pages.select("page_id", U.html_text_of(F.col("html")).alias("text"))


@query("TX13_scrub_html")
def _(t):
    return t.pages.select("page_id", U.scrub_of(F.col("html")).alias("html"))


@query("TX15_chunks", r"""
with recursive p as (select doc_id, trim(line, ' ' || chr(9) || chr(13)) as p, row_number() over (partition by doc_id order by pos) as n from """ + LINES + r""" where trim(line, ' ' || chr(9) || chr(13)) <> ''),
walk as (
  select doc_id, n, length(p) as s, 1::bigint as start from p where n = 1
  union all select p.doc_id, p.n, case when walk.s >= 400 then length(p.p) else walk.s + length(p.p) end, case when walk.s >= 400 then p.n else walk.start end from walk join p on p.doc_id = walk.doc_id and p.n = walk.n + 1
)
select doc_id, start || '-' || max(n) as para from walk group by doc_id, start
""")
def _(t):
    got = t.documents.select("doc_id", F.explode(U.chunks_of(F.col("text"), 400)).alias("c"))
    return got.select("doc_id", "c.para").filter("para <> '-'")


@query("TX16_packed")
def _(t):
    @F.pandas_udf("array<string>")
    def run(s):
        return s.map(lambda x: U.packed([f"[{k}]\n{b}" for k, (_, b) in enumerate(U.chunks(x, 400))], 1000))

    return t.documents.select("doc_id", F.posexplode(run("text")).alias("part", "block"))


@query("TX25_outline")
def _(t):
    @F.pandas_udf("array<struct<id:int,parent:int,depth:int,kind:string,name:string>>")
    def run(s):
        return s.map(lambda x: [dict(zip(("id", "parent", "depth", "kind", "name"), r, strict=True)) for r in U.outline(x)])

    return t.documents.select("doc_id", F.explode(run("text")).alias("n")).select("doc_id", "n.*")


@query("TX38_plain_text")
def _(t):
    books = t.documents.select(F.lit("md").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = t.pages.select(F.lit("epub").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return books.unionByName(pages).select("kind", "id", U.plain_text(F.col("kind"), F.col("text")).alias("text"))


# dates, numbers, arrays, maps, JSON ------------------------------------------------------------------------------


@query("DM1_timestamps", "select event_id, epoch_us(ts) as us, null::timestamp as bad from events")
def _(t):
    return t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.expr("try_to_timestamp(event_type)").cast("timestamp_ntz").alias("bad"))


@query("DM2_whole_days", "select event_id, floor((epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(ts)) / 86400000000.0)::bigint as days from events")
def _(t):
    return t.events.select("event_id", S.whole_days_since(F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("days"))


@query("DM3_fraction_days", "select event_id, round((epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(ts)) / 86400000000.0, 6)::double as days from events")
def _(t):
    return t.events.select("event_id", F.round(S.days_between(F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")), 6).alias("days"))


@query("DM4_ttl", "select event_id, ts + interval 7 day as expires, ts + interval 7 day <= timestamp '2024-01-20 00:00:00' as expired from events")
def _(t):
    at = F.col("ts") + F.expr("interval 7 day")
    return t.events.select("event_id", at.alias("expires"), (at <= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("expired"))


@query("DM5_rounding", "select o_orderkey, round(o_totalprice / 7, 6) as r from orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 7, 6).alias("r"))


@query("DM6_pace", "select l_orderkey, l_linenumber, l_partkey, round(2 + greatest(0.0, least(1.0, l_quantity / 5 / 7.0)) * 3)::int as warm, round(greatest(1.0, least(7.0, l_quantity / 5)))::int as review from lineitem")
def _(t):
    warm, review = S.pace(F.col("l_quantity") / 5)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", warm.alias("warm"), review.alias("review"))


@query("DM7_calibration", """
with s as (select o_custkey as u, count(*) as a, count_if(o_orderstatus = 'F') as g, count_if(o_orderstatus <> 'F') as i, max(o_totalprice) / 50000 as p from orders group by all),
x as (select u, (case when a >= 10 then 2.0 when a >= 5 then 1.0 when a >= 3 then 0.5 else 0.0 end + case when g >= 10 then 2.0 when g >= 5 then 1.0 when g >= 2 then 0.5 else 0.0 end + case when i >= 15 then 1.0 when i >= 8 then 0.5 else 0.0 end + case when p >= 8 then 1.0 when p >= 5 then 0.5 else 0.0 end)::double as score from s)
select u, score, case when score >= 4.5 then 'advanced' when score >= 2.0 then 'intermediate' else 'beginner' end as level from x
""")
def _(t):
    done = F.col("o_orderstatus") == "F"
    s = t.orders.groupBy(F.col("o_custkey").alias("u")).agg(F.count(F.lit(1)).alias("a"), F.count_if(done).alias("g"), F.count_if(~done).alias("i"), (F.max("o_totalprice") / 50000).alias("p"))
    score, level = S.calibration(F.col("a"), F.col("g"), F.col("i"), F.col("p"))
    return s.select("u", score.alias("score"), level.alias("level"))


@query("DM8_level_names", "select n_nationkey, case when n_regionkey < 2 then 'advanced' else 'beginner' end as level from nation")
def _(t):
    said = F.when(F.col("n_regionkey") < 2, "深入").otherwise("beginner")
    return t.nation.select("n_nationkey", S.knowledge_level(said).alias("level"))


@query("DM9_rhythm", "select c_custkey, case when count(o_orderkey) = 0 then 'start' when count(o_orderkey) < 3 then 'building' else 'stable' end as level from customer left join orders on o_custkey = c_custkey group by c_custkey")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", S.rhythm(F.coalesce("n", F.lit(0))).alias("level"))


@query("DM10_sizes", "select p_partkey, round(16 + least(24.0, 5 * log2(p_size + 1)), 6)::double as size, round(1 + greatest(0.0, least(1.0, p_size / 100.0)) * 3, 2)::double as width from part")
def _(t):
    return t.part.select("p_partkey", F.round(S.node_size(F.col("p_size")), 6).alias("size"), S.edge_width(F.col("p_size").cast("double")).alias("width"))


@query("DM11_arrays", "select doc_id, array_to_string(l[1:2], ',') as head, array_to_string(list_slice(l, -2, -1), ',') as last, list_contains(l, 'en') as has, array_to_string([l[1], l[3]], ',') as dropped from (select doc_id, [lang, source, 'x'] as l from documents)")
def _(t):
    l = F.array("lang", "source", F.lit("x"))
    return t.documents.select("doc_id", F.array_join(F.slice(l, 1, 2), ",").alias("head"), F.array_join(A.tail(l, 2), ",").alias("last"), F.array_contains(l, "en").alias("has"), F.array_join(A.drop_at(l, F.lit(1)), ",").alias("dropped"))


@query("DM12_maps", """
with m as (select user_id, event_type, count(*) as a, count_if(value > 50) as b from events group by all)
select user_id, string_agg(event_type || '=' || (a + b), ',' order by a + b desc, event_type) as top from (select * from m qualify row_number() over (partition by user_id order by a + b desc, event_type) <= 3) group by user_id
""")
def _(t):
    m = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("value") > 50).alias("b"))
    maps = m.groupBy("user_id").agg(*[F.map_from_entries(F.collect_list(F.struct("event_type", c))).alias(c) for c in ("a", "b")])
    top = A.top_entries(A.add_maps(F.col("a"), F.col("b")), 3)
    return maps.select("user_id", F.array_join(F.transform(top, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("top"))


@query("DM13_json", "select event_id, coalesce(cast(json_extract_string(props, '$.k') as int), 0) as k, '{\"k\":' || json_extract_string(props, '$.k') || '}' as canonical from events")
def _(t):
    k = F.from_json("props", "k INT")
    return t.events.select("event_id", F.coalesce(k["k"], F.lit(0)).alias("k"), F.to_json(k).alias("canonical"))


@query("DM14_skills", "select event_id, 'k' || json_extract_string(props, '$.k') as name, case when event_type = 'view' then event_type else '' end as applicable from events")
def _(t):
    from quillmill.functions.skills import normalized_skill

    name = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    raw = F.when(F.col("event_type") == "view", F.to_json(F.struct(name.alias("name"), F.col("event_type").alias("场景")))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    return t.events.select("event_id", normalized_skill(raw).alias("s")).select("event_id", "s.name", "s.applicable")


@query("DM15_truncate", "select doc_id, left(text, 200) as head, length(text)::int as n from documents")
def _(t):
    return t.documents.select("doc_id", F.left("text", F.lit(200)).alias("head"), F.length("text").alias("n"))


@query("DM16_smoothing", "select vec_id, i, round(avg(x) over (partition by vec_id order by i rows between 3 preceding and 3 following), 6) as s from (select vec_id, unnest(range(1, 65)) as i, unnest(embedding)::double as x from embeddings)")
def _(t):
    from pyspark.sql import Window as W

    v = t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "x"))
    w = W.partitionBy("vec_id").orderBy("p").rowsBetween(-3, 3)
    return v.select("vec_id", (F.col("p") + 1).cast("long").alias("i"), F.round(F.avg(F.col("x").cast("double")).over(w), 6).alias("s"))


# -- aggregations -------------------------------------------------------------------------------------------------


@query("AG1_term_counts", f"select doc_id, term, count(*) as n from (select doc_id, unnest({Q.words('text')}) as term from documents) where term not in ({Q.STOP}) group by doc_id, term qualify row_number() over (partition by doc_id order by count(*) desc, term) <= 200")
def _(t):
    return O.term_counts(t.documents, ["doc_id"], "text", 200).select("doc_id", "term", "n")


@query("AG2_weighted_terms", f"with {Q.TERMS} select doc, term, round(w, 6) as w, rank from vec")
def _(t):
    from quillmill.plans.graphs import vectors

    return vectors(t).select("doc", "term", F.round("w", 6).alias("w"), F.col("rank").cast("long").alias("rank"))


@query("AG3_alias_fold", f"with {Q.TERMS} select doc, case when term in ('des', 'les') then 'du' when term = 'tion' then 'eau' else term end as term, round(sum(w), 6) as w from vec group by all")
def _(t):
    from quillmill.plans.graphs import vectors

    alias = t.spark.createDataFrame([("DES", "du"), ("les", "du"), ("tion", "eau")], "alias string, canonical string")
    got = O.fold_aliases(vectors(t), ["doc"], "term", "w", alias)
    return got.select("doc", "term", F.round("w", 6).alias("w"))


@query("AG4_max_version", "select l_partkey, max(l_linenumber) as v from lineitem group by l_partkey")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.max("l_linenumber").alias("v"))


@query("AG5_scalars", "select count(*) as n, max(l_orderkey) as top, round(sum(l_quantity), 2) as s, coalesce(max(case when l_quantity > 1000 then 1 end), 0) as c from lineitem")
def _(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("top"), F.round(F.sum("l_quantity"), 2).alias("s"), F.coalesce(F.max(F.when(F.col("l_quantity") > 1000, 1)), F.lit(0)).alias("c"))


@query("AG6_min_per_pair", "select l_partkey, l_suppkey, min(l_orderkey) as first from lineitem group by all")
def _(t):
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first"))


@query("AG7_conditional_counts", "select user_id, count_if(event_type = 'view')::bigint as views, count_if(event_type = 'error')::bigint as errors, count(distinct event_type) as kinds, count(*) as n from events group by all")
def _(t):
    k = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.count_if(k == "view").alias("views"), F.count_if(k == "error").alias("errors"), F.count_distinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n"))


@query("AG8_document_frequency", f"select term, count(*) as df from (select distinct doc_id, unnest({Q.words('text')}) as term from documents) group by term")
def _(t):
    return t.documents.select(F.explode(F.array_distinct(T.raw_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("AG9_coverage", f"with {Q.TERMS} select term, count(distinct doc) as docs, round(sum(w), 6) as w from vec group by term")
def _(t):
    from quillmill.plans.graphs import vectors

    return vectors(t).groupBy("term").agg(F.count_distinct("doc").alias("docs"), F.round(F.sum("w"), 6).alias("w"))


@query("AG10_weak_concepts", f"""
with n as (select conv_id, turn, term, count(*) as n from (select conv_id, turn, unnest({Q.words('text')}) as term from conversations where role = 'user') where term not in ({Q.STOP}) group by conv_id, turn, term
  qualify row_number() over (partition by conv_id, turn order by count(*) desc, term) <= 10)
select term, count(*) as notes from n group by term order by notes desc, term limit 3
""")
def _(t):
    per = O.term_counts(t.notes, ["book", "note"], "text", 10)
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("notes")).orderBy(F.desc("notes"), "term").limit(3)


@query("AG11_map_accumulation", "select user_id, string_agg(event_type || ':' || n, ',' order by event_type) as m from (select user_id, event_type, count(*) as n from events group by all) group by user_id")
def _(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    parts = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return m.select("user_id", F.array_join(parts, ",").alias("m"))


@query("AG12_preferences", f"""
with per as (select doc_id, term, count(*) as n from (select doc_id, unnest({Q.words('text')}) as term from documents) where term not in ({Q.STOP}) group by doc_id, term qualify row_number() over (partition by doc_id order by count(*) desc, term) <= 15)
select term, sum(n)::bigint as score from per group by term order by score desc, term limit 60
""")
def _(t):
    return O.preferences(t.documents, "doc_id", "text")[0]


@query("AG13_coverage_rate", f"""
with p as (select unnest(['tion', 'eau', 'the', 'ung', 'los']) as term), d as (select distinct doc_id as node, unnest({Q.words('text')}) as term from documents),
k as (select distinct node from d)
select k.node, round(count(p.term) / 5.0, 6)::double as rate from k left join d on d.node = k.node left join p on p.term = d.term group by k.node
""")
def _(t):
    from quillmill.operators.profile import overlap_rate

    p = t.spark.createDataFrame([(x,) for x in ("tion", "eau", "the", "ung", "los")], "term string")
    d = t.documents.select(F.col("doc_id").alias("node"), F.explode(F.array_distinct(T.raw_words(F.col("text")))).alias("term"))
    return overlap_rate(d, p).select("node", F.round("rate", 6).alias("rate"))


@query("AG14_asset_brief", "select source, max(n_chars) as version, bool_or(lang = 'en') as has_rag, bool_or(lang = 'xx') as has_skill, max(case when lang = 'en' then left(text, 200) end) as summary, count(*) - 1 as merged from documents group by source")
def _(t):
    en = F.col("lang") == "en"
    return t.documents.groupBy("source").agg(F.max("n_chars").alias("version"), F.bool_or(en).alias("has_rag"), F.bool_or(F.col("lang") == "xx").alias("has_skill"), F.max(F.when(en, F.left("text", F.lit(200)))).alias("summary"), (F.count(F.lit(1)) - 1).alias("merged"))


@query("AG15_quantiles", """
with o as (select user_id, value, row_number() over (partition by user_id order by value) - 1 as at_, count(*) over (partition by user_id) as n from events)
select user_id, max(case when at_ = least(n - 1, floor(n * 0.25)) then value end) as low, max(case when at_ = n // 2 then value end) as median, max(n) as n from o group by user_id
""")
def _(t):
    low = R.lower_quantile(t.events, ["user_id"], "value", 0.25).withColumnRenamed("quantile", "low")
    return low.join(R.lower_quantile(t.events, ["user_id"], "value", 0.5).select("user_id", F.col("quantile").alias("median")), "user_id").select("user_id", "low", "median", "n")


@query("AG16_shelf_stats", "select lang, count(*) as total, count_if(n_chars > 3000)::bigint as done, string_agg(distinct source, ',' order by source) as tags from documents group by lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_chars") > 3000).alias("done"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("tags"))


@query("AG17_preview_merge", f"""
with a as (select term, count(*) as n from (select unnest({Q.words('text')}) as term from documents union all select unnest({Q.words('text')}) from benchmark) group by term)
select term, n from a order by n desc, term limit 12
""")
def _(t):
    w = lambda df: df.select(F.explode(T.raw_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    both = w(t.documents).unionByName(w(t.benchmark))
    return both.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(12)


@query("AG18_page_status", """
with w as (select conv_id as doc, turn as idx from conversations), c as (select distinct conv_id as doc, turn as idx from conversations where role = 'user')
select w.doc, count(*) as pages, count(c.idx) as cached, coalesce(string_agg(case when c.idx is null then w.idx end, ',' order by w.idx), '') as missing from w left join c on c.doc = w.doc and c.idx = w.idx group by w.doc
""")
def _(t):
    w = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"))
    c = t.conversations.filter("role = 'user'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"))
    got = B.page_status(w, c)
    return got.select("doc", "pages", "cached", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("AG19_cube_ext", """
select l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) as g, count(*) as n, round(sum(l_quantity), 2) as q, count(distinct l_suppkey) as s from lineitem group by cube (l_returnflag, l_linestatus)
""")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.count_distinct("l_suppkey").alias("s"))


@query("AG19_rollup_ext", "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as p from orders group by rollup (o_orderstatus, o_orderpriority)")
def _(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("p"))
