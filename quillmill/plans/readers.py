"""Search, retrieval, reader profiles, event windows and further joins over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import profile as P
from quillmill.operators import relational as R
from quillmill.operators import retrieval as V
from quillmill.operators import search as X
from quillmill.operators import terms as O
from quillmill.plans import sqltext as Q
from quillmill.plans.registry import query
from quillmill.streaming import jobs as J

L_ = r"(select doc_id, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) as pos, unnest(string_split_regex(text, '\r?\n')) as line from documents)"


@query("FT1_trigram_match", "select doc_id from documents where contains(lower(text), 'tion') and contains(lower(text), 'the')")
def _(t):
    low = F.lower("text")
    return t.documents.filter(F.contains(low, F.lit("tion")) & F.contains(low, F.lit("the"))).select("doc_id")


@query("FT1_trigram_index", "select gram, count(*) as docs from (select distinct doc_id, substr(lower(text), i, 3) as gram from documents, lateral (select unnest(range(1, length(text) - 1)) as i) where length(text) >= 3) group by gram")
def _(t):
    return X.trigram_index(t.documents, "doc_id", "text").groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))


BM = " + ".join(
    f"ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5)) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / mean))" for k in range(3)
)


@query("FT2_bm25", f"""
with b as (select doc_id, greatest(length(text) - 2, 0)::double as len, {", ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)})::double as f{k}" for k, w in enumerate(("tionth", "eauen", "schung")))} from documents),
s as (select count(*) as n, avg(len) as mean, {", ".join(f"count_if(f{k} > 0) as d{k}" for k in range(3))} from b)
select doc_id, round({BM}, 6)::double as score from b, s where f0 > 0 or f1 > 0 or f2 > 0 order by score desc, doc_id limit 100
""")
def _(t):
    return X.bm25(t.documents, "doc_id", "text", ["tionth", "eauen", "schung"], 100)


@query("FT3_like", "select doc_id, case when strpos(text, 'gs') > 0 then (case when strpos(text, 'gs') > 31 then '…' else '' end) || substr(text, greatest(1, strpos(text, 'gs') - 30), least(length(text), strpos(text, 'gs') + 31) - greatest(1, strpos(text, 'gs') - 30) + 1) || (case when strpos(text, 'gs') + 31 < length(text) then '…' else '' end) else left(text, 60) end as snippet from documents where text ilike '%gs%' order by doc_id limit 50")
def _(t):
    return X.like_search(t.documents, "doc_id", "text", "gs", 50)


@query("FT4_index_upkeep", """
with g as (select distinct item_id, substr(lower(text), i, 3) as gram from benchmark, lateral (select unnest(range(1, length(text) - 1)) as i) where item_id >= 5),
n as (select distinct 1000 + c.n_nationkey as item_id, substr(lower(n_name), i, 3) as gram from nation c, lateral (select unnest(range(1, length(n_name) - 1)) as i))
select item_id, gram from g union all select item_id, gram from n
""")
def _(t):
    index = X.trigram_index(t.benchmark, "item_id", "text")
    gone = t.benchmark.filter("item_id < 5").select("item_id")
    new = t.nation.select((F.col("n_nationkey") + 1000).cast("long").alias("item_id"), F.col("n_name").alias("text"))
    return X.maintain_index(index, gone, new, "item_id", "text").select("item_id", "gram")


@query("JN11_substring_join", rf"""
with q as (select p_name, unnest(list_distinct(regexp_extract_all(p_name, '[A-Za-z][A-Za-z0-9_]*'))) as token from (select distinct p_name from part))
select p_name, page_id, count(*) as score from q join pages on contains(html, token) group by all
""")
def _(t):
    q = t.part.select("p_name", F.col("p_name").alias("question")).distinct()
    got = V.chunk_scores(q, "p_name", "question", t.pages.withColumn("pos", F.lit(0)), "page_id", "pos", "html")
    return got.select("p_name", "page_id", "score")


@query("JN12_lexicon_hits", r"""
with lex as (select unnest(['tion', 'the of', 'eau', 'Is', 'los']) as term)
select doc_id, term from documents join lex on regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9\-]' || lower(term) || '[^a-z0-9\-]')
""")
def _(t):
    lex = t.spark.createDataFrame([(x,) for x in ("tion", "the of", "eau", "Is", "los")], "term string")
    return O.lexicon_hits(t.documents, "doc_id", "text", lex)


Q_TOKENS = "tok as (select item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*'))) as token from benchmark)"


@query("TK7_top_chunks", f"""
with {Q_TOKENS}, s as (select item_id, conv_id, turn, count(*) as score from tok join conversations on contains(text, token) where role = 'assistant' group by all)
select item_id, conv_id, turn, score from s qualify row_number() over (partition by item_id order by score desc, conv_id, turn) <= 4
""")
def _(t):
    c = t.conversations.filter("role = 'assistant'")
    return V.best_chunks(t.benchmark, "item_id", "text", c, "conv_id", "turn", "text", 4)


@query("TK8_top_skills", """
with s as (select source, doc_id, (contains(text, 'schung')::int + contains(text, 'eauen')::int) as score from documents), m as (select *, max(score) over (partition by source) as top from s)
select source, doc_id, score from m where top = 0 or score > 0 qualify row_number() over (partition by source order by case when top > 0 then -score else 0 end, doc_id) <= 8
""")
def _(t):
    score = F.contains("text", F.lit("schung")).cast("int") + F.contains("text", F.lit("eauen")).cast("int")
    return V.hits_or_first(t.documents.select("source", "doc_id", score.alias("score")), "source", "score", "doc_id", 8)


@query("TK9_top_books", "with s as (select source, doc_id, (contains(text, 'the')::int + contains(text, 'des')::int) as score from documents) select source, doc_id, score from s qualify row_number() over (partition by source order by score desc, doc_id) <= 3")
def _(t):
    score = F.contains("text", F.lit("the")).cast("int") + F.contains("text", F.lit("des")).cast("int")
    return R.first_rows(t.documents.select("source", "doc_id", score.alias("score")), ["source"], [F.desc("score"), F.col("doc_id")], 3)


@query("TK11_catalog", """
with d as (select doc_id, case when lang = 'es' then '' else source end as domain, text from documents), p as (select source as domain, avg(n_chars) / 1000 as score from documents where lang = 'de' group by source),
f as (select d.domain, min(doc_id) as first, max(floor(coalesce(p.score, 0))) as liked from d left join p on p.domain = d.domain group by d.domain)
select row_number() over (order by case when d.domain = '' then 1 else 0 end, liked desc, first, doc_id) as place, d.domain, doc_id as doc, left(text, 60) as summary from d join f on f.domain = d.domain order by 1 limit 150
""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("doc"), F.when(F.col("lang") == "es", "").otherwise(F.col("source")).alias("domain"), "text")
    p = t.documents.filter("lang = 'de'").groupBy(F.col("source").alias("domain")).agg((F.avg("n_chars") / 1000).alias("score"))
    return V.catalog(d, p).withColumn("place", F.col("place").cast("long"))


@query("PR1_relatedness", """
with e as (select a.l_suppkey as node, max(least(100, a.l_quantity * 2)) as edge from lineitem a group by a.l_suppkey)
select s_suppkey as node, greatest(0, least(100, greatest(round(edge), round(50 * (s_nationkey / 25.0) + 50 * 0.2))))::double as base,
(case when s_nationkey = 3 then greatest(60, least(100, greatest(round(edge), round(50 * (s_nationkey / 25.0) + 10)))) else greatest(0, least(100, greatest(round(edge), round(50 * (s_nationkey / 25.0) + 10)))) end)::double as score from supplier join e on e.node = s_suppkey
""")
def _(t):
    e = t.lineitem.groupBy(F.col("l_suppkey").alias("node")).agg(F.max(F.least(F.lit(100.0), F.col("l_quantity") * 2)).alias("edge"))
    s = t.supplier.withColumnRenamed("s_suppkey", "node").join(e, "node")
    warm = F.col("s_nationkey") / 25.0
    base, _ = P.relatedness(F.col("edge"), warm, F.lit(0.2), F.lit(False), F.lit(60.0))
    score, _ = P.relatedness(F.col("edge"), warm, F.lit(0.2), F.col("s_nationkey") == 3, F.lit(60.0))
    return s.select("node", base.alias("base"), score.alias("score"))


@query("PR2_hot_profile", """
with x as (select *, floor(value / 25)::bigint as book from events), r as (select *, case when book is not distinct from lag(book) over w then 0 else 1 end as new from x window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as run from r), l as (select * from s qualify run = max(run) over (partition by user_id))
select user_id, max(book) as book, count_if(event_type = 'view')::bigint as opened, count_if(event_type = 'click')::bigint as highlights, count_if(event_type = 'error')::bigint as questions from l group by user_id
""")
def _(t):
    x = t.events.withColumn("book", F.floor(F.col("value") / 25).cast("long"))
    return P.hot_profile(x, "user_id", "ts", "event_id", "book", "event_type", "props")


def archives(t):
    k = F.get_json_object("props", "$.k")
    terms = F.array(F.concat(F.lit("k"), k), F.col("event_type"))
    return t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("key"), F.floor("value").cast("long").alias("book"), terms.alias("terms"))


@query("PR3_profile_fold")
def _(t):
    return P.fold_profiles(archives(t))


@query("PR4_refresh", """
with r as (select user_id, 'k' || json_extract_string(props, '$.k') as term, count(*) as n from events group by user_id, 'k' || json_extract_string(props, '$.k'))
select user_id as "user", term from r qualify row_number() over (partition by user_id order by n desc, term) <= 10
""")
def _(t):
    r = t.events.select(F.col("user_id").alias("user"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("term"))
    prefs = r.groupBy("user", "term").agg(F.count(F.lit(1)).alias("score"))
    return P.refreshed(r, prefs, prefs.select("user", F.lit("kx").alias("term")).distinct())[1]


@query("PR5_manual_edit", r"select c_custkey, greatest(1, least(10, round(c_acctbal / 500)))::double as score, trim(regexp_replace(c_name, '[^\p{L}\p{M}\p{N}_]+', ' ', 'g')) as name from customer where trim(c_name) <> ''")
def _(t):
    got = t.customer.select("c_custkey", R.clip(F.round(F.col("c_acctbal") / 500), 1.0, 10.0).alias("score"), T.clean_profile_name(F.col("c_name")).alias("name"))
    return got.filter("name <> ''")


@query("PR6_thresholds", """
with g as (select user_id, ts, event_id, round((epoch_us(ts) - epoch_us(lag(ts) over w)) / 86400000000.0, 2)::double as days from events where event_type = 'purchase' window w as (partition by user_id order by ts, event_id)),
s as (select user_id as "user", days from g qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 24),
n as (select "user", count(*) as samples from s group by "user"),
m as (select "user", days as median from (select "user", days, row_number() over (partition by "user" order by days) - 1 as at_, count(*) over (partition by "user") as n from s where days is not null) where at_ = least(n - 1, floor(n * 0.5))),
q as (select user_id as "user", value as score, row_number() over (partition by user_id order by value) - 1 as at_, count(*) over (partition by user_id) as n from events where event_type = 'view'),
c as (select user_id as "user", value as score, row_number() over (partition by user_id order by value) - 1 as at_, count(*) over (partition by user_id) as n from events where event_type = 'click'),
s1 as (select "user", round(greatest(45.0, least(60.0, score)), 1) as s1 from q where at_ = least(n - 1, floor(n * 0.25)) and n >= 6), s2 as (select "user", round(greatest(45.0, least(60.0, score)), 1) as s2 from c where at_ = least(n - 1, floor(n * 0.25)) and n >= 3)
select n."user", case when samples >= 6 and median is not null then round(median, 2) end as median, case when samples >= 6 then round(2 + greatest(0.0, least(1.0, median / 7.0)) * 3)::int end as warm, case when samples >= 6 then round(greatest(1.0, least(7.0, median)))::int end as review, least(s1, s2)::double as strength
from n left join m on m."user" = n."user" left join s1 on s1."user" = n."user" left join s2 on s2."user" = n."user"
""")
def _(t):
    s = P.intervals(t.events.filter("event_type = 'purchase'"), "user_id", "ts", "event_id").select(F.col("user_id").alias("user"), "days")
    score = lambda k: t.events.filter(F.col("event_type") == k).select(F.col("user_id").alias("user"), F.col("value").alias("score"))
    return P.learn_thresholds(s, score("view"), score("click"))


@query("PR7_recommendations", """
with l as (select user_id, max(ts) as at_ from events where event_type = 'purchase' group by user_id), e as (select user_id, count_if(event_type = 'error')::bigint as unclear, count_if(event_type = 'purchase') as archived from events group by user_id)
select e.user_id, unclear, greatest(0, floor((epoch_us(timestamp '2024-02-10 00:00:00') - epoch_us(at_)) / 86400000000.0))::bigint as days, floor((epoch_us(timestamp '2024-02-10 00:00:00') - epoch_us(at_)) / 86400000000.0) >= 14 as due,
case when archived = 0 then 'start' when archived < 3 then 'building' else 'stable' end as rhythm from e left join l on l.user_id = e.user_id
""")
def _(t):
    from quillmill.functions.scalar import rhythm

    k = F.col("event_type")
    e = t.events.groupBy("user_id").agg(F.count_if(k == "error").alias("unclear"), F.count_if(k == "purchase").alias("archived"), F.max(F.when(k == "purchase", F.col("ts"))).alias("at"))
    days, due = P.due(F.col("at"), F.lit("2024-02-10 00:00:00").cast("timestamp"), F.lit(14))
    return e.select("user_id", "unclear", F.when(F.col("at").isNotNull(), days).otherwise(0).alias("days"), due.alias("due"), rhythm(F.col("archived")).alias("rhythm"))


@query("PR8_fallback", """
with c as (select user_id as "user", max_by(event_id, (ts, event_id)) as doc from events group by user_id), r as (select user_id as "user", event_id as doc, ts as at_ from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts, event_id) <= 3),
n as (select user_id as "user", event_id as doc, value as strength from events where event_type = 'view'),
a as (select "user", doc, 0 as p, 0.0::double as o from c union all select "user", doc, 1, epoch_us(at_)::double from r union all select "user", doc, 2, -strength from n),
k as (select a.* from a where doc in (select event_id from events where value > 5)), once as (select * from k qualify row_number() over (partition by "user", doc order by p, o) = 1)
select "user", doc, row_number() over (partition by "user" order by p, o, doc)::int as place from once qualify row_number() over (partition by "user" order by p, o, doc) <= 3
""")
def _(t):
    e = t.events.withColumnRenamed("user_id", "user").withColumnRenamed("event_id", "doc")
    c = e.groupBy("user").agg(F.max_by("doc", F.struct("ts", "doc")).alias("doc"))
    r = e.filter("event_type = 'purchase'").select("user", "doc", F.col("ts").alias("at"))
    n = e.filter("event_type = 'view'").select("user", "doc", F.col("value").alias("strength"))
    return V.fallback_selection(c, r, n, e.filter("value > 5").select("doc"))


@query("PR9_validation", """
with ch as (select user_id as "user", floor(value)::bigint as doc, min(event_id) as pos from events group by all), k as (select c_custkey as doc from customer where c_acctbal > 0),
cur as (select "user", max(doc) as doc from ch group by "user"), g as (select ch.*, (cur.doc is not null)::int as c from ch join k on k.doc = ch.doc left join cur on cur."user" = ch."user" and cur.doc = ch.doc)
select "user", doc, row_number() over (partition by "user" order by c desc, pos)::int as place from g qualify row_number() over (partition by "user" order by c desc, pos) <= 3
""")
def _(t):
    ch = t.events.select(F.col("user_id").alias("user"), F.floor("value").cast("long").alias("doc"), F.col("event_id").alias("pos"))
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("doc"))
    return V.validated_selection(ch, known, ch.groupBy("user").agg(F.max("doc").alias("doc")))


@query("PR10_domain_label", "select doc_id, coalesce(case when lang <> 'en' then lang end, case when source < 'src5' then source end, 'none') as label from documents")
def _(t):
    return t.documents.select("doc_id", F.coalesce(F.when(F.col("lang") != "en", F.col("lang")), F.when(F.col("source") < "src5", F.col("source")), F.lit("none")).alias("label"))


@query("PR11_hydration", f"""
with t as (select doc_id, term from (select doc_id, unnest({Q.words('text')}) as term from documents) where term not in ({Q.STOP}) group by doc_id, term qualify row_number() over (partition by doc_id order by count(*) desc, term) <= 40)
select doc_id, array_to_string(list(term order by term)[1:40], ',') as terms from t where term not in ('tion', 'eau') group by doc_id
""")
def _(t):
    top = O.term_counts(t.documents, ["doc_id"], "text", 40)
    old = t.spark.createDataFrame([("tion",), ("eau",)], "term string")
    got = R.without(top, old, ["term"]).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("term")), 1, 40).alias("t"))
    return got.select("doc_id", F.array_join("t", ",").alias("terms"))


# -- event time, batch twins of the streams ------------------------------------------------------------------------


@query("SM8_tumbling_ext", "select time_bucket(interval 1 hour, ts) as start, event_type as kind, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(t):
    got = J.windowed_counts(t.events, size="1 hour")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))


@query("SM8_sliding_ext", "select time_bucket(interval 15 minute, ts) - k.o * interval 15 minute as start, event_type as kind, count(*) as n, round(sum(value), 4) as total from events, (select unnest([0, 1, 2, 3]) as o) k group by all")
def _(t):
    got = J.windowed_counts(t.events, size="1 hour", slide="15 minutes")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))


@query("SM8_sessions_ext", """
with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id as "user", min(ts) as start, max(ts) + interval 6 hour as end_, count(*) as n from s group by user_id, k
""")
def _(t):
    got = J.sessions(t.events, "6 hours")
    return got.select("user", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end_"), "n")


@query("SM1_assembled", "select conv_id as stream_key, count(*) as n, md5(string_agg(text, '' order by turn, role, text)) as h from conversations group by conv_id")
def _(t):
    got = t.conversations.groupBy(F.col("conv_id").alias("stream_key")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    return got.select("stream_key", "n", F.md5(F.array_join(F.transform("l", lambda s: s["text"]), "")).alias("h"))


@query("SM5_ttl_capacity", """
with c as (select * from events where ts > (select max(ts) from events) - interval 10 day) select user_id, event_id from c qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 15
""")
def _(t):
    top = t.events.agg(F.max("ts").alias("top"))
    live = t.events.join(F.broadcast(top), F.col("ts") > F.col("top") - F.expr("interval 10 day"))
    return R.first_rows(live, ["user_id"], [F.desc("ts"), F.desc("event_id")], 15).select("user_id", "event_id")


@query("SM6_reading_progress", "select user_id, max_by(value, (ts, event_id)) as position, max(ts) as updated from events group by user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("position"), F.max("ts").alias("updated"))


@query("SM7_task_dedupe", "select user_id, event_type, min(event_id) as task from events where ts >= timestamp '2024-01-20' group by all")
def _(t):
    return t.events.filter("ts >= timestamp_ntz'2024-01-20 00:00:00'").groupBy("user_id", "event_type").agg(F.min("event_id").alias("task"))


@query("JN_asof_ext", """
select p.event_id, max_by(v.event_id, (v.ts, v.event_id)) as before from (select * from events where event_type = 'purchase') p left join (select * from events where event_type = 'view') v on v.user_id = p.user_id and v.ts <= p.ts group by p.event_id
""")
def _(t):
    # one sort by user and time for both sides, no join: the last view seen so far
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = t.events.filter(F.col("event_type").isin("view", "purchase"))
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    got = e.withColumn("before", F.last_value(view, ignoreNulls=True).over(w)).filter("event_type = 'purchase'")
    return got.select("event_id", "before")


@query("JN_interval_ext", "select o.o_orderkey, count(*) as n from orders o join lineitem l on l.l_orderkey = o.o_orderkey and l.l_shipdate between o.o_orderdate and o.o_orderdate + interval 400 day group by all")
def _(t):
    l = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    inside = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 400 day"))
    return t.orders.join(l, "o_orderkey").filter(inside).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


# -- with a model as an option, and details ------------------------------------------------------------------------


@query("LM1_pair_scoring", """
with d as (select distinct l_suppkey as i, l_partkey as k from lineitem), p as (select a.i as a, b.i as b, count(*)::double as strength from d a join d b on a.k = b.k and a.i < b.i group by all)
select a, b, round(strength, 1)::double as strength, '无' as direction, '概念共现' as relation from p order by strength desc, a, b limit 40
""")
def _(t):
    from quillmill.operators.models import score_pairs

    p = R.shared_key_pairs(t.lineitem, "l_suppkey", "l_partkey", 1)
    got = score_pairs(p.select("a", "b", F.col("shared").cast("double").alias("strength"), F.array(F.lit("parts")).alias("reasons")))
    return got.select("a", "b", "strength", "direction", "relation")


# a stand-in answers with a prompt's beginning and fails on lengths divisible by 7
@query("LM2_summaries", """
with b as (select doc_id, k, substr(text, k * 65536 + 1, 65536) as part from (select doc_id, text, unnest(range(0, (length(text) - 1) // 65536 + 1)) as k from documents where length(text) > 0)),
r as (select doc_id, k, case when length(part) % 7 <> 0 then left(part, 40) end as reply from b),
g as (select doc_id, count(*) as blocks, list(k::int order by k) filter (where reply is null) as failed, string_agg(reply, chr(10) order by k) as said from r group by doc_id),
w as (select *, said || case when failed is null then '' else chr(10) || '[missing: ' || array_to_string(failed, ',') || ']' end as whole from g)
select doc_id, blocks, array_to_string(coalesce(failed, []), ',') as failed, case when blocks = 1 then said when length(whole) % 7 <> 0 then left(whole, 40) else whole end as summary from w
union all select doc_id, 0, '', null from documents where coalesce(length(text), 0) = 0
""")
def _(t):
    from quillmill.operators.models import Echo, summarised

    got = summarised(t.documents, "doc_id", "text", Echo(40, 7))
    return got.select("doc_id", "blocks", F.array_join(F.col("failed").cast("array<string>"), ",").alias("failed"), "summary")


@query("LM5_transcription", """
select page_id, case when length(coalesce(html, '')) % 11 = 0 then 'new' else 'cached' end as status, case when length(coalesce(html, '')) % 11 = 0 then 'again: ' else '' end || left(coalesce(html, ''), 60) as transcript,
  (select count(distinct html) from pages) as prompts, (select count(distinct coalesce(html, '')) from pages where length(coalesce(html, '')) % 11 = 0) as failed_first
from pages
""")
def _(t):
    """Twice over all pages: what failed at first is asked for again, nothing else is."""
    from quillmill.operators.models import Echo, cached, transcribe
    from quillmill.storage import expire, fresh_path

    cache = fresh_path(t.spark, "transcription-cache")
    expire(t.spark, cache)
    transcribe(t.pages, "html", Echo(60, 11), cache)
    again = transcribe(t.pages, "html", Echo(60, 0, "again: "), cache)
    texts, lost = cached(t.spark, cache).agg(F.count(F.lit(1)).alias("prompts")), cached(t.spark, cache, "failed").agg(F.count_distinct("digest").alias("failed_first"))
    return again.select("page_id", "status", "transcript").crossJoin(F.broadcast(texts)).crossJoin(F.broadcast(lost))


@query("RD5_book_detail", """
with l as (select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as last, count(*) as n, count_if(o_orderstatus = 'F')::bigint as read from orders group by o_custkey)
select c_custkey, c_name, coalesce(n, 0) as n, coalesce(read, 0) as read, last, coalesce(round(read * 100.0 / n), 0)::bigint as percent from customer left join l on o_custkey = c_custkey
""")
def _(t):
    l = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("read"))
    zero = F.lit(0)
    return t.customer.join(l, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", zero).alias("n"), F.coalesce("read", zero).alias("read"), "last", F.coalesce(F.round(F.col("read") * 100.0 / F.col("n")), F.lit(0.0)).cast("long").alias("percent"))


@query("SC1_format_dispatch", "select p_partkey, case when p_size < 20 then 'md' when p_size < 30 then 'epub' when p_size < 40 then 'pdf' else 'txt' end as format from part")
def _(t):
    from quillmill.sources.books import book_format

    suffix = F.when(F.col("p_size") < 10, ".md").when(F.col("p_size") < 20, ".MARKDOWN").when(F.col("p_size") < 30, ".epub").when(F.col("p_size") < 40, ".pdf").otherwise(".txt")
    return t.part.select("p_partkey", book_format(F.concat("p_name", suffix)).alias("format"))


@query("SC4_decoding", r"""
with a as (select doc_id, text, regexp_replace(text, '[^\x00-\x7f]', '', 'g') as plain from documents)
select doc_id, case doc_id % 3 when 1 then plain || ' caf' || chr(233) || ' ' when 2 then plain || chr(20013) || chr(25991) else text end as text from a
""")
def _(t):
    """Texts as files of three kinds: UTF-8, Latin-1 (a word that is neither UTF-8 nor GBK) and GBK (two characters)."""
    from quillmill.sources.books import decoded

    plain = F.encode(F.regexp_replace("text", r"[^\x00-\x7f]", ""), "UTF-8")
    latin, gbk = F.unhex(F.lit("20636166E920")), F.unhex(F.lit("D6D0CEC4"))
    kind = F.col("doc_id") % 3
    raw = F.when(kind == 1, F.concat(plain, latin)).when(kind == 2, F.concat(plain, gbk)).otherwise(F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", decoded(raw).alias("text"))


@query("TK6_first_seen_ties", f"""
with w as (select doc_id, unnest({Q.words('text')}) as term, unnest(range(0, len({Q.words('text')}))) as p from documents),
k as (select doc_id, term, row_number() over (partition by doc_id order by p) - 1 as p from w where term not in ({Q.STOP}))
select doc_id, term, count(*) as n, min(p)::int as seen from k group by doc_id, term qualify row_number() over (partition by doc_id order by count(*) desc, min(p)) <= 30
""")
def _(t):
    return O.first_seen_counts(t.documents, ["doc_id"], "text", 30).select("doc_id", "term", "n", "seen")


@query("WN5_adjacent_edges", "select doc_id, pos as a, lead(pos) over (partition by doc_id order by pos) as b from " + L_ + " where length(line) > 200 qualify b is not null")
def _(t):
    w = W.partitionBy("doc_id").orderBy("pos")
    got = t.lines.filter(F.length("line") > 200).select("doc_id", F.col("pos").cast("long").alias("a"), F.lead(F.col("pos").cast("long")).over(w).alias("b"))
    return got.filter("b is not null")


@query("WN8_top_per_group", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 3")
def _(t):
    got = R.first_rows(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, rank="rank")
    return got.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("WN9_group_maximum", "select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem qualify l_quantity >= max(l_quantity) over (partition by l_suppkey) - 0.01")
def _(t):
    got = t.lineitem.withColumn("_m", F.max("l_quantity").over(W.partitionBy("l_suppkey")))
    return got.filter(F.col("l_quantity") >= F.col("_m") - 0.01).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("TX1_split_by_headings", r"""
with h as (select *, regexp_matches(line, '!') as head from """ + L_ + r"""), s as (select *, sum(head::int) over (partition by doc_id order by pos) as sec from h),
b as (select doc_id, sec, max(case when head then line end) as title, trim(string_agg(case when not head then line end, chr(10) order by pos), ' ' || chr(9) || chr(10) || chr(13)) as body from s group by doc_id, sec)
select doc_id, row_number() over (partition by doc_id order by sec) as idx, md5(coalesce(title, '')) as title, length(body)::int as n from b where body <> ''
""")
def _(t):
    from quillmill.operators.sections import sections

    got = sections(t.lines, "doc_id", "pos", "line", F.contains("line", F.lit("!")), F.col("line"))
    return got.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("title").alias("title"), F.length("body").alias("n"))


@query("PR12_search", "select doc_id from documents where contains(lower(text), 'schungen') order by doc_id")
def _(t):
    return X.search(t.documents, "doc_id", "text", '"schungen" (of)', 1 << 30).select("doc_id")


@query("FT5_switched_off", "select doc_id, 0.0::double as score, '' as snippet from documents where false")
def _(t):
    return X.search(t.documents, "doc_id", "text", "schung", enabled=False)


@query("RD9_page_cache", """
with p as (select page_id // 20 as doc, page_id as idx, length(coalesce(html, '')) % 11 <> 0 as ok from pages)
select doc, count(*) as pages, count_if(ok)::bigint as cached, coalesce(string_agg(idx::varchar, ',' order by idx) filter (where not ok), '') as missing from p group by doc
""")
def _(t):
    """Twenty pages are a document; pages whose transcription failed are missing."""
    from quillmill.operators.models import Echo, transcribe
    from quillmill.sources.books import page_status
    from quillmill.storage import expire, fresh_path

    cache = fresh_path(t.spark, "transcription-cache")
    expire(t.spark, cache)
    p = t.pages.withColumn("doc", F.expr("page_id div 20")).withColumn("idx", F.col("page_id"))
    read = transcribe(p, "html", Echo(60, 11), cache).filter("status <> 'failed'")
    got = page_status(p.select("doc", "idx"), read.select("doc", "idx"))
    return got.select("doc", "pages", "cached", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("SM2_stale_guard", """
with c as (select client_id, click_id, arrived_at, ts, date_diff('day', date '1970-01-01', ts::date) as generation from clicks where arrived_at is not null and ts is not null),
m as (select *, max(generation) over (partition by client_id order by arrived_at, click_id, ts rows unbounded preceding) as newest from c)
select client_id, click_id, generation::int as generation from m where generation >= newest
""")
def _(t):
    """Clicks of a day that a client's later day had overtaken when they arrived are refused."""
    from quillmill.streaming.jobs import current_only

    c = t.clicks.filter("arrived_at is not null and ts is not null").withColumn("generation", F.unix_date(F.to_date("ts")))
    return current_only(c, "client_id", "generation", ["arrived_at", "click_id", "ts"], F.to_date("arrived_at")).select("client_id", "click_id", "generation")


@query("SM3_incremental_edges", """
with d as (select distinct l_suppkey as i, l_partkey as k from lineitem), n as (select d.* from d join supplier on s_suppkey = i where s_acctbal > 9000)
select least(n.i, d.i) as a, greatest(n.i, d.i) as b, count(distinct n.k) as shared from n join d on d.k = n.k and d.i <> n.i group by all
""")
def _(t):
    from quillmill.operators.similarity import delta_pairs

    d = t.lineitem.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k"))
    new = d.join(R.small(t.supplier.filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("i"))), "i", "left_semi")
    return delta_pairs(new, d, t.spark.createDataFrame([], "a bigint, b bigint"))


@query("SM4_index_triggers", """
with s as (
  select client_id, city, 'I' as op, -1 as seq, -1 as change_id from clients union all select client_id, city, op, seq, change_id from client_changes),
n as (select * from s where client_id is not null qualify row_number() over (partition by client_id order by seq desc nulls last, change_id desc nulls last, op nulls last, city nulls last) = 1)
select client_id, count(*) as grams from (
  select distinct client_id, substr(lower(city), i, 3) as gram from n, lateral (select unnest(range(1, length(city) - 1)) as i) where op is distinct from 'D') group by client_id
""")
def _(t):
    """The trigrams of clients' cities: filled from the clients, then kept up by the insertions, updates and deletions of each month."""
    from quillmill.storage import expire, fresh_path
    from quillmill.streaming.buckets import Buckets, indexed

    root = fresh_path(t.spark, "city-index")
    expire(t.spark, root)
    state = Buckets(t.spark, f"{root}/state", ["client_id"], "client_id bigint, city string, op string, seq bigint, change_id bigint")
    index = Buckets(t.spark, f"{root}/index", ["client_id"], "client_id bigint, gram string")
    order = [F.desc_nulls_last("seq"), F.desc_nulls_last("change_id"), F.asc_nulls_last("op"), F.asc_nulls_last("city")]
    old = t.clients.select("client_id", "city", F.lit("I").alias("op"), F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("change_id"))
    changes = t.client_changes.select("client_id", "city", "op", "seq", "change_id", F.date_trunc("month", F.col("valid_at").cast("timestamp")).alias("month"))
    months = sorted((r[0] for r in changes.select("month").distinct().collect()), key=lambda m: (m is None, str(m)))  # some months
    for k, batch in enumerate([old, *[changes.filter(F.col("month").eqNullSafe(F.lit(m))).drop("month") for m in months]]):
        indexed(state, index, k, batch, order, ~F.col("op").eqNullSafe("D"), lambda now: X.trigram_index(now, "client_id", "city"))
    return index.rows().groupBy("client_id").agg(F.count(F.lit(1)).alias("grams"))


@query("LM3_sync_fallback", "with s as (select l_suppkey as node, l_partkey as other, max(l_quantity) * 2 as strength from lineitem group by all having max(l_quantity) * 2 >= 50) select node, other, strength from s qualify row_number() over (partition by node order by strength desc, other) <= 20")
def _(t):
    e = t.lineitem.groupBy(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("other")).agg((F.max("l_quantity") * 2).alias("strength"))
    return R.first_rows(e.filter("strength >= 50"), ["node"], [F.desc("strength"), F.col("other")], 20)


@query("LM4_selection_fallback", "with s as (select item_id, doc_id, count(*) as score from (select item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*'))) as token from benchmark) join documents on contains(text, token) group by all) select item_id, doc_id, score from s qualify row_number() over (partition by item_id order by score desc, doc_id) <= 3")
def _(t):
    d = t.documents.select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("body"))
    return V.best_chunks(t.benchmark, "item_id", "text", d, "doc_id", "pos", "body", 3).select("item_id", "doc_id", "score")


@query("LM6_outline_fallback")
def _(t):
    import pyarrow as pa

    from quillmill.functions.text_udf import outline, outline_markdown

    def run(batches):  # few texts as Python strings at once, whatever a batch holds
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([outline_markdown(outline(x.as_py())) for x in b["text"]], pa.string())], ["doc_id", "markdown"])

    d = t.documents.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, markdown string")


@query("SC5_epub_scan")
def _(t):
    """Ten pages each bound as an EPUB file, read again by the EPUB source: (path, idx, title, text)."""
    from quillmill.functions.text_udf import html_text_of
    from quillmill.sources.books import make_epub
    from quillmill.sources.epub import epub_rows
    from quillmill.storage import expire, fresh_path, put_file

    root = fresh_path(t.spark, "epub")
    expire(t.spark, root)

    def bound(key, pdf):
        pages = [(f"p{i}.xhtml", x or "") for i, x in sorted(zip(pdf["page_id"], pdf["html"], strict=True))]
        put_file(f"{root}/books/{key[0]}.epub", make_epub(pages))
        return pd.DataFrame([(key[0],)], columns=["book"])

    t.pages.groupBy(F.expr("page_id div 10").alias("book")).applyInPandas(bound, "book bigint").agg(F.count("book")).first()
    got = epub_rows(t.spark, root, "path string, idx int, title string, html string", groupBytes=str(8 << 20))  # a task's rows are held at once
    return got.select(F.regexp_extract("path", "books/[^/]*$", 0).alias("path"), "idx", "title", html_text_of(F.col("html")).alias("text"))
