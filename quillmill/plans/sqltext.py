"""Pieces of DuckDB SQL that several twins share."""

from quillmill.functions.text import STOPWORDS_ENGLISH

STOP = ", ".join(f"'{w}'" for w in STOPWORDS_ENGLISH)
RAW = r"regexp_extract_all(lower({0}), '[a-z][a-z\-]{{2,}}')"


def words(text: str) -> str:
    return RAW.format(text)


# a book: what a source has in a language among 500 documents
BOOK = "source || '-' || (doc_id // 500) || '/' || lang"

# the top 200 terms of each document, then the weighted top 80 of each book
TERMS = rf"""
piece as (select {BOOK} as book, doc_id, text, 1.0::double as weight from documents
  union all select {BOOK}, -1 - doc_id, string_split_regex(text, '\r?\n')[1], 2.0::double from documents),
raw as (select book, doc_id, weight, unnest({words("text")}) as term from piece),
tf as (select book, doc_id, weight, term, count(*) as n from raw where term not in ({STOP}) group by book, doc_id, weight, term
  qualify row_number() over (partition by book, doc_id, weight order by count(*) desc, term) <= 200),
vec as (select book as doc, term, sum(n * weight) as w, row_number() over (partition by book order by sum(n * weight) desc, term) as rank from tf group by book, term
  qualify rank <= 80)
"""

IDF = """
num as (select count(distinct doc) as n from vec),
idf as (select term, count(*) as df, case when max(num.n) >= 8 and count(*) / max(num.n) > 0.5 then (ln((max(num.n) + 1) / (count(*) + 1)) + 1) * 0.2 else ln((max(num.n) + 1) / (count(*) + 1)) + 1 end as idf
  from vec, num group by term),
wv as (select doc, vec.term, rank, w * coalesce(idf, 1.0) as wt, sqrt(sum(pow(w * coalesce(idf, 1.0), 2)) over (partition by doc)) as norm from vec left join idf on vec.term = idf.term)
"""

PAIRS = """
prod as (select a.doc as a, b.doc as b, a.term, a.rank, a.wt * b.wt as dot, a.wt + b.wt as both_, a.norm * b.norm as norms from wv a join wv b on a.term = b.term and a.doc < b.doc),
pair as (select a, b, sum(dot) / max(norms) as sim, list(term order by round(both_, 6) desc, rank, term)[1:5] as reasons from prod group by a, b having count(*) >= 2 and sum(dot) / max(norms) + 1e-9 >= {tau})
"""

EDGES = """
l as (select s_suppkey as node from supplier),
d as (select distinct l_suppkey as i, l_partkey as k from lineitem),
e as (select a.i as a, b.i as b, count(*) / 1500.0::double as sim from d a join d b on a.k = b.k and a.i < b.i group by a.i, b.i having count(*) >= {least})
"""

# suppliers of neighbouring nations; five nations are a chain of their own
NEAR_EDGES = """
l as (select s_suppkey as node from supplier),
d as (select distinct l_suppkey as i, l_partkey as k from lineitem),
e as (select a.i as a, b.i as b, count(*) / 1500.0::double as sim from d a join d b on a.k = b.k and a.i < b.i join supplier x on x.s_suppkey = a.i join supplier y on y.s_suppkey = b.i
  where x.s_nationkey // 5 = y.s_nationkey // 5 and abs(x.s_nationkey - y.s_nationkey) <= 1 group by a.i, b.i having count(*) >= {least})
"""
