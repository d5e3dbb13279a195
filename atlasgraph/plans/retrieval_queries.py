"""Queries of recall, linking, disambiguation and context, with their SQL.

Searches take as queries every question whose number is divisible by 20, against all documents and symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import STOP_WORDS
from ..operators import bm25, linking, pipeline, routing
from ..operators.context import BUDGET, NOTICE
from ..operators.graph import test_graph
from ..operators.metrics import fan_in
from .graph_queries import BASE, _table
from .text_queries import _HALF, _WIDE, TOKENS, _code_sql, _quoted, _route_sql, questions, terms_sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _docs(spark, d) -> DataFrame:
    return _table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    return questions(spark, d).where((n % 20 == 0) & F.col("question").isNotNull()).select(F.col("id").alias("qid"), "question")


_INDEX = f"""with recursive dt as (select doc_id as id, unnest({terms_sql('text')}) as term from documents where text is not null),
tf as (select id, term, count(*) as tf from dt group by id, term), dl as (select id, sum(tf)::bigint as dl from tf group by id), st as (select count(*) as n_docs, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from tf group by term),
po as (select tf.term, tf.id, tf.tf, ln(1.0::double + (n_docs - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double) / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl)) as weight from tf join dl on dl.id = tf.id join df on df.term = tf.term, st),
q as (select id, max(question) as question from dataset where id is not null group by id),
qs as (select id as qid, question from q where question is not null and regexp_extract(id, '([0-9]+)$', 1)::bigint % 20 = 0),
qt as (select qid, unnest(list_distinct(list_filter({terms_sql('question')}, lambda x: x not in ({_quoted(sorted(STOP_WORDS))})))) as term from qs),
sc as (select qid, id, sum(weight) as score, array_to_string(list_sort(list(qt.term)), '|') as matched_terms from qt join po on po.term = qt.term group by qid, id),
rk as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from sc where score >= 1.0)
"""


@query("a10_document_frequency", _INDEX + "select term, df from df")
def _(spark, d):
    return bm25.build_index(_docs(spark, d)).df


@query("a10_corpus_stats", _INDEX + "select n_docs, round(avgdl, 6) as avgdl from st")
def _(spark, d):
    return bm25.build_index(_docs(spark, d), persist=False).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("a11_topic_recall", _INDEX + "select qid, rank, id, round(score, 4) as score, matched_terms from rk where rank <= 8")
def _(spark, d):
    r = bm25.search(_docs(spark, d), search_queries(spark, d))
    return r.withColumn("matched_terms", F.array_join("matched_terms", "|"))


@query("r5_bm25_context", _INDEX + ", r0 as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as r from sc) select qid, r as rank, id, round(score, 4) as score from r0 where r <= 8")
def _(spark, d):
    return bm25.search(_docs(spark, d), search_queries(spark, d), bm25.TOP, 0.0).drop("matched_terms")


@query("r5_context_text", _INDEX + f""", r0 as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as r from sc) where r <= 8),
ln as (select qid, 0 as o, 0 as p, '{bm25.HEADING}' as line from qs union all select qid, r, 0, '[' || r || '] [Document] ' || id || '  (BM25=' || round(score, 4) || ')' from r0 union all select qid, r, 1, '    ' || text from r0 join documents on doc_id = id),
s as (select *, sum(length(line) + 1) over (partition by qid order by o, p) as run from ln)
select qid, (select string_agg(id::varchar, '|' order by r) from r0 where r0.qid = s.qid) as linked, coalesce(string_agg(line || chr(10), '' order by o, p) filter (run <= {BUDGET}), '') || case when max(run) > {BUDGET} then '{NOTICE}' else '' end as context_text from s group by qid""")
def _(spark, d):
    docs, q = _docs(spark, d), search_queries(spark, d)
    return bm25.bm25_context(bm25.texts(docs), q, docs).select("qid", F.array_join(F.col("linked").cast("array<string>"), "|").alias("linked"), "context_text")


_KEYS = r""", sy as (select id, label, qualname as name, string_split(qualname, '.') as p from n where label in ('Function', 'Class') and qualname is not null),
mo as (select id, label, path, name as short, replace(regexp_replace(regexp_replace(regexp_replace(path, '^src/', ''), '/__init__\.py$', ''), '\.py$', ''), '/', '.') as name from n where label = 'Module'),
keys as (select name as key, false as folded, 'exact_qualname' as method, 100 as score, id, label, name from sy
  union all select unnest(list_transform(generate_series(2, len(p) - 1), lambda i: array_to_string(p[i:], '.'))), false, 'suffix_qualname', 80, id, label, name from sy
  union all select p[-1], false, 'short_name', 60, id, label, name from sy where len(p) > 1
  union all select distinct k, false, 'module_path', 30, id, label, name from (select id, label, name, unnest([name, path, short]) as k from mo union all select id, label, name, unnest(list_transform(generate_series(2, len(string_split(name, '.')) - 1), lambda i: array_to_string(string_split(name, '.')[i:], '.'))) from mo) where k is not null
  union all select lower(name), true, 'concept_name', 40, id, label, name from n where label = 'Concept'),
hits as (select tok.id as qid, c as matched, method, score, k.id, k.label, k.name from tok join keys k on (not folded and k.key = tok.c) or (folded and k.key = lower(tok.c))),
best as (select *, row_number() over (partition by qid, id order by score desc, length(matched) desc, matched) as b from hits),
lk as (select *, row_number() over (partition by qid order by score desc, id) as rank from best where b = 1)
"""
_LINK = BASE + ", q as (select id, max(question) as question from dataset where id is not null group by id)" + TOKENS + _KEYS


@query("j11_link_entities", _LINK + "select qid, rank, id, label, name, matched, score, method from lk where rank <= 5")
def _(spark, d):
    q = questions(spark, d).select(F.col("id").alias("qid"), "question")
    return linking.link_entities(test_graph(spark, d).nodes, q)


@query("w3_disambiguate", _LINK + """, f as (select *, lead(score) over (partition by qid order by score desc, id) as next, count(*) over (partition by qid) as n from lk where rank <= 5)
select qid, n, case when method in ('exact_qualname', 'suffix_qualname') or n = 1 or score - next >= 20 then id end as pick, not (method in ('exact_qualname', 'suffix_qualname') or n = 1 or score - next >= 20) as needs_disambiguation, method not in ('exact_qualname', 'suffix_qualname') and n = 1 as degraded from f where rank = 1""")
def _(spark, d):
    q = questions(spark, d).select(F.col("id").alias("qid"), "question")
    return linking.disambiguate(linking.link_entities(test_graph(spark, d).nodes, q))


@query("w2_merge_candidates", _LINK + """, al as (select qid, id, label, score::double as score, method from lk where rank <= 5 union all select qid, id, label, score + 0.5, 'bm25_card' from lk where label in ('Function', 'Class')),
rr as (select *, case method when 'exact_qualname' then 5 when 'suffix_qualname' then 4 when 'short_name' then 3 when 'concept_name' then 2 when 'module_path' then 1 else 0 end as r from al),
bb as (select *, row_number() over (partition by qid, id order by r desc, score desc, method) as b from rr)
select qid, row_number() over (partition by qid order by r desc, score desc, id) as position, id, label, score, method from bb where b = 1""")
def _(spark, d):
    q = questions(spark, d).select(F.col("id").alias("qid"), "question")
    every = linking.link_entities(test_graph(spark, d).nodes, q, None)
    cards = linking.card_candidates(every.withColumn("score", F.col("score") + 0.5))
    return linking.merge_candidates(every.where("rank <= 5"), cards)


@query("f10_auto_anchor", _LINK + "select qid, id, method in ('exact_qualname', 'suffix_qualname') as anchors from lk where rank <= 5")
def _(spark, d):
    q = questions(spark, d).select(F.col("id").alias("qid"), "question")
    return linking.link_entities(test_graph(spark, d).nodes, q).select("qid", "id", linking.may_anchor(F.col("method")).alias("anchors"))


@query("j12_alias_containment", """with b as (select 'concept::' || min(group_no) as id, alias from (select group_no, unnest(regexp_extract_all(lower(name), '[a-z]{7,}')) as alias from concept_groups) group by alias), q as (select id, max(question) as question from dataset where id is not null group by id)
select distinct q.id as qid, b.id, b.alias as matched from q join b on contains(lower(q.question), b.alias)""")
def _(spark, d):
    words = _table(spark, d, "concept_groups").select("group_no", "name", F.explode(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]{7,})"), F.lit(1))).alias("alias"))
    nodes = words.groupBy("alias").agg(F.min("group_no").alias("n")).select(F.concat(F.lit("concept::"), F.col("n").cast("string")).alias("id"), F.lit("Concept").alias("label"), F.col("alias").alias("name"), F.array("alias").alias("zh_aliases"))
    q = questions(spark, d).select(F.col("id").alias("qid"), "question")
    return linking.alias_hits(nodes, q).select("qid", "id", "matched").distinct()


@query("j15_expand_concepts", """with c as (select group_no as id, lower(trim(x)) as low from (select group_no, unnest(list_concat([name], coalesce(aliases, []))) as x from concept_groups) where trim(x) <> ''),
f as (select low, min(id) as id from c group by low), s as (select distinct unnest(members) as name from concept_groups) select distinct s.name, f.id from s join f on f.low = lower(trim(s.name))""")
def _(spark, d):
    t = _table(spark, d, "concept_groups")
    return linking.expand_names(t.select(F.col("group_no").alias("id"), F.lit("Concept").alias("label"), "name", "aliases"), t.select(F.explode("members").alias("name")).distinct())


_TWO = BASE + """, d0 as (select id, max(question) as question, max(gold_entity) as g, max(target_semantic) as t from dataset where id is not null group by id),
q as (select id, question from d0 union all select id || '#1', split_part(g, '::', -1) || ' ' || coalesce(t, '') from d0 where g is not null)""" + TOKENS + _KEYS


@query("u1_extra_queries", _TWO + """, two as (select split_part(qid, '#', 1) as qid, id, max(score) as score from lk where rank <= 5 group by 1, 2)
select qid, rank, id, score from (select *, row_number() over (partition by qid order by score desc, id) as rank from two) where rank <= 5""")
def _(spark, d):
    # The question's own links, and those of a rewriting that names the symbol asked for.
    nodes = test_graph(spark, d).nodes
    first = linking.link_entities(nodes, questions(spark, d).select(F.col("id").alias("qid"), "question"))
    again = _table(spark, d, "dataset").where("id is not null").groupBy(F.col("id").alias("qid")).agg(F.max("gold_entity").alias("g"), F.max("target_semantic").alias("t")).where("g is not null")
    again = again.select("qid", F.concat(F.substring_index("g", "::", -1), F.lit(" "), F.coalesce("t", F.lit(""))).alias("question"))
    return linking.union_best(first.select("qid", "id", "score"), linking.link_entities(nodes, again).select("qid", "id", "score"))


@query("j16_candidates_described", _LINK + ", fi as (select fn.id, count(distinct e.src) as fan_in from fn left join e on e.dst = fn.id and e.type = 'CALLS' group by fn.id) select qid, lk.id, coalesce(n.path, '') as path, coalesce(fi.fan_in, 0) as fan_in from lk left join n on n.id = lk.id left join fi on fi.id = lk.id where rank <= 5")
def _(spark, d):
    G = test_graph(spark, d)
    linked = linking.link_entities(G.nodes, questions(spark, d).select(F.col("id").alias("qid"), "question"))
    return linking.enrich_candidates(G.nodes, linked, fan_in(G)).select("qid", "id", "path", "fan_in")


@query("l7_budget", """with l as (select source, doc_id, length(split_part(text, chr(10), 1)) + 1 as n from documents where text is not null and source is not null), s as (select *, sum(n) over (partition by source order by doc_id) as run from l)
select source, coalesce(sum(n) filter (run <= 6000), 0)::bigint + case when max(run) > 6000 then length('…（上下文因预算截断，仅保留高优先级内容）') else 0 end as chars from s group by source""")
def _(spark, d):
    from ..operators.context import within_budget

    lines = _table(spark, d, "documents").where("text is not null and source is not null").select("source", F.col("doc_id").alias("seq"), F.substring_index("text", "\n", 1).alias("line"))
    return within_budget(lines, "source").select("source", F.length("context_text").cast("long").alias("chars"))


@query("l7_budget_lines", """with l as (select source, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null and source is not null),
s as (select source, length(line) + 1 as n, sum(length(line) + 1) over (partition by source order by doc_id, i) as run from l)
select source, coalesce(sum(n) filter (run <= 6000), 0)::bigint + case when max(run) > 6000 then length('…（上下文因预算截断，仅保留高优先级内容）') else 0 end as chars from s group by source""")
def _(spark, d):
    from ..operators.context import within_budget

    lines = _table(spark, d, "documents").where("text is not null and source is not null").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return within_budget(lines.select("source", F.struct("doc_id", "p").alias("seq"), "line"), "source").select("source", F.length("context_text").cast("long").alias("chars"))


@query("r1_build_context")
def _(spark, d):
    G = test_graph(spark, d)
    docs = G.nodes.where("text is not null").select("id", "text")
    return pipeline.build_context(G, docs, search_queries(spark, d))


_NODE_INDEX = _INDEX[len("with recursive ") : _INDEX.index("q as (")].replace("doc_id as id", "id").replace("from documents", "from n")
_ROUTES = BASE + f""", q as (select id, translate(coalesce(question, ''), '{_WIDE}', '{_HALF}') as question from (select id, max(question) as question from dataset where id is not null group by id)
  where question is not null and regexp_extract(id, '([0-9]+)$', 1)::bigint % 20 = 0)""" + TOKENS + _KEYS + ", " + _NODE_INDEX + f"""
qt as (select id as qid, unnest(list_distinct(list_filter({terms_sql('question')}, lambda x: x not in ({_quoted(sorted(STOP_WORDS))})))) as term from q where id not in (select qid from lk)),
sc as (select qid, po.id, sum(weight) as score from qt join po on po.term = qt.term group by qid, po.id), tp as (select qid, least(count(*), 8) as topics from sc where score >= 1.0 group by qid),
top as (select *, lead(score) over (partition by qid order by rank) as next, count(*) over (partition by qid) as k from lk where rank <= 5),
ch2 as (select qid, k, string_agg(id, '|' order by rank) over (partition by qid rows between unbounded preceding and unbounded following) as linked, rank, id, method in ('exact_qualname', 'suffix_qualname') as exact, score - next as gap from top),
m as (select q.id as qid, q.question as norm, coalesce(c.k, 0) as linked, coalesce(c.linked, '') as ids, coalesce(tp.topics, 0) as topics, not coalesce(c.exact or c.k = 1 or c.gap >= 20, true) as asks, case when c.exact or c.k = 1 or c.gap >= 20 then c.id end as pick, coalesce(not c.exact and c.k = 1, false) as weak from q left join ch2 c on c.qid = q.id and c.rank = 1 left join tp on tp.qid = q.id),
sg as (select *, {_code_sql('norm')} as code, regexp_matches(norm, '{routing.PRONOUN.replace('(?<!应)该', '(?:^|[^应])该')}') or topics > 0 as pronoun from m),
rt as (select *, case {_route_sql()} end as hit from sg), rl as (select *, coalesce(split_part(hit, ':', 2), 'entity_local') as route_label, coalesce('rule:' || split_part(hit, ':', 1), 'fallback:default') as route_source from rt),
md as (select *, route_label = 'entity_local' as here, case when route_label = 'out_of_scope' then 'out_of_scope' when route_label <> 'entity_local' then 'overview' when linked > 0 then 'symbol' when topics > 0 then 'topic' else 'overview' end as mode from rl),
routes as (select qid, route_label, route_source, mode, ids as linked, topics, route_label in ('structural', 'out_of_scope') or (here and linked = 0 and topics = 0) or (here and weak) as degraded, here and asks as needs_disambiguation from md)
"""


@query("r1_routes", _ROUTES + "select * from routes")
def _(spark, d):
    c = QUERIES["r1_build_context"](spark, d)
    return c.select("qid", "route_label", "route_source", "mode", F.array_join("linked", "|").alias("linked"), "topics", "degraded", "needs_disambiguation")


@query("r3_context_modes", _ROUTES + "select route_label, mode, degraded, count(*) as n from routes group by all")
def _(spark, d):
    return QUERIES["r1_build_context"](spark, d).groupBy("route_label", "mode", "degraded").agg(F.count("*").alias("n"))
