"""Queries of semantic alignment, cards, blocking and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, evaluation, linking, semantic
from ..operators.graph import by_label, by_type, test_graph
from ..operators.orphans import norm_ref
from .general import _NORM
from .graph_queries import BASE, _table
from .retrieval_queries import _INDEX, _LINK, _ROUTES, _docs, search_queries
from .retrieval_queries import QUERIES as RETRIEVAL
from .text_queries import questions

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _replies(spark, d) -> DataFrame:
    s = _table(spark, d, "concept_staging")
    return s.select("id", "name", "ctype", norm_ref(F.col("source_ref")).alias("source_ref"), "quote", "description", F.col("confidence").cast("double").alias("confidence"), norm_ref(F.col("target_ref")).alias("target_ref"))


def _sources(spark, d) -> DataFrame:
    return _table(spark, d, "documents").where("source_ref is not null and text is not null").select(norm_ref(F.col("source_ref")).alias("source_ref"), "text")


def _known(spark, d) -> DataFrame:
    return _table(spark, d, "graph_nodes").select("id").union(_table(spark, d, "shared_nodes").select("id")).where("id is not null").select(norm_ref(F.col("id")).alias("id")).distinct()


_KEY = r"regexp_replace(lower(trim(name)), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{0085}\x{2028}\x{2029}\x{1680}-]+', '', 'g')"
_VALID = f"""with k as (select distinct {_NORM.format("id")} as id from (select id from graph_nodes union all select id from shared_nodes) where id is not null),
s as (select id, name, ctype, {_NORM.format("source_ref")} as source_ref, quote, description, confidence::double as confidence, {_NORM.format("target_ref")} as target_ref from concept_staging),
d as (select {_NORM.format("source_ref")} as source_ref, text from documents where source_ref is not null and text is not null),
v0 as (select s.* exclude (confidence, ctype), case when ctype in ('domain_concept', 'mechanism', 'design_decision') then ctype else 'domain_concept' end as ctype, coalesce(quote <> '' and exists (select 1 from d where d.source_ref = s.source_ref and contains(d.text, s.quote)), false) as verified,
  least(1.0, greatest(0.0, coalesce(confidence, 0.0))) as c, target_ref is not null and target_ref not in (select id from k) as bad from s where trim(coalesce(name, '')) <> '' and trim(coalesce(source_ref, '')) <> ''),
v1 as (select *, round(case when verified then c else c / 2 end, 6) as confidence from v0),
v as (select *, case when target_ref is not null then not bad end as target_ok, case when confidence < 0.4 then 'low_confidence' when bad then 'bad_target' end as reject from v1)
"""


@query("semantic_validation", _VALID + "select id, ctype, verified, confidence, target_ok, reject from v")
def _(spark, d):
    return semantic.validate(_replies(spark, d), _sources(spark, d), _known(spark, d), 0.4).select("id", "ctype", "verified", "confidence", "target_ok", "reject")


@query("reject_counts", _VALID + "select coalesce(reject, 'kept') as reject, count(*) as n from v group by 1")
def _(spark, d):
    v = semantic.validate(_replies(spark, d), _sources(spark, d), _known(spark, d), 0.4)
    return v.groupBy(F.coalesce("reject", F.lit("kept")).alias("reject")).agg(F.count("*").alias("n"))


@query("a8_align", f"""with r as (select id, name, {_KEY} as key, confidence::double as confidence, source_ref, quote from concept_staging where name is not null),
b as (select key, name, min(id) as at, arg_max((confidence, -id), (confidence, -id)) as best from r where key <> '' group by key, name),
c as (select key, arg_max(name, best) as name, round(max(best[1]), 6) as confidence from b group by key),
e as (select key, count(distinct (source_ref, quote)) as n from r where quote is not null group by key)
select c.key, c.name, c.confidence, coalesce((select string_agg(b.name, '|' order by b.at) from b where b.key = c.key and b.name <> c.name), '') as aliases, coalesce(e.n, 0) as evidence from c left join e on e.key = c.key""")
def _(spark, d):
    r = _replies(spark, d).where("name is not null").withColumn("source_ref", F.col("source_ref"))
    raw = _table(spark, d, "concept_staging").select("id", F.col("source_ref").alias("raw_ref"))
    a = semantic.align(r.join(raw, "id").drop("source_ref").withColumnRenamed("raw_ref", "source_ref"))
    return a.select("key", "name", F.round("confidence", 6).alias("confidence"), F.array_join("aliases", "|").alias("aliases"), F.size("evidence").cast("long").alias("evidence"))


@query("r6_run_semantic", _VALID + f""", x as (select *, 'concept::' || {_KEY} as dst from v where reject is null or reject = 'bad_target'),
e as (select source_ref as src, 'DESCRIBES' as type, dst, confidence, not verified as u from x where source_ref like '%::commit::%' union all select target_ref, 'IMPLEMENTS', dst, confidence, not verified from x where target_ok union all select source_ref, 'IMPLEMENTS', dst, confidence, not verified from x where source_ref not like '%::commit::%')
select src, type, dst, max(confidence) as confidence, bool_and(u) as quote_unverified from e group by src, type, dst""")
def _(spark, d):
    return semantic.run_semantic(_replies(spark, d), _sources(spark, d), _known(spark, d), min_confidence=0.4)["edges"]


@query("a15_commit_batches", BASE + """, c as (select id, (row_number() over (order by id) - 1) // 20 as batch from n where label = 'Commit')
select c.batch::bigint as batch, count(distinct c.id) as commits, min(c.id) as first, count(distinct e.dst) as candidates from c left join e on e.src = c.id and e.type = 'MODIFIES' group by c.batch""")
def _(spark, d):
    G = test_graph(spark, d)
    b = semantic.commit_batches(by_label(G.nodes, "Commit"), by_type(G.edges, "MODIFIES"))
    return b.select("batch", F.size("commits").cast("long").alias("commits"), F.col("commits")[0].alias("first"), F.size("candidates").cast("long").alias("candidates"))


@query("a15_docstring_batch", BASE + """, m as (select id from n where label = 'Module' and trim(coalesce(text, '')) <> '')
select count(*) as modules, min(id) as first, (select count(distinct fn.id) from fn join m on starts_with(fn.id, m.id || '::')) as candidates from m having count(*) > 0""")
def _(spark, d):
    nodes = test_graph(spark, d).nodes
    b = semantic.docstring_batch(by_label(nodes, "Module").select("id", F.col("text").alias("docstring")), by_label(nodes, "Function"))
    return b.select(F.size("modules").cast("long").alias("modules"), F.col("modules")[0].alias("first"), F.size("candidates").cast("long").alias("candidates"))


@query("a16_merge_cards", """with g as (select group_no, list_filter(list_transform(coalesce(aliases, []), lambda x: trim(x)), lambda x: x is not null and x <> '') as a, list_filter(list_transform(coalesce(members, []), lambda x: trim(x)), lambda x: x is not null and x <> '') as b, coalesce(aliases, []) as ra, coalesce(members, []) as rb from concept_groups),
z as (select group_no, p, alias, min(o) over (partition by group_no, alias) as o from (select group_no, 0 as p, trim(x) as alias, i * 2 as o from (select group_no, unnest(ra) as x, generate_subscripts(ra, 1) as i from g) union all select group_no, 1, trim(x), i * 2 + 1 from (select group_no, unnest(rb) as x, generate_subscripts(rb, 1) as i from g)) where alias is not null and alias <> ''),
y as (select distinct group_no, alias, o from z), w as (select *, row_number() over (partition by group_no order by o) as r from y), m as (select * from w where r <= 6),
gen as (select alias from m group by alias having count(distinct group_no) >= 3)
select g.group_no as id, coalesce((select string_agg(alias, '|' order by r) from m where m.group_no = g.group_no and alias not in (select alias from gen)), '') as aliases from g""")
def _(spark, d):
    t = _table(spark, d, "concept_groups")
    none = F.array().cast("array<string>")
    a = t.select(F.col("group_no").alias("id"), F.coalesce("aliases", none).alias("aliases"))
    b = t.select(F.col("group_no").alias("id"), F.coalesce("members", none).alias("aliases"))
    return semantic.merge_cards(a, b).select("id", F.array_join("aliases", "|").alias("aliases"))


@query("a17_card_targets", BASE + """, w as (select fn.id, (select count(*) from e where e.dst = fn.id and e.type in ('CALLS', 'MODIFIES')) as weight from fn),
t as (select id from w order by weight desc, id limit 110) select id from n where label in ('Concept', 'Class') union select id from t union select gold_entity from dataset where gold_entity is not null""")
def _(spark, d):
    G = test_graph(spark, d)
    weight = by_label(G.nodes, "Function").select("id").join(by_type(G.edges, "CALLS", "MODIFIES").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("weight")), "id", "left").select("id", F.coalesce("weight", F.lit(0)).alias("weight"))
    gold = _table(spark, d, "dataset").where("gold_entity is not null").select(F.col("gold_entity").alias("id"))
    return semantic.card_targets(G.nodes, weight, gold)


@query("j18_apply_cards", BASE + """, c as (select {0} as id, arg_max(case when quote_valid then description end, x.id) filter (true) as zh_desc, max(x.id) as m from concept_staging x where source_ref is not null group by 1),
cc as (select c.id, s.quote_valid, s.description from c join concept_staging s on s.id = c.m) select n.id, case when cc.quote_valid then cc.description end as zh_desc from n left join cc on cc.id = n.id""".format(_NORM.format("source_ref")))
def _(spark, d):
    cards = _table(spark, d, "concept_staging").where("source_ref is not null").select(norm_ref(F.col("source_ref")).alias("id"), F.col("description").alias("desc"), F.coalesce("quote_valid", F.lit(False)).alias("desc_accepted"), F.array("name").alias("zh_aliases"), F.col("id").alias("seq"))
    nodes = test_graph(spark, d).nodes.select("id", "label")
    return semantic.apply_cards(semantic.apply_cards(nodes, cards), cards).select("id", "zh_desc")


@query("j19_similar_names", r"""with n as (select distinct name as x, regexp_replace(lower(name), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{0085}\x{2028}\x{2029}\x{1680}]+', '', 'g') as t from concept_staging where name is not null),
g as (select x, case when length(t) < 2 then list_filter([t], lambda y: y <> '') else list_distinct(list_transform(generate_series(1, length(t) - 1), lambda i: substr(t, i, 2))) end as g from n),
e as (select x, len(g) as n, unnest(g) as gram from g), p as (select a.x as a, b.x as b, count(*) as s, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.gram = b.gram and a.x < b.x group by 1, 2)
select a, b, round(s / (na + nb - s), 4) as j from p where s / (na + nb - s) >= 0.6""")
def _(spark, d):
    return semantic.similar_names(_table(spark, d, "concept_staging").select("name"), 0.6)


# ---- evaluation ------------------------------------------------------------------------------------------------

_LAST = """with l as (select *, row_number() over (partition by id, "group" order by batch desc nulls last, ts desc nulls last, row_no desc) as r from judge_pp_b), g as (select * from l where r = 1 and ok)
"""


@query("s10_resume", _LAST + "select row_no, id, verdict from g")
def _(spark, d):
    return evaluation.last_good(_table(spark, d, "judge_pp_b"), ["id", "group"], ["batch", "ts", "row_no"]).select("row_no", "id", "verdict")


@query("a13_rates", _LAST + """select "group", count(*) as n, round(avg((coalesce(verdict, '') = 'correct')::int), 4) as correct, round(avg((coalesce(verdict, '') = 'partial')::int), 4) as partial, round(avg((coalesce(verdict, '') = 'wrong')::int), 4) as wrong from g group by 1""")
def _(spark, d):
    return evaluation.rates(evaluation.last_good(_table(spark, d, "judge_pp_b"), ["id", "group"], ["batch", "ts", "row_no"]), ["group"])


@query("a13_delta", _LAST + """select layer, round(round(avg((verdict is not distinct from 'correct')::int) filter ("group" = 'B'), 4) - round(avg((verdict is not distinct from 'correct')::int) filter ("group" = 'A'), 4), 4) as delta from g where layer is not null group by layer having count(distinct "group") = 2""")
def _(spark, d):
    g = evaluation.last_good(_table(spark, d, "judge_pp_b"), ["id", "group"], ["batch", "ts", "row_no"]).where("layer is not null")
    return evaluation.rate_delta(evaluation.rates(g, ["layer", "group"]))


_RANKED = _INDEX + """, gd as (select distinct qs.qid, d.doc_id as id from qs join dataset x on x.id = qs.qid join documents d on contains(lower(d.text), lower(x.target_semantic)) where x.target_semantic is not null),
fr as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rk from sc)
"""


def _targets(spark, d, q: DataFrame) -> DataFrame:
    return _table(spark, d, "dataset").where("target_semantic is not null").select(F.col("id").alias("qid"), F.col("target_semantic").alias("phrase")).distinct().join(q.select("qid"), "qid")


@query("a19_failure_attribution", _RANKED + "select qs.qid, min(fr.rk) as best, case when min(fr.rk) is null then 'unreachable' when min(fr.rk) <= 3 then 'hit' else 'rank_loss' end as cause from qs left join gd on gd.qid = qs.qid left join fr on fr.qid = gd.qid and fr.id = gd.id group by qs.qid")
def _(spark, d):
    q = search_queries(spark, d)
    ranked = bm25.gold_ranks(_docs(spark, d), q, _targets(spark, d, q))
    return evaluation.failure_attribution(q, ranked, ranked.select("qid", "id"))


@query("a18_calibration_grid", _RANKED + """, t as (select fr.qid, fr.rk, fr.score, gd.id is not null as gold from fr left join gd on gd.qid = fr.qid and gd.id = fr.id where fr.rk <= 3),
g as (select s::double as min_score, m::double as margin, a as autopick from (values (1), (2), (4), (8)) x(s), (values (0.1), (0.15), (0.2), (0.25)) y(m), (values (true), (false)) z(a)),
c as (select qs.qid, min_score, margin, autopick, count(t.rk) as k, max(round(score, 4)) filter (rk = 1) as s1, max(round(score, 4)) filter (rk = 2) as s2, coalesce(bool_or(gold and rk = 1), false) as g1, coalesce(bool_or(gold), false) as g3 from qs cross join g left join t on t.qid = qs.qid and t.score >= min_score group by all),
r as (select min_score, margin, autopick, count(*) as n, round(avg(((autopick or k > 1) and g1)::int), 4) as hit_1, round(avg(((autopick or k > 1) and g3)::int), 4) as hit_3, round(avg((case when k >= 2 and s1 > 0 then (s1 - s2) / s1 < margin else false end)::int), 4) as over_ask from c group by all),
f as (select *, over_ask <= 0.2 as feasible, over_ask <= 0.2 and hit_1 > 0 as ok from r)
select * exclude (ok), ok and row_number() over (order by ok desc, hit_1 desc, hit_3 desc, min_score desc, margin desc, autopick) = 1 as best, row_number() over (order by hit_1 desc, hit_3 desc, min_score desc, margin desc, autopick) = 1 as least_bad from f""")
def _(spark, d):
    q, docs = search_queries(spark, d), _docs(spark, d)
    top = bm25.ranking(bm25.texts(docs), q, 3, 0.0).select("qid", "id", "rank", "score")  # no cell looks beyond
    gold = top.join(_targets(spark, d, q), "qid").join(docs, "id").where(F.contains(F.lower("text"), F.lower("phrase"))).select("qid", "id").distinct()
    scored = top.join(gold.withColumn("g", F.lit(True)), ["qid", "id"], "left").select("qid", "rank", "score", F.coalesce("g", F.lit(False)).alias("gold"))
    grid = spark.createDataFrame([(s, m, a) for s in (1.0, 2.0, 4.0, 8.0) for m in (0.1, 0.15, 0.2, 0.25) for a in (True, False)], "min_score double, margin double, autopick boolean")
    return evaluation.calibration_grid(q, scored, grid)


@query("f22_number_in_answer", "select row_no, regexp_matches(coalesce(answer, ''), '(^|[^0-9])' || regexp_extract(question, '[0-9]+') || '($|[^0-9])') as found from judge_pp_b where regexp_extract(question, '[0-9]+') <> ''")
def _(spark, d):
    j = _table(spark, d, "judge_pp_b").withColumn("n", F.regexp_extract("question", "([0-9]+)", 1)).where("n <> ''")
    return j.select("row_no", evaluation.number_in(F.col("answer"), F.col("n")).alias("found"))


@query("bare_refusals", """select row_no, trim(coalesce(answer, '')) = '' and coalesce(error, '') = '' as refusal from judge_pp_b""")
def _(spark, d):
    return _table(spark, d, "judge_pp_b").select("row_no", evaluation.bare_refusal(F.col("answer"), F.when(F.coalesce("error", F.lit("")) != "", F.array("error"))).alias("refusal"))


@query("mode_classes", "select coalesce(gold_mode_class, subset) as mode, count(distinct id) as n from dataset group by 1")
def _(spark, d):
    return _table(spark, d, "dataset").groupBy(F.coalesce("gold_mode_class", "subset").alias("mode")).agg(F.count_distinct("id").alias("n"))


_PREMISE = """with d as (select id, any_value(absent_keywords) as absent, any_value(truth_anchors) as truths from dataset where subset = 'PP' group by id),
j as (select j.row_no, coalesce(j.answer, '') as text, lower(coalesce(j.answer, '')) as low, coalesce(d.absent, []) as absent, coalesce(d.truths, []) as truths from judge_pp_b j join d on d.id = j.id)
select row_no, len(list_filter(absent, lambda w: contains(low, lower(w)))) > 0 as leak,
  regexp_matches(text, '没有|未使用|不是|并非|实际上|无|而非') and (len(truths) = 0 or len(list_filter(truths, lambda w: contains(low, lower(w)))) > 0) as corrected from j"""


@query("f22_judge_premise", _PREMISE)
def _(spark, d):
    known = _table(spark, d, "dataset").where("subset = 'PP'").groupBy("id").agg(F.first("absent_keywords").alias("absent"), F.first("truth_anchors").alias("truths"))
    j = _table(spark, d, "judge_pp_b").join(known, "id")
    return j.select("row_no", evaluation.judge_premise(F.col("answer"), F.lit(None).cast("string"), F.col("absent"), F.col("truths")).alias("x")).select("row_no", "x.leak", "x.corrected")


@query("f22_judge_linked", _LINK + """, gq as (select id, any_value(gold_entity) as gold from dataset where gold_entity is not null group by id),
eq as (select gq.id, gq.gold as x from gq union select gq.id, e.dst from gq join e on e.src = gq.gold and e.type in ('IMPLEMENTS', 'DESCRIBES') union select gq.id, e.src from gq join e on e.dst = gq.gold and e.type in ('IMPLEMENTS', 'DESCRIBES')),
t as (select qid, list(id order by rank) as top from lk where rank <= 3 group by qid)
select gq.id, coalesce((select bool_or(eq.x = t.top[1]) from eq where eq.id = gq.id), false) as hit_1, coalesce((select bool_or(list_contains(t.top, eq.x)) from eq where eq.id = gq.id), false) as hit_3 from gq left join t on t.qid = gq.id""")
def _(spark, d):
    G = test_graph(spark, d)
    q = _table(spark, d, "dataset").where("gold_entity is not null").groupBy("id").agg(F.first("gold_entity").alias("gold"))
    eq = evaluation.gold_equivalents(G.edges, q.select("gold").distinct())
    links = linking.link_entities(G.nodes, questions(spark, d).select(F.col("id").alias("qid"), "question"))
    top = links.groupBy(F.col("qid").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("x")))), lambda x: x["x"]).alias("anchors"))
    out = q.join(eq, "gold").join(top, "id", "left")
    return out.select("id", evaluation.judge_linked(F.col("anchors"), F.col("ids")).alias("x")).select("id", "x.hit_1", "x.hit_3")


@query("a13_premise_rates", _PREMISE.replace("select j.row_no,", "select j.row_no, j.\"group\" as g,").replace("select row_no, len", "select row_no, g, len").replace("with d as", "with x as (with d as", 1) + """) select g as "group", count(*) as n, round(avg(leak::int), 4) as leak_rate, round(avg(corrected::int), 4) as corrected_rate from x group by g""")
def _(spark, d):
    known = _table(spark, d, "dataset").where("subset = 'PP'").groupBy("id").agg(F.first("absent_keywords").alias("absent"), F.first("truth_anchors").alias("truths"))
    j = _table(spark, d, "judge_pp_b").join(known, "id")
    judged = j.select("group", evaluation.judge_premise(F.col("answer"), F.lit(None).cast("string"), F.col("absent"), F.col("truths")).alias("x")).select("group", "x.leak", "x.corrected")
    return evaluation.premise_rates(judged)


# Which questions were asked and how they were routed is what r1_routes checks; here their rates.
_GOLD = """, gq as (select id, min(subset) as subset, min(gold_entity) as gold, min(gold_behavior) as behavior, min(gold_mode_class) as wanted from dataset where id is not null group by id),
eq as (select gold, gold as x from gq where gold is not null union select gold, e.dst from gq join e on e.src = gq.gold and e.type in ('IMPLEMENTS', 'DESCRIBES') union select gold, e.src from gq join e on e.dst = gq.gold and e.type in ('IMPLEMENTS', 'DESCRIBES')),
ls as (select routes.*, gq.*, list_filter(string_split(routes.linked, '|'), lambda x: x <> '') as l from routes join gq on gq.id = routes.qid),
cls as (select *, case when mode in ('meta', 'overview', 'global') then 'overview' when mode in ('symbol', 'entity_local') then 'symbol' when mode in ('topic', 'llm') then 'topic' else mode end as mc,
  case when wanted in ('meta', 'overview', 'global') then 'overview' when wanted in ('symbol', 'entity_local') then 'symbol' when wanted in ('topic', 'llm') then 'topic' else wanted end as wc from ls),
jd as (select subset, behavior, case when gold is not null then exists (select 1 from eq where eq.gold = cls.gold and eq.x = l[1]) end as hit_1, case when gold is not null then exists (select 1 from eq where eq.gold = cls.gold and list_contains(l[1:3], eq.x)) end as hit_3,
  case when gold is not null then exists (select 1 from eq where eq.gold = cls.gold and list_contains(l, eq.x)) end as recalled,
  case when behavior is not null then case when behavior = 'should_disambiguate' then needs_disambiguation else not needs_disambiguation and len(l) > 0 and mc = 'symbol' end end as passed, needs_disambiguation as asks, case when wanted is not null then mc = wc end as routed from cls)
select subset, count(*) as n, round(avg(hit_1::int), 4) as hit_1, round(avg(hit_3::int), 4) as hit_3, round(avg(recalled::int), 4) as recall_gold, round(avg(passed::int), 4) as pass_rate, round(avg(asks::int) filter (behavior = 'should_autopick'), 4) as over_ask,
  round(avg((not asks)::int) filter (behavior = 'should_disambiguate'), 4) as under_ask, round(avg(routed::int), 4) as routing from jd group by subset"""


@query("a13_subset_rates", _ROUTES + _GOLD)
def _(spark, d):
    meta = _table(spark, d, "dataset").where("id is not null").groupBy(F.col("id").alias("qid")).agg(*[F.min(c).alias(c) for c in ("subset", "gold_entity", "gold_behavior", "gold_mode_class")])
    return evaluation.subset_rates(evaluation.judged_contexts(meta, RETRIEVAL["r1_build_context"](spark, d), test_graph(spark, d).edges))


@query("f22_judge_overview", """with x as (select row_no, coalesce(answer, '') as text, row_no % 2 = 0 as meta from judge_pp_b),
h as (select *, contains(text, 'the')::int + contains(text, '没有')::int + contains(text, 'no ')::int + regexp_matches(text, '(^|[^0-9])3($|[^0-9])')::int as facts_hit from x) select row_no, meta and facts_hit >= 2 as passed, meta as mode_ok, facts_hit from h""")
def _(spark, d):
    j = _table(spark, d, "judge_pp_b")
    route = F.when(F.col("row_no") % 2 == 0, F.when(F.col("row_no") % 4 == 0, "meta").otherwise("global")).otherwise("entity_local")
    x = evaluation.judge_overview(route, F.lit("symbol"), F.col("answer"), F.lit(None).cast("string"), ["the", "没有", "no "], ["3"], 2)
    return j.select("row_no", x.alias("x")).select("row_no", "x.passed", "x.mode_ok", "x.facts_hit")


@query("f22_judge_ambiguous", """with q as (select distinct id, gold_behavior, length(question) % 3 as k from dataset where gold_behavior is not null and question is not null)
select id, k, case when gold_behavior = 'should_disambiguate' then k = 0 else k = 1 end as passed, k = 0 and gold_behavior <> 'should_disambiguate' as over_ask, k <> 0 and gold_behavior = 'should_disambiguate' as under_ask, k <= 1 as anchored from q""")
def _(spark, d):
    # By the question's length: asked back, picked and anchored, picked without an anchor.
    q = _table(spark, d, "dataset").where("gold_behavior is not null and question is not null").select("id", "gold_behavior", (F.length("question") % 3).alias("k")).distinct()
    anchors = F.when(F.col("k") <= 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    x = evaluation.judge_ambiguous(F.col("gold_behavior"), F.when(F.col("k") == 0, True), anchors, F.lit("entity_local"))
    return q.select("id", "k", x.alias("x")).select("id", "k", "x.passed", "x.over_ask", "x.under_ask", "x.anchored")
