"""Queries over the graph tables: scans, upserts, joins, traversal, metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import impact as im
from ..operators import metrics as me
from ..operators.graph import Graph, by_label, by_type, test_graph
from .general import _NORM

QUERIES: dict = {}
ORACLE: dict = {}

BASE = f"""
with recursive l0 as (
  select {_NORM.format("id")} as id, label, repo, created_at from (select id, label, repo, created_at from graph_nodes union all select id, label, repo, created_at from shared_nodes) where id is not null),
t0 as (select {_NORM.format("source_ref")} as id, arg_min(text, doc_id) as text from documents where source_ref is not null and text is not null group by 1),
n as (
  select a.id, a.label, a.repo, a.created_at, t0.text,
    case when a.label in ('Function', 'Class') then split_part(a.id, '::', -1) end as qualname,
    case when a.label in ('Function', 'Class', 'Module') then split_part(a.id, '::', 2) end as path,
    case when a.label = 'Commit' then split_part(a.id, '::', -1) end as hash,
    case when a.label = 'Concept' then split_part(a.id, '::', -1) when a.label = 'Module' then regexp_replace(split_part(split_part(a.id, '::', 2), '/', -1), '[.]py$', '') end as name,
    case when a.label = 'Function' then regexp_matches(split_part(a.id, '::', -1), '^(dispatch|publish|route)_') end as is_endpoint,
    case when a.label = 'Module' then length(a.id) * 10 + dayofyear(a.created_at) end as loc,
    strftime(a.created_at, '%Y-%m-%d %H:%M:%S') as authored_at
  from (select id, arg_max(label, created_at) as label, arg_max(repo, created_at) as repo, max(created_at) as created_at from l0 group by id) a left join t0 on t0.id = a.id),
e0 as (select {_NORM.format("src")} as src, type, {_NORM.format("dst")} as dst, edge_no, observed_at, props from graph_edges where src is not null and dst is not null and type is not null),
e as (select src, type, dst, arg_max(observed_at, edge_no) filter (observed_at is not null) as observed_at, arg_max(props.count, edge_no) filter (props.count is not null) as count,
    arg_max(props.lines_added, edge_no) filter (props.lines_added is not null) as lines_added, arg_max(props.lines_deleted, edge_no) filter (props.lines_deleted is not null) as lines_deleted,
    arg_max(props.overlap_lines, edge_no) filter (props.overlap_lines is not null) as overlap_lines, arg_max(props.pattern, edge_no) filter (props.pattern is not null) as pattern,
    arg_max(props.confidence, edge_no) filter (props.confidence is not null) as confidence
  from e0 group by src, type, dst),
up as (select c.dst as id, c.src as parent, p.label from e c join n p on p.id = c.src where c.type = 'CONTAINS'),
home as (select distinct id, parent as module from up where label = 'Module'
         union select u.id, v.parent from up u join up v on v.id = u.parent where u.label = 'Class' and v.label = 'Module'),
calls as (select dst as node, src as pred from e where type = 'CALLS'),
imports as (select dst as node, src as pred from e where type = 'IMPORTS'),
fn as (select * from n where label = 'Function')
"""


def query(name: str, sql: str | None = None, base: bool = True):
    """Register a query of (graph, spark, sf_dir), with the SQL that follows the graph's views."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(test_graph(spark, sf_dir), spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = (BASE if base else "") + sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("s4_load_graph", "select src, type, dst, count, lines_added, lines_deleted, pattern, round(confidence, 4) as confidence from e")
def _(G, spark, d):
    return G.edges.select("src", "type", "dst", "count", "lines_added", "lines_deleted", "pattern", F.round("confidence", 4).alias("confidence"))


@query("s5_nodes_of_label", "select id, qualname, path, is_endpoint from n where label = 'Function'")
def _(G, spark, d):
    return by_label(G.nodes, "Function").select("id", "qualname", "path", "is_endpoint")


@query("s6_edges_of_type", "select src, dst, lines_added, lines_deleted, overlap_lines from e where type = 'MODIFIES'")
def _(G, spark, d):
    return by_type(G.edges, "MODIFIES").select("src", "dst", "lines_added", "lines_deleted", "overlap_lines")


@query("s7_get_nodes", "select id, label, repo from n where id in (select dst from e where type = 'FIXES')")
def _(G, spark, d):
    return g.lookup(G.nodes, by_type(G.edges, "FIXES").select(F.col("dst").alias("id"))).select("id", "label", "repo")


@query("u2_upsert_edges", "select type, count(*) as n, sum(lines_added)::bigint as lines_added, sum(count)::bigint as calls from e group by type")
def _(G, spark, d):
    twice = g.upsert(G.edges.withColumn("seq", F.lit(1)).unionByName(G.edges.withColumn("seq", F.lit(2))), ["src", "type", "dst"], "seq")
    return twice.groupBy("type").agg(F.count("*").alias("n"), F.sum("lines_added").alias("lines_added"), F.sum("count").alias("calls"))


@query("a1_counts", "select 'nodes' as kind, label as name, count(*) as n from n group by rollup(label) union all select 'edges', type, count(*) from e group by rollup(type)")
def _(G, spark, d):
    return g.counts(Graph(g.valid_labels(G.nodes), G.edges))


@query("t4_reverse_adjacency", "select distinct node, pred from calls")
def _(G, spark, d):
    return g.reverse(G.edges, "CALLS")


@query("t4_forward_adjacency", "select distinct e.src, e.dst from e join fn a on a.id = e.src join fn b on b.id = e.dst where type = 'CALLS'")
def _(G, spark, d):
    return g.forward(G, "CALLS", "Function")


_REACH = """, reach as (select id as seed, id as node, 0 as level from fn union select r.seed, c.pred, r.level + 1 from reach r join calls c on c.node = r.node where r.level < 3),
levels as (select seed, node, min(level) as level from reach group by seed, node)
"""


@query("t1_bfs_levels", _REACH + "select seed, level, count(*) as nodes from levels group by seed, level")
def _(G, spark, d):
    seeds = by_label(G.nodes, "Function").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return im.level_sizes(seeds, g.reverse(G.edges, "CALLS"), 3)


@query("t1_truncated", _REACH + "select distinct l.seed, true as truncated from levels l join calls c on c.node = l.node where l.level = 3 and not exists (select 1 from levels m where m.seed = l.seed and m.node = c.pred)")
def _(G, spark, d):
    return im.truncated_seeds(by_label(G.nodes, "Function").select(F.col("id").alias("seed")), g.reverse(G.edges, "CALLS"), 3)


def _joined(df, *cols):
    return df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes if not cols or c in cols])


_CUT = "(select distinct l.seed from levels l join {adj} c on c.node = l.node where l.level = {d} and not exists (select 1 from levels m where m.seed = l.seed and m.node = c.pred))"


@query(
    "t2_impact_calls",
    """, reach as (select id as seed, id as node, 0 as level from fn where is_endpoint union select r.seed, c.pred, r.level + 1 from reach r join calls c on c.node = r.node where r.level < 2),
levels as (select seed, node, min(level) as level from reach group by seed, node),
ep as (select l.seed, string_agg(distinct l.node, '|' order by l.node) as v from levels l join fn on fn.id = l.node where fn.is_endpoint group by l.seed),
md as (select l.seed, string_agg(distinct h.module, '|' order by h.module) as v from levels l join n on n.id = l.node join home h on h.id = l.node group by l.seed)
select l.seed as resolved_symbol, 'calls' as mode, 2 as depth, coalesce(string_agg(l.node, '|' order by l.node) filter (level = 1), '') as direct_callers, coalesce(string_agg(l.node, '|' order by l.node) filter (level >= 2), '') as transitive_callers,
  coalesce(any_value(ep.v), '') as affected_endpoints, coalesce(any_value(md.v), '') as affected_modules, l.seed in """
    + _CUT.format(adj="calls", d=2)
    + " as truncated from levels l left join ep on ep.seed = l.seed left join md on md.seed = l.seed group by l.seed",
)
def _(G, spark, d):
    return _joined(im.impact(G, by_label(G.nodes, "Function").where("is_endpoint").select("id"), 2, "calls"))


@query(
    "t3_impact_imports",
    """, reach as (select id as seed, module as node, 0 as level from home where id in (select id from fn where is_endpoint) union select r.seed, c.pred, r.level + 1 from reach r join imports c on c.node = r.node where r.level < 3),
levels as (select seed, node, min(level) as level from reach group by seed, node),
ep as (select l.seed, string_agg(distinct h.id, '|' order by h.id) as v from levels l join home h on h.module = l.node join fn on fn.id = h.id where fn.is_endpoint group by l.seed)
select l.seed as resolved_symbol, 'imports' as mode, 3 as depth, coalesce(string_agg(l.node, '|' order by l.node) filter (level = 1), '') as direct_callers, coalesce(string_agg(l.node, '|' order by l.node) filter (level >= 2), '') as transitive_callers,
  coalesce(any_value(ep.v), '') as affected_endpoints, string_agg(l.node, '|' order by l.node) as affected_modules, l.seed in """
    + _CUT.format(adj="imports", d=3)
    + " as truncated from levels l left join ep on ep.seed = l.seed group by l.seed",
)
def _(G, spark, d):
    return _joined(im.impact(G, by_label(G.nodes, "Function").where("is_endpoint").select("id"), 3, "imports"))


def _of_all(name: str, *changes: tuple[str, str]) -> str:
    """The SQL of a query of endpoints, for all functions."""
    sql = ORACLE[name][len(BASE):]
    for a, b in changes:
        if a not in sql:
            raise ValueError(f"{name}: no {a!r}")
        sql = sql.replace(a, b)
    return sql


@query("t2_impact_calls_all", _of_all("t2_impact_calls", ("0 as level from fn where is_endpoint union", "0 as level from fn union"), ("r.level < 2", "r.level < 3"), ("2 as depth", "3 as depth"), ("l.level = 2", "l.level = 3")))
def _(G, spark, d):
    return im.impact(G, by_label(G.nodes, "Function").select("id"), 3, "calls", joined="|")


@query("t3_impact_imports_all", _of_all("t3_impact_imports", ("(select id from fn where is_endpoint)", "(select id from fn)")))
def _(G, spark, d):
    return _joined(im.impact(G, by_label(G.nodes, "Function").select("id"), 3, "imports"))


_SYMBOLS = "(select distinct split_part(qualname, '.', -1) as symbol from fn union select distinct qualname from fn union select distinct name from n where label = 'Module')"


@query(
    "resolve_symbols",
    f""", w as {_SYMBOLS}, hits as (select w.symbol, list(distinct fn.id order by fn.id) filter (fn.qualname = w.symbol) as e, list(distinct fn.id order by fn.id) filter (ends_with(fn.qualname, '.' || w.symbol)) as s
  from w left join fn on fn.qualname = w.symbol or ends_with(fn.qualname, '.' || w.symbol) group by w.symbol),
best as (select symbol, case when len(e) > 0 then e else coalesce(s, []) end as c from hits)
select symbol, case when len(c) = 1 then 'ok' when len(c) > 1 then 'ambiguous' else 'not_found' end as status, case when len(c) = 1 then c[1] end as id, case when len(c) > 1 then array_to_string(c, '|') end as candidates from best""",
)
def _(G, spark, d):
    fn = by_label(G.nodes, "Function")
    wanted = fn.select(F.substring_index("qualname", ".", -1).alias("symbol")).union(fn.select("qualname")).union(by_label(G.nodes, "Module").select("name"))
    return _joined(im.resolve_symbols(G.nodes, wanted))


@query("j10_module_of", "select id, module from home")
def _(G, spark, d):
    return im.modules_of(G)


@query("t5_blast_radius", _REACH + "select fn.id, count(l.node) as blast_radius, count(case when t.is_endpoint then 1 end) as blast_endpoints from fn left join levels l on l.seed = fn.id and l.node <> fn.id left join fn t on t.id = l.node group by fn.id")
def _(G, spark, d):
    return im.blast_radius(G, 3)


def _pagerank_sql(rounds: int) -> str:
    sql = ", pe as (select distinct e.src, e.dst from e join fn a on a.id = e.src join fn b on b.id = e.dst where type = 'CALLS'), dg as (select fn.id, count(pe.dst) as deg from fn left join pe on pe.src = fn.id group by fn.id), c as (select count(*)::double as n from fn)"
    sql += ", r0 as materialized (select id, deg, 1.0::double / c.n as rank from dg, c)"
    for i in range(rounds):
        sql += f", r{i + 1} as materialized (select d.id, d.deg, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + (select coalesce(sum(rank), 0) from r{i} where deg = 0) / c.n) as rank from dg d cross join c left join (select pe.dst as id, sum(r.rank / r.deg) as got from pe join r{i} r on r.id = pe.src group by pe.dst) g on g.id = d.id)"
    return sql + f" select id, round(rank, 6) as rank from r{rounds}"


@query("t6_pagerank", _pagerank_sql(8))
def _(G, spark, d):
    return me.pagerank(G, rounds=8, every=4).select("id", F.round("rank", 6).alias("rank"))


@query("t6_pagerank_converged")
def _(G, spark, d):
    return me.pagerank(G).select("id", F.round("rank", 6).alias("rank"))


@query("t7_path_exists", """, ch as (select a.src || '>' || a.dst || '>' || b.dst as chain_id, a.src as x, a.dst as y, b.dst as z from (select src, dst from e where type = 'IMPORTS') a join (select src, dst from e where type in ('IMPORTS', 'CONTAINS')) b on b.src = a.dst)
select distinct chain_id, exists (select 1 from e where type = 'IMPORTS' and e.src = ch.y and e.dst = ch.z) as holds from ch""")
def _(G, spark, d):
    a = by_type(G.edges, "IMPORTS").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    b = by_type(G.edges, "IMPORTS", "CONTAINS").select(F.col("src").alias("y"), F.col("dst").alias("z"))
    chains = a.join(b, "y").select(F.concat_ws(">", "x", "y", "z").alias("chain_id"), F.array("x", "y", "z").alias("chain")).distinct()
    return im.path_exists(G.edges, chains, "IMPORTS")


@query("t8_caller_pattern", """, w as (select c1.node, c1.pred from calls c1 union select c1.node, c2.pred from calls c1 join calls c2 on c2.node = c1.pred)
select fn.id, coalesce(string_agg(distinct w.pred, '|' order by w.pred), '') as callers from fn left join w on w.node = fn.id where fn.is_endpoint group by fn.id""")
def _(G, spark, d):
    return _joined(im.caller_pattern(G, by_label(G.nodes, "Function").where("is_endpoint").select("id"), 2))


@query("t8_caller_pattern_all", """, w as (select c1.node, c1.pred from calls c1 union select c1.node, c2.pred from calls c1 join calls c2 on c2.node = c1.pred union select c1.node, c3.pred from calls c1 join calls c2 on c2.node = c1.pred join calls c3 on c3.node = c2.pred)
select fn.id, coalesce(string_agg(distinct w.pred, '|' order by w.pred), '') as callers from fn left join w on w.node = fn.id group by fn.id""")
def _(G, spark, d):
    return _joined(im.caller_pattern(G, by_label(G.nodes, "Function").select("id")))


@query("a3_fan_in", "select fn.id, count(distinct e.src) as fan_in from fn left join e on e.dst = fn.id and e.type = 'CALLS' group by fn.id")
def _(G, spark, d):
    return me.fan_in(G)


_HEAT = """, m as (select e.dst as id, e.src, coalesce(lines_added, 0) + coalesce(lines_deleted, 0) as lines, k.created_at >= (select max(created_at) - interval 90 day from n where label = 'Commit') as recent from e join n k on k.id = e.src and k.label = 'Commit' where e.type = 'MODIFIES'),
heat as (select fn.id, count(distinct m.src) as commits_all, count(distinct case when recent then m.src end) as commits_90d, coalesce(sum(case when recent then lines else 0 end), 0)::bigint as churn_90d, count(distinct m.src) + 2 * count(distinct case when recent then m.src end) as heat from fn left join m on m.id = fn.id group by fn.id)
"""


@query("a4_change_heat", _HEAT + "select * from heat")
def _(G, spark, d):
    return me.change_heat(G)


@query("window_start", "select max(created_at) - interval 90 day as since from n where label = 'Commit'")
def _(G, spark, d):
    return me.window_start(G.nodes)


_FIX = "select fn.id, count(e.src) as fix_involvement from fn left join e on e.dst = fn.id and e.type = 'MODIFIES' and e.src in (select src from e where type = 'FIXES') group by fn.id"


@query("a5_fix_involvement", _FIX)
def _(G, spark, d):
    return me.fix_involvement(G)


@query("a12_degrees", "select id, count(*) as degree from (select src as id from e union all select dst from e) group by id")
def _(G, spark, d):
    return me.degrees(G.edges)


@query("l6_top_degree", "select id, degree from (select id, count(*) as degree from (select src as id from e union all select dst from e) group by id) order by degree desc, id limit 12")
def _(G, spark, d):
    return me.degrees(G.edges).orderBy(F.desc("degree"), "id").limit(12)


@query(
    "a14_all_metrics",
    _HEAT + ", fi as (select fn.id, count(distinct e.src) as fan_in from fn left join e on e.dst = fn.id and e.type = 'CALLS' group by fn.id), fx as (" + _FIX + ") select fi.id, fan_in, commits_all, commits_90d, churn_90d, heat, fix_involvement from fi join heat using (id) join fx using (id)",
)
def _(G, spark, d):
    return me.all_metrics(G, wanted=["fan_in", "commits_all", "commits_90d", "churn_90d", "heat", "fix_involvement"]).drop("label")


@query("a14_node_metrics")
def _(G, spark, d):
    from ..sources.python_source import complexity
    from .extract_queries import _files

    G = me.kept(G)
    return me.all_metrics(G, complexity=complexity(_files(spark, d), by_label(G.nodes, "Function")))


@query("a14_coverage", _HEAT + ", fi as (select fn.id, count(distinct e.src) as fan_in from fn left join e on e.dst = fn.id and e.type = 'CALLS' group by fn.id), fx as (" + _FIX + ") select count(*) as functions, round(avg((fan_in > 0)::int), 4) as called, round(avg((commits_all > 0)::int), 4) as changed, round(avg((fix_involvement > 0)::int), 4) as fixed from fi join heat using (id) join fx using (id)")
def _(G, spark, d):
    parts = me.fan_in(G).join(me.change_heat(G), "id").join(me.fix_involvement(G), "id")
    return me.coverage(parts)


@query("a7_quality_ratios", """select round(count(*) filter (type = 'MODIFIES' and b.id is not null) / nullif(count(*) filter (type = 'MODIFIES'), 0), 4) as modifies_resolved, count(*) filter (type = 'MODIFIES' and b.id is null) as dangling_modifies,
  round(count(*) filter (type = 'CALLS' and b.label = 'Function') / nullif(count(*) filter (type = 'CALLS'), 0), 4) as call_resolved_rate, round(count(*) filter (type = 'PROPOSES' and b.id is not null) / nullif(count(*) filter (type = 'PROPOSES'), 0), 4) as proposes_resolved from e left join n b on b.id = e.dst""")
def _(G, spark, d):
    known = G.nodes.select(F.col("id").alias("dst"), F.col("label").alias("dl"))
    j = G.edges.join(known, "dst", "left")
    n = lambda c: F.count(F.when(c, 1))
    ratio = lambda a, b, name: F.round(n(a) / F.nullif(n(b), F.lit(0)), 4).alias(name)
    t = lambda x: F.col("type") == x
    return j.agg(
        ratio(t("MODIFIES") & F.col("dl").isNotNull(), t("MODIFIES"), "modifies_resolved"), n(t("MODIFIES") & F.col("dl").isNull()).alias("dangling_modifies"),
        ratio(t("CALLS") & (F.col("dl") == "Function"), t("CALLS"), "call_resolved_rate"), ratio(t("PROPOSES") & F.col("dl").isNotNull(), t("PROPOSES"), "proposes_resolved"),
    )


@query("j9_anchored_modifies", "select src, dst, lines_added, lines_deleted from e where type = 'MODIFIES' and dst in (select id from n)")
def _(G, spark, d):
    return by_type(G.edges, "MODIFIES").join(G.nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "lines_added", "lines_deleted")


@query("u4_dangling", "select e.src, e.type, e.dst from e where not exists (select 1 from n where n.id = e.dst)")
def _(G, spark, d):
    return G.edges.join(G.nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "type", "dst")


@query("j6_contains_parent", """select f.id, coalesce(c.id, m.id) as parent from fn f left join n c on c.label = 'Class' and c.path = f.path and c.repo is not distinct from f.repo and c.qualname = regexp_replace(f.qualname, '[.][^.]*$', '') and f.qualname like '%.%' left join n m on m.label = 'Module' and m.id = split_part(f.id, '::', 1) || '::' || f.path""")
def _(G, spark, d):
    fn = by_label(G.nodes, "Function").select("id", "path", "repo", "qualname", F.concat_ws("::", F.substring_index("id", "::", 1), "path").alias("m"))
    cls = by_label(G.nodes, "Class").select("path", "repo", F.col("qualname").alias("owner"), F.col("id").alias("c"))
    owned = fn.withColumn("owner", F.when(F.col("qualname").contains("."), F.regexp_replace("qualname", r"[.][^.]*$", "")))
    mods = by_label(G.nodes, "Module").select(F.col("id").alias("m"), F.lit(1).alias("known"))
    out = owned.join(cls, [owned.path == cls.path, owned.repo.eqNullSafe(cls.repo), owned.owner == cls.owner], "left").select(owned.id, "m", "c").join(mods, "m", "left")
    return out.select("id", F.coalesce("c", F.when(F.col("known") == 1, F.col("m"))).alias("parent"))


@query("j13_concept_expansion", """, i as (select dst as concept, src, row_number() over (partition by dst order by (s.label <> 'Function')::int, coalesce(s.qualname, s.path), s.id) as r from e join n s on s.id = e.src and s.label in ('Function', 'Module') join n c on c.id = e.dst and c.label = 'Concept' where type = 'IMPLEMENTS'),
k as (select dst as concept, src, row_number() over (partition by dst order by s.authored_at desc, s.id desc) as r from e join n s on s.id = e.src join n c on c.id = e.dst and c.label = 'Concept' where type = 'DESCRIBES')
select n.id, coalesce((select string_agg(src, '|' order by r) from i where concept = n.id and r <= 8), '') as implementers, coalesce((select string_agg(src, '|' order by r) from k where concept = n.id and r <= 4), '') as commits from n where label = 'Concept'""")
def _(G, spark, d):
    from ..operators.context import concept_expansion

    c = concept_expansion(G, by_label(G.nodes, "Concept").select("id"))
    return _joined(c)


@query("j16_enriched_candidates", "select fn.id, fn.path, coalesce(count(distinct e.src), 0) as fan_in from fn left join e on e.dst = fn.id and e.type = 'CALLS' where is_endpoint group by fn.id, fn.path")
def _(G, spark, d):
    return by_label(G.nodes, "Function").where("is_endpoint").select("id", "path").join(me.fan_in(G), "id", "left").select("id", "path", "fan_in")


@query("j16_enriched_candidates_all", _of_all("j16_enriched_candidates", ("where is_endpoint ", "")))
def _(G, spark, d):
    return by_label(G.nodes, "Function").select("id", "path").join(me.fan_in(G), "id", "left").select("id", "path", "fan_in")


@query("j17_gold_equivalents", """, w as (select distinct gold_entity as gold from dataset where gold_entity is not null)
select gold, string_agg(distinct x, '|' order by x) as ids from (select gold, gold as x from w union select gold, dst from w join e on e.src = gold and type in ('IMPLEMENTS', 'DESCRIBES') union select gold, src from w join e on e.dst = gold and type in ('IMPLEMENTS', 'DESCRIBES')) group by gold""")
def _(G, spark, d):
    from ..operators.evaluation import gold_equivalents

    gold = _table(spark, d, "dataset").where("gold_entity is not null").select(F.col("gold_entity").alias("gold")).distinct()
    return _joined(gold_equivalents(G.edges, gold))


@query("l3_latest_commits", "select id, commit from (select e.dst as id, k.id as commit, row_number() over (partition by e.dst order by k.authored_at desc, k.id desc) as r from e join n k on k.id = e.src join fn on fn.id = e.dst where type = 'MODIFIES') where r <= 6")
def _(G, spark, d):
    from ..operators.context import latest_commits

    return latest_commits(G, by_label(G.nodes, "Function").select("id"), 6).select("id", "commit")


@query("l5_overview", """select section, name, n from (
  (select 'modules' as section, path as name, loc as n from n where label = 'Module' order by loc desc, path limit 8) union all
  (select 'hot', x.dst, x.c from (select dst, count(*) as c from e where type = 'MODIFIES' group by dst) x where dst in (select id from n) order by x.c desc, x.dst limit 5) union all
  (select 'concepts', x.dst, x.c from (select dst, count(*) as c from e where type = 'IMPLEMENTS' group by dst) x where dst in (select id from n) order by x.c desc, x.dst limit 8))""")
def _(G, spark, d):
    from ..operators.context import overview_rows

    return overview_rows(G)


@query("a9_repo_card", """, c as (select """ + ", ".join(f"count(*) filter (label = '{x}') as n_{x.lower()}" for x in g.NODE_LABELS) + """ from n),
mods as (select path as name, loc as n from n where label = 'Module' order by loc desc, path limit 8),
hot as (select dst as name, count(*) as n from e where type = 'MODIFIES' and dst in (select id from n) group by dst order by n desc, dst limit 5), con as (select dst as name, count(*) as n from e where type = 'IMPLEMENTS' and dst in (select id from n) group by dst order by n desc, dst limit 8)
select c.*, (select string_agg(distinct repo, ', ' order by repo) from n) as repo, (select string_agg(name || '=' || n, '|' order by n desc, name) from mods) as modules, (select string_agg(name || '=' || n, '|' order by n desc, name) from hot) as hot,
  (select string_agg(name || '=' || n, '|' order by n desc, name) from con) as concepts, (select string_agg(id || '=' || qualname || '??', '|' order by id) from fn where is_endpoint) as entrypoints from c""")
def _(G, spark, d):
    from ..operators.context import repo_card

    card = repo_card(G)
    rows = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string"))), "|").alias(c)
    ends = F.array_join(F.transform("entrypoints", lambda x: F.concat(x["id"], F.lit("="), x["qualname"], F.coalesce(x["http_method"], F.lit("?")), F.coalesce(x["route_path"], F.lit("?")))), "|").alias("entrypoints")
    return card.select("repo", *[c for c in card.columns if c.startswith("n_")], rows("modules"), rows("hot"), rows("concepts"), ends)


@query("u3_shared_modules", "select distinct module from home where id in (select id from fn where is_endpoint) intersect select dst from e where type = 'IMPORTS'")
def _(G, spark, d):
    a = im.modules_of(G).join(by_label(G.nodes, "Function").where("is_endpoint").select("id"), "id", "left_semi").select("module")
    return a.intersect(by_type(G.edges, "IMPORTS").select("dst"))


# ---- gold recipes: path queries of one to three hops ---------------------------------------------------------

_RECIPES = {
    "fn_module": "select distinct id as key, module as value from home where id in (select id from fn)",
    "fn_callers": "select node as key, pred as value from calls",
    "concept_impl_fns": "select e.dst as key, e.src as value from e join fn on fn.id = e.src where type = 'IMPLEMENTS'",
    "commit_mod_fns": "select e.src as key, e.dst as value from e join fn on fn.id = e.dst where type = 'MODIFIES'",
    "fn_concepts": "select e.src as key, e.dst as value from e join fn on fn.id = e.src where type = 'IMPLEMENTS'",
    "class_module": "select distinct id as key, module as value from home where id in (select id from n where label = 'Class')",
    "rev_calls_closure": "select seed as key, node as value from lv where level > 0",
    "impact_modules": "select distinct seed as key, module as value from lv join home on home.id = lv.node",
    "calls_chain": "select a.pred as key, b.node as value from calls a join calls b on b.pred = a.node",
    "concept_fns_commits": "select i.dst as key, m.src as value from e i join fn on fn.id = i.src join e m on m.dst = i.src and m.type = 'MODIFIES' where i.type = 'IMPLEMENTS'",
    "commit_fns_concepts": "select m.src as key, i.dst as value from e m join fn on fn.id = m.dst join e i on i.src = m.dst and i.type = 'IMPLEMENTS' where m.type = 'MODIFIES'",
    "design_provenance": "select i.src as key, k.src as value from e i join fn on fn.id = i.src join e k on k.dst = i.dst and k.type = 'DESCRIBES' where i.type = 'IMPLEMENTS'",
}
_LV = ", rc as (select id as seed, id as node, 0 as level from fn where is_endpoint union select r.seed, c.pred, r.level + 1 from rc r join calls c on c.node = r.node where r.level < 3), lv as (select seed, node, min(level) as level from rc group by seed, node)"


def _recipe(name: str):
    def run(G, spark, d):
        from ..operators.evaluation import recipes

        return recipes(G, name)

    return run


for _name, _sql in _RECIPES.items():
    query(f"j20_{_name}", _LV + f" select key, count(distinct value) as n, min(value) as first, max(value) as last from ({_sql}) group by key")(_recipe(_name))


for _name in ("rev_calls_closure", "impact_modules"):
    query(f"j20_{_name}_all", _of_all(f"j20_{_name}", ("from fn where is_endpoint union", "from fn union")))(_recipe(f"{_name}_all"))


@query("k7_viz_data", """, dg as (select id, count(*) as degree from (select src as id from e union all select dst from e) group by id)
select n.id, n.label, coalesce(n.qualname, n.name, n.path, n.hash, split_part(n.id, '::', -1)) as title, coalesce(dg.degree, 0) as degree from n left join dg on dg.id = n.id""")
def _(G, spark, d):
    title = F.coalesce("qualname", "name", "path", "hash", g.tail(F.col("id")))
    return G.nodes.select("id", "label", title.alias("title")).join(me.degrees(G.edges), "id", "left").select("id", "label", "title", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("l6_hotspots", "select dst as id, count(*) as n from e where type = 'MODIFIES' group by dst order by n desc, id limit 15")
def _(G, spark, d):
    return by_type(G.edges, "MODIFIES").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(15)


@query("term_in_graph", """, w(term) as (values ('redis'), ('span'), ('orchard'), ('emit_'), ('нет'), ('工单'))
select term, exists (select 1 from n where contains(lower(coalesce(qualname, '') || chr(1) || coalesce(name, '') || chr(1) || coalesce(path, '') || chr(1) || coalesce(text, '')), term)) as present from w""")
def _(G, spark, d):
    from ..operators.routing import node_text, terms_present

    terms = spark.createDataFrame([(t,) for t in ("redis", "span", "orchard", "emit_", "нет", "工单")], "term string")
    return terms_present(node_text(G.nodes), terms)


_CALL_LINES = f"""with c as (select {_NORM.format("src")} as s, {_NORM.format("dst")} as t, edge_no, props.call_sites as lines from graph_edges where type = 'CALLS' and src is not null and dst is not null),
l as (select s, t, edge_no, unnest(lines) as line, generate_subscripts(lines, 1) as i from c)
select s as src, t as dst, count(*) as n, string_agg(line::varchar, ',' order by edge_no, i) as lines from l group by s, t"""


@query("a2_calls_merged", _CALL_LINES, base=False)
def _(G, spark, d):
    from ..operators.callgraph import merge_calls

    e = _table(spark, d, "graph_edges").where("type = 'CALLS' and src is not null and dst is not null").select(g.norm_ref(F.col("src")).alias("src"), g.norm_ref(F.col("dst")).alias("dst"), "edge_no", F.posexplode("props.call_sites").alias("i", "line"))
    return merge_calls(e, ["edge_no", "i"]).select("src", "dst", F.col("count").alias("n"), F.array_join(F.col("call_sites").cast("array<string>"), ",").alias("lines"))


# ---- sinks: written, read back, counted --------------------------------------------------------------------


@query("k1_snapshot", "select 'nodes' as kind, label as name, count(*) as n from n group by rollup(label) union all select 'edges', type, count(*) from e group by rollup(type)")
def _(G, spark, d):
    from ..session import shared_dir
    from ..sources.sinks import load_graph, save_graph

    path = shared_dir(spark, "snapshot")
    save_graph(G, path)
    return g.counts(load_graph(spark, path))


@query("k1_json_export", "select type, count(*) as n, sum(count)::bigint as calls from e group by type")
def _(G, spark, d):
    from ..session import shared_dir
    from ..sources.sinks import export_json

    path = shared_dir(spark, "export")
    export_json(Graph(G.nodes.select("id", "label"), G.edges.select("src", "type", "dst", "count")), path)
    rows = spark.read.schema("edge struct<src: string, type: string, dst: string, properties: struct<count: int>>").json(path).where("edge is not null")
    return rows.groupBy("edge.type").agg(F.count("*").alias("n"), F.sum("edge.properties.count").alias("calls"))


@query("k4_audit_log", "select verdict, count(*) as n, count(distinct left_ref) as refs from align_audit group by verdict", base=False)
def _(G, spark, d):
    from ..session import shared_dir
    from ..sources.sinks import read_json_lines, write_audit

    path = shared_dir(spark, "audit")
    write_audit(_table(spark, d, "align_audit").select("id", "left_ref", "right_ref", "verdict"), path)
    back = read_json_lines(spark, path, "id long, left_ref long, right_ref long, verdict string")
    return back.groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("left_ref").alias("refs"))


@query("k6_append_records", "select subset, 2 * count(*) as n from dataset group by subset", base=False)
def _(G, spark, d):
    from ..session import shared_dir
    from ..sources.sinks import append_records, read_json_lines

    path = shared_dir(spark, "records")
    for _ in range(2):
        append_records(_table(spark, d, "dataset").select("id", "subset"), path)
    return read_json_lines(spark, path, "id string, subset string").groupBy("subset").agg(F.count("*").alias("n"))
