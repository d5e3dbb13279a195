"""Queries over inputs derived from the test tables, where the tables themselves hold no cases, or none that SQL can know:
messages that close issues, questions that name technologies, source files written from a template."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as tx
from ..functions.lexicon import TECH_TERMS
from ..operators import callgraph, routing, semantic
from ..operators.graph import test_graph
from ..operators.orphans import norm_ref
from ..sources.indexer import structure
from ..sources.python_source import class_facts, function_facts, import_facts, parse_sources, spans
from .general import _NORM
from .graph_queries import BASE, _table
from .text_queries import QS, questions

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- commit messages: every document's first line, with words that close issues by the rest of its number ----------------

_MESSAGES = """with m as (select doc_id, coalesce(replace(split_part(text, chr(10), 1), '#', ''), '') as line from documents)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    line = F.coalesce(F.regexp_replace(F.substring_index("text", "\n", 1), "#", ""), F.lit(""))
    ends = F.when(k == 0, F.concat(F.lit(" fixes #"), n)).when(k == 1, F.concat(F.lit(" (#"), n, F.lit(")"))).when(k == 2, F.concat(F.lit("\nCloses #"), n, F.lit(" and resolved #7\n(#8)"))).when(k == 3, F.concat(F.lit(" Fixed #"), n, F.lit(" (#"), n, F.lit(") (#9)"))).otherwise(F.lit(" #5"))
    return _table(spark, d, "documents").select("doc_id", F.concat(line, ends).alias("message"))


@query("f13_fixes", _MESSAGES + """ select doc_id, doc_id as number, 'fixes' as pattern from m where doc_id % 6 = 0 union all select doc_id, doc_id, 'closes' from m where doc_id % 6 = 2 union all select doc_id, 7, 'resolved' from m where doc_id % 6 = 2
union all select doc_id, doc_id, 'fixed' from m where doc_id % 6 = 3 union all select doc_id, 9, 'pr_ref' from m where doc_id % 6 = 3 and doc_id <> 9 union all select doc_id, doc_id, 'pr_ref' from m where doc_id % 6 = 1""")
def _(spark, d):
    return _messages(spark, d).select("doc_id", F.explode(tx.fixes(F.col("message"))).alias("f")).select("doc_id", F.col("f.number").cast("long").alias("number"), "f.pattern")


@query("f13_pull_requests", _MESSAGES + " select doc_id, doc_id as number from m where doc_id % 6 = 1 union all select doc_id, 9 from m where doc_id % 6 = 3 and doc_id <> 9")
def _(spark, d):
    return QUERIES["f13_fixes"](spark, d).where("pattern = 'pr_ref'").select("doc_id", "number")


# ---- premises: technologies named in questions, claims nobody can know ------------------------------------------------------

_TOLD = QS + ", t as (select id, question || case regexp_extract(id, '([0-9]+)$', 1)::bigint % 3 when 0 then ' (Redis, kafka-consumer?)' when 1 then ' xredis PostgreSQL9' else '' end as question from q where question is not null)"


def _told(spark, d) -> DataFrame:
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 3
    q = questions(spark, d).where("question is not null")
    return q.select("id", F.concat("question", F.when(k == 0, " (Redis, kafka-consumer?)").when(k == 1, " xredis PostgreSQL9").otherwise("")).alias("question"))


@query("f9_lexical_premises", _TOLD + " select id, unnest(list_filter([" + ", ".join(f"case when regexp_matches(lower(question), '(^|[^a-z0-9]){t}($|[^a-z0-9])') then '使用 {s}' end" for t, s in TECH_TERMS.items()) + "], lambda x: x is not null)) as claim from t")
def _(spark, d):
    return routing.lexical_premises(_told(spark, d)).select("id", "claim")


_CLAIM_TECH = ", ".join(f"case when regexp_matches(lower(claim), '(^|[^a-z0-9]){t}($|[^a-z0-9])') then '{t}' end" for t in TECH_TERMS)


@query("f9_claim_terms", f"""with c as (select distinct id, trim(false_premise || ' uses Redis in 三 层 and 4  retries') as claim from dataset where false_premise is not null),
t as (select id, claim, list_distinct(list_filter(list_concat([{_CLAIM_TECH}], regexp_extract_all(claim, '[A-Za-z][A-Za-z0-9_]+'), list_transform(regexp_extract_all(claim, '[0-9一二三四五六七八九十百千零两]+\\s*(级|轮|层|阶段|个|次|步|档|重)'), lambda x: regexp_replace(x, '\\s+', '', 'g'))), lambda x: x is not null and length(x) >= 2)) as terms from c)
select id, claim, array_to_string(list_sort(terms), '|') as terms from t""")
def _(spark, d):
    claims = _table(spark, d, "dataset").where("false_premise is not null").select("id", F.concat("false_premise", F.lit(" uses Redis in 三 层 and 4  retries")).alias("claim")).distinct()
    return routing.premises_from_claims(claims).select("id", "claim", F.array_join(F.sort_array("terms"), "|").alias("terms"))


@query("verify_premises", BASE + """, q as (select distinct id, unnest(absent_keywords) as word from dataset where absent_keywords is not null),
k as (select distinct id, case when regexp_extract(id, '([0-9]+)$', 1)::bigint % 2 = 1 then reverse(word) || 'q' else word end as term from q where word is not null and word <> ''),
g as (select lower(concat_ws(chr(1), qualname, name, path, text)) as low from n), hit as (select distinct lower(term) as t from k where exists (select 1 from g where contains(low, lower(term))))
select id, count(*) as terms from k group by id having count(case when lower(term) in (select t from hit) then 1 end) = 0""")
def _(spark, d):
    # Of every other question the keywords are turned round, so that nothing holds them.
    odd = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 2 == 1
    k = _table(spark, d, "dataset").select("id", F.explode("absent_keywords").alias("word")).where("word <> ''").distinct()
    prem = k.withColumn("term", F.when(odd, F.concat(F.reverse("word"), F.lit("q"))).otherwise(F.col("word"))).groupBy("id").agg(F.collect_set("term").alias("terms"))
    prem = prem.select("id", F.lit("").alias("claim"), "terms", F.lit("dataset").alias("source"))
    return routing.verify_premises(routing.node_text(test_graph(spark, d).nodes), prem).select("id", F.size("terms").cast("long").alias("terms"))


@query("u4_unmatched_cards", BASE + f", c as (select distinct {_NORM.format('source_ref')} || case when id % 7 = 0 then '_gone' else '' end as id from concept_staging where source_ref is not null) select id from c where id not in (select id from n)")
def _(spark, d):
    cards = _table(spark, d, "concept_staging").where("source_ref is not null").select(F.concat(norm_ref(F.col("source_ref")), F.when(F.col("id") % 7 == 0, "_gone").otherwise("")).alias("id"))
    return semantic.unmatched_cards(test_graph(spark, d).nodes, cards)


# ---- imports: every module of source_files imports the one that follows it, in four ways, and two that are outside -----------

_IMPORTS = r"""with m as (select distinct replace(regexp_replace(regexp_replace(regexp_replace(replace(relpath, '\', '/'), '^src/', ''), '/__init__\.py$', ''), '\.py$', ''), '/', '.') as module from source_files where relpath is not null),
s as (select module, lead(module) over (order by module) as nxt from m),
i as (select module, 0 as seq, nxt as target, null as symbol from s where nxt is not null union all select module, 1, nxt, 'thing' from s where nxt is not null union all select module, 2, regexp_replace(nxt, '\.[^.]*$', ''), split_part(nxt, '.', -1) from s where contains(nxt, '.')
  union all select module, 3, nxt || '.deep.er', null from s where nxt is not null union all select module, 4, 'os.path', null from s union all select module, 5, 'numpy', 'array' from s)"""


def _module_imports(spark, d) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    m = _table(spark, d, "source_files").where("relpath is not null").select(tx.dotted_module(F.col("relpath")).alias("module")).distinct()
    # All modules by name in one task: the test tables' own input, not the operator.
    s = m.withColumn("nxt", F.lead("module").over(Window.orderBy("module")))
    nxt, none = F.col("nxt"), F.lit(None).cast("string")
    one = lambda seq, target, symbol: F.struct(F.lit(seq).alias("seq"), target.alias("target"), symbol.alias("symbol"))
    parent = F.when(F.contains(nxt, F.lit(".")), F.regexp_replace(nxt, r"\.[^.]*$", ""))
    every = F.array(one(0, nxt, none), one(1, nxt, F.lit("thing")), one(2, parent, F.substring_index(nxt, ".", -1)), one(3, F.concat(nxt, F.lit(".deep.er")), none), one(4, F.lit("os.path"), none), one(5, F.lit("numpy"), F.lit("array")))
    return s.select("module", F.explode(every).alias("i")).select("module", "i.*").where("target is not null"), m


@query("j5_resolve_imports", _IMPORTS + """, f as (select *, case when symbol is null then target else target || '.' || symbol end as whole from i),
h as (select f.module, f.seq, f.target, f.symbol, f.whole, arg_max(m.module, length(m.module)) as hit from f join m on f.whole = m.module or starts_with(f.whole, m.module || '.') group by all),
x as (select module, hit, case when symbol is null or hit = whole then '*module*' else symbol end as name, min(seq) as seq from h where (symbol is null or length(hit) >= length(target)) and hit <> module group by all)
select module, hit as target, string_agg(name, '|' order by seq) as names from x group by module, hit""")
def _(spark, d):
    imports, modules = _module_imports(spark, d)
    return callgraph.resolve_imports(imports, modules).select("module", "target", F.array_join("names", "|").alias("names"))


@query("j7_external_imports", _IMPORTS + " select distinct module, target from i where not exists (select 1 from m where m.module = i.target or starts_with(m.module, i.target || '.'))")
def _(spark, d):
    imports, modules = _module_imports(spark, d)
    return callgraph.external_imports(imports, modules)


# ---- calls: the functions of function_facts call each other by every rule ---------------------------------------------------

_CALLS = """with f as (select distinct file_id::varchar as module, qualname from function_facts where file_id is not null and qualname is not null),
c as (select distinct module, regexp_replace(qualname, '[.][^.]*$', '') as q from f where contains(qualname, '.')),
o as (select module, min(qualname) as fn from f where not contains(qualname, '.') group by module), ms as (select module, lead(module) over (order by module) as nxt from (select distinct module from f)),
w as (select module, qualname as caller, regexp_replace(qualname, '[.][^.]*$', '') as cls, split_part(qualname, '.', -1) as own from f where contains(qualname, '.')),
r as (select f.module, f.qualname as caller, 'name' as kind, o.fn as a, null as b, o.module as target_module, o.fn as target from f join o on o.module = f.module
 union all select f.module, f.qualname, 'name', 'brought', null, o.module, o.fn from f join ms on ms.module = f.module left join o on o.module = ms.nxt
 union all select f.module, f.qualname, 'attr', 'mod', o.fn, case when o.fn is not null then ms.nxt end, o.fn from f join ms on ms.module = f.module left join o on o.module = ms.nxt
 union all select f.module, f.qualname, 'attr', 'mod', 'no_such', null, null from f
 union all select w.module, w.caller, 'attr', w.cls, w.own, case when not contains(w.cls, '.') then w.module end, case when not contains(w.cls, '.') then w.caller end from w
 union all select w.module, w.caller, 'self', w.own, null, w.module, w.caller from w
 union all select w.module, w.caller, 'self', 'no_such', null, null, null from w union all select f.module, f.qualname, 'other', 'x[0]', null, null, null from f)
"""


@query("j1_resolve_calls", _CALLS + "select * from r where not (kind = 'attr' and contains(a, '.'))")
def _(spark, d):
    from pyspark.sql import Window

    f = _table(spark, d, "function_facts").where("file_id is not null and qualname is not null").select(F.col("file_id").cast("string").alias("module"), "qualname").distinct()
    method = f.where("qualname like '%.%'").select("module", F.col("qualname").alias("caller"), F.regexp_replace("qualname", r"\.[^.]*$", "").alias("cls"), F.substring_index("qualname", ".", -1).alias("own"))
    classes = method.select("module", F.col("cls").alias("qualname")).distinct().withColumn("bases", F.array().cast("array<string>"))
    first = f.where("qualname not like '%.%'").groupBy("module").agg(F.min("qualname").alias("fn"))
    pairs = f.select("module").distinct().withColumn("nxt", F.lead("module").over(Window.orderBy("module")))  # the input again
    after = pairs.join(first.select(F.col("module").alias("nxt"), F.col("fn").alias("there")), "nxt", "left")
    call = lambda kind, a, b=None: F.struct(F.lit(kind).alias("kind"), a.alias("a"), (F.lit(None).cast("string") if b is None else b).alias("b"))
    of_all = f.withColumnRenamed("qualname", "caller").join(first, "module", "left").join(after, "module", "left")
    s1 = of_all.select("module", "caller", F.explode(F.array(call("name", F.col("fn")), call("name", F.lit("brought")), call("attr", F.lit("mod"), F.col("there")), call("attr", F.lit("mod"), F.lit("no_such")), call("other", F.lit("x[0]")))).alias("s"))
    s2 = method.select("module", "caller", F.explode(F.array(call("attr", F.col("cls"), F.col("own")), call("self", F.col("own")), call("self", F.lit("no_such")))).alias("s"))
    sites = s1.unionByName(s2).select("module", "caller", F.lit(0).alias("seq"), F.lit(1).alias("line"), "s.*").where("a is not null and not (kind = 'attr' and a like '%.%')")
    imports = after.where("nxt is not null").select("module", F.lit("mod").alias("alias"), F.col("nxt").alias("target"))
    brought = after.where("there is not null").select("module", F.lit("brought").alias("alias"), F.col("nxt").alias("target"), F.col("there").alias("symbol"))
    return callgraph.resolve_calls(sites, f, classes, imports, brought).select("module", "caller", "kind", "a", "b", "target_module", "target")


# ---- source files written from a template: what extraction makes of them is known --------------------------------------------

_SOURCE = '''"""Module {n}."""
import os.path

{imports}
class Holder(Base):
    """Holds."""

    def first(self, x: int = 1):
        return self.second() if x else None

    async def second(self):
        for i in []:
            while i and True:
                helper(i)
        {brought}

def helper(x):
    return x

@app.get("/run")
def run():
    return Holder.first(None)
'''
#: (qualname, signature, first line, last line, asynchronous, method, cyclomatic, endpoint) of the template's functions.
_FUNCTIONS = [
    ("Holder.first", "first(self, x: int=1)", 8, 9, False, True, 2, False), ("Holder.second", "async second(self)", 11, 15, True, True, 4, False),
    ("helper", "helper(x)", 17, 18, False, False, 1, False), ("run", "run()", 20, 22, False, False, 1, True),
]
_FACTS = ", ".join(f"('{q}', '{s}', {a}, {b}, {str(i).lower()}, {str(m).lower()}, {c}, {str(e).lower()})" for q, s, a, b, i, m, c, e in _FUNCTIONS)
_FILES = r"""with p as (select distinct repo, replace(relpath, '\', '/') as relpath from source_files where repo is not null and relpath is not null),
m as (select repo, relpath, replace(regexp_replace(regexp_replace(regexp_replace(relpath, '^src/', ''), '/__init__\.py$', ''), '\.py$', ''), '/', '.') as module from p),
s as (select *, lead(module) over (partition by repo order by module) as nxt from m),
k(qualname, signature, span_start, span_end, is_async, is_method, cyclomatic, is_endpoint) as (values """ + _FACTS + ")"


def _written(spark, d) -> DataFrame:
    """(repo, relpath, source_text): a file for every path of source_files; each imports the next of its repository."""
    from pyspark.sql import Window

    p = _table(spark, d, "source_files").where("repo is not null and relpath is not null").select("repo", F.regexp_replace("relpath", r"\\", "/").alias("relpath")).distinct()
    nxt = F.lead("module").over(Window.partitionBy("repo").orderBy("module"))
    s = p.withColumn("module", tx.dotted_module(F.col("relpath"))).withColumn("nxt", nxt)
    head, rest = _SOURCE.replace("{n}", "n").split("{imports}")
    middle, tail = rest.split("{brought}")
    text = F.concat(F.lit(head), F.when(F.col("nxt").isNull(), "\n").otherwise(F.concat(F.lit("from "), "nxt", F.lit(" import run as brought\n"))), F.lit(middle[1:]), F.when(F.col("nxt").isNull(), "return 0").otherwise("return brought()"), F.lit(tail))
    return s.select("repo", "relpath", text.alias("source_text"))


@query("s2_parse_template", _FILES + " select repo, relpath, module, true as parsed, 22 as loc, 4 as functions, 1 as classes from s")
def _(spark, d):
    return parse_sources(_written(spark, d)).select("repo", "relpath", "module", "parsed", F.col("facts.loc").alias("loc"), F.size("facts.functions").alias("functions"), F.size("facts.classes").alias("classes"))


@query("f14_template_functions", _FILES + " select repo, relpath, qualname, signature, span_start, span_end, is_async, is_method, cyclomatic from s, k")
def _(spark, d):
    return function_facts(parse_sources(_written(spark, d))).select("repo", "relpath", "qualname", "signature", "span_start", "span_end", "is_async", "is_method", "cyclomatic")


@query("a6_template_cyclomatic", _FILES + " select repo, count(*) as functions, sum(cyclomatic)::bigint as total, max(cyclomatic) as most from s, k group by repo")
def _(spark, d):
    return function_facts(parse_sources(_written(spark, d))).groupBy("repo").agg(F.count("*").alias("functions"), F.sum("cyclomatic").alias("total"), F.max("cyclomatic").alias("most"))


@query("f12_span_table", "select file_id::varchar as file, qualname, min((span_start, span_end))[1] as span_start, min((span_start, span_end))[2] as span_end from function_facts where file_id is not null and span_start is not null and span_end is not null group by file_id, qualname")
def _(spark, d):
    fn = _table(spark, d, "function_facts").where("file_id is not null and span_start is not null and span_end is not null").withColumn("file", F.col("file_id").cast("string"))
    return spans(fn, "file")


@query("f11_template_imports", _FILES + " select repo, relpath, 'os' as alias, 'os' as target, null as symbol, 'os.path' as whole from s union all select repo, relpath, 'brought', nxt, 'run', null from s where nxt is not null")
def _(spark, d):
    return import_facts(parse_sources(_written(spark, d))).select("repo", "relpath", "alias", "target", "symbol", F.col("full").alias("whole"))


_EDGES = _FILES + """, g as (select repo || '::' || relpath as id, repo, relpath, module, nxt from s), after as (select g.*, h.id as to_id from g left join g h on h.repo = g.repo and h.module = g.nxt),
x as (select id as src, 'CONTAINS' as type, id || '::Holder' as dst from g union all select id, 'CONTAINS', id || '::helper' from g union all select id, 'CONTAINS', id || '::run' from g union all select id || '::Holder', 'CONTAINS', id || '::Holder.first' from g union all select id || '::Holder', 'CONTAINS', id || '::Holder.second' from g
  union all select id || '::Holder.first', 'CALLS', id || '::Holder.second' from g union all select id || '::Holder.second', 'CALLS', id || '::helper' from g union all select id || '::run', 'CALLS', id || '::Holder.first' from g
  union all select id || '::Holder.second', 'CALLS', to_id || '::run' from after where to_id is not null union all select id, 'IMPORTS', to_id from after where to_id is not null)
"""


@query("structure_edges", _EDGES + "select src, type, dst from x")
def _(spark, d):
    s = structure(parse_sources(_written(spark, d)), Settings())
    return s["contains"].unionByName(s["imports"]).unionByName(s["calls"]).select("src", "type", "dst")


@query("structure_nodes", _FILES + """ select repo || '::' || relpath as id, 'Module' as label, null as qualname, false as is_endpoint, 'os' as external_imports from s union all select repo || '::' || relpath || '::Holder', 'Class', 'Holder', false, null from s
union all select repo || '::' || relpath || '::' || qualname, 'Function', qualname, is_endpoint, null from s, k""")
def _(spark, d):
    s = structure(parse_sources(_written(spark, d)), Settings())
    none = F.lit(None).cast("string")
    m = s["module"].select("id", "label", none.alias("qualname"), F.lit(False).alias("is_endpoint"), F.array_join("external_imports", "|").alias("external_imports"))
    c = s["class"].select("id", "label", "qualname", F.lit(False).alias("is_endpoint"), none.alias("external_imports"))
    return m.unionByName(c).unionByName(s["function"].select("id", "label", "qualname", "is_endpoint", none.alias("external_imports")))


@query("class_template_facts", _FILES + " select repo, relpath, 'Holder' as qualname, 5 as span_start, 15 as span_end, 'Base' as bases from s")
def _(spark, d):
    return class_facts(parse_sources(_written(spark, d))).select("repo", "relpath", "qualname", "span_start", "span_end", F.array_join("bases", "|").alias("bases"))
