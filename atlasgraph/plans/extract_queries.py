"""Queries of source extraction over source_files and function_facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import callgraph
from ..sources.indexer import structure
from ..sources.python_source import call_sites, class_facts, function_facts, import_facts, parse_sources, spans
from .graph_queries import _table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _files(spark, d) -> DataFrame:
    """One text per (repo, relpath): that of the latest reading, then the largest file_id."""
    f = _table(spark, d, "source_files").where("repo is not null and relpath is not null and source_text is not null")
    return f.groupBy("repo", "relpath").agg(F.max_by("source_text", F.struct("read_at", "file_id")).alias("source_text"))


def _parsed(spark, d) -> DataFrame:
    return parse_sources(_files(spark, d))


@query("s2_parse_files")
def _(spark, d):
    return _parsed(spark, d).select("repo", "relpath", "module", "parsed", F.col("facts.loc").alias("loc"), F.size("facts.functions").alias("functions"), F.size("facts.classes").alias("classes"))


@query("f14_functions")
def _(spark, d):
    return function_facts(_parsed(spark, d)).select("repo", "relpath", "qualname", "signature", "span_start", "span_end", "is_async", "is_method", F.array_join("decorators", "|").alias("decorators"))


@query("a6_cyclomatic")
def _(spark, d):
    return function_facts(_parsed(spark, d)).groupBy("repo").agg(F.count("*").alias("functions"), F.sum("cyclomatic").alias("total"), F.max("cyclomatic").alias("most"))


@query("j4_owning_class", """with f as (select distinct file_id as module, qualname from function_facts where qualname like '%.%'), c as (select distinct module, split_part(qualname, '.', 1) as q from f)
select f.module, f.qualname, arg_max(c.q, length(c.q)) as owner from f join c on c.module = f.module and starts_with(f.qualname, c.q || '.') group by f.module, f.qualname""")
def _(spark, d):
    f = _table(spark, d, "function_facts").where("qualname like '%.%'").select(F.col("file_id").alias("module"), "qualname").distinct()
    return callgraph.owning_class(f, f.select("module", F.substring_index("qualname", ".", 1).alias("qualname")).distinct())


@query("j8_lines_in_spans", """with s as (select distinct file_id as blob, qualname, span_start, span_end from function_facts where span_start is not null), l as (select distinct blob, span_start + 1 as line from s)
select l.blob, l.line, count(*) as holders from l join s on s.blob = l.blob and l.line between s.span_start and s.span_end group by l.blob, l.line""")
def _(spark, d):
    s = _table(spark, d, "function_facts").where("span_start is not null").select(F.col("file_id").alias("blob"), "qualname", "span_start", "span_end").distinct()
    lines = s.select("blob", (F.col("span_start") + 1).alias("line")).distinct()
    return callgraph.lines_in_spans(lines, s).groupBy("blob", "line").agg(F.count("*").alias("holders"))


@query("w4_latest_run", "select file_id, qualname, run, cyclomatic from (select *, row_number() over (partition by file_id, qualname order by run desc, span_start) as r from function_facts) where r = 1")
def _(spark, d):
    w = Window.partitionBy("file_id", "qualname").orderBy(F.desc("run"), "span_start")
    return _table(spark, d, "function_facts").withColumn("r", F.row_number().over(w)).where("r = 1").select("file_id", "qualname", "run", "cyclomatic")


@query("structure_counts")
def _(spark, d):
    s = structure(_parsed(spark, d), Settings())
    out = None
    for name in ("module", "class", "function", "contains", "imports", "calls"):
        one = s[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out
