"""A source tree and its git history to a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import endpoint, first_line_or_null, fixes
from ..operators.callgraph import external_imports, lines_in_spans, merge_calls, resolve_calls, resolve_imports
from ..operators.graph import Graph
from ..session import stored
from .gitlog import changed_lines, read_blobs, read_git
from .python_source import call_sites, class_facts, function_facts, import_facts, parse_sources, read_worktree, spans

SEPARATOR = "\x01"
PROPS = "count int, call_sites array<int>, names array<string>, lines_added int, lines_deleted int, overlap_lines int, pattern string"


def _edges(df: DataFrame, etype: str, **props) -> DataFrame:
    out = [F.col("src"), F.lit(etype).alias("type"), F.col("dst")]
    for p in PROPS.split(", "):
        name, kind = p.split(" ")
        out.append((props[name] if name in props else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def within(repo: str, name: str) -> Column:
    """A dotted name of a repository, whose own name can't be taken for a part of it; null for no name."""
    return F.concat(F.regexp_replace(F.coalesce(repo, F.lit("")), r"[.]", "\x02"), F.lit(SEPARATOR + "."), F.col(name))


def without(name: Column) -> Column:
    return F.substring_index(name, SEPARATOR + ".", -1)


def module_id(repo, path):
    return F.concat_ws("::", repo, path)


def structure(parsed: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Tables of nodes and edges of parsed modules (see parse_sources): module, class, function, contains, imports, calls, sites.

    Names are resolved within their repository: a module goes by repository and dotted name, so two repositories with one
    path have nothing to do with each other.
    """
    # A dotted name and what it is compared with get the repository as their first part.
    parsed = parsed.withColumn("module", within("repo", "module"))
    fn, cl, im = function_facts(parsed), class_facts(parsed), import_facts(parsed)
    im = im.withColumns({"full": within("repo", "full"), "target": F.when(F.col("target") == "", F.col("target")).otherwise(within("repo", "target"))})
    mid = module_id(F.col("repo"), F.col("relpath"))
    home = parsed.where("parsed").select("repo", "module", "relpath").distinct()
    mods = home.select("module")
    plain = im.where("symbol is null").select("module", "seq", F.col("full").alias("target"), F.lit(None).cast("string").alias("symbol"))
    sym = im.where("symbol is not null").select("module", "seq", "target", "symbol")
    inside = resolve_imports(plain.unionByName(sym), mods)
    outer = external_imports(im.select("module", F.when(F.col("symbol").isNull(), F.col("target")).otherwise(F.when(F.col("target") != "", F.col("target")).otherwise(within("repo", "symbol"))).alias("target")), mods)
    # `from p import m` of a module p.m isn't external even if p alone is no module.
    outer = outer.groupBy("module").agg(F.sort_array(F.collect_set(without(F.col("target")))).alias("external_imports"))
    ep = endpoint(F.col("decorators"), F.col("arguments"), settings.endpoint_patterns)
    module = parsed.where("parsed").join(outer, "module", "left").select(
        mid.alias("id"), F.lit("Module").alias("label"), "repo", F.col("relpath").alias("path"), F.regexp_replace(F.substring_index("relpath", "/", -1), r"\.py$", "").alias("name"), F.col("facts.package").alias("package"), F.col("facts.loc").alias("loc"),
        first_line_or_null(F.col("facts.docstring")).alias("docstring"), F.coalesce("external_imports", F.array().cast("array<string>")).alias("external_imports"),
    )
    classes = cl.select(F.concat_ws("::", "repo", "relpath", "qualname").alias("id"), F.lit("Class").alias("label"), "repo", "qualname", F.col("relpath").alias("path"), "span_start", "span_end", first_line_or_null(F.col("docstring")).alias("docstring"), "bases", "module")
    functions = fn.withColumn("ep", ep).select(
        F.concat_ws("::", "repo", "relpath", "qualname").alias("id"), F.lit("Function").alias("label"), "repo", "qualname", F.col("relpath").alias("path"), "signature", "span_start", "span_end", "is_async", "is_method", F.col("ep").isNotNull().alias("is_endpoint"),
        F.col("ep.http_method").alias("http_method"), F.col("ep.route_path").alias("route_path"), first_line_or_null(F.col("docstring")).alias("docstring"), "cyclomatic", "module",
    )
    owner = F.when(F.col("qualname").contains("."), F.regexp_replace("qualname", r"\.[^.]*$", ""))
    known = classes.select(F.col("module").alias("m"), F.col("qualname").alias("q"), F.col("id").alias("c")).distinct()
    f = functions.withColumn("owner", owner)
    contains = _edges(f.join(known, (F.col("module") == F.col("m")) & (F.col("owner") == F.col("q")), "left").select(F.coalesce("c", module_id(F.col("repo"), F.col("path"))).alias("src"), F.col("id").alias("dst")).distinct(), "CONTAINS")
    contains = contains.unionByName(_edges(classes.select(module_id(F.col("repo"), F.col("path")).alias("src"), F.col("id").alias("dst")).distinct(), "CONTAINS"))
    at = home.select("module", mid.alias("mid"))
    imp = inside.join(at, "module").join(at.select(F.col("module").alias("target"), F.col("mid").alias("dst")), "target").select(F.col("mid").alias("src"), "dst", "names")
    sites = call_sites(fn)
    resolved = stored(resolve_calls(sites, functions.select("module", "qualname"), cl.select("module", "qualname", "bases"), im.where("symbol is null").select("module", "alias", "target"), sym_alias(im)), "resolved-calls")
    ids = functions.select("module", "qualname", "id").distinct()
    hit = resolved.where("target is not null").join(ids.select("module", F.col("qualname").alias("caller"), F.col("id").alias("src")), ["module", "caller"]).join(ids.select(F.col("module").alias("target_module"), F.col("qualname").alias("target"), F.col("id").alias("dst")), ["target_module", "target"])
    calls = merge_calls(hit, ["seq"])
    return {"module": module, "class": classes, "function": functions, "contains": contains, "imports": _edges(imp, "IMPORTS", names=F.col("names")), "calls": _edges(calls, "CALLS", count=F.col("count"), call_sites=F.col("call_sites")), "sites": resolved}


def sym_alias(im: DataFrame) -> DataFrame:
    return im.where("symbol is not null").select("module", "alias", "target", "symbol")


def history(spark: SparkSession, root: str, repo: str, functions: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    """Commits, issues, MODIFIES, TOUCHES and FIXES of a repository, anchored at the functions (path, qualname, id) and
    modules (path, id) of today; dangling counts changes of functions that are gone."""
    changes = stored(read_git(spark, root), "git-changes")
    cid = F.concat_ws("::", F.lit(repo), F.lit("commit"), "commit")
    commits = changes.select(cid.alias("id"), F.lit("Commit").alias("label"), F.lit(repo).alias("repo"), F.col("commit").alias("hash"), "author", "authored_at", "message", "files_changed", "insertions", "deletions").distinct()
    py = changes.where("patch <> '' and (a_path like '%.py' or b_path like '%.py')").withColumn("path", F.coalesce("b_path", "a_path"))
    lines = stored(changed_lines(py, ["commit", "path", "a_blob", "b_blob"]).withColumn("blob", F.when(F.col("side") == "new", F.col("b_blob")).otherwise(F.col("a_blob"))), "git-lines")
    # A blob is read and parsed once, however many commits show it.
    parsed = stored(parse_sources(read_blobs(lines.select("blob"), root).withColumn("relpath", F.lit("x.py")), keys=("blob",)), "git-blobs")
    table = spans(function_facts(parsed), "blob")
    failed = parsed.where("not parsed").select("blob")
    broken = lines.join(failed, "blob", "left_semi").select("commit", "path").distinct()
    n = lambda side: F.count(F.when(F.col("side") == side, 1)).cast("int")
    touched = lines.join(broken, ["commit", "path"], "left_semi").groupBy("commit", "path").agg(n("new").alias("a"), n("old").alias("d"))
    touches = touched.join(modules.select("path", F.col("id").alias("dst")), "path").select(cid.alias("src"), "dst", "a", "d")
    per = lines_in_spans(lines.join(broken, ["commit", "path"], "left_anti"), table).groupBy("commit", "path", "qualname").agg(n("new").alias("a"), n("old").alias("d"))
    head = functions.select("path", "qualname", F.col("id").alias("dst")).distinct()
    m = per.join(head, ["path", "qualname"]).select(cid.alias("src"), "dst", "a", "d")
    dangling = per.join(head, ["path", "qualname"], "left_anti")
    fx = commits.select(F.col("id").alias("src"), F.explode(fixes(F.col("message"))).alias("f")).select("src", F.concat_ws("::", F.lit(repo), F.lit("issue"), F.col("f.number").cast("string")).alias("dst"), "f.number", "f.pattern")
    issues = fx.select(F.col("dst").alias("id"), F.lit("Issue").alias("label"), "number", F.lit(True).alias("stub")).distinct()
    props = {"lines_added": F.col("a"), "lines_deleted": F.col("d")}
    distinct = parsed.agg(F.count("*")).first()[0]
    uses = lines.select("commit", "path", "side", "blob").distinct().count()
    return {"commit": commits, "issue": issues, "modifies": _edges(m, "MODIFIES", overlap_lines=F.col("a") + F.col("d"), **props), "touches": _edges(touches, "TOUCHES", **props), "fixes": _edges(fx, "FIXES", pattern=F.col("pattern")), "dangling": dangling, "blob_cache_hit_rate": round(1 - distinct / uses, 4) if uses else None}


def build_graph(spark: SparkSession, root: str, repo: str, settings: Settings | None = None) -> tuple[Graph, dict]:
    """The whole ingestion: (graph, counters)."""
    settings = settings or Settings.of(spark)
    files = read_worktree(spark, root, repo, settings)
    parsed = stored(parse_sources(files, settings.src_roots), "parsed")
    s = structure(parsed, settings)
    s |= {k: stored(s[k], f"graph-{k}") for k in ("module", "class", "function")}
    h = history(spark, root, repo, s["function"], s["module"])
    nodes = None
    for part in ("module", "class", "function"):
        nodes = s[part].drop("module") if nodes is None else nodes.unionByName(s[part].drop("module"), allowMissingColumns=True)
    nodes = nodes.unionByName(h["commit"], allowMissingColumns=True).unionByName(h["issue"], allowMissingColumns=True)
    edges = s["contains"].unionByName(s["imports"]).unionByName(s["calls"]).unionByName(h["modifies"]).unionByName(h["touches"]).unionByName(h["fixes"])
    graph = Graph(stored(nodes.dropDuplicates(["id"]), "graph-nodes"), stored(edges, "graph-edges"))
    site = s["sites"].agg(F.count("*").alias("n"), F.count("target").alias("hit")).first()
    counters = {"parse_skips": parsed.where("not parsed").count(), "calls_resolved": site["hit"], "call_resolved_rate": round(site["hit"] / site["n"], 4) if site["n"] else None, "dangling_modifies": h["dangling"].count(), "blob_cache_hit_rate": h["blob_cache_hit_rate"]}
    return graph, counters
