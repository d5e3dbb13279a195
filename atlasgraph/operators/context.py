"""Context assembly: latest commits, concept expansion, overview, repository card, budgeted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled_line
from ..session import stored
from .graph import Graph, by_label, by_type, tail

COMMITS, CONCEPTS, IMPLEMENTERS, CONCEPT_COMMITS = 6, 8, 8, 4
TOP_MODULES, TOP_HOT, TOP_CONCEPTS = 8, 5, 8
BUDGET = 6000
NOTICE = "…（上下文因预算截断，仅保留高优先级内容）"


def latest_commits(graph: Graph, ids: DataFrame, n: int = COMMITS) -> DataFrame:
    """(id, commit, authored_at, rank): the n latest commits that modify each id, by the time's text and then the id."""
    k = by_label(graph.nodes, "Commit").select(F.col("id").alias("commit"), "authored_at")
    m = by_type(graph.edges, "MODIFIES").select(F.col("dst").alias("id"), F.col("src").alias("commit")).join(ids.select("id").distinct(), "id", "left_semi").join(k, "commit")
    w = Window.partitionBy("id").orderBy(F.desc("authored_at"), F.desc("commit"))
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("id", "commit", "authored_at", "rank")


def _ranked(rows: DataFrame, key: str, order: list[Column], n: int, out: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    top = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return top.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]).alias(out))


def concept_expansion(graph: Graph, concepts: DataFrame) -> DataFrame:
    """(id, implementers, commits): of each concept the first 8 functions, then modules, that implement it, and the 4
    latest commits that describe it."""
    ids = concepts.select("id").distinct()
    node = graph.nodes.select(F.col("id").alias("x"), "label", "qualname", "path", "authored_at")
    impl = by_type(graph.edges, "IMPLEMENTS").select(F.col("dst").alias("id"), F.col("src").alias("x")).join(ids, "id", "left_semi").join(node.where("label in ('Function', 'Module')"), "x")
    desc = by_type(graph.edges, "DESCRIBES").select(F.col("dst").alias("id"), F.col("src").alias("x")).join(ids, "id", "left_semi").join(node, "x")
    a = _ranked(impl, "id", [(F.col("label") != "Function").cast("int"), F.coalesce("qualname", "path"), F.col("x")], IMPLEMENTERS, "implementers")
    b = _ranked(desc, "id", [F.desc("authored_at"), F.desc("x")], CONCEPT_COMMITS, "commits")
    none = F.array().cast("array<string>")
    return ids.join(a, "id", "left").join(b, "id", "left").select("id", F.coalesce("implementers", none).alias("implementers"), F.coalesce("commits", none).alias("commits"))


def _targets(graph: Graph, etype: str) -> DataFrame:
    """(name, n): how often each known node is a target."""
    n = by_type(graph.edges, etype).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return n.join(graph.nodes.select("id"), "id", "left_semi")


def overview_rows(graph: Graph) -> DataFrame:
    """(section, name, n): the largest modules, the most changed functions, the concepts implemented most."""
    mods = by_label(graph.nodes, "Module").orderBy(F.desc(F.coalesce("loc", F.lit(0))), "path").limit(TOP_MODULES).select(F.lit("modules").alias("section"), F.col("path").alias("name"), F.col("loc").cast("long").alias("n"))
    hot = _targets(graph, "MODIFIES").orderBy(F.desc("n"), "id").limit(TOP_HOT).select(F.lit("hot"), "id", "n")
    core = _targets(graph, "IMPLEMENTS").orderBy(F.desc("n"), "id").limit(TOP_CONCEPTS).select(F.lit("concepts"), "id", "n")
    return mods.union(hot).union(core)


def _optional(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)


def entrypoints(graph: Graph) -> DataFrame:
    """(id, qualname, http_method, route_path) of every endpoint."""
    fn = by_label(graph.nodes, "Function").where("is_endpoint")
    return fn.select("id", "qualname", _optional(fn, "http_method"), _optional(fn, "route_path"))


def repo_card(graph: Graph) -> DataFrame:
    """One row: the repositories, the counts by label, the overview's lists as arrays of structs, and all entry points (endpoints)."""
    repos = F.array_join(F.sort_array(F.collect_set(_optional(graph.nodes, "repo"))), ", ").alias("repo")
    stats = graph.nodes.groupBy().agg(repos, *[F.count(F.when(F.col("label") == x, 1)).alias(f"n_{x.lower()}") for x in ("Module", "Class", "Function", "Commit", "Issue", "Concept")])
    rows = overview_rows(graph)
    lists = rows.groupBy().agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == s, F.struct((-F.col("n")).alias("k"), F.col("name"))))), lambda x: F.struct(x["name"].alias("name"), (-x["k"]).alias("n"))).alias(s) for s in ("modules", "hot", "concepts")])
    ends = entrypoints(graph).groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "qualname", "http_method", "route_path"))).alias("entrypoints"))
    return stats.crossJoin(lists).crossJoin(ends)  # one row each


def card_text(graph: Graph, summary: str | None = None) -> DataFrame:
    """One row: the card as text. Repositories, counts, the summary if there is one, the overview's lists and all entry points."""
    nodes = graph.nodes
    count = lambda x: F.count(F.when(F.col("label") == x, 1)).cast("string")
    repos = F.array_join(F.sort_array(F.collect_set(_optional(nodes, "repo"))), ", ")
    size = F.concat(F.lit("规模: 模块 "), count("Module"), F.lit(" · 类 "), count("Class"), F.lit(" · 函数 "), count("Function"), F.lit(" · 提交 "), count("Commit"), F.lit(" · 概念 "), count("Concept"))
    told = [F.lit(""), F.lit("【概述】（来源: 索引期网关生成 · 已过专名白名单校验）"), F.lit(summary)] if summary else []
    none = F.count(F.when((F.col("label") == "Function") & F.col("is_endpoint"), 1)) == 0
    head = [F.lit("【仓库卡片】（来源: 图谱统计 · level-0 repo_card）"), F.concat(F.lit("仓库: "), F.when(repos == "", "(unknown)").otherwise(repos)), size, *told]
    ends_title = F.when(none, "【入口点】（来源: Function.is_endpoint 聚合）: （本图无 HTTP 端点）").otherwise("【入口点】（来源: Function.is_endpoint 聚合）")

    def part(df: DataFrame, s: int, k: Column, name: Column, line: Column, title: str | None = None) -> DataFrame:
        rows = df.select(F.lit(s).alias("s"), F.lit(2).alias("t"), k.cast("long").alias("k"), name.alias("name"), line.alias("line"))
        if title is None:
            return rows
        first = rows.limit(1).select("s", F.posexplode(F.array(F.lit(""), F.lit(title))).alias("t", "line"))
        return rows.unionByName(first.select("s", "t", F.lit(0).cast("long").alias("k"), F.lit("").alias("name"), "line"))

    once = nodes.groupBy().agg(F.array(*head).alias("head"), F.array(F.lit(""), ends_title).alias("ends"))
    fixed = once.select(F.lit(0).alias("s"), F.posexplode("head").alias("t", "line")).unionByName(once.select(F.lit(4).alias("s"), F.posexplode("ends").alias("t", "line")))
    out = fixed.select("s", "t", F.lit(0).cast("long").alias("k"), F.lit("").alias("name"), "line")
    doc = first_filled_line(F.col("text"))
    mods = by_label(nodes, "Module").orderBy(F.desc(F.coalesce("loc", F.lit(0))), "path").limit(TOP_MODULES)
    shown = F.concat(F.lit("- "), F.coalesce("path", F.lit("?")), F.lit(" (loc="), F.coalesce(F.col("loc").cast("string"), F.lit("?")), F.lit("): "), F.when(F.coalesce(doc, F.lit("")) == "", "（无 docstring）").otherwise(doc))
    out = out.unionByName(part(mods, 1, -F.coalesce("loc", F.lit(0)), F.coalesce("path", F.lit("")), shown, "【顶层模块】（来源: Module 按 loc 降序）"))
    about = nodes.select("id", "qualname", "name", "text")
    hot = _targets(graph, "MODIFIES").orderBy(F.desc("n"), "id").limit(TOP_HOT).join(about, "id")
    out = out.unionByName(part(hot, 2, -F.col("n"), F.col("id"), F.concat(F.lit("- "), F.coalesce("qualname", tail(F.col("id"))), F.lit(" (被 "), F.col("n").cast("string"), F.lit(" 次提交修改)")), "【热点函数】（来源: MODIFIES 计数，改动最频繁）"))
    core = _targets(graph, "IMPLEMENTS").orderBy(F.desc("n"), "id").limit(TOP_CONCEPTS).join(about, "id")
    out = out.unionByName(part(core, 3, -F.col("n"), F.col("id"), F.concat(F.lit("- "), F.coalesce("name", tail(F.col("id"))), F.lit(" (落 "), F.col("n").cast("string"), F.lit(" 处实现): "), F.coalesce(doc, F.lit(""))), "【核心概念】（来源: IMPLEMENTS 落点最多）"))
    ends = entrypoints(graph)
    out = out.unionByName(part(ends, 4, F.lit(0), F.col("id"), F.concat(F.lit("- "), F.coalesce("qualname", F.lit("")), F.lit(" ["), F.coalesce("http_method", F.lit("?")), F.lit(" "), F.coalesce("route_path", F.lit("?")), F.lit("]"))))
    return out.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "t", "k", "name", "line"))), lambda x: x["line"]), "\n").alias("card"))


def within_budget(lines: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """(key, context_text) of rows (key, seq, line): whole lines while the running length, line ends included, keeps
    within the budget; what was cut is told behind it, beyond the budget."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.withColumn("sum", F.sum(F.length("line") + 1).over(w))
    kept = F.sort_array(F.collect_list(F.when(F.col("sum") <= budget, F.struct("seq", "line"))))
    body = F.array_join(F.transform(kept, lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return run.groupBy(key).agg(F.concat(body, F.when(F.max("sum") > budget, F.lit(NOTICE)).otherwise("")).alias("context_text"))


def symbol_lines(graph: Graph, linked: DataFrame) -> DataFrame:
    """(qid, seq, line) of the symbol context: cards of the linked entities, impact, commits, concepts, in this order.

    linked has qid, id, label, name, rank. seq keeps sections apart, so a budget cuts the least important first.
    """
    from .impact import impact

    node = graph.nodes.select("id", "qualname", "path", "text", "loc", "name")
    card = linked.select("qid", "id", "label", "rank").join(node, "id")
    doc = first_filled_line(F.col("text"))
    doc = F.when(doc == "", "（无 docstring）").otherwise(doc)
    body = (
        F.when(F.col("label") == "Function", F.array(F.concat(F.lit("- [Function] "), "qualname", F.lit("  （文件: "), "path", F.lit("）")), F.concat(F.lit("    说明: "), doc)))
        .when(F.col("label") == "Class", F.array(F.concat(F.lit("- [Class] "), "qualname", F.lit("  （文件: "), "path", F.lit("）")), F.concat(F.lit("    说明: "), doc)))
        .when(F.col("label") == "Module", F.array(F.concat(F.lit("- [Module] "), "name", F.lit("  （路径: "), "path", F.lit(", loc="), F.col("loc").cast("string"), F.lit("）")), F.concat(F.lit("    说明: "), doc)))
        .otherwise(F.array(F.concat(F.lit("- [Concept] "), F.coalesce("name", tail(F.col("id"))))))
    )

    def lines(df: DataFrame, section: int, order: Column, values: Column) -> DataFrame:
        return df.select("qid", order.alias("o"), F.posexplode(values).alias("p", "line")).select("qid", F.struct(F.lit(section).alias("s"), F.col("o").cast("long").alias("o"), F.col("p").cast("long").alias("p")).alias("seq"), "line")

    heads = linked.select("qid").distinct()
    out = lines(heads, 0, F.lit(0), F.array(F.lit("【命中实体】（来源: 图谱节点）"))).unionByName(lines(card, 1, F.col("rank"), body))
    fns = linked.where("label = 'Function'").select("qid", "id", "rank")
    # A qualname that several functions have gets no impact block.
    unique = by_label(graph.nodes, "Function").groupBy("qualname").agg(F.count("*").alias("n"), F.first("id").alias("id")).where("n = 1").select("id")
    hit = stored(impact(graph, fns.select("id").distinct().join(unique, "id", "left_semi"), 2, "calls"), "context-impact").withColumnRenamed("resolved_symbol", "id")
    short = lambda c: F.when(F.size(c) == 0, "（无）").otherwise(F.array_join(F.transform(c, lambda x: tail(x)), ", "))
    block = F.array(
        F.concat(F.lit("- 目标 "), tail(F.col("id")), F.lit(":")), F.concat(F.lit("    直接调用方: "), short(F.col("direct_callers"))), F.concat(F.lit("    间接调用方: "), short(F.col("transitive_callers"))),
        F.concat(F.lit("    受影响端点: "), short(F.col("affected_endpoints"))), F.concat(F.lit("    受影响模块: "), short(F.col("affected_modules"))),
    )
    hits = fns.join(hit, "id")
    out = out.unionByName(lines(hits.select("qid").distinct(), 2, F.lit(0), F.array(F.lit(""), F.lit("【影响面】（来源: CALLS 反向 BFS, depth=2）")))).unionByName(lines(hits, 3, F.col("rank"), block))
    k = by_label(graph.nodes, "Commit").select(F.col("id").alias("commit"), "hash", "authored_at", "text")
    m = by_type(graph.edges, "MODIFIES").select(F.col("dst").alias("id"), F.col("src").alias("commit"))
    touched = fns.select("qid", "id").join(m, "id").select("qid", "commit").distinct().join(k, "commit")
    touched = touched.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("authored_at"), F.desc("commit")))).where(F.col("rank") <= COMMITS)
    out = out.unionByName(lines(touched.select("qid").distinct(), 4, F.lit(0), F.array(F.lit(""), F.lit("【相关提交】（来源: MODIFIES）"))))
    out = out.unionByName(lines(touched, 5, F.col("rank"), F.array(F.concat(F.lit("- "), F.substring("hash", 1, 8), F.lit(" "), "authored_at", F.lit(": "), first_filled_line(F.col("text"))))))
    direct = linked.where("label = 'Concept'").select("qid", F.col("id").alias("concept"), F.lit(0).alias("way"))
    implements = fns.join(by_type(graph.edges, "IMPLEMENTS").select(F.col("src").alias("id"), F.col("dst").alias("concept")), "id").select("qid", "concept", F.lit(1).alias("way"))
    described = touched.join(by_type(graph.edges, "DESCRIBES").select(F.col("src").alias("commit"), F.col("dst").alias("concept")), "commit").select("qid", "concept", F.lit(2).alias("way"))
    con = direct.unionByName(implements).unionByName(described).groupBy("qid", "concept").agg(F.min("way").alias("way")).join(by_label(graph.nodes, "Concept").select(F.col("id").alias("concept"), "name", "text"), "concept")
    con = con.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("way", "concept"))).where(F.col("rank") <= CONCEPTS)
    out = out.unionByName(lines(con.select("qid").distinct(), 6, F.lit(0), F.array(F.lit(""), F.lit("【相关概念】（来源: 命中概念 / IMPLEMENTS / DESCRIBES）"))))
    return out.unionByName(lines(con, 7, F.col("rank"), F.array(F.concat(F.lit("- "), "name", F.lit(": "), first_filled_line(F.col("text"))))))


def card_summary(card: dict, client=None, retries: int = 2, limit: int = 300) -> str | None:
    """A client's summary of a card (client(card) -> text); None without a client, on failure, or where the text is too long or
    names an identifier that the card doesn't."""
    import json
    import re

    known = json.dumps(card, ensure_ascii=False, default=str)
    for _ in range(retries + 1 if client else 0):
        try:
            text = (client(card) or "").strip()
        except Exception:
            continue
        if text and len(text) <= limit and all(name in known for name in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", text)):
            return text
    return None


def load_or_build_card(graph: Graph, path: str) -> DataFrame:
    """The card kept below path for this very graph, else one worked out now (degraded). The cache goes by the graph's own
    counts, so another graph never gets it."""
    from .graph import counts

    spark = graph.nodes.sparkSession
    mark = counts(graph).agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", F.coalesce("name", F.lit("")), F.col("n").cast("string")))), ",")).alias("m")).first()["m"]
    try:
        return spark.read.parquet(f"{path}/{mark}").withColumn("degraded", F.lit(False))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    card = repo_card(graph)
    card.write.mode("overwrite").parquet(f"{path}/{mark}")
    return spark.read.parquet(f"{path}/{mark}").withColumn("degraded", F.lit(True))
