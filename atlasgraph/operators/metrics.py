"""Graph metrics: fan-in, change heat, fix involvement, blast radius, PageRank, degrees, and their join per node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from . import reach
from .graph import Graph, by_label, by_type, forward
from .impact import Closure, blast_radius, numbered

WINDOW_DAYS = 90
DAMPING, TOLERANCE, MAX_ROUNDS = 0.85, 1e-6, 200


def fan_in(graph: Graph, calls: Closure | None = None) -> DataFrame:
    """(id, fan_in): distinct callers of every function, 0 where none. calls: the numbers of functions and calls if they are there
    already."""
    if calls:
        callers = calls.edges.groupBy(F.col("node").alias("seed")).agg(F.count_distinct("pred").alias("fan_in"))
        return calls.named(calls.levels.join(callers, "seed", "left"), "seed").select(F.col("seed").alias("id"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
    callers = by_type(graph.edges, "CALLS").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("fan_in"))
    return by_label(graph.nodes, "Function").select("id").join(callers, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def window_start(nodes: DataFrame) -> DataFrame:
    """One row: 90 days before the newest commit."""
    return by_label(nodes, "Commit").agg((F.max("created_at") - F.expr(f"interval {WINDOW_DAYS} days")).alias("since"))


def change_heat(graph: Graph) -> DataFrame:
    """(id, commits_all, commits_90d, churn_90d, heat) of every function; heat = all + 2 x recent, the window is inclusive."""
    when = by_label(graph.nodes, "Commit").select(F.col("id").alias("src"), "created_at")
    m = by_type(graph.edges, "MODIFIES").join(when, "src").crossJoin(F.broadcast(window_start(graph.nodes)))  # one row
    recent = F.col("created_at") >= F.col("since")
    lines = F.coalesce("lines_added", F.lit(0)) + F.coalesce("lines_deleted", F.lit(0))
    agg = m.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("commits_all"), F.count_distinct(F.when(recent, F.col("src"))).alias("commits_90d"), F.sum(F.when(recent, lines).otherwise(0)).alias("churn_90d"))
    out = by_label(graph.nodes, "Function").select("id").join(agg, "id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("id", z("commits_all").alias("commits_all"), z("commits_90d").alias("commits_90d"), z("churn_90d").alias("churn_90d"), (z("commits_all") + 2 * z("commits_90d")).alias("heat"))


def fix_involvement(graph: Graph) -> DataFrame:
    """(id, fix_involvement): changes by commits that fix any issue, 0 where none."""
    fixing = by_type(graph.edges, "FIXES").select("src").distinct()
    n = by_type(graph.edges, "MODIFIES").join(fixing, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return by_label(graph.nodes, "Function").select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("fix_involvement"))


def pagerank(graph: Graph, etype: str = "CALLS", label: str = "Function", *, rounds: int | None = None, every: int = 5) -> DataFrame:
    """(id, rank): power iteration until the ranks move by less than 1e-6 in total, at most 200 rounds, or a fixed
    number of rounds. Mass of nodes without out-edges is spread evenly. The ranks sum to 1.

    A round is one join and one aggregation over the edges; every few rounds the ranks are written to the shared
    folder, which cuts the plan, and the round before is dropped there. Without a fixed number of rounds that is every
    round, new ranks beside the old ones, so the change is measured on what was written and the first round below the
    tolerance is the last.
    """
    every = 1 if rounds is None else every
    edges = stored(forward(graph, etype, label), "pagerank-edges")
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    ids = by_label(graph.nodes, label).select("id")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    base = stored(ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg")), "pagerank-nodes")
    rank = base.select("id", "deg", F.lit(1.0 / n).alias("rank"))
    limit = MAX_ROUNDS if rounds is None else rounds
    done = 0
    while done < limit:
        last = rank
        step = min(every, limit - done)
        for _ in range(step):
            loose = rank.agg(F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("rank"))), F.lit(0.0)).alias("loose"))
            push = edges.join(rank.where("deg > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("part")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
            rank = rank.join(push, "id", "left").crossJoin(F.broadcast(loose)).select("id", "deg", F.col("rank").alias("old"), ((1 - DAMPING) / n + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        done += step
        rank = stored(rank, "pagerank")
        discard(last)
        if rounds is None and rank.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < TOLERANCE:
            break
    return rank.select("id", "rank")


def pagerank_at_once(c: Closure, rounds: int | None = None) -> DataFrame:
    """(id, rank) as pagerank has them, of the closure's seeds and the edges among them, all rounds in one task that holds the
    numbers of edges (8 bytes each while they are read). For at most reach.TOGETHER seeds and edges."""
    limit = MAX_ROUNDS if rounds is None else rounds

    def ask(ids: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids.sort()
        n = len(ids)
        place = np.full(max(int(ids[-1]), *(int(x.max(initial=0)) for x in (edges >> 32, edges & 0xFFFFFFFF))) + 1, -1, np.int32)
        place[ids] = np.arange(n, dtype=np.int32)
        edges = np.unique(edges)  # by the target, so that a part of the edges meets a stretch of targets
        dst, src = place[edges >> 32], place[edges & 0xFFFFFFFF]
        both = (dst >= 0) & (src >= 0)
        dst, src = dst[both], src[both]
        deg = np.bincount(src, minlength=n)
        rank = np.full(n, 1.0 / n)
        for _ in range(limit):
            part = np.divide(rank, deg, out=np.zeros(n), where=deg > 0)
            got = np.zeros(n)
            for a in range(0, len(dst), reach.STEP):
                d = dst[a : a + reach.STEP]
                got[d[0] : d[-1] + 1] += np.bincount(d - d[0], weights=part[src[a : a + reach.STEP]])
            old, rank = rank, (1 - DAMPING) / n + DAMPING * (got + rank[deg == 0].sum() / n)
            if rounds is None and np.abs(rank - old).sum() < TOLERANCE:
                break
        for a in range(0, n, reach.VALUES):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + reach.VALUES]), pa.array(rank[a : a + reach.VALUES])], ["seed", "rank"])

    return c.named(reach.in_one(c.levels, c.edges, ask, "seed long, rank double"), "seed").select(F.col("seed").alias("id"), "rank")


def degrees(edges: DataFrame, *types: str) -> DataFrame:
    """(id, degree): in plus out; a self loop counts twice."""
    e = by_type(edges, *types) if types else edges
    return e.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def kept(graph: Graph) -> Graph:
    """What all_metrics reads of the graph, written to the shared folder, as it reads it many times."""
    some = lambda df, *names: df.select(*[c for c in names if c in df.columns])
    nodes = graph.nodes.where(F.col("label").isin("Function", "Module", "Commit"))
    edges = by_type(graph.edges, "CALLS", "IMPORTS", "MODIFIES", "FIXES")
    return Graph(stored(some(nodes, "id", "label", "is_endpoint", "created_at", "cyclomatic"), "metrics-nodes"), stored(some(edges, "src", "type", "dst", "lines_added", "lines_deleted"), "metrics-edges"))


def all_metrics(graph: Graph, rounds: int | None = None, complexity: DataFrame | None = None, wanted: list[str] | None = None) -> DataFrame:
    """One row per function and module with all its metrics; nodes and edges keep their number.

    Functions have null in module_pagerank, modules in all the rest. complexity (id, cyclomatic) are the functions whose
    source was parsed, by default the nodes' own column if there is one; cyclomatic is null for all others. With wanted only
    functions with these metrics of theirs come, and the closures and rounds of others aren't gone through.
    """
    if complexity is None and "cyclomatic" in graph.nodes.columns:
        complexity = by_label(graph.nodes, "Function").select("id", "cyclomatic")
    if complexity is None:
        complexity = graph.nodes.where("false").select("id", F.lit(None).cast("int").alias("cyclomatic"))

    def within(etype: str, label: str) -> Closure:
        """The numbers of nodes and edges; an edge that is there twice stays so, none of what is asked counts it twice."""
        edges = by_type(graph.edges, etype).where("src is not null and dst is not null").select(F.col("dst").alias("node"), F.col("src").alias("pred"))
        return numbered(by_label(graph.nodes, label).select(F.col("id").alias("seed")), edges)

    def ranks(etype: str, label: str, name: str, c: Closure) -> DataFrame:
        small = max(c.levels.count(), c.edges.count()) <= reach.TOGETHER
        return (pagerank_at_once(c, rounds) if small else pagerank(graph, etype, label, rounds=rounds)).select("id", F.round("rank", 8).alias(name))

    calls = within("CALLS", "Function") if wanted is None or {"blast_radius", "blast_endpoints", "pagerank"} & set(wanted) else None
    parts = {
        ("fan_in",): lambda: fan_in(graph, calls), ("commits_all", "commits_90d", "churn_90d", "heat"): lambda: change_heat(graph), ("fix_involvement",): lambda: fix_involvement(graph),
        ("blast_radius", "blast_endpoints"): lambda: blast_radius(graph, calls=calls), ("pagerank",): lambda: ranks("CALLS", "Function", "pagerank", calls), ("cyclomatic",): lambda: complexity,
    }
    out = by_label(graph.nodes, "Function").select("id")
    for names, part in parts.items():
        if wanted is None or set(names) & set(wanted):
            out = out.join(part(), "id", "left")
    functions = out.select("id", F.lit("Function").alias("label"), *(out.columns[1:] if wanted is None else wanted))
    if wanted is not None:
        return functions
    modules = ranks("IMPORTS", "Module", "module_pagerank", within("IMPORTS", "Module")).select("id", F.lit("Module").alias("label"), "module_pagerank")
    return functions.unionByName(modules, allowMissingColumns=True)


def coverage(metrics: DataFrame) -> DataFrame:
    """One row: functions, and how many have callers, changes, fixes; shares to 4 places, null without functions."""
    n = F.count("*")
    share = lambda c: F.round(F.sum(F.when(F.col(c) > 0, 1).otherwise(0)) / F.nullif(n, F.lit(0)), 4)
    return metrics.agg(n.alias("functions"), share("fan_in").alias("called"), share("commits_all").alias("changed"), share("fix_involvement").alias("fixed"))
