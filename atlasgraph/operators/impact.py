"""Impact: symbol resolution, bounded reverse closures over calls or imports, all-sources closures.

A closure goes by numbers instead of names and hop by hop: each frontier is joined with the edges, made distinct, and
freed of what was reached before, so a cycle or a hub is expanded once per seed. Frontiers are written to the shared
folder, an empty one ends the closure. The hop count is bounded by 4. Where only something about each closure is asked,
seeds go through blocks (reach) and the pairs of seed and node are never rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from . import reach
from .graph import Graph, by_label, by_type, reverse

DEPTHS = (1, 2, 3, 4)
MODES = ("calls", "imports")


def check_arguments(depth, mode: str) -> None:
    if isinstance(depth, bool) or not isinstance(depth, int) or depth not in DEPTHS:
        raise ValueError(f"depth must be a whole number from 1 to 4, not {depth!r}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def resolve_symbols(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, status, id, candidates) per wanted symbol: an exact qualname beats all names that end in '.symbol';
    one match is a hit, several are ambiguous (sorted candidates), none is not_found.

    The suffix rule is an equi-join: every function offers its qualname and all that follows one of its dots.
    """
    fn = by_label(nodes, "Function").where("qualname is not null").select("id", "qualname")
    parts = F.split("qualname", r"\.")
    keys = fn.select("id", F.col("qualname").alias("symbol"), F.lit(1).alias("exact")).unionByName(
        fn.where("qualname like '%.%'").withColumn("p", parts).select("id", F.explode(F.expr("transform(sequence(2, size(p)), i -> array_join(slice(p, i, size(p)), '.'))")).alias("symbol"), F.lit(0).alias("exact"))
    )
    wanted = symbols.select("symbol").distinct()
    hits = wanted.join(keys, "symbol", "left").groupBy("symbol").agg(
        F.sort_array(F.collect_set(F.when(F.col("exact") == 1, F.col("id")))).alias("e"), F.sort_array(F.collect_set(F.when(F.col("exact") == 0, F.col("id")))).alias("s")
    )
    best = hits.select("symbol", F.when(F.size("e") > 0, F.col("e")).otherwise(F.col("s")).alias("c"))
    status = F.when(F.size("c") == 1, "ok").when(F.size("c") > 1, "ambiguous").otherwise("not_found")
    return best.select("symbol", status.alias("status"), F.when(F.size("c") == 1, F.col("c")[0]).alias("id"), F.when(F.size("c") > 1, F.col("c")).alias("candidates"))


@dataclass
class Closure:
    """levels (seed, node, level) and edges (node, pred) in numbers, names (n, name) for them."""

    levels: DataFrame
    edges: DataFrame
    names: DataFrame

    def numbered(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with these columns' names as numbers; rows with a name that the closure doesn't know are dropped."""
        for c in columns:
            df = df.join(self.names.select(F.col("name").alias(c), F.col("n").alias(f"{c}#")), c).drop(c).withColumnRenamed(f"{c}#", c)
        return df

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(self.names.select(F.col("n").alias(c), F.col("name").alias(f"{c}#")), c).drop(c).withColumnRenamed(f"{c}#", c)
        return df


def closure(seeds: DataFrame, rev: DataFrame, depth: int) -> Closure:
    """All nodes that reach the seeds' nodes in at most depth hops with their smallest hop; seeds have level 0.

    seeds has seed and node, rev has node and pred.
    """
    names = [df.select(F.col(c).alias("name")) for df, c in ((seeds, "seed"), (seeds, "node"), (rev, "node"), (rev, "pred"))]
    every = names[0].unionByName(names[1]).unionByName(names[2]).unionByName(names[3]).distinct()
    out = Closure(None, None, stored(every.withColumn("n", F.monotonically_increasing_id()), "closure-names"))
    out.edges = stored(out.numbered(rev.select("node", "pred"), "node", "pred").distinct(), "closure-edges")
    new = stored(out.numbered(seeds.select("seed", "node"), "seed", "node").distinct().withColumn("level", F.lit(0)), "closure-level")
    out.levels = new
    for d in range(1, depth + 1):
        step = new.join(out.edges, "node").select("seed", F.col("pred").alias("node")).distinct()
        new = stored(step.join(out.levels.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("level", F.lit(d)), "closure-level")
        if new.isEmpty():
            break
        out.levels = out.levels.unionByName(new)
    return out


def bfs_levels(seeds: DataFrame, rev: DataFrame, depth: int) -> DataFrame:
    """The closure's (seed, node, level) by name."""
    c = closure(seeds, rev, depth)
    return c.named(c.levels, "seed", "node").select("seed", "node", "level")


def level_sizes(seeds: DataFrame, rev: DataFrame, depth: int) -> DataFrame:
    """(seed, level, nodes): how many nodes the closure has by level; names are looked up for these rows only."""
    c = closure(seeds, rev, depth)
    return c.named(c.levels.groupBy("seed", "level").agg(F.count("*").alias("nodes")), "seed").select("seed", "level", "nodes")


def cut_short(c: Closure, depth: int) -> DataFrame:
    """(seed, truncated) by name of the closure's seeds that have more nodes beyond the depth."""
    return c.named(truncated(c.levels, c.edges, depth), "seed").select("seed", "truncated")


def truncated(levels: DataFrame, rev: DataFrame, depth: int) -> DataFrame:
    """Seeds whose last frontier (level = depth) has a predecessor that the closure doesn't hold."""
    last = levels.where(F.col("level") == depth).select("seed", "node").join(rev, "node").select("seed", F.col("pred").alias("node")).distinct()
    return last.join(levels, ["seed", "node"], "left_anti").select("seed").distinct().withColumn("truncated", F.lit(True))


def numbered(seeds: DataFrame, rev: DataFrame, *more: DataFrame) -> Closure:
    """Numbers for the seeds (seed), the edges (node, pred) and further tables of one column, and the edges by them."""
    out = Closure(seeds, None, reach.numbers(seeds.select("seed"), rev.select("node"), rev.select("pred"), *more))
    out.edges = stored(out.numbered(rev.select("node", "pred"), "node", "pred"), "reach-edges")
    out.levels = stored(out.numbered(seeds.select("seed").distinct(), "seed"), "reach-seeds")
    return out


def truncated_seeds(seeds: DataFrame, rev: DataFrame, depth: int) -> DataFrame:
    """(seed, truncated) by name of the seeds (seed) whose closure has more nodes beyond the depth."""
    c = numbered(seeds, rev)
    return c.named(reach.in_blocks(c.levels, c.edges, depth, reach.ask_cut, "seed long"), "seed").select("seed", F.lit(True).alias("truncated"))


def module_counts(graph: Graph, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, n, first, last) by name: how many modules hold what calls the seed (seed) within so many hops, itself included, and
    the first and the last of them; a seed with none has no row."""
    home = stored(modules_of(graph), "reach-home")
    c = numbered(seeds, reverse(graph.edges, "CALLS"), home.select("module"))
    homes = stored(c.numbered(home.withColumnRenamed("id", "node"), "node", "module"), "reach-homes")
    out = stored(reach.in_blocks(c.levels, c.edges, depth, reach.ask_modules, "seed long, n long, first long, last long", homes=homes), "reach-modules")
    return c.named(out, "seed", "first", "last").select("seed", "n", "first", "last")


def modules_of(graph: Graph) -> DataFrame:
    """(id, module): the module that contains a node, directly or through its class; two steps at most."""
    contains = by_type(graph.edges, "CONTAINS").select(F.col("src").alias("parent"), F.col("dst").alias("id")).distinct()
    label = graph.nodes.select(F.col("id").alias("parent"), "label")
    up = contains.join(label, "parent")
    direct = up.where("label = 'Module'").select("id", F.col("parent").alias("module"))
    above = up.where("label = 'Module'").select(F.col("id").alias("parent"), F.col("parent").alias("module"))
    through = up.where("label = 'Class'").join(above, "parent").select("id", "module")
    return direct.unionByName(through).distinct()


def _row(lists: DataFrame, depth: int, mode: str) -> DataFrame:
    none = F.array().cast("array<string>") if dict(lists.dtypes)["ends"] == "array<string>" else F.lit("")
    filled = lambda c, name: F.coalesce(c, none).alias(name)
    return lists.select(
        F.col("seed").alias("resolved_symbol"), F.lit(mode).alias("mode"), F.lit(depth).alias("depth"), F.col("direct").alias("direct_callers"), F.col("transitive").alias("transitive_callers"),
        filled("ends", "affected_endpoints"), filled("modules", "affected_modules"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def impact(graph: Graph, targets: DataFrame, depth: int = 3, mode: str = "calls", joined: str | None = None) -> DataFrame:
    """A row per target function (targets has id): callers by level, endpoints, modules, whether the depth cut it short.

    calls: reverse closure over CALLS, the target included in endpoints and modules. imports: the target's
    modules and all that import them; endpoints are those in any of these modules. joined (calls): texts instead of lists, with
    this between the names.
    """
    check_arguments(depth, mode)
    if joined is not None and mode != "calls":
        raise ValueError("only lists of calls come joined")
    if mode == "calls":  # each is asked several times
        graph = Graph(stored(graph.nodes.select("id", "label", "is_endpoint"), "impact-nodes"), stored(by_type(graph.edges, "CALLS", "CONTAINS").select("src", "type", "dst"), "impact-edges"))
    home = modules_of(graph)
    ordered = lambda c, name: F.sort_array(F.collect_set(c)).alias(name)
    ends = by_label(graph.nodes, "Function").where("is_endpoint").select("id")
    if mode == "calls":
        home = stored(home.join(graph.nodes.select("id"), "id", "left_semi"), "impact-home")
        c = numbered(targets.select(F.col("id").alias("seed")), reverse(graph.edges, "CALLS"), home.select("module"))
        homes = stored(c.numbered(home.withColumnRenamed("id", "node"), "node", "module"), "impact-homes")
        at = stored(c.numbered(ends.select(F.col("id").alias("node")).distinct(), "node"), "impact-ends")
        discard(graph.nodes, graph.edges, home)
        ask, schema = (reach.ask_lists, reach.LISTS) if joined is None else (partial(reach.ask_lists, joined=joined), reach.TEXTS)
        return _row(reach.in_blocks(c.levels, c.edges, depth, ask, schema, ends=at, homes=homes, names=c.names), depth, mode)
    rev = reverse(graph.edges, "IMPORTS")
    seeds = targets.select(F.col("id").alias("seed"), "id").join(home, "id").select("seed", F.col("module").alias("node"))
    c = closure(seeds, rev, depth)
    levels = stored(c.named(c.levels, "seed", "node").select("seed", "node", "level"), "impact-levels")
    out = levels.groupBy("seed").agg(ordered(F.when(F.col("level") == 1, F.col("node")), "direct"), ordered(F.when(F.col("level") >= 2, F.col("node")), "transitive"))
    modules = levels.groupBy("seed").agg(ordered("node", "modules"))
    endpoints = levels.join(home.withColumnRenamed("module", "node"), "node").join(ends, "id", "left_semi").groupBy("seed").agg(ordered("id", "ends"))
    for extra in (endpoints, modules, cut_short(c, depth)):
        out = out.join(extra, "seed", "left")
    return _row(out, depth, mode)


def impact_analysis(graph: Graph, symbol: str, depth: int = 3, mode: str = "calls") -> dict:
    """The single-symbol call: a dictionary, with error (and candidates) where the symbol doesn't resolve."""
    check_arguments(depth, mode)
    spark = graph.nodes.sparkSession
    found = resolve_symbols(graph.nodes, spark.createDataFrame([(symbol,)], "symbol string")).first()
    if found["status"] != "ok":
        return {"error": found["status"]} | ({"candidates": list(found["candidates"])} if found["candidates"] else {})
    row = impact(graph, spark.createDataFrame([(found["id"],)], "id string"), depth, mode).first()
    if row is None:  # imports: the function lies in no module
        return {"resolved_symbol": found["id"], "mode": mode, "depth": depth, "direct_callers": [], "transitive_callers": [], "affected_endpoints": [], "affected_modules": [], "truncated": False}
    return row.asDict()


def blast_radius(graph: Graph, depth: int = 3, calls: Closure | None = None) -> DataFrame:
    """(id, blast_radius, blast_endpoints) of every function: its reverse call closure without itself. calls: the numbers of
    functions and calls if they are there already."""
    fn = stored(by_label(graph.nodes, "Function").select("id", "is_endpoint"), "blast-functions")
    c = calls or numbered(fn.select(F.col("id").alias("seed")), reverse(graph.edges, "CALLS"))
    ends = stored(c.numbered(fn.where("is_endpoint").select(F.col("id").alias("node")), "node"), "blast-ends")
    size = stored(reach.in_blocks(c.levels, c.edges, depth, reach.ask_size, "seed long, nodes long, ends long", ends=ends), "blast-sizes")
    return c.named(size, "seed").select(F.col("seed").alias("id"), F.col("nodes").alias("blast_radius"), F.col("ends").alias("blast_endpoints"))


def caller_pattern(graph: Graph, targets: DataFrame, hops: int = 3) -> DataFrame:
    """(id, callers): of each target all that call it over one to so many CALLS, itself included where it lies on a cycle."""
    rev = reverse(graph.edges, "CALLS")
    # The callers' closures, and the target itself if one of its closure's inner nodes calls it back, or it itself.
    c = closure(targets.select(F.col("id").alias("seed"), F.col("id").alias("node")), rev, hops)
    back = c.levels.where(F.col("level") < hops).join(c.edges, "node").where("pred = seed").select("seed", F.col("seed").alias("node")).distinct()
    found = c.named(c.levels.where("level > 0").select("seed", "node").unionByName(back), "seed", "node").withColumnRenamed("seed", "id")
    callers = found.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("callers"))
    return targets.select("id").distinct().join(callers, "id", "left").select("id", F.coalesce("callers", F.array().cast("array<string>")).alias("callers"))


def path_exists(edges: DataFrame, chains: DataFrame, etype: str = "CALLS") -> DataFrame:
    """(chain_id, holds): whether every step of the chain (an array of ids) is an edge; a chain of one id holds."""
    ends = F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("src"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("dst"))
    steps = chains.where("size(chain) > 1").select("chain_id", F.explode(ends).alias("s"))
    e = by_type(edges, etype).select("src", "dst").distinct()
    broken = steps.select("chain_id", "s.src", "s.dst").join(e, ["src", "dst"], "left_anti").select("chain_id").distinct().withColumn("b", F.lit(1))
    return chains.select("chain_id").join(broken, "chain_id", "left").select("chain_id", F.col("b").isNull().alias("holds"))
