"""Command line: index, semantic, viz, impact, stats, all, serve."""

from __future__ import annotations

import argparse
import json
import sys

from .config import Settings
from .operators.graph import Graph, upsert
from .session import cleanup, get_session, stored
from .sources.sinks import load_graph, patch_stats, render_all, save_graph, statistics, write_stats


def _index(spark, args) -> None:
    from .sources.indexer import build_graph

    graph, counters = build_graph(spark, args.root, args.name, Settings.of(spark))
    save_graph(graph, f"{args.out}/graph")
    write_stats(statistics(graph, {"quality": counters}), f"{args.out}/stats.json")


def _semantic(spark, args) -> None:
    """Replies of a model are an input table (JSON lines); asking the model is the caller's affair."""
    from pyspark.sql import functions as F

    from .operators.semantic import run_semantic

    graph = load_graph(spark, f"{args.out}/graph")
    replies = spark.read.schema("id long, name string, ctype string, description string, source_ref string, quote string, confidence double, target_ref string").json(args.replies)
    text = F.coalesce(*[F.col(c) for c in ("message", "docstring") if c in graph.nodes.columns])
    out = run_semantic(replies, graph.nodes.select(F.col("id").alias("source_ref"), text.alias("text")).where("text is not null"), graph.nodes.select("id"), min_confidence=Settings.of(spark).semantic_confidence_min)
    nodes = graph.nodes.unionByName(out["nodes"], allowMissingColumns=True)
    edges = graph.edges.unionByName(out["edges"], allowMissingColumns=True)
    done = Graph(stored(nodes.dropDuplicates(["id"]), "semantic-nodes"), stored(upsert(edges.withColumn("_seq", F.lit(1)), ["src", "type", "dst"], "_seq"), "semantic-edges"))
    save_graph(done, f"{args.out}/graph")
    patch_stats(f"{args.out}/stats.json", {"semantic": out["stats"].first().asDict()})


def _viz(spark, args) -> None:
    print("\n".join(render_all(load_graph(spark, f"{args.out}/graph"), args.out)))


def _impact(spark, args) -> int:
    from .operators.impact import impact_analysis

    try:
        found = impact_analysis(load_graph(spark, f"{args.out}/graph"), args.symbol, args.depth, args.mode)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps(found, ensure_ascii=False, indent=2))
    return 1 if "error" in found else 0


def _stats(spark, args) -> None:
    print(json.dumps(statistics(load_graph(spark, f"{args.out}/graph")), ensure_ascii=False, indent=2))


def _all(spark, args) -> None:
    _index(spark, args)
    if args.replies:
        try:
            _semantic(spark, args)
        except Exception as e:  # the structure is worth keeping without it
            print(f"semantic step left out: {str(e)[:200]}", file=sys.stderr)
    _viz(spark, args)


def _serve(spark, args) -> None:
    from .tools import Tools, serve

    serve(Tools(spark, lambda: load_graph(spark, f"{args.out}/graph")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="atlasgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        s = sub.add_parser(name)
        s.add_argument("--out", default="output")
        for flags, kw in options:
            s.add_argument(flags, **kw)
        s.set_defaults(run=run)

    root, name, replies = ("root", {}), ("--name", {"default": "repo"}), ("--replies", {"default": None})
    add("index", _index, root, name)
    add("semantic", _semantic, ("--replies", {"required": True}))
    add("viz", _viz)
    add("impact", _impact, ("symbol", {}), ("--depth", {"type": int, "default": 3}), ("--mode", {"default": "calls", "choices": ("calls", "imports")}))
    add("stats", _stats)
    add("all", _all, root, name, replies)
    add("serve", _serve)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(get_session(), args) or 0


if __name__ == "__main__":
    code = main()
    cleanup(get_session())  # what other callers of main() still hold is theirs to clean up
    sys.exit(code)
