"""The graph as tables: loading, upserts, label and type scans, counts, set operations.

Nodes are rows (id, label, ...), edges rows (src, type, dst, ...). Writing an id or a triple again merges
property by property, and the later write wins wherever it has a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .orphans import norm_ref

NODE_LABELS = ("Module", "Class", "Function", "Commit", "Issue", "Concept")
EDGE_TYPES = ("CONTAINS", "IMPORTS", "CALLS", "MODIFIES", "TOUCHES", "FIXES", "DESCRIBES", "IMPLEMENTS", "PROPOSES")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def upsert(writes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key; every other column has its value of the latest write (largest seq) in which it isn't null.

    Applying a batch twice changes nothing. Rows with a null key are dropped.
    """
    rest = [c for c in writes.columns if c not in keys and c != seq]
    known = writes.where(" and ".join(f"`{k}` is not null" for k in keys))
    return known.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest])


def valid_labels(nodes: DataFrame) -> DataFrame:
    """Nodes as they are; a label outside the closed set fails the job when it is read."""
    bad = ~F.col("label").isin(*NODE_LABELS) | F.col("label").isNull()
    return nodes.withColumn("label", F.when(bad, F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null"))))).otherwise(F.col("label")))


def by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label)


def by_type(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("type").isin(*types))


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted ids (a table with a column id), each once."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def counts(graph: Graph) -> DataFrame:
    """(kind, name, n) by label and type, with a null name for the totals."""
    n = graph.nodes.rollup("label").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), F.col("label").alias("name"), "n")
    e = graph.edges.rollup("type").agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), F.col("type").alias("name"), "n")
    return n.unionByName(e)


def reverse(edges: DataFrame, etype: str) -> DataFrame:
    """(node, pred) of one edge type, distinct."""
    return by_type(edges, etype).where("src is not null and dst is not null").select(F.col("dst").alias("node"), F.col("src").alias("pred")).distinct()


def forward(graph: Graph, etype: str, label: str) -> DataFrame:
    """(src, dst), distinct, of one type with both ends of one label."""
    ids = by_label(graph.nodes, label).select("id")
    e = by_type(graph.edges, etype).select("src", "dst").distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def tail(c: Column) -> Column:
    """The last part of an id."""
    return F.substring_index(c, "::", -1)


# ---- the graph of the test tables -------------------------------------------------------------------------

_PROPS = ["count", "call_sites", "names", "lines_added", "lines_deleted", "overlap_lines", "pattern", "confidence", "evidence", "quote_unverified"]
ENDPOINT = r"^(dispatch|publish|route)_"


def test_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes and edges of graph_nodes, shared_nodes and graph_edges, with the parts that the ids spell out.

    An id's latest life counts. Documents that name a node as their source_ref lend it their text (the smallest doc_id).
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lives = read("graph_nodes").unionByName(read("shared_nodes")).where("id is not null").withColumn("id", norm_ref(F.col("id")))
    latest = lives.groupBy("id").agg(F.max_by(F.struct("label", "repo", "created_at"), F.col("created_at")).alias("x")).select("id", "x.*")
    texts = read("documents").where("source_ref is not null and text is not null").select(norm_ref(F.col("source_ref")).alias("id"), "doc_id", "text")
    texts = texts.groupBy("id").agg(F.min_by("text", "doc_id").alias("text"))
    part = F.split("id", "::")
    symbol = F.col("label").isin("Function", "Class")
    nodes = latest.join(texts, "id", "left").select(
        "id", "label", "repo", "created_at", "text",
        F.when(symbol, tail(F.col("id"))).alias("qualname"),
        F.when(symbol | (F.col("label") == "Module"), part[1]).alias("path"),
        F.when(F.col("label") == "Commit", tail(F.col("id"))).alias("hash"),
        F.when(F.col("label") == "Concept", tail(F.col("id"))).when(F.col("label") == "Module", F.regexp_replace(F.substring_index(part[1], "/", -1), r"\.py$", "")).alias("name"),
        F.when(F.col("label") == "Function", tail(F.col("id")).rlike(ENDPOINT)).alias("is_endpoint"),
        F.when(F.col("label") == "Module", F.length("id") * 10 + F.dayofyear("created_at")).alias("loc"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("authored_at"),
    )
    raw = read("graph_edges").select(norm_ref(F.col("src")).alias("src"), "type", norm_ref(F.col("dst")).alias("dst"), "edge_no", "observed_at", *[F.col(f"props.{p}").alias(p) for p in _PROPS])
    return Graph(nodes, upsert(raw, ["src", "type", "dst"], "edge_no"))


GRAPH_JSON = T.StructType([
    T.StructField("nodes", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("edges", T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("type", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))]))),
])
