"""Consolidating pairwise matches into groups: connected components by minimum labels and pointer jumping.

Every round takes for each vertex the smallest of itself and its neighbours, jumps along those pointers to
their ends, spells the edges in the new labels and drops loops and repeats, so the edges shrink round by
round. Labels and edges are written to the shared folder each round; the rounds end when no edge is left, that
is when no label changes. The last label is the smallest vertex of the component.

Hubs: shared names become stars in two levels (name and salt, then name), never pairs, and the minimum is
aggregated before the shuffle. Joins on labels split skewed keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

SALTS = 32


def norm_name(c: Column) -> Column:
    """Lower case without white space and '-'; other characters count."""
    return F.regexp_replace(F.lower(c), r"(?U)[\s\-]+", "")


def star_edges(members: DataFrame, vertex: str, label: str) -> DataFrame:
    """Edges (a, b) that link all vertices with one label, as many as vertices: each vertex with the smallest of
    its (label, salt), those with the smallest of the label. Null and empty labels link nothing."""
    m = members.where(F.col(label).isNotNull() & (F.col(label) != "") & F.col(vertex).isNotNull()).select(F.col(vertex).alias("v"), F.col(label).alias("l")).distinct()
    m = m.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    near = m.groupBy("l", "s").agg(F.min("v").alias("m1"))
    far = near.groupBy("l").agg(F.min("m1").alias("m0"))
    one = m.join(near, ["l", "s"]).select(F.col("v").alias("a"), F.col("m1").alias("b"))
    two = near.join(far, "l").select(F.col("m1").alias("a"), F.col("m0").alias("b"))
    return one.unionByName(two).where("a <> b").distinct()


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex: root is the smallest vertex linked with v, directly or through others.

    vertices has v, edges a and b (undirected; loops, repeats and edges with a null end are harmless). A vertex
    without edges is its own root; an end that is no vertex takes part but doesn't come out.
    """
    labels = None
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
    while not live.isEmpty():
        # The smaller end is its own candidate, so only the larger end needs its neighbours, and both need themselves.
        at = stored(live.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("y")), "components-hook")
        # Pointers strictly fall along hooks; jumping squares the distance each time.
        moved = True
        while moved:
            hook = at.select("x", "y")
            on = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
            jumped = stored(hook.join(on, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")), "components-jump")
            discard(at)
            at, moved = jumped, not jumped.where("moved").isEmpty()
        hook = at.select("x", "y")
        to_a = hook.select(F.col("x").alias("a"), F.col("y").alias("ra"))
        to_b = hook.select(F.col("x").alias("b"), F.col("y").alias("rb"))
        ends = live.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ra", "a").alias("p"), F.coalesce("rb", "b").alias("q"))
        last, live = live, stored(ends.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "components-edges")
        discard(last)
        if labels is None:
            labels = at
        else:
            follow = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
            before = labels.select("x", "y")
            moved_on = before.join(follow, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
            last, labels = labels, stored(moved_on.unionByName(hook.join(before.select("x"), "x", "left_anti")), "components-labels")
            discard(last, at)
    labels = labels if labels is None else labels.select("x", "y")
    v = vertices.where("v is not null").select("v").distinct()
    if labels is None:
        return v.withColumn("root", F.col("v"))
    return v.join(labels.withColumnRenamed("x", "v"), "v", "left").select("v", F.coalesce("y", "v").alias("root"))


def consolidate(groups: DataFrame, audit: DataFrame) -> DataFrame:
    """(group_no, root_no) for every group. Linked are two existing groups with a 'same' verdict, and groups that
    share one normalised name among name, members and aliases (null or empty names link nothing)."""
    names = groups.select("group_no", F.explode(F.concat(F.array("name"), F.coalesce("members", F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    by_name = star_edges(names.select("group_no", norm_name(F.col("name")).alias("label")), "group_no", "label")
    known = groups.where("group_no is not null").select(F.col("group_no").alias("v")).distinct()
    same = audit.where("verdict = 'same' and left_ref <> right_ref").select(F.col("left_ref").alias("a"), F.col("right_ref").alias("b")).distinct()
    same = same.join(known.withColumnRenamed("v", "a"), "a", "left_semi").join(known.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b")
    return connected_components(known, by_name.unionByName(same)).select(F.col("v").alias("group_no"), F.col("root").alias("root_no"))
