"""Semantic extraction: validating replies, aligning concepts, materialising them, batching, cards, name blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, concept_key, tidy
from ..session import stored

BATCH, MIN_CONFIDENCE, ALIAS_CAP, GENERIC_AT, TOP_FUNCTIONS = 20, 0.6, 6, 3, 110
CTYPES = ("domain_concept", "mechanism", "design_decision")


def validate(replies: DataFrame, sources: DataFrame, targets: DataFrame, min_confidence: float = MIN_CONFIDENCE, ctypes: tuple[str, ...] = CTYPES) -> DataFrame:
    """replies (id, name, ctype, source_ref, quote, confidence, target_ref) plus verified, confidence, ctype, target_ok, reject.

    A quote is verified if a text of its source contains it; without that the confidence, clamped to 0..1, is halved. An
    unknown ctype becomes the first one. A blank name or source is dropped silently; below the threshold a reply is
    rejected (low_confidence); a target that isn't known is taken off and noted (bad_target). sources has source_ref
    and text (any number of texts each), targets has id.
    """
    r = replies.where((F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim(F.coalesce("source_ref", F.lit(""))) != ""))
    said = r.where("quote is not null and quote <> ''").select("id", "source_ref", "quote").join(sources, "source_ref").where(F.contains("text", "quote")).select("id").distinct().withColumn("verified", F.lit(True))
    known = targets.select(F.col("id").alias("target_ref")).distinct().withColumn("target_ok", F.lit(True))
    r = r.join(said, "id", "left").join(known, "target_ref", "left")
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))
    ok = F.coalesce("verified", F.lit(False))
    r = r.withColumn("verified", ok).withColumn("confidence", F.round(F.when(F.col("verified"), c).otherwise(c / 2), 6))
    r = r.withColumn("ctype", F.when(F.col("ctype").isin(*ctypes), F.col("ctype")).otherwise(ctypes[0]))
    bad = F.col("target_ref").isNotNull() & F.col("target_ok").isNull()
    r = r.withColumn("reject", F.when(F.col("confidence") < min_confidence, "low_confidence").when(bad, "bad_target"))
    return r.withColumn("target_ok", F.when(F.col("target_ref").isNull(), F.lit(None)).otherwise(~bad))


def align(replies: DataFrame, seq: str = "id") -> DataFrame:
    """A row per concept key: the spelling of highest confidence (the first among equal) is canonical, the other spellings
    are aliases in order of arrival, evidence the distinct (source_ref, quote) in order of arrival."""
    r = replies.withColumn("key", concept_key(F.col("name"))).where("key <> ''")
    first = r.groupBy("key", "name").agg(F.min(seq).alias("at"), F.max_by(F.struct("confidence", "ctype", "description", seq), F.struct("confidence", (-F.col(seq)).alias("s"))).alias("best"))
    names = first.groupBy("key").agg(F.max_by(F.struct("name", "best"), F.struct(F.col("best.confidence"), (-F.col(f"best.{seq}")).alias("s"))).alias("c"), F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    ev = r.where("quote is not null").groupBy("key", "source_ref", "quote").agg(F.min(seq).alias("at")).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "source_ref", "quote"))), lambda x: F.struct(x["source_ref"].alias("source_ref"), x["quote"].alias("quote"))).alias("evidence"))
    canonical = F.col("c.name")
    out = names.join(ev, "key", "left")
    return out.select("key", canonical.alias("name"), F.col("c.best.ctype").alias("ctype"), F.col("c.best.description").alias("description"), F.col("c.best.confidence").alias("confidence"), F.filter("names", lambda n: n != canonical).alias("aliases"), F.coalesce("evidence", F.array().cast("array<struct<source_ref:string,quote:string>>")).alias("evidence"))


def materialise(valid: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concept nodes (id, label, ...) and DESCRIBES / IMPLEMENTS edges (src, type, dst, confidence, quote_unverified)."""
    nodes = concepts.select(F.concat(F.lit("concept::"), "key").alias("id"), F.lit("Concept").alias("label"), "name", "ctype", "description", "aliases", "confidence", "evidence")
    dst = F.concat(F.lit("concept::"), concept_key(F.col("name")))
    base = valid.where("reject is null or reject = 'bad_target'")
    described = base.where("source_ref like '%::commit::%'").select(F.col("source_ref").alias("src"), F.lit("DESCRIBES").alias("type"), dst.alias("dst"), "confidence", (~F.col("verified")).alias("quote_unverified"))
    implemented = base.where("target_ok").select(F.col("target_ref").alias("src"), F.lit("IMPLEMENTS").alias("type"), dst.alias("dst"), "confidence", (~F.col("verified")).alias("quote_unverified"))
    modules = base.where("source_ref not like '%::commit::%'").select(F.col("source_ref").alias("src"), F.lit("IMPLEMENTS").alias("type"), dst.alias("dst"), "confidence", (~F.col("verified")).alias("quote_unverified"))
    edges = described.unionByName(implemented).unionByName(modules).groupBy("src", "type", "dst").agg(F.max("confidence").alias("confidence"), F.min("quote_unverified").alias("quote_unverified"))
    return nodes, edges


def commit_batches(commits: DataFrame, modifies: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, commits, candidates): commits by id in chunks, with all they modify.

    Ranks come from a range partition and its sizes, so no task sorts all commits.
    """
    spark = commits.sparkSession
    ids = stored(commits.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()), "batches")
    # One row per range partition.
    sizes = ids.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy("id")
    ranked = ids.withColumn("r", F.row_number().over(w)).join(F.broadcast(before), "part").select("id", F.floor((F.col("before") + F.col("r") - 1) / size).alias("batch"))
    cand = ranked.join(modifies.select(F.col("src").alias("id"), "dst"), "id").groupBy("batch").agg(F.sort_array(F.collect_set("dst")).alias("candidates"))
    out = ranked.groupBy("batch").agg(F.sort_array(F.collect_list("id")).alias("commits")).join(cand, "batch", "left")
    return out.select("batch", "commits", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def docstring_batch(modules: DataFrame, functions: DataFrame) -> DataFrame:
    """(modules, candidates): one row with all modules (id, docstring) that have a docstring, and the functions whose id begins
    with one of theirs; no row without such modules. An id offers all that stands before one of its '::'."""
    told = modules.where("trim(coalesce(docstring, '')) <> ''").select(F.col("id").alias("module")).distinct()
    before = F.expr("transform(sequence(1, size(split(id, '::'))), i -> substring_index(id, '::', i))")
    cand = functions.select("id", F.explode(before).alias("module")).where("module <> id").join(told, "module", "left_semi").groupBy().agg(F.sort_array(F.collect_set("id")).alias("candidates"))
    return told.groupBy().agg(F.sort_array(F.collect_list("module")).alias("modules")).where("size(modules) > 0").crossJoin(cand)  # one row each


def interleave(a: Column, b: Column, cap: int = ALIAS_CAP) -> Column:
    """Two lists alternately, tidy and distinct, at most cap entries (the merged card's own limit)."""
    pairs = F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))
    return F.slice(tidy(pairs), 1, cap)


def merge_cards(first: DataFrame, second: DataFrame, cap: int = ALIAS_CAP, generic: int = GENERIC_AT) -> DataFrame:
    """(id, aliases) of two sets of cards (id, aliases): lists interleaved, without aliases that `generic` or more entities use."""
    none = F.array().cast("array<string>")
    both = first.select("id", F.col("aliases").alias("a")).join(second.select("id", F.col("aliases").alias("b")), "id", "full").select("id", interleave(F.coalesce("a", none), F.coalesce("b", none), cap).alias("m"))
    each = both.select("id", F.posexplode("m").alias("p", "alias"))
    common = each.groupBy("alias").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= generic)
    kept = each.join(common, "alias", "left_anti").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return both.select("id").join(kept, "id", "left").select("id", F.coalesce("aliases", none).alias("aliases"))


def card_targets(nodes: DataFrame, weight: DataFrame, gold: DataFrame, top: int = TOP_FUNCTIONS) -> DataFrame:
    """(id): all concepts and classes, the top functions by weight (id, weight), and the gold neighbourhood (id)."""
    best = weight.join(nodes.where("label = 'Function'").select("id"), "id", "left_semi").orderBy(F.desc("weight"), "id").limit(top).select("id")
    return nodes.where("label in ('Concept', 'Class')").select("id").union(best).union(gold.select("id")).distinct()


def similar_names(names: DataFrame, threshold: float, key: str = "name") -> DataFrame:
    """(a, b, j): pairs of distinct names, a < b, whose sets of character pairs have a Jaccard similarity of the threshold or more.

    Exact, by prefix filtering: a name offers only its rarest pairs, n - ceil(t * n) + 1 of n, since two similar names
    must share one of these; lengths that can't reach the threshold don't meet. Pairs that nobody rare shares never form.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    n = names.where(F.col(key).isNotNull()).select(F.col(key).alias("x")).distinct().withColumn("g", bigrams(F.col("x"))).where("size(g) > 0")
    n = stored(n, "names")
    each = n.select("x", F.size("g").alias("n"), F.explode("g").alias("gram"))
    rare = each.groupBy("gram").agg(F.count("*").alias("df"))
    w = Window.partitionBy("x").orderBy("df", "gram")
    pre = each.join(rare, "gram").withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select("x", "n", "gram")
    other = pre.select(F.col("x").alias("y"), F.col("n").alias("m"), "gram")
    near = (F.col("n") >= F.lit(threshold) * F.col("m")) & (F.col("m") >= F.lit(threshold) * F.col("n"))
    pairs = pre.join(other, "gram").where((F.col("x") < F.col("y")) & near).select("x", "y").distinct()
    full = pairs.join(n.withColumnRenamed("g", "gx"), "x").join(n.select(F.col("x").alias("y"), F.col("g").alias("gy")), "y")
    shared = F.size(F.array_intersect("gx", "gy"))
    return full.select(F.col("x").alias("a"), F.col("y").alias("b"), (shared / (F.size("gx") + F.size("gy") - shared)).alias("j")).where(F.col("j") >= threshold).select("a", "b", F.round("j", 4).alias("j"))


def apply_cards(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """Nodes with zh_desc and zh_aliases replaced by their card's: the description only of accepted cards. Applying cards twice
    is applying them once; the number of nodes doesn't change; a node without a card keeps what it has."""
    c = cards.groupBy("id").agg(F.max_by(F.struct(F.when(F.col("desc_accepted"), F.col("desc")).alias("d"), tidy(F.coalesce("zh_aliases", F.array().cast("array<string>"))).alias("a")), F.monotonically_increasing_id() if "seq" not in cards.columns else F.col("seq")).alias("c"))
    had = lambda name, kind: F.col(name) if name in nodes.columns else F.lit(None).cast(kind)
    j = nodes.join(c, "id", "left")
    rest = [x for x in nodes.columns if x not in ("zh_desc", "zh_aliases")]
    return j.select(*rest, F.when(F.col("c").isNotNull(), F.col("c.d")).otherwise(had("zh_desc", "string")).alias("zh_desc"), F.when(F.col("c").isNotNull(), F.col("c.a")).otherwise(had("zh_aliases", "array<string>")).alias("zh_aliases"))


def unmatched_cards(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    return cards.select("id").distinct().join(nodes.select("id"), "id", "left_anti")


def run_semantic(replies: DataFrame, sources: DataFrame, targets: DataFrame, **options) -> dict[str, DataFrame]:
    """Replies (an input table; asking a model is the caller's affair) to valid, concepts, nodes, edges and counts."""
    valid = stored(validate(replies, sources, targets, **options), "semantic-valid")
    kept = valid.where("reject is null or reject = 'bad_target'")
    concepts = stored(align(kept), "semantic-concepts")
    nodes, edges = materialise(valid, concepts)
    stats = valid.agg(F.count("*").alias("seen"), F.count(F.when(F.col("reject") == "low_confidence", 1)).alias("low_confidence"), F.count(F.when(F.col("reject") == "bad_target", 1)).alias("bad_target"), F.count(F.when(F.col("reject").isNull() | (F.col("reject") == "bad_target"), 1)).alias("extracted"))
    return {"valid": valid, "concepts": concepts, "nodes": nodes, "edges": edges, "stats": stats}
