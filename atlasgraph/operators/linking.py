"""Linking questions to symbols, merging and disambiguating candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import STOP_WORDS
from ..functions.text import candidates, dotted_module, first_filled_line, may_be_in

# Score and rank of each way to find a symbol.
SCORES = {"exact_qualname": 100, "suffix_qualname": 80, "short_name": 60, "concept_name": 40, "module_path": 30}
RANKS = {"exact_qualname": 5, "suffix_qualname": 4, "short_name": 3, "concept_name": 2, "module_path": 1, "bm25_card": 0}
STRONG = ("exact_qualname", "suffix_qualname")
MARGIN, TOP, ALIAS_LENGTH = 20, 5, 3


def _ends(name: Column) -> Column:
    """What follows each dot of a dotted name, with one dot or more left in it."""
    p = F.split(name, r"\.")
    return F.when(F.size(p) > 2, F.transform(F.sequence(F.lit(2), F.greatest(F.size(p) - 1, F.lit(2))), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))).otherwise(F.array().cast("array<string>"))


def symbol_keys(nodes: DataFrame) -> DataFrame:
    """(key, folded, method, score, id, label, name): every spelling by which a question may name a node. Suffixes are
    exploded here, so linking is one equi-join. folded keys are compared in lower case."""
    sym = nodes.where("label in ('Function', 'Class') and qualname is not null").select("id", "label", F.col("qualname").alias("name"))
    key = lambda df, c, method, folded=False: df.select(c.alias("key"), F.lit(folded).alias("folded"), F.lit(method).alias("method"), F.lit(SCORES[method]).alias("score"), "id", "label", "name")
    out = key(sym, F.col("name"), "exact_qualname")
    out = out.unionByName(key(sym.withColumn("k", F.explode(_ends(F.col("name")))), F.col("k"), "suffix_qualname"))
    out = out.unionByName(key(sym.where("name like '%.%'"), F.substring_index("name", ".", -1), "short_name"))
    mod = nodes.where("label = 'Module'").select("id", "label", "path", F.col("name").alias("short"), dotted_module(F.col("path")).alias("name"))
    own = F.array_distinct(F.filter(F.concat(F.array("name", "path", "short"), _ends(F.col("name")), F.array(F.when(F.size(F.split("name", r"\.")) > 2, F.substring_index("name", ".", -2)))), lambda x: x.isNotNull()))
    out = out.unionByName(key(mod.withColumn("k", F.explode(own)), F.col("k"), "module_path"))
    con = nodes.where("label = 'Concept'")
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in nodes.columns else F.array().cast("array<string>"))
    con = con.select("id", "label", "name", F.explode(F.array_distinct(F.filter(F.transform(names, F.lower), lambda x: F.coalesce(x, F.lit("")) != ""))).alias("k"))
    return out.unionByName(key(con, F.col("k"), "concept_name", True))


def alias_hits(nodes: DataFrame, questions: DataFrame, key: str = "qid") -> DataFrame:
    """(key, matched, method, score, id, label, name): aliases of three characters or more that a question contains;
    zh_aliases of any node, aliases of concepts too.

    Containment has no equality to join on, so aliases and questions meet on the alias's first three characters:
    each question offers all its three-character pieces once.
    """
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), none) if c in nodes.columns else none
    every = F.concat(some("zh_aliases"), F.when(F.col("label") == "Concept", some("aliases")).otherwise(none))
    a = nodes.select("id", "label", F.coalesce("qualname", "name").alias("name") if "qualname" in nodes.columns else "name", F.explode(F.array_distinct(every)).alias("alias"))
    a = a.withColumn("alias", F.trim("alias")).where((F.length("alias") >= ALIAS_LENGTH) & ~F.col("alias").isin(*sorted(STOP_WORDS))).withColumn("low", F.lower("alias")).withColumn("piece", F.substring("low", 1, 3))
    q = questions.select(key, F.lower("question").alias("q")).where(F.length("q") >= 3)
    pieces = q.select(key, "q", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(q) - 2), i -> substring(q, i, 3))"))).alias("piece"))
    hit = pieces.join(a, "piece").where(F.contains(F.col("q"), F.col("low")))
    return hit.select(key, F.col("alias").alias("matched"), F.lit("concept_name").alias("method"), F.lit(SCORES["concept_name"]).alias("score"), "id", "label", "name").distinct()


def link_entities(nodes: DataFrame, questions: DataFrame, k: int | None = TOP, key: str = "qid") -> DataFrame:
    """(key, rank, id, label, name, matched, score, method): of each question the k best symbols it names, each by its
    best way (score, then the longer match, then the match itself), in order of score and id."""
    keys = symbol_keys(nodes).withColumn("low", F.lower("key"))
    # A question offers dozens of names and few of them are any symbol's, so most are dropped before anything is shuffled. The
    # engine takes exploded rows for as small as what they come from; unless told otherwise it would broadcast them.
    tok = questions.select(key, F.explode(candidates(F.col("question"))).alias("matched")).withColumn("low", F.lower("matched"))
    tok = tok.where(may_be_in(F.col("low"), keys, "low"))
    hits = tok.hint("merge").join(keys, "low").where(F.col("folded") | (F.col("key") == F.col("matched"))).select(key, "matched", "method", "score", "id", "label", "name")
    if "zh_aliases" in nodes.columns:
        hits = hits.unionByName(alias_hits(nodes, questions, key))
    best = Window.partitionBy(key, "id").orderBy(F.desc("score"), F.desc(F.length("matched")), "matched")
    hits = hits.withColumn("b", F.row_number().over(best)).where("b = 1")
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= k) if k else out).select(key, "rank", "id", "label", "name", "matched", "score", "method")


def _method_rank() -> Column:
    out = F.lit(0)
    for m, r in RANKS.items():
        out = F.when(F.col("method") == m, r).otherwise(out)
    return out


def merge_candidates(*lists: DataFrame, key: str = "qid") -> DataFrame:
    """(key, position, id, label, score, method): one candidate per id, the stronger method first and then the higher
    score; in order of method, score and id."""
    every = lists[0].select(key, "id", "label", F.col("score").cast("double").alias("score"), "method")
    for x in lists[1:]:
        every = every.unionByName(x.select(key, "id", "label", F.col("score").cast("double").alias("score"), "method"))
    every = every.where("id is not null").withColumn("r", _method_rank())
    every = every.withColumn("b", F.row_number().over(Window.partitionBy(key, "id").orderBy(F.desc("r"), F.desc("score"), "method"))).where("b = 1")
    return every.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("r"), F.desc("score"), "id"))).select(key, "position", "id", "label", "score", "method")


def card_candidates(recall: DataFrame, key: str = "qid") -> DataFrame:
    """Functions and classes of a topic recall (with label) as candidates of the weakest method."""
    return recall.where("label in ('Function', 'Class')").select(key, "id", "label", "score", F.lit("bm25_card").alias("method"))


def disambiguate(linked: DataFrame, margin: int = MARGIN, key: str = "qid") -> DataFrame:
    """(key, n, pick, needs_disambiguation, degraded): a strong method leads and is taken; a single weak candidate is
    taken as degraded; of several weak ones the first is taken if it leads by the margin, else the question is ambiguous."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    first = linked.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("n", F.count("*").over(Window.partitionBy(key))).where("r = 1")
    strong, single = F.col("method").isin(*STRONG), F.col("n") == 1
    taken = strong | single | (F.col("score") - F.col("next") >= margin)
    return first.select(key, "n", F.when(taken, F.col("id")).alias("pick"), (~taken).alias("needs_disambiguation"), (~strong & single).alias("degraded"))


def may_anchor(method: Column, matched: Column | None = None) -> Column:
    """Whether a candidate may feed a deterministic tool: a strong method, and if terms are given at least one word of content."""
    ok = method.isin(*STRONG)
    if matched is not None:
        ok = ok & F.exists(matched, lambda t: (F.length(t) >= 2) & ~t.isin(*sorted(STOP_WORDS)))
    return ok


def union_best(*results: DataFrame, key: str = "qid", k: int = TOP) -> DataFrame:
    """Results of extra queries joined: of each (key, id) the highest score, then the k best."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    best = every.groupBy(key, "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "id", "score")


def expand_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): concepts by name or alias, trimmed and in lower case; the smallest id that has it."""
    some = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in nodes.columns else F.array().cast("array<string>")
    c = nodes.where("label = 'Concept'").select("id", F.explode(F.filter(F.transform(F.concat(F.array("name"), some), lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x, F.lit("")) != "")).alias("low"))
    first = c.groupBy("low").agg(F.min("id").alias("id"))
    return names.select("name", F.lower(F.trim("name")).alias("low")).join(first, "low").select("name", "id").distinct()


def enrich_candidates(nodes: DataFrame, cand: DataFrame, fan_in: DataFrame) -> DataFrame:
    """Candidates plus path, doc_head (first filled line) and fan_in."""
    meta = nodes.select("id", F.coalesce("path", F.lit("")).alias("path"), first_filled_line(F.col("text")).alias("doc_head"))
    return cand.join(meta, "id", "left").join(fan_in, "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
