"""Evaluation: gold recipes and equivalents, row judges, rates, calibration grid, failure attribution, resumed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph, by_label, by_type, reverse
from .impact import bfs_levels, module_counts, modules_of


def gold_equivalents(edges: DataFrame, gold: DataFrame) -> DataFrame:
    """(gold, ids): the gold id and all one IMPLEMENTS or DESCRIBES edge away, either way."""
    e = by_type(edges, "IMPLEMENTS", "DESCRIBES").select("src", "dst")
    out = gold.select("gold", F.col("gold").alias("x"))
    out = out.unionByName(gold.join(e, gold.gold == e.src).select("gold", F.col("dst").alias("x"))).unionByName(gold.join(e, gold.gold == e.dst).select("gold", F.col("src").alias("x")))
    return out.groupBy("gold").agg(F.sort_array(F.collect_set("x")).alias("ids"))


def recipe_pairs(graph: Graph, name: str) -> DataFrame:
    """(key, value) of a named path query. The closures start at endpoints, with _all behind the name at all functions."""
    fn = by_label(graph.nodes, "Function").select("id", "is_endpoint")
    edge = lambda t, a="src", b="dst": by_type(graph.edges, t).select(F.col(a).alias("key"), F.col(b).alias("value"))
    of = lambda df, c: df.join(fn.select(F.col("id").alias(c)), c, "left_semi")

    def via(first: DataFrame, second: DataFrame) -> DataFrame:
        return first.withColumnRenamed("value", "mid").join(second.withColumnRenamed("key", "mid"), "mid").select("key", "value")

    home = modules_of(graph).select(F.col("id").alias("key"), F.col("module").alias("value"))
    if name == "fn_module":
        return of(home, "key")
    if name == "class_module":
        return home.join(by_label(graph.nodes, "Class").select(F.col("id").alias("key")), "key", "left_semi")
    if name == "fn_callers":
        return edge("CALLS", "dst", "src")
    if name == "concept_impl_fns":
        return of(edge("IMPLEMENTS", "dst", "src"), "value")
    if name == "commit_mod_fns":
        return of(edge("MODIFIES"), "value")
    if name == "fn_concepts":
        return of(edge("IMPLEMENTS"), "key")
    if name.removesuffix("_all") in ("rev_calls_closure", "impact_modules"):
        seeds = (fn if name.endswith("_all") else fn.where("is_endpoint")).select(F.col("id").alias("seed"), F.col("id").alias("node"))
        levels = bfs_levels(seeds, reverse(graph.edges, "CALLS"), 3)
        if name.startswith("rev_calls_closure"):
            return levels.where("level > 0").select(F.col("seed").alias("key"), F.col("node").alias("value"))
        return via(levels.select(F.col("seed").alias("key"), F.col("node").alias("value")), home)
    if name == "calls_chain":
        return via(edge("CALLS"), edge("CALLS"))
    if name == "concept_fns_commits":
        return via(of(edge("IMPLEMENTS", "dst", "src"), "value"), edge("MODIFIES", "dst", "src"))
    if name == "commit_fns_concepts":
        return via(of(edge("MODIFIES"), "value"), edge("IMPLEMENTS"))
    if name == "design_provenance":
        return via(of(edge("IMPLEMENTS"), "key"), edge("DESCRIBES", "dst", "src"))
    raise ValueError(f"no recipe {name!r}")


def recipes(graph: Graph, name: str) -> DataFrame:
    """(key, n, first, last) of a recipe's distinct answers by key."""
    if name.removesuffix("_all") == "impact_modules":  # by blocks: what calls each seed is never rows
        fn = by_label(graph.nodes, "Function")
        seeds = (fn if name.endswith("_all") else fn.where("is_endpoint")).select(F.col("id").alias("seed"))
        return module_counts(graph, seeds, 3).withColumnRenamed("seed", "key")
    p = recipe_pairs(graph, name).distinct()
    return p.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))


def last_good(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Resumed runs: of each key the last record, kept if it is ok."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1 and ok").drop("_r")


def rates(judged: DataFrame, by: list[str]) -> DataFrame:
    """n and the share of each verdict by group, to 4 places; records without a verdict count in n."""
    share = lambda v: F.round(F.avg((F.coalesce(F.col("verdict"), F.lit("")) == v).cast("double")), 4).alias(v)
    return judged.groupBy(*by).agg(F.count("*").alias("n"), share("correct"), share("partial"), share("wrong"))


def rate_delta(r: DataFrame, group: str = "group", a: str = "A", b: str = "B") -> DataFrame:
    """Per remaining keys the difference (b - a) of the share of correct verdicts."""
    keys = [c for c in r.columns if c not in (group, "n", "correct", "partial", "wrong")]
    side = lambda g, name: r.where(F.col(group) == g).select(*keys, F.col("correct").alias(name))
    return side(a, "a").join(side(b, "b"), keys).select(*keys, F.round(F.col("b") - F.col("a"), 4).alias("delta"))


OVER_ASK_CAP = 0.2


def calibration_grid(questions: DataFrame, scored: DataFrame, grid: DataFrame) -> DataFrame:
    """Per cell of the grid (min_score, margin, autopick) over all questions: hit@1, hit@3, over-ask, whether the cell is
    feasible (over-ask at most 0.2), whether it is the best one (feasible, with hits) and the best whether feasible or not.

    questions has qid, scored qid, rank, score (not rounded) and gold (whether the hit is gold). A question's candidates are
    its hits that reach min_score; it is asked back if the first two lie closer than margin, as a share of the first score. A
    single candidate is an anchor only with autopick. grid holds a fixed number of parameter rows and nothing beyond a
    question's three best rows counts, so each question meets it at a fixed cost.
    """
    top = scored.where("rank <= 3").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "gold"))).alias("top"))
    every = questions.select("qid").distinct().join(top, "qid", "left").crossJoin(F.broadcast(grid))
    cells = every.withColumn("c", F.filter("top", lambda x: x["score"] >= F.col("min_score")))
    n = F.coalesce(F.array_size("c"), F.lit(0))
    s1, s2 = (F.round(F.get("c", F.lit(i))["score"], 4) for i in (0, 1))
    over = F.coalesce(F.when((n >= 2) & (s1 > 0), (s1 - s2) / s1 < F.col("margin")), F.lit(False))
    hit = lambda k: F.coalesce((F.col("autopick") | (n > 1)) & F.exists(F.slice("c", 1, k), lambda x: x["gold"]), F.lit(False))
    share = lambda c, name: F.round(F.avg(c.cast("int")), 4).alias(name)
    out = cells.groupBy("min_score", "margin", "autopick").agg(F.count("*").alias("n"), share(hit(1), "hit_1"), share(hit(3), "hit_3"), share(over, "over_ask"))
    out = out.withColumn("feasible", F.col("over_ask") <= OVER_ASK_CAP).withColumn("_ok", F.col("feasible") & (F.col("hit_1") > 0))
    order = [F.desc("hit_1"), F.desc("hit_3"), F.desc("min_score"), F.desc("margin"), F.col("autopick")]
    first = lambda *by: F.row_number().over(Window.orderBy(*by, *order)) == 1  # noqa: E731  # as many rows as the grid has
    return out.withColumn("best", F.col("_ok") & first(F.desc("_ok"))).withColumn("least_bad", first()).drop("_ok")


def failure_attribution(questions: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, cause): hit (a gold answer among the first three), rank_loss (found, but later) or unreachable (no shared term)."""
    best = ranked.join(gold, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("best"))
    return questions.select("qid").distinct().join(best, "qid", "left").select("qid", "best", F.when(F.col("best").isNull(), "unreachable").when(F.col("best") <= 3, "hit").otherwise("rank_loss").alias("cause"))


def bare_refusal(context: Column, suggestions: Column) -> Column:
    """No context and no suggestion either."""
    return (F.trim(F.coalesce(context, F.lit(""))) == "") & (F.coalesce(F.size(suggestions), F.lit(0)) <= 0)


def number_in(text: Column, number: Column) -> Column:
    """Whether the number stands in the text with no digit beside it."""
    return F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?<!\d)"), number.cast("string"), F.lit(r"(?!\d)")))


# Words by which an answer contradicts a premise.
CONTRADICTIONS = ("没有", "未使用", "不是", "并非", "实际上", "无", "而非")


def mode_class(mode: Column) -> Column:
    """overview, symbol or topic for the modes that belong to them; any other mode as it is."""
    return F.when(mode.isin("meta", "overview", "global"), "overview").when(mode.isin("symbol", "entity_local"), "symbol").when(mode.isin("topic", "llm"), "topic").otherwise(mode)


def _said(answer: Column, context: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(answer, F.lit("")), F.coalesce(context, F.lit("")))


def judge_overview(route_label: Column, mode: Column, answer: Column, context: Column, facts: list[str], numbers: list[str], least: int = 3) -> Column:
    """(passed, mode_ok, facts_hit): an overview mode and at least `least` of the facts and whole numbers said."""
    text = _said(answer, context)
    hits = [F.contains(text, F.lit(f)).cast("int") for f in facts] + [number_in(text, F.lit(n)).cast("int") for n in numbers]
    total = sum(hits, F.lit(0))
    ok = F.coalesce(route_label.isin("meta", "global"), F.lit(False)) | (F.coalesce(mode_class(mode), F.lit("")) == "overview")
    return F.struct((ok & (total >= least)).alias("passed"), ok.alias("mode_ok"), total.alias("facts_hit"))


def judge_linked(anchors: Column, gold: Column) -> Column:
    """(hit_1, hit_3, anchors_top3): whether the gold ids (with their equivalents) are among the first anchors."""
    top = F.slice(F.coalesce(anchors, F.array().cast("array<string>")), 1, 3)
    return F.struct(F.coalesce(F.arrays_overlap(F.slice(top, 1, 1), gold), F.lit(False)).alias("hit_1"), F.coalesce(F.arrays_overlap(top, gold), F.lit(False)).alias("hit_3"), top.alias("anchors_top3"))


def judge_ambiguous(gold_behavior: Column, needs_disambiguation: Column, anchors: Column, mode: Column) -> Column:
    """(passed, predicted, over_ask, under_ask, anchored): asking back and picking against what was wanted; a pick counts
    only if it is anchored at a symbol. A missing field means a pick."""
    asks = F.coalesce(needs_disambiguation, F.lit(False))
    anchored = (F.coalesce(F.size(anchors), F.lit(0)) > 0) & (F.coalesce(mode_class(mode), F.lit("")) == "symbol")
    should = F.coalesce(gold_behavior, F.lit("")) == "should_disambiguate"
    return F.struct(
        F.when(should, asks).otherwise(~asks & anchored).alias("passed"), F.when(asks, "should_disambiguate").otherwise("should_autopick").alias("predicted"),
        (~should & asks).alias("over_ask"), (should & ~asks).alias("under_ask"), anchored.alias("anchored"),
    )


def judge_premise(answer: Column, context: Column, absent: Column, truths: Column) -> Column:
    """(leak, corrected): whether an absent keyword is said; whether a contradiction and a truth are (no truths: a
    contradiction is enough)."""
    text = _said(answer, context)
    low = F.lower(text)
    none = F.array().cast("array<string>")
    says = lambda words: F.coalesce(F.exists(F.coalesce(words, none), lambda w: F.contains(low, F.lower(w))), F.lit(False))
    contradicts = text.rlike("|".join(CONTRADICTIONS))
    return F.struct(says(absent).alias("leak"), (contradicts & (says(truths) | (F.size(F.coalesce(truths, none)) == 0))).alias("corrected"))


def judged_contexts(questions: DataFrame, contexts: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per question with its judgements: hit_1 and hit_3 where it has a gold entity (null otherwise), passed, over_ask and
    under_ask where it has a gold behaviour, routed where it has a gold mode class.

    questions has qid, subset, gold_entity, gold_behavior and gold_mode_class, contexts what build_context gives.
    """
    eq = gold_equivalents(edges, questions.where("gold_entity is not null").select(F.col("gold_entity").alias("gold")).distinct()).select(F.col("gold").alias("gold_entity"), F.col("ids").alias("golds"))
    j = questions.join(contexts.select("qid", "linked", "mode", "needs_disambiguation"), "qid").join(eq, "gold_entity", "left")
    linked = judge_linked(F.col("linked"), F.col("golds"))
    ambiguous = judge_ambiguous(F.col("gold_behavior"), F.col("needs_disambiguation"), F.col("linked"), F.col("mode"))
    of = lambda known, value: F.when(F.col(known).isNotNull(), value)
    return j.select(
        "qid", "subset", "gold_behavior", of("gold_entity", linked["hit_1"]).alias("hit_1"), of("gold_entity", linked["hit_3"]).alias("hit_3"), of("gold_behavior", ambiguous["passed"]).alias("passed"),
        of("gold_behavior", ambiguous["over_ask"]).alias("over_ask"), of("gold_behavior", ambiguous["under_ask"]).alias("under_ask"), of("gold_mode_class", mode_class(F.col("mode")) == mode_class(F.col("gold_mode_class"))).alias("routed"),
        of("gold_entity", F.coalesce(F.arrays_overlap("linked", "golds"), F.lit(False))).alias("recalled"),
    )


def subset_rates(judged: DataFrame, by: str = "subset") -> DataFrame:
    """Per subset n, hit@1, hit@3, recall of the gold entity among all links, pass, over-ask (of the questions that should be
    picked), under-ask (of those that should be asked back) and routing accuracy, to 4 places; null where nothing counts."""
    share = lambda c, when=None: F.round(F.avg((F.col(c) if when is None else F.when(F.col("gold_behavior") == when, F.col(c))).cast("int")), 4)
    return judged.groupBy(by).agg(
        F.count("*").alias("n"), share("hit_1").alias("hit_1"), share("hit_3").alias("hit_3"), share("recalled").alias("recall_gold"), share("passed").alias("pass_rate"),
        share("over_ask", "should_autopick").alias("over_ask"), share("under_ask", "should_disambiguate").alias("under_ask"), share("routed").alias("routing"),
    )


def premise_rates(judged: DataFrame, by: str = "group") -> DataFrame:
    """Per group n and the shares of answers that leak an absent keyword and that correct the premise (leak, corrected)."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 4).alias(f"{c}_rate")
    return judged.groupBy(by).agg(F.count("*").alias("n"), share("leak"), share("corrected"))
