"""Retrieval pipelines: a batch of questions to one row of context each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled_line, half_width
from ..session import stored
from . import bm25, linking, routing
from .context import BUDGET, card_text, concept_expansion, overview_rows, symbol_lines, within_budget
from .graph import Graph, tail

# What a question outside the repository is answered with.
SUGGESTIONS = ("可以问：这个项目整体是做什么的（返回仓库卡片）", "可以问：修改某个函数（如 _handle_terminate）会波及哪些调用方", "可以问：某个机制（如 崩溃恢复 / 看门狗 / 门禁）在哪实现")
OUTSIDE = "【超出仓库范围】（来源: 路由判定 out_of_scope）\n这个问题看起来不指向本代码库的具体内容。"


def topic_lines(graph: Graph, recall: DataFrame) -> DataFrame:
    """(qid, seq, line) of the topic context: recalled concepts with their implementers and commits, then the other hits."""
    node = graph.nodes.select("id", "label", F.coalesce("qualname", "name", "path", tail(F.col("id"))).alias("title"), "text")
    hit = recall.join(node, "id")
    con = hit.where("label = 'Concept'")
    more = concept_expansion(graph, con.select("id"))
    shown = lambda c: F.transform(F.col(c), lambda x: F.concat(F.lit("      · "), tail(x)))
    head = F.concat(F.lit("- [Concept] "), "title", F.lit("  (相关度 "), F.col("score").cast("string"), F.lit(", 命中词: "), F.array_join(F.slice("matched_terms", 1, 6), "/"), F.lit(")"))
    con = con.join(more, "id").select("qid", F.lit(1).alias("s"), F.col("rank").cast("int").alias("o"), F.posexplode(F.concat(F.array(head), shown("implementers"), shown("commits"))).alias("p", "line"))
    rest = hit.where("label <> 'Concept'").select("qid", F.lit(2).alias("s"), F.col("rank").cast("int").alias("o"), F.lit(0).alias("p"), F.concat(F.lit("- ["), "label", F.lit("] "), "title", F.lit(": "), first_filled_line(F.col("text"))).alias("line"))
    heads = hit.select("qid").distinct().select("qid", F.lit(0).alias("s"), F.lit(0).alias("o"), F.lit(0).alias("p"), F.lit("【命中主题概念】（来源: 主题召回 / IMPLEMENTS·DESCRIBES 展开）").alias("line"))
    out = heads.unionByName(con).unionByName(rest)
    return out.select("qid", F.struct("s", "o", "p").alias("seq"), "line")


def overview_text(graph: Graph) -> DataFrame:
    """One row: the overview as text."""
    rows = overview_rows(graph).select(F.struct("section", (-F.col("n")).alias("k"), "name").alias("x"))
    line = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), (-x["k"]).cast("string"), F.lit(")")))
    return rows.groupBy().agg(F.concat(F.lit("【仓库概览】（来源: 图谱统计）\n"), F.array_join(line, "\n")).alias("overview"))


EXTRA_QUERIES = 4


def _with_extra(graph: Graph, index: bm25.Index | bm25.Texts, extra: DataFrame, alone: DataFrame, linked: DataFrame, recall: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and topics joined by those of a question's first rewritings (qid, seq, question), for questions without a link: per
    id the highest score, then the best again."""
    first = Window.partitionBy("qid").orderBy("seq")
    e = extra.join(alone.select("qid"), "qid", "left_semi").where("trim(coalesce(question, '')) <> ''").withColumn("r", F.row_number().over(first)).where(F.col("r") <= EXTRA_QUERIES)
    e = e.select(F.concat_ws("\x01", "qid", F.col("r").cast("string")).alias("qid"), half_width(F.col("question")).alias("question"))
    back = F.substring_index("qid", "\x01", 1)

    def best(df: DataFrame, k: int, rest: list[str]) -> DataFrame:
        per = df.groupBy("qid", "id").agg(F.max_by(F.struct(*rest), "score").alias("x"), F.max("score").alias("score")).select("qid", "id", "score", "x.*")
        return per.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    more = linking.link_entities(graph.nodes, e).withColumn("qid", back)
    links = linked.unionByName(best(more, linking.TOP, ["label", "name", "matched", "method"]).select(linked.columns))
    topics = best(recall.unionByName(bm25.topic_recall(index, e).withColumn("qid", back)), bm25.TOP, ["matched_terms"]).select(recall.columns)
    return links, topics.join(links.select("qid"), "qid", "left_anti")


def build_context(graph: Graph, documents: DataFrame, questions: DataFrame, budget: int = BUDGET, allow_overview: bool = True, extra: DataFrame | None = None, summary: str | None = None, index: bm25.Index | bm25.Texts | None = None) -> DataFrame:
    """A row per question (qid, question): route_label, route_source, mode, linked ids, topics, context_text, degraded,
    needs_disambiguation, pick, candidates, premise_flags, suggestions, resolved_query.

    Linked questions take the symbol branch, or ask back if their candidates are too close; unlinked ones the topic
    branch, then the overview. Topics are recalled only for questions without a link. extra (qid, seq, question) holds
    rewritings that questions without a link may use, at most four each. Meta questions get the repository card, with the
    summary if there is one. Every question gets a row. index is that of the documents; without one they are
    scored without an index.
    """
    # Each stage feeds several branches, so it is written once instead of being worked out in every one.
    graph = Graph(stored(graph.nodes, "context-nodes"), stored(graph.edges, "context-edges"))
    q = stored(questions.select("qid", half_width(F.col("question")).alias("question")), "context-questions")
    linked = stored(linking.link_entities(graph.nodes, q), "context-linked")
    alone = q.join(linked.select("qid"), "qid", "left_anti")
    index = bm25.texts(documents) if index is None else index
    recall = stored(bm25.topic_recall(index, alone), "context-recall")
    if extra is not None:
        linked, recall = (stored(x, "context-extra") for x in _with_extra(graph, index, extra, alone, linked, recall))
    n_linked = linked.groupBy("qid").agg(F.count("*").alias("linked"), F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("l"))
    n_topic = recall.groupBy("qid").agg(F.count("*").alias("topic_hits"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    signals = routing.with_signals(q.join(n_linked, "qid", "left").join(n_topic, "qid", "left").select("qid", "question", zero("linked"), zero("topic_hits"), "l"))
    routed = stored(routing.route(signals).select("qid", "question", "linked", "topic_hits", "l", "route_label", "route_source"), "context-routed")
    choice = stored(linking.disambiguate(linked).select("qid", "pick", "needs_disambiguation", F.col("degraded").alias("weak")), "context-choice")
    local = routed.where("route_label = 'entity_local'").select("qid")
    sym = local.join(choice.where("not needs_disambiguation"), "qid", "left_semi")
    symbol = stored(within_budget(symbol_lines(graph, linked.join(sym, "qid", "left_semi")), "qid", budget), "context-symbol").withColumnRenamed("context_text", "symbol_text")
    topic = stored(within_budget(topic_lines(graph, recall.join(local, "qid", "left_semi")), "qid", budget), "context-topic").withColumnRenamed("context_text", "topic_text")
    ask = linked.join(local, "qid", "left_semi").groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: F.concat(F.lit("- "), x["name"])), "\n").alias("ask_text"))
    flags = routing.verify_premises(routing.node_text(graph.nodes), routing.lexical_premises(q, key="qid"), key="qid").groupBy("qid").agg(F.sort_array(F.collect_list("claim")).alias("premise_flags"))
    out = routed.join(choice, "qid", "left").join(symbol, "qid", "left").join(topic, "qid", "left").join(ask, "qid", "left").join(flags, "qid", "left").crossJoin(F.broadcast(overview_text(graph))).crossJoin(F.broadcast(card_text(graph, summary)))
    is_local = F.col("route_label") == "entity_local"
    asks = is_local & F.coalesce("needs_disambiguation", F.lit(False))
    over = F.col("overview") if allow_overview else F.lit("")
    text = (
        F.when(F.col("route_label") == "out_of_scope", F.lit(OUTSIDE)).when(F.col("route_label") == "meta", F.col("card")).when(~is_local, F.col("overview"))
        .when(asks, F.concat(F.lit("【候选消歧】（来源: 词面链接多合法候选，需澄清）\n"), "ask_text")).otherwise(F.coalesce("symbol_text", "topic_text", over))
    )
    lost = is_local & F.col("symbol_text").isNull() & F.col("topic_text").isNull() & ~asks
    mode = F.when(F.col("route_label") == "out_of_scope", "out_of_scope").when(~is_local, "overview").when(asks | F.col("symbol_text").isNotNull(), "symbol").when(F.col("topic_text").isNotNull(), "topic").otherwise("overview" if allow_overview else "none")
    none = F.array().cast("array<string>")
    return out.select(
        "qid", "route_label", "route_source", mode.alias("mode"), F.coalesce(F.transform("l", lambda x: x["id"]), none).alias("linked"), F.col("topic_hits").alias("topics"), text.alias("context_text"),
        (F.col("route_label").isin("structural", "out_of_scope") | lost | (is_local & F.coalesce("weak", F.lit(False)))).alias("degraded"), asks.alias("needs_disambiguation"), F.when(is_local, F.col("pick")).alias("pick"),
        F.coalesce("premise_flags", none).alias("premise_flags"), F.when(F.col("route_label").isin("structural", "out_of_scope") | lost, F.array(*map(F.lit, SUGGESTIONS))).otherwise(none).alias("suggestions"), F.col("question").alias("resolved_query"),
    )
