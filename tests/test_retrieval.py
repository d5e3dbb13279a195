"""Recall against plain Python, disambiguation bands, routing, premises, alignment, cards, evaluation."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from atlasgraph.operators import bm25, evaluation, linking, routing, semantic
from atlasgraph.operators.context import NOTICE, within_budget

from .conftest import rows


def terms(t):
    return [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1 and not w.isdigit()]


def test_bm25_equals_plain_python(spark):
    docs = {i: t for i, t in enumerate(["cursor ledger cursor", "ledger pallet", "beacon beacon shard", "", "cursor shard roster ledger", "...", None])}
    index = bm25.build_index(spark.createDataFrame(list(docs.items()), "id long, text string"))
    got = {(r["qid"], r["id"]): r["score"] for r in bm25.score(index, bm25.query_terms(spark.createDataFrame([("q", "cursor ledger cursor"), ("none", ""), ("null", None)], "qid string, question string"))).collect()}
    tf = {i: Counter(terms(t)) for i, t in docs.items() if terms(t)}
    n, avg = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    for i, c in tf.items():
        s = 0.0
        for w in {"cursor", "ledger"} & set(c):
            df = sum(w in x for x in tf.values())
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg))
        assert (("q", i) in got) == (s > 0) and (s == 0 or abs(got["q", i] - s) < 1e-6)
    assert index.stats.first()["n_docs"] == 4
    assert bm25.build_index(spark.createDataFrame([], "id long, text string")).postings.count() == 0


@pytest.mark.parametrize("cands, pick, asks, weak", [([(100, "exact_qualname"), (100, "exact_qualname")], True, False, False), ([(60, "short_name")], True, False, True), ([(60, "short_name"), (30, "module_path")], True, False, False), ([(60, "short_name")] * 6, False, True, False), ([(50, "short_name"), (30, "module_path")], True, False, False), ([(45, "short_name"), (30, "module_path")], False, True, False)])
def test_bands(spark, cands, pick, asks, weak):
    df = spark.createDataFrame([("q", f"n{i}", s, m) for i, (s, m) in enumerate(cands)], "qid string, id string, score int, method string")
    r = linking.disambiguate(df).first()
    assert (r["pick"] is not None) is pick and r["needs_disambiguation"] is asks and r["degraded"] is weak
    assert linking.disambiguate(df.limit(0)).count() == 0


NODES = "id string, label string, qualname string, path string, name string, aliases array<string>, zh_aliases array<string>"


def test_linking(spark):
    nodes = spark.createDataFrame([("f1", "Function", "Store._begin", "a.py", None, None, ["看门狗"]), ("f2", "Function", "pkg.Store._begin", "a.py", None, None, None), ("m", "Module", None, "src/app/core.py", "core", None, None), ("c", "Concept", None, None, "Adapter", ["Shim"], None), ("n", "Function", None, None, None, None, None)], NODES)
    q = spark.createDataFrame([("1", "what calls Store._begin"), ("2", "shim or core?"), ("3", "app.core"), ("4", None), ("5", "谁喂看门狗")], "qid string, question string")
    got = {(r["qid"], r["id"]): r["method"] for r in linking.link_entities(nodes, q).collect()}
    assert got == {("1", "f1"): "exact_qualname", ("1", "f2"): "suffix_qualname", ("2", "c"): "concept_name", ("2", "m"): "module_path", ("3", "m"): "module_path", ("5", "f1"): "concept_name"}


@pytest.mark.parametrize("q, linked, topics, label", [("你了解这个项目吗", 0, 0, "meta"), ("列出所有 run_thread 的调用", 0, 0, "structural"), ("run_thread 怎么用", 0, 0, "entity_local"), ("整体架构", 0, 0, "global"), ("什么是区块链", 0, 0, "out_of_scope"), ("什么是适配层", 0, 2, "entity_local"), ("随便问问", 0, 1, "entity_local"), (None, 0, 0, "entity_local"), ("整体架构", 1, 0, "entity_local")])
def test_routes(spark, q, linked, topics, label):
    df = spark.createDataFrame([(q, linked, topics)], "question string, linked int, topic_hits int")
    assert routing.route(routing.with_signals(df)).first()["route_label"] == label


def test_premises(spark):
    texts = routing.node_text(spark.createDataFrame([("a", "uses SQLite here"), ("b", None)], "id string, text string"))
    q = spark.createDataFrame([("1", "为什么用 Redis 和 SQLite"), ("2", "无"), ("3", None)], "id string, question string")
    assert rows(routing.verify_premises(texts, routing.lexical_premises(q)), "id", "claim") == [("1", "使用 Redis")]
    claims = spark.createDataFrame([("x", "retries 五级 with Kafka"), ("y", "没有可查")], "id string, claim string")
    assert routing.premises_from_claims(claims).first()["terms"][0] == "kafka" and routing.premises_from_claims(claims).count() == 1


def test_budget(spark):
    df = spark.createDataFrame([("k", i, "x" * 9) for i in range(5)] + [("s", 0, "ab")], "k string, seq int, line string")
    assert dict(rows(within_budget(df, "k", 25))) == {"k": "xxxxxxxxx\n" * 2 + NOTICE, "s": "ab\n"}


R = "id long, name string, ctype string, source_ref string, quote string, description string, confidence double, target_ref string"


def test_semantic(spark):
    replies = [(1, "甲", "domain_concept", "r::commit::1", "q one", "d", 0.9, "fn"), (2, "甲 ", "weird", "r::commit::2", "q two", "d", 0.7, None), (3, "乙", "mechanism", "r::commit::1", "not there", "d", 0.9, "gone"), (4, "丙", "mechanism", "r::commit::1", None, "d", 0.3, None), (5, "丁", "mechanism", "mod", "q one", "d", 0.8, None), (6, " ", "mechanism", "mod", "x", "d", 0.9, None), (7, None, "mechanism", None, "x", "d", 0.9, None)]
    src = spark.createDataFrame([("r::commit::1", "has q one"), ("r::commit::2", "q two."), ("mod", "q one")], "source_ref string, text string")
    out = semantic.run_semantic(spark.createDataFrame(replies, R), src, spark.createDataFrame([("fn",)], "id string"), min_confidence=0.4)
    s = out["stats"].first()
    assert (s["seen"], s["low_confidence"], s["bad_target"], s["extracted"]) == (5, 1, 1, 4)
    c = {r["key"]: r for r in out["concepts"].collect()}
    assert set(c) == {"甲", "乙", "丁"} and c["甲"]["aliases"] == ["甲 "] and len(c["甲"]["evidence"]) == 2
    assert rows(out["edges"].groupBy("type").count()) == [("DESCRIBES", 3), ("IMPLEMENTS", 2)]


def test_align_spellings(spark):
    r = spark.createDataFrame([(1, "alphabeta", 0.5), (2, "Alpha Beta", 0.6), (3, "alphabeta", 0.9), (4, "foo_bar", 0.5), (5, "foo-bar", 0.5)], "id long, name string, confidence double").withColumn("ctype", F.lit("c")).withColumn("description", F.lit("")).withColumn("source_ref", F.lit("s")).withColumn("quote", F.lit(None).cast("string"))
    got = {x["name"]: x["aliases"] for x in semantic.align(r).collect()}
    assert got == {"alphabeta": ["Alpha Beta"], "foo_bar": [], "foo-bar": []}


def test_cards(spark):
    nodes = spark.createDataFrame([("f", "Function"), ("c", "Class"), ("x", "Concept")], "id string, label string")
    cards = spark.createDataFrame([("f", "d", True, ["a", " a", ""], 1), ("c", "d", False, ["b"], 1), ("lost", "d", True, None, 1)], "id string, desc string, desc_accepted boolean, zh_aliases array<string>, seq int")
    once = semantic.apply_cards(nodes, cards)
    assert rows(once, "id", "zh_desc", "zh_aliases") == rows(semantic.apply_cards(once, cards), "id", "zh_desc", "zh_aliases") == [("c", None, ["b"]), ("f", "d", ["a"]), ("x", None, None)]
    assert rows(semantic.unmatched_cards(nodes, cards)) == [("lost",)]


def test_similar_names_equal_all_pairs(spark):
    import random

    rng = random.Random(9)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 8))) for _ in range(60)})
    grams = {n: ({t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 1 else {t}) for n in names if (t := n.replace(" ", ""))}
    for thr in (0.3, 0.6):
        want = sorted((a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= thr)
        assert sorted((r["a"], r["b"]) for r in semantic.similar_names(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), thr).collect()) == want


def test_evaluation(spark):
    j = spark.createDataFrame([("1", "A", 1, False, "wrong"), ("1", "A", 2, True, "correct"), ("2", "A", 1, True, "correct"), ("2", "A", 2, False, None), ("3", "B", 1, True, None)], "id string, `group` string, n int, ok boolean, verdict string")
    good = evaluation.last_good(j, ["id", "group"], ["n"])
    assert rows(good, "id", "n") == [("1", 2), ("3", 1)]
    assert rows(evaluation.rates(good, ["group"]), "group", "n", "correct") == [("A", 1, 1.0), ("B", 1, 0.0)]


def test_terms_by_pieces(spark):
    texts = routing.node_text(spark.createDataFrame([("a", "uses SQLite here"), ("b", None), ("c", ""), ("d", "abcx bcde 中文" + "z" * 100_000)], "id string, text string"))
    # All pieces of abcde are there, but in no text as one.
    want = {"sqlite": True, "SQL": True, "here": True, "redis": False, "": False, None: False, "lite h": True, "abcde": False, "x": True, "Q": True, "y": False, "he": True, "hx": False, "中": True, "中文": True, "文中": False, "zzzz": True}
    t = spark.createDataFrame([(x,) for x in want], "term string")
    assert dict(rows(routing.terms_present(texts, t))) == want
    assert routing.terms_present(texts, t.limit(0)).count() == 0 and not routing.terms_present(texts.limit(0), t).where("present").count()


def test_a_batch_is_searched_like_an_index(spark):
    docs = spark.createDataFrame([("a", "cursor ledger harbor"), ("b", "cursor cursor 工单索引"), ("c", ""), ("d", None), ("e", "pallet roster")], "id string, text string")
    q = spark.createDataFrame([("1", "where is the cursor"), ("2", "工单在哪"), ("3", "nothing here"), ("4", None)], "qid string, question string")
    whole = bm25.topic_recall(bm25.build_index(docs), q, 8, 0.0)
    assert rows(bm25.search(docs, q, 8, 0.0)) == rows(whole) and whole.count() > 2
    assert bm25.search(docs.limit(0), q).count() == 0 and bm25.search(docs, q.limit(0)).count() == 0


def test_card_cache_and_summary(spark, small, tmp_path):
    from atlasgraph.operators.context import card_summary, load_or_build_card
    from atlasgraph.operators.graph import Graph, test_graph

    G = test_graph(spark, small)
    first, second = load_or_build_card(G, str(tmp_path)).first(), load_or_build_card(G, str(tmp_path)).first()
    assert first["degraded"] and not second["degraded"] and first["n_function"] == second["n_function"] > 0
    assert load_or_build_card(Graph(G.nodes.limit(3), G.edges), str(tmp_path)).first()["degraded"]
    assert card_summary({"a": "emit_span"}) is None and card_summary({"a": "emit_span"}, lambda c: "emit_span 很好") == "emit_span 很好"
    assert card_summary({"a": 1}, lambda c: "invented_name") is None and card_summary({}, lambda c: 1 / 0) is None


def test_context_branches_and_extra_queries(spark):
    from atlasgraph.operators.graph import Graph
    from atlasgraph.operators.pipeline import build_context

    nodes = spark.createDataFrame(
        [("r::a.py::run_all", "Function", "run_all", "a.py", None, None, "Runs the beacon ledger.", None, None, True), ("r::b.py::go", "Function", "A.go", "b.py", None, None, None, None, None, False), ("r::b.py::go2", "Function", "B.go", "b.py", None, None, None, None, None, False), ("concept::x", "Concept", None, None, "shard roster", None, "shard roster balance", None, None, None), ("r::a.py", "Module", None, "a.py", "a", None, None, None, 10, None)],
        "id string, label string, qualname string, path string, name string, hash string, text string, authored_at string, loc int, is_endpoint boolean",
    )
    edges = spark.createDataFrame([("r::b.py::go", "CALLS", "r::a.py::run_all"), ("r::a.py::run_all", "IMPLEMENTS", "concept::x")], "src string, type string, dst string")
    q = spark.createDataFrame([("sym", "what is run_all"), ("ask", "go"), ("topic", "shard roster balance"), ("meta", "了解这个项目"), ("out", "什么是天气"), ("none", "zzz"), ("null", None), ("again", "qqq")], "qid string, question string")
    extra = spark.createDataFrame([("again", 1, " "), ("again", 2, "run_all"), ("sym", 1, "A.go")], "qid string, seq int, question string")
    docs = nodes.where("text is not null").select("id", "text").unionByName(spark.createDataFrame([(f"d{i}", f"other words {i} here") for i in range(9)], "id string, text string"))
    got = {r["qid"]: r for r in build_context(Graph(nodes, edges), docs, q, extra=extra).collect()}
    assert len(got) == 8 and (got["sym"]["mode"], got["ask"]["needs_disambiguation"], got["topic"]["mode"], got["meta"]["route_label"], got["out"]["mode"]) == ("symbol", True, "topic", "meta", "out_of_scope")
    assert got["none"]["degraded"] and got["none"]["suggestions"] and got["none"]["mode"] == "overview" and got["null"]["context_text"]
    assert got["again"]["linked"] == ["r::a.py::run_all"] and got["again"]["mode"] == "symbol" and got["sym"]["linked"] == ["r::a.py::run_all"]
    assert "A.go" in got["sym"]["context_text"] or "go" in got["sym"]["context_text"]
    assert all(r["context_text"].strip() for r in got.values())
    assert build_context(Graph(nodes, edges), docs, q.where("qid = 'none'"), allow_overview=False).first()["mode"] == "none"


def test_row_judges(spark):
    df = spark.createDataFrame([("meta", "overview", "3 modules, 30 rows", ["a", "b"], ["b"], "should_autopick", False, "symbol", ["Redis"], ["SQLite"], "没有用 sqlite"), (None, None, None, None, ["b"], "should_disambiguate", None, None, None, None, None)], "route string, mode string, text string, anchors array<string>, gold array<string>, want string, asks boolean, m2 string, absent array<string>, truths array<string>, answer string")
    c = F.col
    out = df.select(evaluation.judge_overview(c("route"), c("mode"), c("text"), F.lit(None).cast("string"), ["modules", "rows"], ["3", "0"], 3).alias("o"), evaluation.judge_linked(c("anchors"), c("gold")).alias("l"), evaluation.judge_ambiguous(c("want"), c("asks"), c("anchors"), c("m2")).alias("a"), evaluation.judge_premise(c("answer"), F.lit(None).cast("string"), c("absent"), c("truths")).alias("p")).collect()
    a, b = out
    assert a["o"]["passed"] and a["o"]["facts_hit"] == 3 and not b["o"]["passed"]
    assert (a["l"]["hit_1"], a["l"]["hit_3"], b["l"]["hit_3"]) == (False, True, False)
    assert a["a"]["passed"] and b["a"]["under_ask"] and not b["a"]["passed"]
    assert a["p"]["corrected"] and not a["p"]["leak"] and not b["p"]["corrected"]


def test_calibration_grid_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    recalled = {f"q{i}": [(round(x, 2), rng.random() < 0.4) for x in sorted((rng.uniform(0.2, 3) for _ in range(i % 5)), reverse=True)] for i in range(23)}
    recalled |= {"close": [(2.0, False), (1.9, True)], "alone": [(1.5, True)], "almost": [(0.99996, True), (0.9, False)]}
    q = spark.createDataFrame([(k,) for k in recalled], "qid string")
    scored = spark.createDataFrame([(k, r, s, g) for k, hits in recalled.items() for r, (s, g) in enumerate(hits, 1)], "qid string, rank int, score double, gold boolean")
    cells = [(s, m, a) for s in (0.5, 1.0, 1.5, 2.0) for m in (0.1, 0.15, 0.2, 0.25) for a in (True, False)]
    want = {}
    for s, m, a in cells:
        h1 = h3 = over = 0
        for hits in recalled.values():
            c = [(round(x, 4), g) for x, g in hits if x >= s]
            over += len(c) > 1 and (c[0][0] - c[1][0]) / c[0][0] < m
            anchors = [] if len(c) == 1 and not a else c
            h1 += any(g for _, g in anchors[:1])
            h3 += any(g for _, g in anchors[:3])
        n = len(recalled)
        want[s, m, a] = (n, round(h1 / n, 4), round(h3 / n, 4), round(over / n, 4))
    order = lambda c: (-want[c][1], -want[c][2], -c[0], -c[1], c[2])
    able = [c for c in cells if want[c][3] <= 0.2 and want[c][1] > 0]
    got = {(r["min_score"], r["margin"], r["autopick"]): r for r in evaluation.calibration_grid(q, scored, spark.createDataFrame(cells, "min_score double, margin double, autopick boolean")).collect()}
    assert {c: (r["n"], r["hit_1"], r["hit_3"], r["over_ask"]) for c, r in got.items()} == want and able
    assert all(r["feasible"] == (want[c][3] <= 0.2) for c, r in got.items())
    assert [c for c, r in got.items() if r["best"]] == [min(able, key=order)] and [c for c, r in got.items() if r["least_bad"]] == [min(cells, key=order)]
    none = evaluation.calibration_grid(q, scored.where("not gold"), spark.createDataFrame(cells, "min_score double, margin double, autopick boolean"))
    assert none.where("best").count() == 0 and none.count() == 32


def test_bm25_context_holds_whole_texts(spark):
    texts = {1: "cursor ledger\nsecond line of one", 2: "cursor pallet\n" + "x" * 60, 3: "beacon\nshard"} | {i: f"filler words {i}" for i in range(4, 12)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    index = bm25.build_index(docs)
    q = spark.createDataFrame([("q", "cursor ledger"), ("none", "zzz")], "qid string, question string")
    rank = {r["id"]: (r["rank"], r["score"]) for r in bm25.topic_recall(index, q, 8, 0.0).collect()}
    assert sorted(rank, key=rank.get) == [1, 2]
    want = [bm25.HEADING] + [x for i in (1, 2) for x in (f"[{rank[i][0]}] [Document] {i}  (BM25={rank[i][1]})", "    " + texts[i])]
    got = {r["qid"]: r for r in bm25.bm25_context(index, q, docs).collect()}
    assert got["q"]["context_text"] == "".join(x + "\n" for x in want) and got["q"]["linked"] == [1, 2]
    assert got["none"]["context_text"] == bm25.HEADING + "\n"
    short = bm25.bm25_context(index, q, docs, budget=sum(len(x) + 1 for x in want) - 1).where("qid = 'q'").first()["context_text"]
    assert short == "".join(x + "\n" for x in want[:-1]) + NOTICE


def test_card_lists_every_entry_point(spark):
    from atlasgraph.operators.context import card_text, repo_card
    from atlasgraph.operators.graph import Graph
    from atlasgraph.operators.pipeline import build_context

    fns = [(f"r::a.py::f{i:02}", "Function", "r", f"f{i:02}", "a.py", None, None, None, None, None, i != 7, "GET" if i else None, f"/p{i}") for i in range(26)]
    nodes = spark.createDataFrame([*fns, ("r::a.py", "Module", "r", None, "a.py", "a", None, "Docs of a.", None, 10, None, None, None), ("concept::x", "Concept", "r", None, None, "shard roster", None, "about", None, None, None, None, None)], "id string, label string, repo string, qualname string, path string, name string, hash string, text string, authored_at string, loc int, is_endpoint boolean, http_method string, route_path string")
    G = Graph(nodes, spark.createDataFrame([("r::k", "MODIFIES", "r::a.py::f07"), ("r::a.py::f01", "IMPLEMENTS", "concept::x")], "src string, type string, dst string"))
    assert [(x["qualname"], x["http_method"], x["route_path"]) for x in repo_card(G).first()["entrypoints"]] == [(f[3], f[11], f[12]) for f in fns if f[10]]
    want = ["【仓库卡片】（来源: 图谱统计 · level-0 repo_card）", "仓库: r", "规模: 模块 1 · 类 0 · 函数 26 · 提交 0 · 概念 1", "", "【概述】（来源: 索引期网关生成 · 已过专名白名单校验）", "short", "", "【顶层模块】（来源: Module 按 loc 降序）", "- a.py (loc=10): Docs of a."]
    want += ["", "【热点函数】（来源: MODIFIES 计数，改动最频繁）", "- f07 (被 1 次提交修改)", "", "【核心概念】（来源: IMPLEMENTS 落点最多）", "- shard roster (落 1 处实现): about", "", "【入口点】（来源: Function.is_endpoint 聚合）"]
    want += [f"- {f[3]} [{f[11] or '?'} {f[12]}]" for f in fns if f[10]]
    assert card_text(G, "short").first()["card"].split("\n") == want
    got = build_context(G, nodes.where("text is not null").select("id", "text"), spark.createDataFrame([("m", "了解这个项目")], "qid string, question string"), summary="short").first()
    assert got["route_label"] == "meta" and got["context_text"].split("\n") == want


def test_concept_aliases_and_docstring_batch(spark):
    nodes = spark.createDataFrame([("c", "Concept", None, None, "watchdog", ["看门狗", "狗"], None), ("f", "Function", "A.go", "a.py", None, ["看门狗"], None)], NODES)
    q = spark.createDataFrame([("1", "谁喂看门狗")], "qid string, question string")
    assert rows(linking.alias_hits(nodes, q), "id", "matched") == [("c", "看门狗")]
    mods = spark.createDataFrame([("r::a.py", "Docs."), ("r::b.py", " "), ("r::c", "More.")], "id string, docstring string")
    fns = spark.createDataFrame([("r::a.py::f",), ("r::a.py::A.g",), ("r::a.pyx::h",), ("r::b.py::f",), ("r::c::d::e",)], "id string")
    got = semantic.docstring_batch(mods, fns).first()
    assert got["modules"] == ["r::a.py", "r::c"] and got["candidates"] == ["r::a.py::A.g", "r::a.py::f", "r::c::d::e"]
    assert semantic.docstring_batch(mods.where("id = 'r::b.py'"), fns).count() == 0


def test_names_a_question_offers_are_neither_broadcast_nor_kept_for_nothing(spark, small):
    from atlasgraph.functions.text import may_be_in
    from atlasgraph.plans.retrieval_queries import QUERIES

    plan = QUERIES["j11_link_entities"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    keys = spark.range(20_000).select(F.concat(F.lit("key_"), F.col("id").cast("string")).alias("k"))
    others = spark.range(20_000, 60_000).select(F.concat(F.lit("key_"), F.col("id").cast("string")).alias("v"))
    assert keys.withColumnRenamed("k", "v").where(may_be_in(F.col("v"), keys, "k")).count() == 20_000
    assert others.where(may_be_in(F.col("v"), keys, "k")).count() < 400
    assert others.where(may_be_in(F.col("v"), keys.limit(0), "k")).count() == 0


def test_blocks_of_texts_rank_as_the_whole_index(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 7)
    words = "cursor ledger harbor funnel pallet roster beacon shard 词法索引 断言路由".split()
    docs = [(f"d{i:02}", " ".join(words[(i * j * j + j) % len(words)] for j in range(1 + i % 9))) for i in range(60)] + [("e", ""), ("f", None), ("g", "7")]
    docs = spark.createDataFrame(docs, "id string, text string")
    q = spark.createDataFrame([("a", "which cursor in the harbor"), ("b", "断言路由 shard"), ("c", "nothing here"), ("d", "the"), ("e", None)], "qid string, question string")
    for k, least in ((3, 0.0), (8, 1.0), (1000, 0.0)):
        got, want = (rows(bm25.topic_recall(x, q, k, least)) for x in (bm25.texts(docs), bm25.build_index(docs)))
        assert got == want and want
    assert bm25.search(docs.limit(0), q).count() == 0 and bm25.search(docs, q.limit(0)).count() == 0


def test_gold_ranks_equal_the_whole_ranking(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["终止流程", "prefetch", "queues"]
    docs = [(i, " ".join(rng.choices(words, k=12)) + (" Prefetch queues" if i % 5 == 0 else "")) for i in range(80)] + [(200 + i, "same text w1 w2 fetch queue") for i in range(3)]
    docs += [(300, "no shared term: 恢复 x fetch queue"), (301, "")]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=3))) for i in range(12)] + [("same", "w1 w2"), ("none", "zz"), ("bare", None)]
    # phrases that start or end within a word, a short one, one in capitals, one nobody holds, two of one question
    phrases = [(q, p) for (q, _), p in zip(asked, ["fetch queue", "w3", "W1 W2", "nobody", "w4 w", "fetch queue", "流程 w", "s", "w29 w", "w5", "fetch", "queues", "fetch queue", "fetch queue", "w1"])] + [("q0", "w7 w"), ("q1", None)]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "qid string, question string")
    ranks = {(r["qid"], r["id"]): r["rank"] for r in bm25.ranking(bm25.build_index(d), q, 1_000_000, 0.0).collect()}
    want = {}
    for qid, p in phrases:
        for i, text in docs:
            if p is not None and p.lower() in text.lower() and (qid, i) in ranks:
                want[qid] = min(want.get(qid, (10**9, 0)), (ranks[qid, i], i))
    monkeypatch.setattr(bm25, "BLOCK", 20)
    monkeypatch.setattr(bm25, "build_index", None)
    got = {r["qid"]: (r["rank"], r["id"]) for r in bm25.gold_ranks(d, q, spark.createDataFrame(phrases, "qid string, phrase string")).collect()}
    assert got == want and len(want) > 6 and want["same"] == (ranks["same", 200], 200)


@pytest.mark.parametrize("name", ["a18_calibration_grid", "a19_failure_attribution"])
def test_evaluation_needs_no_index(spark, small, monkeypatch, name):
    import __spark_entry__

    monkeypatch.setattr(bm25, "build_index", None)
    df = __spark_entry__.queries()[name](spark, small)
    assert df.count() >= 4
