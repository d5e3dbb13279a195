"""Graph, impact, metrics on the three-module fixture and random graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasgraph.operators import graph as g
from atlasgraph.operators import impact as im
from atlasgraph.operators import metrics as me
from atlasgraph.operators import reach
from atlasgraph.operators.callgraph import merge_calls, resolve_calls, resolve_imports

from .conftest import rows

M = {"api": "r::src/app/api.py", "service": "r::src/app/service.py", "core": "r::src/app/core.py"}


@pytest.fixture(scope="module")
def app(spark):
    f = lambda m, q, e=False: (f"{M[m]}::{q}", "Function", q, e)
    nodes = [(v, "Module", None, None) for v in M.values()] + [(f"{M['service']}::Service", "Class", "Service", None)]
    nodes += [f("api", "handler_a", True), f("api", "handler_b", True), f("service", "Service.run"), f("service", "helper"), f("core", "compute"), f("core", "util")]
    fid = {q: i for i, label, q, _ in nodes if label == "Function"}
    edges = [(M["api"], "CONTAINS", fid["handler_a"]), (M["api"], "CONTAINS", fid["handler_b"]), (M["service"], "CONTAINS", f"{M['service']}::Service"), (f"{M['service']}::Service", "CONTAINS", fid["Service.run"])]
    edges += [(M["service"], "CONTAINS", fid["helper"]), (M["core"], "CONTAINS", fid["compute"]), (M["core"], "CONTAINS", fid["util"])]
    edges += [(M["api"], "IMPORTS", M["service"]), (M["api"], "IMPORTS", M["core"]), (M["service"], "IMPORTS", M["core"])]
    edges += [(fid[a], "CALLS", fid[b]) for a, b in (("handler_a", "Service.run"), ("handler_b", "helper"), ("Service.run", "compute"), ("helper", "compute"), ("compute", "util"))]
    return g.Graph(spark.createDataFrame(nodes, "id string, label string, qualname string, is_endpoint boolean"), spark.createDataFrame(edges, "src string, type string, dst string")), fid


def names(ids):
    return sorted(i.split("::")[-1] for i in ids)


@pytest.mark.parametrize(
    "symbol, depth, mode, direct, transitive, modules, cut",
    [
        ("compute", 3, "calls", ["Service.run", "helper"], ["handler_a", "handler_b"], 3, False),
        ("util", 1, "calls", ["compute"], [], 1, True),
        ("util", 3, "calls", ["compute"], ["Service.run", "handler_a", "handler_b", "helper"], 3, False),
        ("compute", 3, "imports", ["src/app/api.py", "src/app/service.py"], [], 3, False),
    ],
)
def test_impact(app, symbol, depth, mode, direct, transitive, modules, cut):
    out = im.impact_analysis(app[0], symbol, depth, mode)
    assert names(out["direct_callers"]) == direct and names(out["transitive_callers"]) == transitive
    assert len(out["affected_modules"]) == modules and out["truncated"] is cut
    assert names(out["affected_endpoints"]) == (["handler_a", "handler_b"] if depth == 3 else [])


def test_resolution(app, spark):
    G, fid = app
    assert im.impact_analysis(G, "run", 3)["resolved_symbol"] == fid["Service.run"]
    assert im.impact_analysis(G, "does_not_exist") == {"error": "not_found"}
    two = spark.createDataFrame([("x::A.run", "Function", "A.run", None), ("x::B.run", "Function", "B.run", None), ("x::run2", "Function", None, None)], G.nodes.schema)
    assert im.impact_analysis(g.Graph(two, G.edges), "run") == {"error": "ambiguous", "candidates": ["x::A.run", "x::B.run"]}


@pytest.mark.parametrize("depth", [0, 5, -1, 3.0, True, "3"])
def test_bad_depth(app, depth):
    with pytest.raises(ValueError):
        im.impact_analysis(app[0], "compute", depth)


def test_bad_mode(app):
    with pytest.raises(ValueError):
        im.impact_analysis(app[0], "compute", 2, "reads")


def test_closure_grows_and_ends_on_cycles(spark):
    rng = random.Random(3)
    e = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(40)}
    rev = spark.createDataFrame([(b, a) for a, b in e], "node string, pred string")
    seeds = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(12)], "seed string, node string")
    before = set()
    for d in (1, 2, 3, 4):
        got = {(r["seed"], r["node"]): r["level"] for r in im.bfs_levels(seeds, rev, d).collect()}
        assert before <= set(got)
        before = set(got)
        for (s, n), level in got.items():
            seen, front = {s}, {s}
            for k in range(level):
                front = {a for a, b in e if b in front} - seen
                seen |= front
            assert n in front


def test_upsert_is_idempotent(spark):
    w = spark.createDataFrame([(1, "a", "x", None), (2, "a", None, 5), (3, "b", None, None), (4, None, "lost", 1)], "seq int, id string, p string, q int")
    once = g.upsert(w, ["id"], "seq")
    assert rows(once, "id", "p", "q") == [("a", "x", 5), ("b", None, None)]
    twice = g.upsert(w.unionByName(w.withColumn("seq", F.col("seq") + 10)), ["id"], "seq")
    assert rows(twice, "id", "p", "q") == rows(once, "id", "p", "q")


def test_unknown_label_fails(spark):
    with pytest.raises(Exception, match="unknown label"):
        g.valid_labels(spark.createDataFrame([("a", "Planet")], "id string, label string")).collect()


def test_pagerank_sums_to_one(app):
    ranks = rows(me.pagerank(app[0]), "rank")
    assert abs(sum(r[0] for r in ranks) - 1) < 1e-6 and len(ranks) == 6


def test_empty_graph(spark):
    G = g.Graph(spark.createDataFrame([], "id string, label string, qualname string, is_endpoint boolean, created_at timestamp"), spark.createDataFrame([], "src string, type string, dst string, lines_added int, lines_deleted int"))
    assert im.blast_radius(G).count() == me.fan_in(G).count() == me.pagerank(G).count() == me.change_heat(G).count() == 0
    assert im.impact_analysis(G, "x") == {"error": "not_found"}


def test_path_exists(app, spark):
    G, fid = app
    ch = spark.createDataFrame([("y", [fid["handler_a"], fid["Service.run"], fid["compute"]]), ("n", [fid["util"], fid["compute"]]), ("one", [fid["util"]])], "chain_id string, chain array<string>")
    assert rows(im.path_exists(G.edges, ch)) == [("n", False), ("one", True), ("y", True)]


def test_call_resolution(spark):
    fn = [("pkg.util", "helper"), ("pkg.util", "compute"), ("pkg.util", "Base.shared"), ("pkg.core", "Worker.run"), ("pkg.core", "Worker.step"), ("pkg.app", "main"), ("pkg.app", "Helpers.do")]
    sites = [
        ("pkg.util", "compute", 0, 5, "name", "helper", None), ("pkg.core", "Worker.run", 0, 10, "name", "helper", None), ("pkg.core", "Worker.run", 1, 11, "self", "step", None), ("pkg.core", "Worker.run", 2, 12, "self", "shared", None),
        ("pkg.core", "Worker.run", 3, 13, "attr", "util", "compute"), ("pkg.core", "Worker.run", 4, 14, "other", "x[0]", None), ("pkg.core", "Worker.run", 5, 15, "name", "unknown", None), ("pkg.core", "Worker.step", 0, 20, "self", "run", None),
        ("pkg.core", "Worker.step", 1, 21, "self", "run", None), ("pkg.app", "main", 0, 30, "attr", "Helpers", "do"),
    ]
    classes = [("pkg.util", "Base", []), ("pkg.core", "Worker", ["Base"]), ("pkg.app", "Helpers", [])]
    out = resolve_calls(
        spark.createDataFrame(sites, "module string, caller string, seq int, line int, kind string, a string, b string"), spark.createDataFrame(fn, "module string, qualname string"), spark.createDataFrame(classes, "module string, qualname string, bases array<string>"),
        spark.createDataFrame([("pkg.core", "util", "pkg.util")], "module string, alias string, target string"), spark.createDataFrame([("pkg.core", "helper", "pkg.util", "helper"), ("pkg.core", "Base", "pkg.util", "Base")], "module string, alias string, target string, symbol string"),
    )
    hit = out.where("target is not null")
    assert out.count() == 10 and hit.count() == 8
    merged = merge_calls(hit.select(F.concat_ws(":", "module", "caller").alias("src"), F.concat_ws(":", "target_module", "target").alias("dst"), "seq", "line"), ["seq"])
    got = {(r["src"], r["dst"]): (r["count"], r["call_sites"]) for r in merged.collect()}
    assert len(got) == 7 and got["pkg.core:Worker.step", "pkg.core:Worker.run"] == (2, [20, 21])
    assert ("pkg.core:Worker.run", "pkg.util:Base.shared") in got and ("pkg.app:main", "pkg.app:Helpers.do") in got


def test_imports(spark):
    imp = [("app.api", 0, "app.service", "Service"), ("app.api", 1, "app.core", "util"), ("app.service", 0, "app.core", "compute"), ("app.service", 1, "app.core", None), ("app.api", 2, "fastapi", None), ("app.core", 0, "app.core", "x")]
    mods = spark.createDataFrame([("app.api",), ("app.service",), ("app.core",)], "module string")
    out = resolve_imports(spark.createDataFrame(imp, "module string, seq int, target string, symbol string"), mods)
    assert {(r["module"], r["target"]): r["names"] for r in out.collect()} == {("app.api", "app.service"): ["Service"], ("app.api", "app.core"): ["util"], ("app.service", "app.core"): ["compute", "*module*"]}


def _power_iteration(nodes, edges):
    out = {x: {b for a, b in edges if a == x and b in nodes} for x in nodes}
    rank, rounds = {x: 1 / len(nodes) for x in nodes}, 0
    for rounds in range(1, 201):
        loose = 0.85 * sum(rank[x] for x in nodes if not out[x]) / len(nodes)
        new = {x: 0.15 / len(nodes) + loose for x in nodes}
        for x in nodes:
            for y in out[x]:
                new[y] += 0.85 * rank[x] / len(out[x])
        moved, rank = sum(abs(new[x] - rank[x]) for x in nodes), new
        if moved < 1e-6:
            break
    return rank, rounds


def test_all_metrics_converge_and_hold_modules(spark):
    rng = random.Random(14)
    fns, mods = [f"r::m{i % 5}.py::f{i}" for i in range(20)], [f"r::m{i}.py" for i in range(5)]
    calls = {(fns[rng.randrange(20)], fns[rng.randrange(16)]) for _ in range(45)}
    imports = {(mods[rng.randrange(5)], mods[rng.randrange(4)]) for _ in range(8)}
    nodes = [(f, "Function", f.split("::")[-1], i % 4 == 0, None, i if i % 3 else None) for i, f in enumerate(fns)] + [(m, "Module", None, None, None, None) for m in mods]
    edges = [(a, t, b, None, None) for t, e in (("CALLS", calls), ("IMPORTS", imports)) for a, b in e]
    G = g.Graph(spark.createDataFrame(nodes, "id string, label string, qualname string, is_endpoint boolean, created_at timestamp, cyclomatic int"), spark.createDataFrame(edges, "src string, type string, dst string, lines_added int, lines_deleted int"))
    got = {r["id"]: r for r in me.all_metrics(G).collect()}
    assert set(got) == set(fns) | set(mods)
    rank, rounds = _power_iteration(fns, calls)
    assert rounds > 8 and rounds % 5
    assert all(abs(got[f]["pagerank"] - rank[f]) < 1.1e-8 for f in fns) and all(got[f]["module_pagerank"] is None for f in fns)
    rank, _ = _power_iteration(mods, imports)
    assert all(abs(got[m]["module_pagerank"] - rank[m]) < 1.1e-8 and got[m]["fan_in"] is None for m in mods)
    for i, f in enumerate(fns):
        seen, front = set(), {f}
        for _ in range(3):
            front = {a for a, b in calls if b in front}
            seen |= front
        assert (got[f]["fan_in"], got[f]["blast_radius"], got[f]["cyclomatic"]) == (sum(b == f for _, b in calls), len(seen - {f}), i if i % 3 else None)


def test_caller_pattern_takes_three_hops(app, spark):
    G, fid = app
    got = {r["id"]: names(r["callers"]) for r in im.caller_pattern(G, g.by_label(G.nodes, "Function").select("id")).collect()}
    assert got[fid["util"]] == ["Service.run", "compute", "handler_a", "handler_b", "helper"] and got[fid["handler_a"]] == [] and len(got) == 6
    loop = g.Graph(G.nodes, spark.createDataFrame([(fid["util"], "CALLS", fid["compute"]), (fid["compute"], "CALLS", fid["util"])], G.edges.schema))
    assert names(im.caller_pattern(loop, spark.createDataFrame([(fid["util"],)], "id string")).first()["callers"]) == ["compute", "util"]


def _random_calls(spark, n=60, calls=150, seed=5):
    """A graph with a hub, cycles and self loops, and of each function who reaches it within three hops, with the hop."""
    rng = random.Random(seed)
    e = {(f"m{rng.randrange(6)}::f{rng.randrange(n):02}", f"m{rng.randrange(6)}::f{rng.randrange(n):02}") for _ in range(calls)} | {(f"m1::f{i:02}", "m0::f00") for i in range(n)}
    ids = sorted({x for p in e for x in p} | {"m0::alone"})
    levels = {}
    for s in ids:
        seen, front = {s: 0}, {s}
        for hop in (1, 2, 3):
            front = {a for a, b in e if b in front} - set(seen)
            seen |= dict.fromkeys(front, hop)
        levels[s] = seen
    nodes = [(i, "Function", i.split("::")[1], i.endswith("7")) for i in ids] + [(f"m{k}", "Module", None, None) for k in range(5)]  # one module isn't known
    edges = [(a, "CALLS", b) for a, b in e] + [(i[:2], "CONTAINS", i) for i in ids]
    return g.Graph(spark.createDataFrame(nodes, "id string, label string, qualname string, is_endpoint boolean"), spark.createDataFrame(edges, "src string, type string, dst string")), e, levels


def _no_rows(monkeypatch):
    """Fails where the pairs of a closure are made rows."""

    def rows_of_pairs(*a, **k):
        raise AssertionError("pairs of a closure as rows")

    monkeypatch.setattr(im, "closure", rows_of_pairs)


def test_blast_radius_by_blocks(spark, monkeypatch):
    G, _, levels = _random_calls(spark)
    _no_rows(monkeypatch)
    want = [(s, len(c) - 1, sum(x.endswith("7") for x in c if x != s)) for s, c in levels.items()]
    assert rows(im.blast_radius(G, 3), "id", "blast_radius", "blast_endpoints") == sorted(want, key=repr)


@pytest.mark.parametrize("places, step", [(1, 1), (1 << 9, 7), (1 << 20, 1 << 20)])
def test_blocks_of_any_size(monkeypatch, places, step):
    rng = random.Random(places)
    e = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)} | {(0, i) for i in range(20)}
    monkeypatch.setattr(reach, "PLACES", places)
    monkeypatch.setattr(reach, "STEP", step)
    pack = lambda pairs: np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
    block = reach.Block(2, np.arange(40), pack(e), np.arange(0, 40, 3), pack((i, i % 4) for i in range(30)), None)
    got = {}
    for batch in block.batches():
        cut, modules = batch.cut(), batch.modules()
        for i, s in enumerate(batch.seeds):
            of = lambda keys: sorted(block.node(keys[keys >> block.shift == i]).tolist())  # noqa: B023, E731
            got[int(s)] = [[of(k) for k in batch.levels], bool(cut[i]), of(modules)]
    for s in range(40):
        seen, front, levels = {s}, {s}, [[s]]
        for _ in range(2):
            front = {b for a, b in e if a in front} - seen
            seen |= front
            levels.append(sorted(front))
        more = bool({b for a, b in e if a in front} - seen)
        assert [x for x in got[s][0] if x] == [x for x in levels if x] and got[s][1:] == [more, sorted({x % 4 for x in seen if x < 30})]


def test_truncated_seeds_by_blocks(spark, monkeypatch):
    G, e, levels = _random_calls(spark)
    _no_rows(monkeypatch)
    want = [(s, True) for s, c in levels.items() if {a for a, b in e if c.get(b) == 3} - set(c)]
    seeds = g.by_label(G.nodes, "Function").select(F.col("id").alias("seed"))
    assert want and rows(im.truncated_seeds(seeds, g.reverse(G.edges, "CALLS"), 3)) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["impact_modules_all", "impact_modules"])
def test_impact_modules_by_blocks(spark, monkeypatch, name):
    from atlasgraph.operators import evaluation

    G, _, levels = _random_calls(spark)
    _no_rows(monkeypatch)
    homes = {s: sorted({x[:2] for x in c if x[:2] != "m5"}) for s, c in levels.items() if name.endswith("_all") or s.endswith("7")}
    got = rows(evaluation.recipes(G, name), "key", "n", "first", "last")
    assert got == sorted([(s, len(h), h[0], h[-1]) for s, h in homes.items() if h], key=repr)


def test_impact_lists_by_blocks(spark, monkeypatch):
    G, e, levels = _random_calls(spark)
    _no_rows(monkeypatch)
    got = {r["resolved_symbol"]: r for r in im.impact(G, g.by_label(G.nodes, "Function").select("id"), 3, "calls").collect()}
    assert set(got) == set(levels)
    for s, c in levels.items():
        r = got[s]
        assert r["direct_callers"] == sorted(x for x, k in c.items() if k == 1) and r["transitive_callers"] == sorted(x for x, k in c.items() if k > 1)
        assert r["affected_endpoints"] == sorted(x for x in c if x.endswith("7")) and r["affected_modules"] == sorted({x[:2] for x in c if x[:2] != "m5"})
        assert r["truncated"] is bool({a for a, b in e if c.get(b) == 3} - set(c))


def test_metrics_that_are_not_asked_for_are_not_worked_out(app, monkeypatch):
    G = g.Graph(app[0].nodes.withColumn("created_at", F.lit(None).cast("timestamp")), app[0].edges.withColumn("lines_added", F.lit(1)).withColumn("lines_deleted", F.lit(0)))
    every = {r["id"]: r for r in me.all_metrics(G).where("label = 'Function'").collect()}

    def looped(*a, **k):
        raise AssertionError("worked out for nothing")

    monkeypatch.setattr(me, "blast_radius", looped)
    monkeypatch.setattr(me, "pagerank", looped)
    wanted = ["fan_in", "commits_all", "commits_90d", "churn_90d", "heat", "fix_involvement"]
    some = me.all_metrics(G, wanted=wanted).collect()
    assert len(some) == len(every) == 6
    assert all([r[c] for c in wanted] == [every[r["id"]][c] for c in wanted] for r in some)


def _calls_and_imports(spark):
    """A graph whose calls and imports have loops, edges to unknown nodes, edges that are there twice and nodes without any."""
    rng = random.Random(31)
    fns, mods = [f"r::m{i % 5}.py::f{i}" for i in range(40)], [f"r::m{i}.py" for i in range(9)]
    calls = [(fns[rng.randrange(36)], fns[rng.randrange(40)]) for _ in range(90)] + [(fns[0], fns[0]), (fns[1], "r::gone"), ("r::gone", fns[2]), (fns[3], mods[0])]
    imports = [(mods[rng.randrange(9)], mods[rng.randrange(7)]) for _ in range(14)] + [(mods[0], fns[0])]
    nodes = [(f, "Function", None, i % 7 == 0, None) for i, f in enumerate(fns)] + [(m, "Module", None, None, None) for m in mods]
    edges = [(a, t, b, None, None) for t, e in (("CALLS", calls + calls[:20]), ("IMPORTS", imports + imports[:3])) for a, b in e]
    G = g.Graph(spark.createDataFrame(nodes, "id string, label string, qualname string, is_endpoint boolean, created_at timestamp"), spark.createDataFrame(edges, "src string, type string, dst string, lines_added int, lines_deleted int"))
    return G, fns, mods, set(calls), set(imports)


@pytest.mark.parametrize("step", [reach.STEP, 7])
def test_all_metrics_take_no_rounds_over_tables(spark, monkeypatch, step):
    G, fns, mods, calls, imports = _calls_and_imports(spark)

    def looped(*a, **k):
        raise AssertionError("rounds over tables")

    monkeypatch.setattr(me, "pagerank", looped)
    monkeypatch.setattr(reach, "STEP", step)
    got = {r["id"]: r for r in me.all_metrics(me.kept(G)).collect()}
    assert set(got) == set(fns) | set(mods)
    for ids, edges, name in ((fns, calls, "pagerank"), (mods, imports, "module_pagerank")):
        rank, _ = _power_iteration(ids, {(a, b) for a, b in edges if a in ids and b in ids})
        assert all(abs(got[i][name] - rank[i]) < 1.1e-8 for i in ids)
    assert all(got[f]["fan_in"] == len({a for a, b in calls if b == f}) for f in fns)


def test_all_metrics_of_more_than_a_task_takes(spark, monkeypatch):
    G = _calls_and_imports(spark)[0]
    once = {r["id"]: r for r in me.all_metrics(G).collect()}
    monkeypatch.setattr(reach, "TOGETHER", 1)
    for r in me.all_metrics(G).collect():
        for name in ("pagerank", "module_pagerank"):
            assert (r[name] is None) == (once[r["id"]][name] is None) and abs((r[name] or 0) - (once[r["id"]][name] or 0)) < 1.1e-8


def test_all_metrics_of_an_empty_graph(spark):
    G = g.Graph(spark.createDataFrame([], "id string, label string, qualname string, is_endpoint boolean, created_at timestamp"), spark.createDataFrame([], "src string, type string, dst string, lines_added int, lines_deleted int"))
    assert me.all_metrics(me.kept(G)).count() == 0


def test_complexity_parses_only_files_that_hold_functions(spark):
    from atlasgraph.sources import python_source as ps

    texts = [("r", "src\\a.py", "def f(x):\n    if x: return 1\n\nclass C:\n    def g(self): pass\n\ndef f(x):\n    pass\n"), (" r", "b.py", "def f(x):\n    for y in x: pass\n"), ("r", "c.py", "def f(): pass\n"), ("s", "src/a.py", "def f(): pass\n")]
    files = spark.createDataFrame(texts, "repo string, relpath string, source_text string")
    ids = spark.createDataFrame([("r::src/a.py::f",), ("r::src/a.py::C.g",), ("r::b.py::f",), ("r::c.py",), ("f",), ("s::src/a.py::other::f",)], "id string")
    assert rows(ps.complexity(files, ids), "id", "cyclomatic") == [("r::b.py::f", 2), ("r::src/a.py::C.g", 1), ("r::src/a.py::f", 1)]


def test_impact_texts_by_blocks(spark, monkeypatch):
    G, _, levels = _random_calls(spark)
    _no_rows(monkeypatch)
    monkeypatch.setattr(reach, "LISTED", 50)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    edges = G.edges.mapInArrow(counted, G.edges.schema)
    got = {r["resolved_symbol"]: r for r in im.impact(g.Graph(G.nodes, edges), g.by_label(G.nodes, "Function").select("id"), 3, "calls", joined="|").collect()}
    assert read.value == G.edges.count()  # the graph is worked out once
    assert set(got) == set(levels)
    for s, c in levels.items():
        r = got[s]
        assert r["direct_callers"] == "|".join(sorted(x for x, k in c.items() if k == 1)) and r["transitive_callers"] == "|".join(sorted(x for x, k in c.items() if k > 1))
        assert r["affected_endpoints"] == "|".join(sorted(x for x in c if x.endswith("7"))) and r["affected_modules"] == "|".join(sorted({x[:2] for x in c if x[:2] != "m5"}))


def test_large_closures_lie_evenly():
    large = 40  # of 2000 seeds, side by side
    pairs = [(i, 2000 + k) for i in range(700, 700 + large) for k in range(900)]
    block = reach.Block(1, np.arange(2000), np.array([a << 32 | b for a, b in pairs], dtype=np.int64), np.empty(0, np.int64), np.empty(0, np.int64), None)
    block.even()
    seeds = np.concatenate([batch.seeds for batch in block.batches()])
    assert sorted(seeds) == list(range(2000)) and 700 <= seeds[0] < 700 + large
    per = ((seeds >= 700) & (seeds < 700 + large)).reshape(20, 100).sum(axis=1)
    assert per.min() >= 1 and per.max() <= 4
