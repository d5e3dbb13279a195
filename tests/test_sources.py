"""Parsing, git history, assembly, snapshots, command line and tool server on a small repository."""

import io
import json
import os
import subprocess
import xml.dom.minidom

import pytest

from atlasgraph import cli
from atlasgraph.config import Settings
from atlasgraph.operators.graph import Graph, counts
from atlasgraph.sources import gitlog, sinks
from atlasgraph.sources.indexer import build_graph, structure
from atlasgraph.sources.python_source import function_facts, import_facts, module_facts, parse_sources, read_worktree
from atlasgraph.tools import Tools, serve

from .conftest import rows

MODULE = '''
import os.path as p
from ..other import thing as t

@app.get("/items")
async def list_items(x: int = 1, *, y=None) -> list:
    """Items."""
    def inner():
        return helper()
    if x and y and p:
        return [i for i in x if i]
    return weird[0].call()

class Service(Base):
    def __init__(self):
        self.run()
    class Inner:
        def deep(self): return t.go()
'''


def test_facts():
    f = module_facts(MODULE, "pkg.sub.mod", False)
    by = {x["qualname"]: x for x in f["functions"]}
    assert list(by) == ["list_items", "list_items.inner", "Service.__init__", "Service.Inner.deep"]
    assert by["list_items"]["signature"] == "async list_items(x: int=1, *, y=None) -> list" and by["list_items"]["decorators"] == ["app.get"] and by["list_items"]["arguments"] == ["/items"]
    assert by["list_items"]["cyclomatic"] == 1 + 1 + 2 + 1 and by["list_items"]["span_start"] == 5
    assert [(c["kind"], c["a"]) for c in by["list_items"]["calls"]] == [("other", "weird[0].call")] and by["list_items.inner"]["calls"][0]["a"] == "helper"
    assert by["Service.__init__"]["calls"][0]["kind"] == "self" and by["Service.Inner.deep"]["is_method"]
    assert [(i["alias"], i["target"], i["symbol"]) for i in f["imports"]] == [("p", "os.path", None), ("t", "pkg.other", "thing")]


@pytest.mark.parametrize("bad", [None, "def f(:", "\x00", "print 'x'"])
def test_unparsable(bad):
    assert module_facts(bad, "m", False) is None


def test_parse_sources(spark):
    df = spark.createDataFrame([("r", "src/a/b.py", MODULE), ("r", "x.py", None), ("r", "y.py", ""), ("r", "z.py", "def f(:")], "repo string, relpath string, source_text string")
    p = parse_sources(df)
    assert rows(p, "relpath", "module", "parsed") == [("src/a/b.py", "a.b", True), ("x.py", "x", False), ("y.py", "y", True), ("z.py", "z", False)]
    assert function_facts(p).count() == 4 and import_facts(p).count() == 2 and parse_sources(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = str(tmp_path_factory.mktemp("repo"))

    def git(*a):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", r, *a], check=True, capture_output=True)

    def put(name, text, message):
        os.makedirs(os.path.dirname(f"{r}/{name}"), exist_ok=True)
        with open(f"{r}/{name}", "w") as f:
            f.write(text)
        git("add", "-A")
        git("commit", "-qm", message)

    git("init", "-q")
    put("tests/test_x.py", "x = 1\n", "tests")
    put("pkg/mod.py", "def alpha(x):\n    return x\n\n\ndef to_delete():\n    return 1\n", "seed")
    put("pkg/mod.py", "def alpha(x):\n    return x + 1\n\n\ndef to_delete():\n    return 1\n\n\ndef beta():\n    return alpha(2)\n", "change\n\nfixes #5")
    put("pkg/mod.py", "def deco(f):\n    return f\n\n\n@deco\ndef alpha(x):\n    return x + 1\n\n\ndef beta():\n    return alpha(2)\n", "drop (#12)")
    put("pkg/bad.py", "def broken(:\n", "bad")
    return r


@pytest.fixture(scope="module")
def indexed(spark, repo, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    assert cli.main(["all", repo, "--name", "demo", "--out", out]) == 0
    return out, sinks.load_graph(spark, f"{out}/graph")


def test_history(indexed):
    out, G = indexed
    e = {(r["type"], r["src"].split("::")[-1], r["dst"].split("::")[-1]): r for r in G.edges.collect()}
    by = {(k[0], k[2]): [] for k in e}
    for k, r in e.items():
        by[k[0], k[2]].append((r["lines_added"], r["lines_deleted"]))
    assert (1, 1) in by["MODIFIES", "alpha"] and by["MODIFIES", "beta"] == [(2, 0)] and ("MODIFIES", "to_delete") not in by and ("MODIFIES", "deco") in by
    assert {k[2]: e[k]["pattern"] for k in e if k[0] == "FIXES"} == {"5": "fixes", "12": "pr_ref"} and ("CALLS", "alpha") in by
    with open(f"{out}/stats.json") as f:
        s = json.load(f)
    assert s["quality"]["dangling_modifies"] >= 2 and s["quality"]["parse_skips"] == 1 and s["nodes"]["Commit"] == 5 and os.path.exists(f"{out}/graph.html")


def test_repositories_with_one_path_stay_apart(spark):
    core = "import util\nfrom util import help_me as h\n\nclass Box:\n    def put(self):\n        return self.take()\n    def take(self):\n        return h()\n"
    files = [("one", "src/core.py", core), ("one", "src/util.py", "def help_me():\n    pass\n"), ("two.x", "src/core.py", core + "\ndef only_two():\n    pass\n"), ("two.x", "src/other.py", "import core\n\ndef go():\n    core.only_two()\n")]
    s = structure(parse_sources(spark.createDataFrame(files, "repo string, relpath string, source_text string")))
    edges = rows(s["contains"].unionByName(s["imports"]).unionByName(s["calls"]), "src", "type", "dst")
    assert all(a.split("::")[0] == b.split("::")[0] for a, _, b in edges) and len(edges) == len(set(edges))
    assert {(a, t, b) for a, t, b in edges if t != "CONTAINS"} == {
        ("one::src/core.py", "IMPORTS", "one::src/util.py"), ("two.x::src/other.py", "IMPORTS", "two.x::src/core.py"), ("one::src/core.py::Box.put", "CALLS", "one::src/core.py::Box.take"), ("two.x::src/core.py::Box.put", "CALLS", "two.x::src/core.py::Box.take"),
        ("one::src/core.py::Box.take", "CALLS", "one::src/util.py::help_me"), ("two.x::src/other.py::go", "CALLS", "two.x::src/core.py::only_two"),
    }
    assert {(r["repo"], r["path"]): r["external_imports"] for r in s["module"].collect()} == {("one", "src/core.py"): [], ("one", "src/util.py"): [], ("two.x", "src/core.py"): ["util"], ("two.x", "src/other.py"): []}


def test_a_failing_git_is_an_error(spark, tmp_path, repo):
    with pytest.raises(RuntimeError):
        gitlog._git(str(tmp_path), "rev-list", "HEAD")
    with pytest.raises(RuntimeError):
        list(gitlog.GitReader(str(repo)).read(gitlog._Range(["0" * 40])))
    with pytest.raises(Exception):
        gitlog.read_git(spark, str(tmp_path / "nowhere")).count()


def test_empty_repository(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert gitlog.read_git(spark, str(tmp_path)).count() == 0


def test_worktree_excludes(spark, repo):
    assert rows(read_worktree(spark, repo, "demo"), "relpath") == [("pkg/bad.py",), ("pkg/mod.py",)]


def test_changed_lines(spark):
    patch = "\n@@ -1,3 +1,4 @@\n a\n-b\n+c\n+d\n e\n\\ No newline\n@@ -10 +11,2 @@\n x\n+y"
    df = spark.createDataFrame([("k", patch), ("n", ""), ("z", None)], "commit string, patch string")
    assert rows(gitlog.changed_lines(df, ["commit"])) == sorted([("k", "new", 2), ("k", "new", 3), ("k", "new", 12), ("k", "old", 2)], key=repr)


def test_settings(spark):
    spark.conf.set("atlasgraph.exclude_dirs", "a,b")
    try:
        assert Settings.of(spark).exclude_dirs == ("a", "b") and Settings.of(spark).src_roots == ("src",)
    finally:
        spark.conf.unset("atlasgraph.exclude_dirs")


def test_snapshots(spark, tmp_path, indexed):
    G = indexed[1]
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"nodes": [{"id": "a", "label": "Module"}], "edges": [{"src": "a", "type": "CALLS", "dst": "b", "properties": {"count": 2}}]}))
    back = sinks.import_json(spark, str(path), "id: string, label: string", "count: int")
    assert rows(back.edges) == [("a", "CALLS", "b", 2)] and rows(back.nodes) == [("a", "Module")]
    sinks.export_json(G, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == G.nodes.count() + G.edges.count()
    assert sinks.patch_stats(str(tmp_path / "s.json"), {"a": 1}) | sinks.patch_stats(str(tmp_path / "s.json"), {"b": 2}) == {"a": 1, "b": 2}
    (tmp_path / "c.json").write_text("")
    with pytest.raises(ValueError):
        sinks.load_cards(spark, str(tmp_path / "c.json"))


def test_pictures(spark, tmp_path, indexed):
    G = indexed[1]
    files = sinks.render_all(G, str(tmp_path / "v"), limit=5, pictured=3)
    assert [os.path.basename(f) for f in files][:3] == ["graph.html", "import_graph.svg", "call_graph.svg"]
    page = open(files[0], encoding="utf-8").read()
    data = json.loads(page.split('type="application/json">')[1].split("</script>")[0])
    assert data["total"] == {"nodes": G.nodes.count(), "edges": G.edges.count()} and len(data["nodes"]) == min(5, G.nodes.count())
    shown = {n["id"] for n in data["nodes"]}
    assert all(e["src"] in shown and e["dst"] in shown for e in data["edges"]) and all(0 <= n["x"] <= 1000 for n in data["nodes"])
    for f in files[1:]:
        assert xml.dom.minidom.parse(f).documentElement.tagName == "svg"
    none = Graph(G.nodes.limit(0), G.edges.limit(0))
    assert len(sinks.render_all(none, str(tmp_path / "w"))) == 3 and "nothing to draw" in open(tmp_path / "w" / "call_graph.svg").read()


@pytest.mark.parametrize("message, code", [([1, 2], -32600), ("text", -32600), (None, -32600), ({"id": 1}, -32600), ({"id": 1, "method": 5}, -32600), ({"method": None}, -32600), ({"id": 1, "method": "ping", "params": [1]}, -32602), ({"id": 1, "method": "what"}, -32601)])
def test_what_is_no_request(spark, message, code):
    answer = Tools(spark, lambda: None).handle(message)
    assert answer["error"]["code"] == code and answer["id"] == (message.get("id") if isinstance(message, dict) else None)
    assert Tools(spark, lambda: None).handle({"method": "ping"}) is None


def test_cli(indexed, capsys):
    out = indexed[0]
    assert cli.main(["impact", "alpha", "--out", out]) == 0 and "beta" in capsys.readouterr().out
    assert cli.main(["impact", "nothing", "--out", out]) == 1 and cli.main(["impact", "alpha", "--depth", "9", "--out", out]) == 2
    assert cli.main(["stats", "--out", out]) == 0
    with pytest.raises(SystemExit):
        cli.main(["unknown"])


def test_server(spark, indexed):
    tools = Tools(spark, lambda: indexed[1])
    ask = lambda i, m, p=None: json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p or {}})
    call = lambda i, n, a: ask(i, "tools/call", {"name": n, "arguments": a})
    lines = [ask(1, "initialize", {"protocolVersion": "X"}), ask(2, "ping"), ask(3, "tools/list"), ask(4, "what"), call(5, "nope", {}), call(6, "impact_analysis", {}), call(7, "impact_analysis", {"symbol": "alpha", "depth": 9}), call(8, "impact_analysis", {"symbol": "alpha"}), call(9, "impact_analysis", {"symbol": "zzz"}), call(10, "repo_overview", {}), "no json", json.dumps({"method": "notify"})]
    out = io.StringIO()
    serve(tools, lines, out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert got[1]["result"]["protocolVersion"] == "X" and got[2]["result"] == {} and len(got[3]["result"]["tools"]) == 3 and got[4]["error"]["code"] == -32601
    kind = lambda i: got[i]["result"]["structuredContent"].get("error")
    assert kind(5) == "unknown_tool" and kind(6) == "invalid_arguments" and kind(7) == "invalid_argument" and got[7]["result"]["isError"]
    assert got[8]["result"]["structuredContent"]["direct_callers"] == ["demo::pkg/mod.py::beta"] and kind(9) == "not_found" and "isError" not in got[9]["result"]
    assert got[10]["result"]["structuredContent"]["n_function"] == 3 and got[None]["error"]["code"] == -32700

    def broken():
        raise OSError("no graph")

    assert Tools(spark, broken).call("repo_overview", {})["structuredContent"]["error"] == "graph_unavailable"


def test_build_graph_counts(spark, repo):
    G, _ = build_graph(spark, repo, "demo")
    assert {(r["kind"], r["name"]): r["n"] for r in counts(Graph(G.nodes, G.edges)).collect()}["nodes", "Function"] == 3
