"""Sinks and snapshots: Parquet graphs, JSON exports and imports, statistics, audit and record logs, an HTML view."""

from __future__ import annotations

import json
import os
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, counts


def save_graph(graph: Graph, path: str) -> None:
    """nodes by label, edges by type; a snapshot replaces the one before."""
    graph.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def export_json(graph: Graph, path: str) -> None:
    """JSON lines, one element each: {"node": {...}} or {"edge": {src, type, dst, properties}}; nulls are kept."""
    keep = {"ignoreNullFields": "false"}
    nodes = graph.nodes.select(F.to_json(F.struct(F.struct("*").alias("node")), keep).alias("value"))
    props = [c for c in graph.edges.columns if c not in ("src", "type", "dst")]
    edge = F.struct("src", "type", "dst", F.struct(*props).alias("properties")) if props else F.struct("src", "type", "dst")
    edges = graph.edges.select(F.to_json(F.struct(edge.alias("edge")), keep).alias("value"))
    nodes.unionByName(edges).write.mode("overwrite").text(path)


def import_json(spark: SparkSession, path: str, node_schema: str, props_schema: str) -> Graph:
    """A single-document snapshot {"nodes": [...], "edges": [{src, type, dst, properties}]}."""
    shape = f"nodes array<struct<{node_schema}>>, edges array<struct<src: string, type: string, dst: string, properties: struct<{props_schema}>>>"
    doc = spark.read.schema(shape).json(path, multiLine=True)
    return Graph(doc.select(F.inline("nodes")), doc.select(F.inline("edges")).select("src", "type", "dst", "properties.*"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def load_cards(spark: SparkSession, path: str, schema: str = "id string, label string, name string, desc string, desc_accepted boolean, zh_aliases array<string>") -> DataFrame:
    """Cards; an empty or blocked input is an error, not an empty enrichment."""
    cards = spark.read.schema(schema).json(path).where("id is not null")
    if cards.isEmpty():
        raise ValueError(f"no cards in {path}")
    return cards


def statistics(graph: Graph, extra: dict | None = None) -> dict:
    """Counts by label and type, totals, and the counters given."""
    rows = counts(graph).collect()  # one row per label and type
    out: dict = {"nodes": {}, "edges": {}}
    for r in rows:
        out[r["kind"]][r["name"] or "total"] = r["n"]
    return out | (extra or {})


def write_stats(stats: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(stats, f, ensure_ascii=False, indent=2, sort_keys=True)


def patch_stats(path: str, changes: dict) -> dict:
    """Replace the given keys of written statistics, keep the others."""
    old = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
    write_stats(old | changes, path)
    return old | changes


def write_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def drawing(graph: Graph, limit: int, label: str | None = None, etype: str | None = None) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of the `limit` most connected nodes and all distinct edges between them; limit is what a picture can hold,
    so the driver gets at most that many nodes. Optionally of one label and one type."""
    from ..operators.metrics import degrees

    nodes = graph.nodes if label is None else graph.nodes.where(F.col("label") == label)
    edges = graph.edges if etype is None else graph.edges.where(F.col("type") == etype)
    title = F.coalesce(*[F.col(c) for c in ("qualname", "name", "path", "hash") if c in nodes.columns], F.substring_index("id", "::", -1))
    top = nodes.join(degrees(edges), "id", "left").select("id", "label", title.alias("title"), F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id").limit(limit).collect()
    shown = graph.nodes.sparkSession.createDataFrame([(r["id"],) for r in top], "id string")
    between = edges.join(F.broadcast(shown.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(shown.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "type", "dst").distinct()
    return [r.asDict() for r in top], [r.asDict() for r in between.collect()]


def layout(n: int, links: list[tuple[int, int]], rounds: int = 60) -> np.ndarray:
    """Places in the unit square, springs along links and repulsion between all; a circle for a start, so always the same."""
    turn = np.arange(n) * 2.399963  # the golden angle
    at = np.sqrt((np.arange(n) + 0.5) / max(n, 1))[:, None] * np.c_[np.cos(turn), np.sin(turn)]
    a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    k = 1.5 / np.sqrt(max(n, 1))
    for step in np.linspace(0.1, 0.005, rounds if n > 1 else 0):
        move = np.zeros_like(at)
        for i in range(0, n, 256):  # a slice of all pairs at a time
            apart = at[i : i + 256, None] - at[None]
            far = (apart**2).sum(-1) + 1e-6
            move[i : i + 256] += (apart * (k * k / far)[..., None]).sum(1)
        if len(a):
            pull = (at[b] - at[a]) * np.sqrt(((at[b] - at[a]) ** 2).sum(1) + 1e-9)[:, None] / k
            np.add.at(move, a, pull)
            np.add.at(move, b, -pull)
        size = np.sqrt((move**2).sum(1, keepdims=True)) + 1e-9
        at = at + move / size * np.minimum(size, step)
    low, high = (at.min(0), at.max(0)) if n else (np.zeros(2), np.ones(2))
    return (at - low) / np.maximum(high - low, 1e-9)


COLORS = {"Module": "#4c78a8", "Class": "#72b7b2", "Function": "#54a24b", "Commit": "#eeca3b", "Issue": "#e45756", "Concept": "#b279a2"}


def graph_svg(nodes: list[dict], edges: list[dict], title: str, total: str, width: int = 1200, height: int = 900) -> str:
    """A picture of nodes and edges; without nodes it says so."""
    place = {n["id"]: i for i, n in enumerate(nodes)}
    links = [(place[e["src"]], place[e["dst"]]) for e in edges if e["src"] != e["dst"]]
    xy = layout(len(nodes), links) * [width - 160, height - 140] + [80, 90]
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif"><rect width="{width}" height="{height}" fill="white"/>']
    out.append(f'<text x="20" y="34" font-size="22">{escape(title)}</text><text x="20" y="58" font-size="13" fill="#666">{escape(total)}</text>')
    if not nodes:
        out.append(f'<text x="{width // 2}" y="{height // 2}" font-size="18" text-anchor="middle">nothing to draw</text>')
    out += [f'<line x1="{xy[a][0]:.1f}" y1="{xy[a][1]:.1f}" x2="{xy[b][0]:.1f}" y2="{xy[b][1]:.1f}" stroke="#999" stroke-opacity="0.5"/>' for a, b in links]
    for n, (x, y) in zip(nodes, xy):
        r = 3 + min(14.0, n["degree"] ** 0.5)
        out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{r:.1f}" fill="{COLORS.get(n["label"], "#888")}"><title>{escape(n["id"])} ({n["degree"]})</title></circle><text x="{x + r + 2:.1f}" y="{y + 4:.1f}" font-size="10">{escape(n["title"] or "")}</text>')
    return "".join(out) + "</svg>"


def bars_svg(rows: list[tuple[str, int]], title: str, width: int = 1000) -> str:
    """Horizontal bars with their numbers."""
    height, most = 70 + 30 * len(rows), max([n for _, n in rows], default=1)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif"><rect width="{width}" height="{height}" fill="white"/><text x="20" y="34" font-size="20">{escape(title)}</text>']
    for i, (name, n) in enumerate(rows):
        y = 56 + 30 * i
        out.append(f'<text x="390" y="{y + 15}" font-size="12" text-anchor="end">{escape(name)}</text><rect x="400" y="{y}" width="{540 * n / most:.1f}" height="20" fill="#4c78a8"/><text x="{408 + 540 * n / most:.1f}" y="{y + 15}" font-size="12">{n}</text>')
    return "".join(out) + "</svg>"


_PAGE = """<!doctype html><meta charset="utf-8"><title>Code graph</title>
<style>body{font:14px sans-serif;margin:1.5em}svg{border:1px solid #ddd;width:100%%;height:75vh;cursor:grab}line{stroke:#999;stroke-opacity:.4}.off{opacity:.08}text{font-size:9px;pointer-events:none}table{border-collapse:collapse}td{padding:2px 10px;border-bottom:1px solid #ddd}label{margin-right:1em}</style>
<h1>Code graph</h1><p id="s"></p><p><span id="labels"></span> <input id="find" placeholder="find"></p><svg id="g" viewBox="0 0 1000 700"><g id="all"></g></svg><p id="info"></p>
<h2>Most connected</h2><table id="t"></table><h2>Most changed</h2><table id="h"></table>
<script id="data" type="application/json">%s</script>
<script>
const d = JSON.parse(document.getElementById('data').textContent), by = id => document.getElementById(id), NS = 'http://www.w3.org/2000/svg';
by('s').textContent = d.total.nodes + ' nodes, ' + d.total.edges + ' edges; drawn are the ' + d.nodes.length + ' most connected nodes and the ' + d.edges.length + ' edges between them';
const table = (id, rows) => { for (const r of rows) { const tr = by(id).insertRow(); for (const c of r) tr.insertCell().textContent = c; } };
table('t', d.top); table('h', d.hot);
const make = (tag, at, up) => { const e = document.createElementNS(NS, tag); for (const k in at) e.setAttribute(k, at[k]); up.appendChild(e); return e; };
const all = by('all'), place = new Map(d.nodes.map((n, i) => [n.id, i])), near = d.nodes.map(() => new Set());
const lines = d.edges.map(e => { const a = place.get(e.src), b = place.get(e.dst); near[a].add(b); near[b].add(a); const l = make('line', {}, all); l.ends = [a, b]; return l; });
const dots = d.nodes.map((n, i) => { const c = make('circle', {r: 2 + Math.min(12, Math.sqrt(n.degree)), fill: d.colors[n.label] || '#888'}, all); make('title', {}, c).textContent = n.id; c.index = i; c.name = make('text', {}, all); c.name.textContent = n.degree > d.named ? n.title : ''; return c; });
const put = () => { d.nodes.forEach((n, i) => { dots[i].setAttribute('cx', n.x); dots[i].setAttribute('cy', n.y); dots[i].name.setAttribute('x', n.x + 6); dots[i].name.setAttribute('y', n.y + 3); }); lines.forEach(l => { const [a, b] = l.ends.map(i => d.nodes[i]); l.setAttribute('x1', a.x); l.setAttribute('y1', a.y); l.setAttribute('x2', b.x); l.setAttribute('y2', b.y); }); };
put();
const shown = new Set(Object.keys(d.colors)), light = keep => { dots.forEach(c => { const on = shown.has(d.nodes[c.index].label) && keep(c.index); c.classList.toggle('off', !on); c.name.classList.toggle('off', !on); }); lines.forEach(l => l.classList.toggle('off', !l.ends.every(i => !dots[i].classList.contains('off')))); };
for (const k of shown) { const l = document.createElement('label'), c = document.createElement('input'); c.type = 'checkbox'; c.checked = true; c.onchange = () => { c.checked ? shown.add(k) : shown.delete(k); light(() => true); }; l.append(c, k); l.style.color = d.colors[k]; by('labels').append(l); }
by('find').oninput = e => light(i => d.nodes[i].id.toLowerCase().includes(e.target.value.toLowerCase()));
let view = [0, 0, 1000, 700], drag = null;
const svg = by('g'), look = () => svg.setAttribute('viewBox', view.join(' ')), scale = () => view[2] / svg.clientWidth;
svg.onwheel = e => { e.preventDefault(); const f = e.deltaY > 0 ? 1.15 : 1 / 1.15; view = [view[0] + view[2] * (1 - f) / 2, view[1] + view[3] * (1 - f) / 2, view[2] * f, view[3] * f]; look(); };
svg.onmousedown = e => { drag = e.target.index ?? -1; };
window.onmouseup = () => { drag = null; };
window.onmousemove = e => { if (drag === null) return; const x = e.movementX * scale(), y = e.movementY * scale(); if (drag >= 0) { d.nodes[drag].x += x; d.nodes[drag].y += y; put(); } else { view[0] -= x; view[1] -= y; look(); } };
svg.ondblclick = () => light(() => true);
svg.onclick = e => { const i = e.target.index; if (i === undefined) return; light(j => j === i || near[i].has(j)); const n = d.nodes[i]; by('info').textContent = n.label + ' ' + n.id + ', ' + n.degree + ' edges'; };
</script>"""


def render_html(graph: Graph, path: str, limit: int = 2000) -> list[str]:
    """graph.html: an interactive graph (drag, zoom, find, filter by label, neighbours on a click) with the data embedded. The
    `limit` most connected nodes are drawn and the page says so beside the whole graph's size; a larger limit draws more.
    Returns the files written."""
    nodes, edges = drawing(graph, limit)
    place = {n["id"]: i for i, n in enumerate(nodes)}
    xy = layout(len(nodes), [(place[e["src"]], place[e["dst"]]) for e in edges if e["src"] != e["dst"]]) * [960, 660] + 20
    for n, (x, y) in zip(nodes, xy):
        n |= {"x": round(float(x), 1), "y": round(float(y), 1)}
    size = {r["kind"]: r["n"] for r in counts(graph).where("name is null").collect()}  # the totals
    data = {"total": {"nodes": size.get("nodes", 0), "edges": size.get("edges", 0)}, "nodes": nodes, "edges": edges, "colors": COLORS, "named": nodes[min(60, len(nodes) - 1)]["degree"] if nodes else 0, "top": [[n["title"], n["label"], n["degree"]] for n in nodes[:12]], "hot": hotspots(graph)}
    return [_write(path, "graph.html", _PAGE % json.dumps(data, ensure_ascii=False).replace("</", "<\\/"))]


def hotspots(graph: Graph, top: int = 15) -> list[list]:
    """[id, changes] of the most changed nodes; a top list, so bounded."""
    return [[r["dst"], r["n"]] for r in graph.edges.where("type = 'MODIFIES' and dst is not null").groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(top).collect()]


def _write(path: str, name: str, text: str) -> str:
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return f"{path}/{name}"


def render_all(graph: Graph, path: str, limit: int = 2000, pictured: int = 80) -> list[str]:
    """graph.html, import_graph.svg (modules by IMPORTS), call_graph.svg (functions by CALLS, the `pictured` most connected each)
    and, if anything changed, hotspots.svg. Returns the files written."""
    files = render_html(graph, path, limit)
    for name, label, etype in (("import_graph", "Module", "IMPORTS"), ("call_graph", "Function", "CALLS")):
        nodes, edges = drawing(graph, pictured, label, etype)
        whole = f"{graph.nodes.where(F.col('label') == label).count()} nodes and {graph.edges.where(F.col('type') == etype).count()} edges in all, {len(nodes)} and {len(edges)} drawn"
        files.append(_write(path, f"{name}.svg", graph_svg(nodes, edges, f"{label}s by {etype}", whole)))
    if hot := hotspots(graph):
        files.append(_write(path, "hotspots.svg", bars_svg([(i.split("::")[-1], n) for i, n in hot], "Most changed")))
    return files
