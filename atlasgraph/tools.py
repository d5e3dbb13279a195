"""The tool server: JSON-RPC over standard input and output, with three tools over one loaded graph.

Errors of a tool are results (isError), not protocol errors; ambiguous and unknown symbols are successful answers.
"""

from __future__ import annotations

import json
import sys
from typing import Any, Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.graph import Graph
from .operators.impact import impact_analysis

PROTOCOL = "2024-11-05"
TOOLS = [
    {"name": "ask_repo", "description": "Context from the code graph for a question.", "inputSchema": {"type": "object", "properties": {"question": {"type": "string"}}, "required": ["question"]}},
    {"name": "impact_analysis", "description": "Who is affected by a change of a function.", "inputSchema": {"type": "object", "properties": {"symbol": {"type": "string"}, "depth": {"type": "integer", "default": 2}, "mode": {"type": "string", "enum": ["calls", "imports"], "default": "calls"}}, "required": ["symbol"]}},
    {"name": "repo_overview", "description": "The repository at a glance.", "inputSchema": {"type": "object", "properties": {}}},
]


class ToolError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def plain(value: Any) -> Any:
    """Rows and arrays as JSON values."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool, dict)) else str(value)


class Tools:
    """The tools over a graph that is loaded at first use."""

    def __init__(self, spark: SparkSession, load: Callable[[], Graph]):
        self.spark, self._load, self._graph, self._index = spark, load, None, None

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            try:
                self._graph = self._load()
            except Exception as e:
                raise ToolError("graph_unavailable", str(e)[:300]) from e
        return self._graph

    def ask_repo(self, question: str) -> dict:
        from .operators.bm25 import build_index, node_documents
        from .operators.pipeline import build_context

        if not isinstance(question, str) or not question.strip():
            raise ToolError("invalid_arguments", "question must be a text")
        g = self.graph
        nodes = g.nodes
        docs = node_documents(nodes).select("id", "text")
        if "text" not in nodes.columns:
            have = [F.col(c) for c in ("docstring", "message", "description") if c in nodes.columns]
            nodes = nodes.withColumn("text", F.coalesce(*have, F.lit(None).cast("string")))
        if self._index is None:  # of the loaded graph, for all questions
            self._index = build_index(docs)
        row = build_context(Graph(nodes, g.edges), docs, self.spark.createDataFrame([("q", question)], "qid string, question string"), index=self._index).first()
        return plain(row)

    def impact_analysis(self, symbol: str, depth: int = 2, mode: str = "calls") -> dict:
        if not isinstance(symbol, str) or not symbol:
            raise ToolError("invalid_arguments", "symbol must be a text")
        try:
            return plain(impact_analysis(self.graph, symbol, depth, mode)) | {}
        except ValueError as e:
            raise ToolError("invalid_argument", str(e)) from e

    def repo_overview(self) -> dict:
        from .operators.context import repo_card

        return plain(repo_card(self.graph).first())

    def call(self, name: str, arguments: Any) -> dict:
        """{content, structuredContent[, isError]} of a tool call."""
        try:
            if name not in {t["name"] for t in TOOLS}:
                raise ToolError("unknown_tool", str(name))
            if not isinstance(arguments, dict):
                raise ToolError("invalid_arguments", "arguments must be an object")
            known = next(t for t in TOOLS if t["name"] == name)["inputSchema"]
            if set(arguments) - set(known["properties"]) or set(known.get("required", [])) - set(arguments):
                raise ToolError("invalid_arguments", f"{name} takes {sorted(known['properties'])}")
            result, bad = getattr(self, name)(**arguments), False
        except ToolError as e:
            result, bad = {"error": e.kind, "message": str(e)}, True
        except Exception as e:  # whatever a tool meets is told to the caller
            result, bad = {"error": "tool_error", "message": str(e)[:300]}, True
        out = {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False)}], "structuredContent": result}
        return out | ({"isError": True} if bad else {})

    def handle(self, message: Any) -> dict | None:
        """The answer to one message; None for a notification. What is no request at all (no object, no method) is told so."""
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            known = message.get("id") if isinstance(message, dict) else None
            return {"jsonrpc": "2.0", "id": known, "error": {"code": -32600, "message": "no request"}}
        if "id" not in message:
            return None
        params = message.get("params") or {}
        if not isinstance(params, dict):
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32602, "message": "params must be an object"}}
        match message.get("method"):
            case "initialize":
                result: dict = {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "atlasgraph", "version": "1"}}
            case "ping":
                result = {}
            case "tools/list":
                result = {"tools": TOOLS}
            case "tools/call":
                result = self.call(params.get("name"), params.get("arguments", {}))
            case other:
                return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {other}"}}
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(tools: Tools, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = tools.handle(json.loads(line))
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if answer is not None:
            print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)
