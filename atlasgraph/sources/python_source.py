"""Python sources to facts: modules, classes, functions with spans, signatures, decorators, complexity, calls, imports."""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..session import stored

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


CALL = _struct(seq=_I, line=_I, kind=_S, a=_S, b=_S)
FUNCTION = _struct(qualname=_S, span_start=_I, span_end=_I, signature=_S, is_async=_B, is_method=_B, docstring=_S, decorators=T.ArrayType(_S), arguments=T.ArrayType(_S), cyclomatic=_I, calls=T.ArrayType(CALL))
CLASS = _struct(qualname=_S, span_start=_I, span_end=_I, docstring=_S, bases=T.ArrayType(_S))
IMPORT = _struct(seq=_I, alias=_S, target=_S, symbol=_S, full=_S)
FACTS = _struct(loc=_I, docstring=_S, package=_S, classes=T.ArrayType(CLASS), functions=T.ArrayType(FUNCTION), imports=T.ArrayType(IMPORT))

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_DEFS, ast.ClassDef)


def _branches(node: ast.AST) -> int:
    """What a node adds to the complexity."""
    match node:
        case ast.If() | ast.For() | ast.AsyncFor() | ast.While() | ast.ExceptHandler() | ast.IfExp() | ast.match_case():
            return 1
        case ast.BoolOp(values=v):
            return len(v) - 1
        case ast.comprehension(ifs=i):
            return len(i)
    return 0


def cyclomatic(function: ast.AST) -> int:
    """1 plus the decision points of the body; nested functions and classes count for themselves."""
    total, todo = 1, list(function.body)
    for node in todo:  # grows while it is read
        total += _branches(node)
        if not isinstance(node, _SCOPES):
            todo += ast.iter_child_nodes(node)
    return total


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


def _shape(call: ast.Call) -> tuple[str, str, str | None]:
    match call.func:
        case ast.Name(id=name):
            return "name", name, None
        case ast.Attribute(value=ast.Name(id="self" | "cls"), attr=attr):
            return "self", attr, None
        case ast.Attribute(value=ast.Name(id=base), attr=attr):
            return "attr", base, attr
        case other:
            return "other", ast.unparse(other)[:80], None


def _decorator(d: ast.expr) -> tuple[str, str | None]:
    match d:
        case ast.Call(func=f, args=[ast.Constant(value=str(text)), *_]):
            return ast.unparse(f), text
        case ast.Call(func=f):
            return ast.unparse(f), None
    return ast.unparse(d), None


def module_facts(source: str | None, dotted: str, is_package: bool) -> dict | None:
    """Facts of one module, None where the source doesn't parse (or is null)."""
    if source is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except Exception:  # syntax, null bytes, nesting
        return None
    package = dotted.rpartition(".")[0]
    here = dotted if is_package else package
    classes, functions, imports = [], [], []

    def above(level: int, module: str | None) -> str:
        if not level:
            return module or ""
        parts = here.split(".") if here else []
        parts = parts[: max(0, len(parts) - (level - 1))]
        return ".".join([*parts, *([module] if module else [])])

    def take_import(node: ast.AST) -> None:
        for n in node.names:
            if isinstance(node, ast.Import):
                top = n.name.split(".")[0]
                imports.append({"alias": n.asname or top, "target": n.name if n.asname else top, "symbol": None, "full": n.name})
            elif n.name != "*":
                imports.append({"alias": n.asname or n.name, "target": above(node.level, node.module), "symbol": n.name, "full": None})

    def visit(node: ast.AST, path: tuple[str, ...], in_class: bool, owner: dict | None) -> None:
        if isinstance(node, ast.ClassDef):
            classes.append({"qualname": ".".join([*path, node.name]), "span_start": _first_line(node), "span_end": node.end_lineno, "docstring": ast.get_docstring(node), "bases": [ast.unparse(b) for b in node.bases]})
            for child in node.body:
                visit(child, (*path, node.name), True, owner)
        elif isinstance(node, _DEFS):
            marks = [_decorator(d) for d in node.decorator_list]
            returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            asynchronous = isinstance(node, ast.AsyncFunctionDef)
            fact = {
                "qualname": ".".join([*path, node.name]), "span_start": _first_line(node), "span_end": node.end_lineno, "signature": f"{'async ' * asynchronous}{node.name}({ast.unparse(node.args)}){returns}",
                "is_async": asynchronous, "is_method": in_class, "docstring": ast.get_docstring(node), "decorators": [m[0] for m in marks], "arguments": [m[1] for m in marks], "cyclomatic": cyclomatic(node), "calls": [],
            }
            functions.append(fact)
            for child in node.body:  # decorators and defaults belong to the definition, not to the body
                visit(child, (*path, node.name), False, fact)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            take_import(node)
        else:
            if isinstance(node, ast.Call) and owner is not None:
                kind, a, b = _shape(node)
                owner["calls"].append({"seq": len(owner["calls"]), "line": node.lineno, "kind": kind, "a": a, "b": b})
            for child in ast.iter_child_nodes(node):
                visit(child, path, in_class, owner)

    try:
        for statement in tree.body:
            visit(statement, (), False, None)
    except RecursionError:
        return None
    for i, x in enumerate(imports):
        x["seq"] = i
    return {"loc": len(source.splitlines()), "docstring": ast.get_docstring(tree), "package": package, "classes": classes, "functions": functions, "imports": imports}


def parse_sources(files: DataFrame, roots: tuple[str, ...] = ("src",), keys: tuple[str, ...] = ("repo", "relpath"), source: str = "source_text") -> DataFrame:
    """files' keys plus module (dotted), parsed and facts; a file that doesn't parse has null facts.

    The parser runs once per file over Arrow batches; facts leave as nested Arrow values.
    """
    from ..functions.text import dotted_module

    path = F.regexp_replace("relpath", r"\\", "/")
    named = files.select(*[F.col(k) for k in keys], dotted_module(path, roots).alias("module"), path.endswith("__init__.py").alias("_package"), F.col(source).alias("_source"))
    shape = T.StructType([named.schema[k] for k in keys] + [T.StructField("module", _S), T.StructField("parsed", _B), T.StructField("facts", FACTS)])
    kept = len(keys)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(FACTS)
        for batch in batches:
            modules, packages, texts = (batch.column(kept + i).to_pylist() for i in range(3))
            facts = [module_facts(t, m or "", bool(p)) for m, p, t in zip(modules, packages, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: kept + 1], pa.array([f is not None for f in facts]), pa.array(facts, kind)], shape.names)

    return named.mapInArrow(run, shape)


def read_worktree(spark: SparkSession, root: str, repo: str, settings: Settings = Settings()) -> DataFrame:
    """(repo, relpath, source_text) of the .py files below root, without excluded folders; text that isn't UTF-8 is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.regexp_replace("path", r"^file:/+", "/"), base, -1)
    folders = F.slice(F.split("relpath", "/"), F.lit(1), F.size(F.split("relpath", "/")) - 1)
    found = files.select(F.lit(repo).alias("repo"), rel.alias("relpath"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("source_text"))
    return found.where(~F.arrays_overlap(folders, F.array(*map(F.lit, settings.exclude_dirs))))


def function_facts(parsed: DataFrame) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("facts", "parsed")]
    return parsed.where("parsed").select(*rest, F.explode("facts.functions").alias("f")).select(*rest, "f.*")


def complexity(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, cyclomatic) of functions (id) that are defined in files (repo, relpath, source_text), and perhaps of others in the same
    files; files in which none of them can be aren't parsed. A name defined twice in a file has the complexity of its last definition."""
    from ..operators.orphans import norm_ref

    # A function's id is its file's place and its qualname, which holds no '::'.
    places = functions.select(F.expr("left(id, length(id) - length(substring_index(id, '::', -1)))").alias("place")).distinct()
    held = files.select("repo", "relpath", norm_ref(F.concat_ws("::", "repo", "relpath", F.lit(""))).alias("place")).join(places, "place", "left_semi").select("repo", "relpath")
    held = stored(held, "complexity-files")  # its size tells whether texts must be shuffled to meet it
    facts = function_facts(parse_sources(files.join(held, ["repo", "relpath"], "left_semi")))
    named = facts.select(norm_ref(F.concat_ws("::", "repo", "relpath", "qualname")).alias("id"), "span_start", "cyclomatic")
    return named.groupBy("id").agg(F.max_by("cyclomatic", "span_start").alias("cyclomatic"))


def class_facts(parsed: DataFrame) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("facts", "parsed")]
    return parsed.where("parsed").select(*rest, F.explode("facts.classes").alias("c")).select(*rest, "c.*")


def import_facts(parsed: DataFrame) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("facts", "parsed")]
    return parsed.where("parsed").select(*rest, F.explode("facts.imports").alias("i")).select(*rest, "i.*")


def call_sites(functions: DataFrame) -> DataFrame:
    """(repo, module, caller, seq, line, kind, a, b)."""
    return functions.select("repo", "module", F.col("qualname").alias("caller"), F.explode("calls").alias("c")).select("repo", "module", "caller", "c.*")


def spans(functions: DataFrame, key: str) -> DataFrame:
    """(key, qualname, span_start, span_end): the first definition of a qualname counts."""
    return functions.groupBy(key, "qualname").agg(F.min(F.struct("span_start", "span_end")).alias("s")).select(key, "qualname", "s.span_start", "s.span_end")
