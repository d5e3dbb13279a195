"""Functions paired with their documentation.

Source files are lexed into token rows (one per logical line, with its change of depth, and for headers the
name and signature, for strings the value). SQL windows do the rest: a cumulative sum gives each row's depth; a
lag window attaches a string to the header right above it; enclosing scopes are the last opening rows of
every smaller depth, found per (file, depth) island.

Only docstrings in Python's sense count: the first statement of the body, one plain string (or adjacent ones),
no f-string, no bytes. Files that do not parse, null and empty files yield nothing.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import unicodedata
import warnings
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

_TYPES = {"file_id": T.LongType(), "seq": T.IntegerType(), "delta": T.IntegerType(), "line": T.IntegerType()}
ROWS = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in ("file_id", "unit", "seq", "delta", "kind", "name", "signature", "doc", "line")])
_SKIP = {tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.ENDMARKER}


def _string(tokens: list) -> str | None:
    """The value of a statement that is nothing but a plain string."""
    if not tokens or not all(t.type == tokenize.STRING or t.string in "()" for t in tokens) or not any(t.type == tokenize.STRING for t in tokens):
        return None
    try:
        value = ast.literal_eval("(" + "\n".join(t.string for t in tokens) + "\n)")
    except Exception:
        return None
    return value if isinstance(value, str) else None


def _header(tokens: list) -> tuple[str, str, str, list] | None:
    """(kind, name, signature, rest of the line) of a def or class line."""
    i = 1 if tokens[0].string == "async" and len(tokens) > 1 else 0
    if tokens[i].type != tokenize.NAME or tokens[i].string not in ("def", "class") or len(tokens) < i + 3:
        return None
    depth = 0
    for j in range(i + 2, len(tokens)):
        s = tokens[j].string
        if tokens[j].type == tokenize.OP:
            depth += (s in "([{") - (s in ")]}")
            if s == ":" and depth == 0:
                inner = tokens[i + 2 : j]
                out = ""
                for k, t in enumerate(inner):
                    gap = k and (t.start[0] != inner[k - 1].end[0] and t.string not in ")]}" and inner[k - 1].string not in "([{" or t.start[0] == inner[k - 1].end[0] and t.start[1] > inner[k - 1].end[1])
                    out += " " * bool(gap) + t.string
                return tokens[i].string, tokens[i + 1].string, out, tokens[j + 1 :]
    return None


def lex(source: str | None) -> list[tuple]:
    """(delta, kind, name, signature, doc, line) per logical line; nothing for what does not parse."""
    if not source or not source.strip():
        return []
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
            stream = list(tokenize.generate_tokens(io.StringIO(source).readline))
    except Exception:  # syntax, indentation, null bytes, depth: the file does not parse
        return []
    rows, line, delta, owed = [], [], 0, 0

    def close(tokens: list) -> None:
        nonlocal delta, owed
        head = _header(tokens)
        first = tokens[0].start[0]
        if head:
            kind, name, signature, rest = head
            rows.append((delta + owed, kind, name, signature, None, first))
            owed = 0
            if rest:  # the body stands on the header's line
                body = rest[: next((i for i, t in enumerate(rest) if t.string == ";"), len(rest))]
                doc = _string(body)
                rows.append((1, "string" if doc is not None else "line", None, None, doc, first))
                owed = -1
        else:
            body = tokens[: next((i for i, t in enumerate(tokens) if t.string == ";"), len(tokens))]
            doc = _string(body)
            rows.append((delta + owed, "string" if doc is not None else "line", None, None, doc, first))
            owed = 0
        delta = 0

    for t in stream:
        if t.type == tokenize.INDENT:
            delta += 1
        elif t.type == tokenize.DEDENT:
            delta -= 1
        elif t.type == tokenize.NEWLINE:
            if line:
                close(line)
            line = []
        elif t.type not in _SKIP:
            line.append(t)
    if line:
        close(line)
    return rows


def token_rows(files: DataFrame) -> DataFrame:
    """The token rows of every distinct (file_id, text)."""
    distinct = files.where("file_id is not null and source_text is not null and source_text <> ''").select(F.col("file_id").cast("long").alias("file_id"), "source_text").distinct()

    def run(batches):
        for pdf in batches:
            out = [(f, u, i, *r) for f, u, s in zip(pdf["file_id"].tolist(), pdf["unit"].tolist(), pdf["source_text"]) for i, r in enumerate(lex(s))]
            yield pd.DataFrame(out, columns=ROWS.names)

    return distinct.withColumn("unit", F.md5("source_text")).mapInPandas(run, ROWS)


def documented_functions(files: DataFrame) -> DataFrame:
    """(file_id, qualname, signature, docstring, line) of every function and method that has a docstring."""
    unit = ["file_id", "unit"]
    w = Window.partitionBy(*unit).orderBy("seq")
    rows = token_rows(files).withColumn("depth", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    above = F.lag(F.struct("kind", "name", "signature", "seq", "depth", "line")).over(w)
    opens = (F.lead("depth").over(w) > F.col("depth")).alias("opens")
    marked = rows.select(*unit, "seq", "depth", "kind", "name", "doc", above.alias("above"), opens)
    # Three branches read these rows, so the files are lexed once and the rows that matter are kept.
    marked = stored(marked.where("opens or kind = 'string' and above.kind = 'def'"), "docpairs-rows")
    docs = marked.where("kind = 'string' and above.kind = 'def' and depth = above.depth + 1").select(*unit, F.col("above.seq").alias("seq"), F.col("above.depth").alias("depth"), F.col("above.name").alias("name"), F.col("above.signature").alias("signature"), F.col("above.line").alias("line"), F.col("doc").alias("docstring"))
    # Probes ask, for each smaller depth, for the last row there that opens a block: the enclosing statement.
    both = marked.where("opens").select(*unit, "depth", "seq", F.lit(None).cast("int").alias("asks"), F.struct("kind", "name").alias("scope"))
    probe = marked.where("kind = 'string' and above.kind = 'def' and depth = above.depth + 1 and above.depth > 0").select(*unit, F.explode(F.expr("sequence(0L, above.depth - 1)")).alias("depth"), F.col("above.seq").alias("seq"), F.col("above.seq").alias("asks"), F.lit(None).cast("struct<kind:string,name:string>").alias("scope"))
    island = Window.partitionBy(*unit, "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(probe).withColumn("scope", F.last("scope", ignorenulls=True).over(island)).where("asks is not null and scope.kind in ('def', 'class')")
    chain = found.groupBy(*unit, F.col("asks").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("depth", "scope.name"))).alias("chain"))
    out = docs.join(chain, [*unit, "seq"], "left")
    qualname = F.concat_ws(".", F.transform(F.coalesce("chain", F.array().cast("array<struct<depth:bigint,name:string>>")), lambda x: x["name"]), F.array("name"))
    return out.select("file_id", qualname.alias("qualname"), "signature", "docstring", "line")


# Whole docstrings that only stand in for one, without case and marks.
PLACEHOLDERS = {
    "todo", "tbd", "tba", "tbc", "fixme", "wip", "xxx", "n a", "na", "none", "nil", "null", "empty", "docstring", "doc", "docs", "doc missing", "missing", "missing doc", "missing docs", "missing docstring", "no doc", "no docs", "no docstring", "no description", "no documentation", "undocumented", "not documented", "documentation", "description", "summary", "placeholder", "see above", "see below", "see code", "to be written", "to be done", "to be documented", "to be filled", "to do", "work in progress", "write me", "fill me in", "fill in", "add docs", "add docstring", "coming soon", "self explanatory", "function", "method", "function docstring", "method docstring", "short description", "one line summary", "lorem ipsum", "stub", "foo", "blah", "test",
    "待补充", "暂无说明", "暂无", "无", "待定", "待写", "待完善", "待办", "无说明", "文档字符串", "说明", "占位", "占位符", "同上", "见上", "见上文", "略", "暂无文档", "无文档", "未完成", "待续", "todo 待补充",
    "siehe oben", "folgt", "noch zu schreiben", "kommt noch", "beschreibung", "platzhalter", "keine beschreibung", "offen",
}
# Words that may follow a mark such as TODO without saying anything.
_EMPTY_WORDS = {"document", "documentation", "docs", "doc", "docstring", "describe", "description", "write", "add", "fill", "in", "out", "me", "this", "it", "the", "a", "here", "later", "function", "method", "class", "to", "be", "written", "done", "finish", "complete", "explain"}
_MARK = {"todo", "fixme", "tbd", "xxx", "wip"}
# Headings of fields.
_FIELDS = "args arguments parameters params returns return yields yield raises raise attributes keyword kwargs other notes note examples example see also warnings rückgabe parameter 参数 返回 返回值 异常".split()
_TAG = re.compile(r"^\s*[:@]\s*\w+[^:]*:?\s*$")
_RULE = re.compile(r"^\s*[-=~*_]{2,}\s*$")
_EMPTY_ITEM = re.compile(r"^\s*[*-]?\s*[`*]*\w+[`]*\s*(\([^)]*\))?\s*(:|：|--|-)\s*$")
_FORMAT = regex.compile(r"\p{Cf}")
_FILLERS = {"the", "a", "an", "this", "that", "function", "method", "for", "of", "to", "and", "it", "implementation", "helper", "implements", "calls", "call"}


_HUMP, _WORD = re.compile(r"(?<=[a-z0-9])(?=[A-Z][a-z])"), re.compile(r"[^\W_]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(_HUMP.sub(" ", text).lower())


@lru_cache(50_000)
def _stem(word: str) -> str:
    for end, back in (("ies", "y"), ("ing", ""), ("es", ""), ("ed", ""), ("s", ""), ("e", "")):
        if word.endswith(end) and len(word) > len(end) + 2:
            word = word[: -len(end)] + back
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def is_trivial(docstring: str | None, qualname: str | None) -> bool:
    """No useful documentation: blank, a bare placeholder, the function's own name, empty field tags, or these together."""
    if docstring is None:
        return True
    text = docstring if docstring.isascii() else _FORMAT.sub("", unicodedata.normalize("NFKC", docstring))
    kept = []
    for row in text.splitlines():
        bare = row.strip()
        if not bare:
            continue
        begin = _WORD.search(bare)
        field = _words(bare) if begin and _words(begin[0])[0] in _FIELDS else []
        if _RULE.match(row) or bare.startswith((":", "@")) and _TAG.match(row) or _EMPTY_ITEM.match(row):
            continue
        if field and bare[-1:] in ":：" and all(w in _FIELDS for w in field) or len(field) == 1 and field[0] in _FIELDS:
            continue
        kept.append(bare)
    rest = " ".join(kept).strip()
    words = _words(rest)
    if not words:
        return True
    if " ".join(words) in PLACEHOLDERS or words[0] in _MARK and all(w in _EMPTY_WORDS or w in _MARK for w in words):
        return True
    own = [w for part in (qualname or "").split(".") for w in _words(part.replace("_", " "))]
    last = _words((qualname or "").rsplit(".", 1)[-1].replace("_", " "))
    if not last:
        return False
    said = [_stem(w) for w in words if w not in _FILLERS] or [_stem(w) for w in words]
    names = [own, last, [w for w in last if not re.search(r"\d", w)]]
    return any(n and said in ([_stem(w) for w in n], [_stem(w) for w in n if w not in _FILLERS]) for n in names) or "".join(words) == "".join(last)


@F.pandas_udf(T.BooleanType())
def _trivial(docstrings: pd.Series, qualnames: pd.Series) -> pd.Series:
    return pd.Series([is_trivial(d, q) for d, q in zip(docstrings, qualnames)], dtype=bool)


def code_description_pairs(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(file_id, qualname, signature, docstring) of the functions and methods with useful documentation, from lexed
    files and from kept facts, repeated rows once."""
    cols = ["file_id", "qualname", "signature", "docstring"]
    known = facts.where("file_id is not null and qualname is not null and docstring is not null").select(F.col("file_id").cast("long").alias("file_id"), *cols[1:]).distinct()
    pairs = documented_functions(files).select(*cols).distinct().unionByName(known)
    return pairs.where(F.length(F.trim("docstring")) > 0).where(~_trivial("docstring", "qualname"))
