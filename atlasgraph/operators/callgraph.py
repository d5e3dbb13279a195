"""Call resolution over extracted facts: names, attributes and self calls to functions, imports to modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_calls(calls: DataFrame, order: list[str]) -> DataFrame:
    """(src, dst, count, call_sites): calls of a pair merged, their lines in the order of visit."""
    sites = F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"])
    return calls.groupBy("src", "dst").agg(F.count("*").alias("count"), sites.alias("call_sites"))


def prefixes(name: Column, drop_last: bool = False) -> Column:
    """All dotted prefixes of a name, longest last; without the whole name if drop_last."""
    parts = F.split(name, r"\.")
    n = F.size(parts) - (1 if drop_last else 0)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def owning_class(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(module, qualname, owner): the class with the longest qualname that is a dotted prefix of the function's.

    functions and classes have module and qualname; prefixes are exploded, so the join is on equality.
    """
    probe = functions.select("module", "qualname", F.explode(prefixes(F.col("qualname"), True)).alias("prefix"))
    c = classes.select("module", F.col("qualname").alias("prefix")).distinct()
    return probe.join(c, ["module", "prefix"]).groupBy("module", "qualname").agg(F.max_by("prefix", F.length("prefix")).alias("owner"))


def resolve_calls(sites: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, from_imports: DataFrame) -> DataFrame:
    """Call sites plus target_module and target (null where a call doesn't resolve).

    sites      (module, caller, seq, line, kind, a, b), kind name|attr|self|other
    functions  (module, qualname); classes (module, qualname, bases array); imports (module, alias, target);
    from_imports (module, alias, target, symbol)

    name a    the module's own top-level function a, else what `from m import a` brings if it is a top-level function
    attr a.b  if a is an imported module: its function b, and nothing else; else the method b of the local class a
    self b    the method b of the caller's class, else of its bases, one level, in their order, the first that has it
    """
    f = functions.select("module", "qualname").distinct()
    top = f.where("qualname not like '%.%'")
    names = sites.where("kind = 'name'")
    own = top.select("module", F.col("qualname").alias("a"), F.lit(1).alias("own"))
    brought = from_imports.join(top.select(F.col("module").alias("target"), F.col("qualname").alias("symbol")), ["target", "symbol"]).groupBy("module", F.col("alias").alias("a")).agg(F.min(F.struct("target", "symbol")).alias("got"))
    r1 = names.join(own, ["module", "a"], "left").join(brought, ["module", "a"], "left").select(*sites.columns, F.when(F.col("own") == 1, F.col("module")).otherwise(F.col("got.target")).alias("target_module"), F.when(F.col("own") == 1, F.col("a")).otherwise(F.col("got.symbol")).alias("target"))

    attrs = sites.where("kind = 'attr'")
    alias = imports.groupBy("module", F.col("alias").alias("a")).agg(F.min("target").alias("m"))
    there = top.select(F.col("module").alias("m"), F.col("qualname").alias("b"), F.lit(1).alias("there"))
    methods = f.select("module", F.col("qualname").alias("q"), F.lit(1).alias("method"))
    local = classes.select("module", F.col("qualname").alias("a"), F.lit(1).alias("local")).distinct()
    j = attrs.withColumn("q", F.concat_ws(".", "a", "b")).join(alias, ["module", "a"], "left").join(there, ["m", "b"], "left").join(local, ["module", "a"], "left").join(methods, ["module", "q"], "left")
    through = F.col("m").isNotNull()
    inside = ~through & (F.col("local") == 1) & (F.col("method") == 1)
    r2 = j.select(*sites.columns, F.when(through & (F.col("there") == 1), F.col("m")).when(inside, F.col("module")).alias("target_module"), F.when(through & (F.col("there") == 1), F.col("b")).when(inside, F.col("q")).alias("target"))

    selfs = sites.where("kind = 'self'")
    owner = owning_class(selfs.select("module", F.col("caller").alias("qualname")).distinct(), classes).withColumnRenamed("qualname", "caller")
    s = selfs.join(owner, ["module", "caller"], "left")
    bases = classes.select("module", F.col("qualname").alias("owner"), F.posexplode_outer("bases").alias("pos", "base"))
    # A base is a local class or one that a from-import brings.
    known = classes.select(F.col("module").alias("bm"), F.col("qualname").alias("bq")).distinct()
    here = bases.join(known, (F.col("module") == F.col("bm")) & (F.col("base") == F.col("bq"))).select("module", "owner", "pos", "bm", "bq")
    away = bases.join(from_imports.select("module", F.col("alias").alias("base"), F.col("target").alias("bm"), F.col("symbol").alias("bq")), ["module", "base"]).join(known, ["bm", "bq"]).select("module", "owner", "pos", "bm", "bq")
    line = here.unionByName(away).unionByName(classes.select("module", F.col("qualname").alias("owner"), F.lit(-1).alias("pos"), F.col("module").alias("bm"), F.col("qualname").alias("bq")))
    heirs = line.join(f.select(F.col("module").alias("bm"), F.col("qualname").alias("mq")), "bm").where(F.col("mq").startswith(F.concat("bq", F.lit(".")))).withColumn("b", F.expr("substring(mq, length(bq) + 2)")).where("b not like '%.%'")
    first = heirs.groupBy("module", "owner", "b").agg(F.min_by(F.struct("bm", "mq"), "pos").alias("hit"))
    # the called name of a self call stands in a
    r3 = s.join(first.withColumnRenamed("b", "a"), ["module", "owner", "a"], "left").select(*sites.columns, F.col("hit.bm").alias("target_module"), F.col("hit.mq").alias("target"))
    none = sites.where("kind not in ('name', 'attr', 'self')").withColumn("target_module", F.lit(None).cast("string")).withColumn("target", F.lit(None).cast("string"))
    return r1.unionByName(r2).unionByName(r3).unionByName(none)


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, target, names): imports within the repository, by the longest prefix that is a module; no self loops.

    imports has module, seq, target (dotted) and symbol (null for a plain import); modules has module. `from p import m` is an
    import of the module p.m if that exists, else of the symbol m from p. Names are distinct, in order; a plain
    import counts as '*module*'.
    """
    known = modules.select("module").distinct()
    full = F.when(F.col("symbol").isNotNull(), F.concat_ws(".", "target", "symbol")).otherwise(F.col("target"))
    probe = imports.withColumn("key", F.monotonically_increasing_id() if "seq" not in imports.columns else F.struct("module", "seq")).withColumn("full", full).select("key", "module", "target", "symbol", "full", F.explode(prefixes(F.col("full"))).alias("prefix"))
    hit = probe.join(known.withColumnRenamed("module", "prefix"), "prefix").groupBy("key", "module", "target", "symbol", "full").agg(F.max_by("prefix", F.length("prefix")).alias("to"))
    # A symbol import must reach its own module at least.
    hit = hit.where("symbol is null or length(to) >= length(target)").where("to <> module")
    name = F.when(F.col("symbol").isNull() | (F.col("to") == F.col("full")), F.lit("*module*")).otherwise(F.col("symbol"))
    return hit.withColumn("name", name).groupBy("module", F.col("to").alias("target")).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("key", "name"))), lambda s: s["name"])).alias("names"))


def external_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, target) of imports that are neither a module of the repository nor a package above one."""
    inside = modules.select(F.explode(prefixes(F.col("module"))).alias("target")).distinct()
    return imports.where("target is not null").select("module", "target").distinct().join(inside, "target", "left_anti").select("module", "target")


def lines_in_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(blob, line, qualname): changed lines by the functions that hold them; a line in nested spans counts for each.

    The equi-key is the blob; a blob's spans are few, so the interval is checked within the hash join.
    """
    s = spans.select(F.col("blob").alias("b"), "qualname", "span_start", "span_end")
    return lines.join(s, (F.col("blob") == F.col("b")) & F.col("line").between(F.col("span_start"), F.col("span_end"))).drop("b")
