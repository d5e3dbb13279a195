"""Routing of questions by an ordered rule table, premises and their check against the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grams, half_width, has_code_token, tech_terms
from ..session import stored

# Words of the rules.
_KNOW = "(?:知道|了解|理解|认识|熟悉|清楚|晓得|明白|懂得|读得?懂|看得?懂|懂)"
_REPO = "(?:代码库|带码库|代码仓库|代码仓|仓库|项目|工程|repo|codebase|代码)"
_GAP = "[^，。？！,.?!、；;：:]{0,4}"
_GLOBAL = r"整体|总体|全局|架构|结构|介绍|讲讲|说说|是(?:干|做)(?:什么|嘛|啥)|干啥|干什么的|质量|难点|亮点|风格|规模|多大|总览|概览|概述|(?:这|这个|该|本|你们的?|整个|我的|我这|咱们?的?)\s*(?:项目|仓库|工程|代码库)"
PRONOUN = "(它|这个|这块|那块|那个|(?<!应)该|上面|上文|前面|刚才|之前那|上述)"
META_WORDS = "了解 熟悉 认识 介绍 简介 概览 概述 总览 整体 整个项目 整个代码 项目架构 项目结构 代码库 这个项目 这项目 这个仓库 这仓库 架构 什么项目 干什么的 是做什么 做什么的 有哪些模块 整个仓库".split()


@dataclass(frozen=True)
class Rule:
    id: str
    label: str
    pattern: str | None = None
    needs: tuple[str, ...] = ()


#: The rule table as data; the first rule whose signals and pattern hold decides.
RULES = (
    Rule("meta-1", "meta", f"{_KNOW}{_GAP}{_REPO}|{_REPO}{_GAP}{_KNOW}"),
    Rule("meta-2", "meta", "你(是谁|是什么(?:东西)?|能(?:干|做|帮)|会(?:干|做)|有(?:什么|哪些)(?:功能|能力|用))|怎么用你|帮我?看(?:一?下)?(?:代码|仓库|项目|工程)"),
    Rule("struct-1", "structural", r"(最|前\s*\d+|多少|几个|统计|列出(?:所有|全部)?|排(?:序|名)|总共有)", ("has_code_token",)),
    Rule("entity-1", "entity_local", None, ("has_code_token",)),
    Rule("global-1", "global", _GLOBAL, ("no_code_token", "no_linker_hit")),
    Rule("oos-1", "out_of_scope", "(是什么意思|什么是)", ("no_repo_reference",)),
)
FALLBACK = "entity_local"


def with_signals(questions: DataFrame, question: str = "question") -> DataFrame:
    """questions (with linked and topic_hits, numbers of hits) plus the rules' signals; null questions are empty ones."""
    q = half_width(F.col(question))
    out = questions.withColumn("norm", q).withColumn("has_code_token", has_code_token(F.col("norm")))
    out = out.withColumn("no_code_token", ~F.col("has_code_token")).withColumn("no_linker_hit", F.col("linked") == 0)
    quiet = ~F.col("norm").rlike(PRONOUN) & ~F.contains(F.col("norm"), F.lit("`"))
    return out.withColumn("no_repo_reference", F.col("no_linker_hit") & (F.col("topic_hits") == 0) & quiet)


def route(signals: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """signals plus route_label and route_source (rule:<id>, or fallback:default)."""

    def pick(value) -> Column:
        out = None
        for r in rules:
            hit = F.lit(True)
            for n in r.needs:
                hit = hit & F.col(n)
            if r.pattern:
                hit = hit & F.col("norm").rlike(r.pattern)
            out = F.when(hit, value(r)) if out is None else out.when(hit, value(r))
        return out

    return signals.withColumn("route_label", F.coalesce(pick(lambda r: F.lit(r.label)), F.lit(FALLBACK))).withColumn("route_source", F.coalesce(pick(lambda r: F.lit(f"rule:{r.id}")), F.lit("fallback:default")))


def is_meta_question(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("|".join(META_WORDS))


def lexical_premises(questions: DataFrame, question: str = "question", key: str = "id") -> DataFrame:
    """(key, claim, terms, source): a named technology is the premise that it is in use."""
    hits = questions.select(key, F.explode(tech_terms(half_width(F.col(question)))).alias("t"))
    return hits.select(key, F.concat(F.lit("使用 "), F.col("t.shown")).alias("claim"), F.array("t.term").alias("terms"), F.lit("lexical:tech_term").alias("source"))


def claim_terms(claim: Column) -> Column:
    """What of a stated claim can be checked: technologies, identifiers, numbers with a unit; distinct, two characters or more."""
    s = F.trim(F.coalesce(claim, F.lit("")))
    tech = F.transform(tech_terms(s), lambda t: t["term"])
    names = F.regexp_extract_all(s, F.lit("([A-Za-z][A-Za-z0-9_]{1,})"), F.lit(1))
    counted = F.transform(F.regexp_extract_all(s, F.lit(r"([0-9一二三四五六七八九十百千零两]+\s*(?:级|轮|层|阶段|个|次|步|档|重))"), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)\s+", ""))
    return F.array_distinct(F.filter(F.concat(tech, names, counted), lambda t: F.length(t) >= 2))


def premises_from_claims(claims: DataFrame, key: str = "id") -> DataFrame:
    """(key, claim, terms, source) of claims (key, claim); a claim without anything to check gives none."""
    out = claims.select(key, F.trim("claim").alias("claim"), claim_terms(F.col("claim")).alias("terms"), F.lit("llm:premise").alias("source"))
    return out.where("size(terms) > 0")


def node_text(nodes: DataFrame) -> DataFrame:
    """(id, low): all searchable text of a node, in lower case."""
    have = [c for c in ("qualname", "name", "path", "docstring", "description", "message", "signature", "text") if c in nodes.columns]
    lists = [F.array_join(c, "\x01") for c in ("aliases", "zh_aliases") if c in nodes.columns]
    quotes = [F.array_join(F.transform("evidence", lambda e: e["quote"]), "\x01")] if "evidence" in nodes.columns else []
    return nodes.select("id", F.lower(F.concat_ws("\x01", *[F.col(c) for c in have], *lists, *quotes)).alias("low"))


PIECE = 3


def _pieces(c: str, n: Column | int) -> Column:
    return F.array_distinct(grams(F.col(c), n))


def terms_present(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, present): whether any node's text contains the term, whatever its case. Empty terms are never present.

    Containment has no equality to join on, so texts (id, low) and terms meet on pieces of three characters (a shorter term is
    its own piece). A term with a piece that no text has is absent; one that is a piece is present. Every other term is looked
    for only in the texts that have its rarest piece. Nothing is gathered to the driver, however large the vocabulary.
    """
    words = stored(terms.select(F.lower("term").alias("t")).where("t <> ''").distinct(), "vocabulary")
    want = words.select("t", F.explode(_pieces("t", F.least(F.length("t"), F.lit(PIECE)))).alias("piece"))
    low = stored(texts.where("low is not null").select("id", "low").distinct(), "vocabulary-texts")
    sizes = [r["n"] for r in words.select(F.least(F.length("t"), F.lit(PIECE)).alias("n")).distinct().collect()]  # at most PIECE rows
    every = F.array_distinct(F.concat(*[grams(F.col("low"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    have = stored(low.select("id", F.explode(every).alias("piece")).join(want.select("piece").distinct(), "piece", "left_semi"), "vocabulary-pieces")
    known = want.join(have.groupBy("piece").agg(F.count("*").alias("df")), "piece", "left")
    per = stored(known.groupBy("t").agg(F.count(F.when(F.col("df").isNull(), 1)).alias("missing"), F.min_by("piece", "df").alias("piece")).where("missing = 0").select("t", "piece"), "vocabulary-rarest")
    at = per.where("t <> piece").join(have, "piece").select("t", "id").distinct()
    found = at.join(low, "id").where(F.contains("low", F.col("t"))).select("t").unionByName(per.where("t = piece").select("t")).distinct()
    found = found.withColumn("present", F.lit(True))
    return terms.select("term").distinct().join(found, F.lower("term") == F.col("t"), "left").select("term", F.coalesce("present", F.lit(False)).alias("present"))


def verify_premises(texts: DataFrame, premises: DataFrame, key: str = "id") -> DataFrame:
    """(key, claim, status, reason, source, terms) of the premises none of whose terms occurs anywhere in the graph."""
    vocabulary = premises.select(F.explode("terms").alias("term")).distinct()
    known = terms_present(texts, vocabulary).where("present").select("term")
    held = premises.select(key, "claim", F.explode("terms").alias("term")).join(known, "term", "left_semi").select(key, "claim").distinct()
    return premises.where("size(terms) > 0").join(held, [key, "claim"], "left_anti").select(key, "claim", F.lit("unverified").alias("status"), F.lit("unknown_entity").alias("reason"), "source", "terms")
