"""Queries p1, p3 and p5 to p10, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import brokenpairs, components, docpairs, mixing, plainform, spans, splits, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brokenpairs.broken_pairs(table(spark, sf_dir, "judge_pp_b"))


def _not_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = plainform.not_plain(table(spark, sf_dir, "dataset"), "dataset", "id", "question")
    return questions.unionByName(plainform.not_plain(table(spark, sf_dir, "concept_staging"), "concept_staging", "id", "name"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _not_plain(spark, sf_dir).drop("plain").distinct()


def p3_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _not_plain(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = splits.overlaps(table(spark, sf_dir, "dataset"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.overlap_report(table(spark, sf_dir, "dataset"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.linked_records(table(spark, sf_dir, "dataset"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.consolidate(table(spark, sf_dir, "concept_groups"), table(spark, sf_dir, "align_audit"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_groups(spark, sf_dir).where("root_no <> group_no").select("root_no", "group_no")


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.code_description_pairs(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "function_facts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pairs(spark, sf_dir).select("file_id", "qualname").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode(tokens.encode(table(spark, sf_dir, "documents")))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, sf_dir, "documents"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_parts(table(spark, sf_dir, "documents"))


def p10_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.clusters(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_plain, p5_found, p5_report, p5_links, p6_found, p6_groups, p7_found, p7_pairs, p8_ids, p8_decoded, p9_mixture, p9_report, p10_found, p10_shared, p10_clusters, p10_classes)}

_COMPONENTS = r"""
with recursive labels as (
  select group_no, regexp_replace(lower(n), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{0085}\x{2028}\x{2029}\x{1680}-]+', '', 'g') as l
  from (select group_no, unnest(list_concat([name], coalesce(members, []), coalesce(aliases, []))) as n from concept_groups)),
star as (select group_no as a, min(group_no) over (partition by l) as b from labels where l is not null and l <> ''),
same as (select left_ref as a, right_ref as b from align_audit where verdict = 'same'
         and left_ref in (select group_no from concept_groups) and right_ref in (select group_no from concept_groups)),
e as (select a, b from star union select b, a from star union select a, b from same union select b, a from same),
reach as (select group_no as v, group_no as r from concept_groups where group_no is not null
          union select e.b, reach.r from reach join e on e.a = reach.v where e.b > reach.r),
groups as (select v as group_no, min(r) as root_no from reach group by v)
"""

ORACLE = {
    "p6_groups": _COMPONENTS + "select group_no, root_no from groups",
    "p6_found": _COMPONENTS + "select root_no, group_no from groups where root_no <> group_no",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
