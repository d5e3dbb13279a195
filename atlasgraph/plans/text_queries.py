"""Queries of the scalar text functions and of routing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import STOP_WORDS, TECH_TERMS, equivalents
from ..operators import routing
from .graph_queries import BASE, _table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question once: (id, question)."""
    return _table(spark, d, "dataset").where("id is not null").groupBy("id").agg(F.max("question").alias("question"))


QS = "with recursive q as (select id, max(question) as question from dataset where id is not null group by id)"


def terms_sql(x: str) -> str:
    words = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) >= 2 and not regexp_matches(w, '^[0-9]+$'))"
    han = f"flatten(list_transform(regexp_extract_all(lower({x}), '[一-鿿㐀-䶿]+'), lambda r: case when length(r) = 1 then [r] else flatten(list_transform([2, 3, 4], lambda n: list_transform(generate_series(1, length(r) - n + 1), lambda i: substr(r, i, n)))) end))"
    return f"list_concat({words}, {han})"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ABBREVIATIONS_SQL = "MAP {" + ", ".join(f"'{k}': [{_quoted(v)}]" for k, v in equivalents().items()) + "}"
IDENT_SQL = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
#: (id, c): the candidate names of every question of the view q.
TOKENS = f""", ch as (select id, regexp_extract_all(coalesce(question, ''), '{IDENT_SQL}') as chains from q),
wd as (select id, chains, flatten(list_transform(chains, lambda c: string_split(c, '.'))) as w0 from ch),
we as (select id, chains, w0, flatten(list_transform(w0, lambda w: coalesce({ABBREVIATIONS_SQL}[lower(w)], []::varchar[]))) as others from wd),
wa as (select id, chains, others, list_concat(w0, others) as words from we),
tok as (select distinct id, c from (select id, unnest(list_concat(chains, others, flatten(list_transform(chains, lambda c: list_transform(generate_series(2, len(string_split(c, '.'))), lambda i: array_to_string(string_split(c, '.')[i:], '.')))),
  list_transform(generate_series(1, len(words)), lambda i: words[i]), {', '.join(f"list_transform(generate_series(1, len(words) - {n - 1}), lambda i: array_to_string(words[i:i + {n - 1}], '{m}'))" for n in (2, 3) for m in '_.')})) as c from wa) where length(c) >= 2 and not regexp_matches(c, '^[0-9]+$'))
"""


@query("f1_terms", f"{QS} select id, len({terms_sql('question')})::bigint as n, array_to_string({terms_sql('question')}, '|') as terms from q where question is not null")
def _(spark, d):
    t = questions(spark, d).where("question is not null").select("id", tx.zh_terms(F.col("question")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("terms"))


@query("f2_query_terms", f"{QS} select id, array_to_string(list_filter({terms_sql('question')}, lambda x: x not in ({_quoted(sorted(STOP_WORDS))})), '|') as terms from q where question is not null")
def _(spark, d):
    return questions(spark, d).where("question is not null").select("id", F.array_join(tx.drop_stop_words(tx.zh_terms(F.col("question"))), "|").alias("terms"))


@query("f3_abbreviations", f"with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) select word, array_to_string({ABBREVIATIONS_SQL}[word], '|') as others from w where {ABBREVIATIONS_SQL}[word] is not null")
def _(spark, d):
    w = _table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    return w.select("word", F.array_join(tx.other_forms(F.col("word")), "|").alias("others")).where("others <> ''")


@query("f4_tech_terms", "select doc_id, concat_ws('|', " + ", ".join(f"case when regexp_matches(lower(text), '(^|[^a-z0-9]){t}($|[^a-z0-9])') then '{s}' end" for t, s in TECH_TERMS.items()) + ") as terms from documents where text is not null")
def _(spark, d):
    return _table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(tx.tech_terms(F.col("text")), lambda t: t["shown"]), "|").alias("terms"))


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")


@query("f5_half_width", f"{QS} select id, translate(coalesce(question, ''), '{_WIDE}', '{_HALF}') as norm from q")
def _(spark, d):
    return questions(spark, d).select("id", tx.half_width(F.col("question")).alias("norm"))


def _code_sql(x: str) -> str:
    return "(" + " or ".join(f"regexp_matches(coalesce({x}, ''), '{p}')" for p in tx.CODE_FORMS) + ")"


@query("f6_code_token", f"select doc_id, {_code_sql('text')} as code from documents")
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.has_code_token(F.col("text")).alias("code"))


@query("f7_candidates", f"{QS}{TOKENS} select id, count(*) as n, string_agg(c, '|' order by c collate c) as names from tok group by id".replace(" collate c", ""))
def _(spark, d):
    c = questions(spark, d).select("id", F.explode(tx.candidates(F.col("question"))).alias("c"))
    return c.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("c")), "|").alias("names"))


@query("f10_content_terms", f"{QS} select id, len(list_filter(list_distinct({terms_sql('question')}), lambda x: length(x) >= 2 and x not in ({_quoted(sorted(STOP_WORDS))})))::bigint as n from q where question is not null")
def _(spark, d):
    t = F.array_distinct(F.filter(tx.drop_stop_words(tx.zh_terms(F.col("question"))), lambda x: F.length(x) >= 2))
    return questions(spark, d).where("question is not null").select("id", F.size(t).cast("long").alias("n"))


@query("f15_parse_time", "select doc_id, try_cast(x as timestamp) as t from (select doc_id, case when doc_id % 3 = 0 then 'soon' else strftime(written_at, '%Y-%m-%d %H:%M:%S') end as x from documents)")
def _(spark, d):
    x = F.when(F.col("doc_id") % 3 == 0, F.lit("soon")).otherwise(F.date_format("written_at", "yyyy-MM-dd HH:mm:ss"))
    return _table(spark, d, "documents").select("doc_id", tx.parsed_time(x).cast("timestamp_ntz").alias("t"))


_BIGRAMS = r"case when length({0}) < 2 then list_filter([{0}], lambda x: x <> '') else list_distinct(list_transform(generate_series(1, length({0}) - 1), lambda i: substr({0}, i, 2))) end"


@query("f17_bigram_jaccard", f"""with g as (select group_no, {_BIGRAMS.format("regexp_replace(lower(name), '\\s+', '', 'g')")} as a, {_BIGRAMS.format("regexp_replace(lower(members[1]), '\\s+', '', 'g')")} as b from concept_groups where name is not null and members[1] is not null)
select group_no, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) as j from g where len(list_concat(a, b)) > 0""")
def _(spark, d):
    g = _table(spark, d, "concept_groups").where("name is not null and try_element_at(members, 1) is not null")
    a, b = tx.bigrams(F.col("name")), tx.bigrams(F.expr("members[0]"))
    return g.select("group_no", F.round(tx.jaccard(a, b), 4).alias("j"), F.size(F.concat(a, b)).alias("s")).where("s > 0").drop("s")


@query("f18_foreign_identifiers", "select id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(description, ''), '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda i: not contains(coalesce(quote, ''), i)))), '|') as names from concept_staging")
def _(spark, d):
    return _table(spark, d, "concept_staging").select("id", F.array_join(F.sort_array(tx.identifiers_not_in(F.col("description"), F.col("quote"))), "|").alias("names"))


@query("f19_has_token", "select row_no, regexp_matches(coalesce(answer, ''), '(^|[^A-Za-z0-9_])' || regexp_extract(question, '[A-Z][a-z]+[A-Z][a-z]+') || '($|[^A-Za-z0-9_])') as found from judge_pp_b where regexp_extract(question, '[A-Z][a-z]+[A-Z][a-z]+') <> ''")
def _(spark, d):
    j = _table(spark, d, "judge_pp_b").withColumn("name", F.regexp_extract("question", "([A-Z][a-z]+[A-Z][a-z]+)", 1)).where("name <> ''")
    return j.select("row_no", tx.has_token(F.col("answer"), F.col("name")).alias("found"))


@query("f20_json_verdict", """with r as (select row_no, regexp_extract(raw_response, '(?s)\\{.*\\}') as j from judge_pp_b where raw_response not like '%<retry>%')
select row_no, json_extract_string(j, '$.verdict') as verdict, json_extract_string(j, '$.reason') as reason from r where j <> '' and json_valid(j)""")
def _(spark, d):
    from ..functions.jsonx import outer_object

    r = _table(spark, d, "judge_pp_b").where("raw_response not like '%<retry>%'").select("row_no", outer_object(F.col("raw_response")).alias("j"))
    v = F.try_parse_json("j")
    return r.select("row_no", v.alias("v")).where("v is not null").select("row_no", F.try_variant_get("v", "$.verdict", "string").alias("verdict"), F.try_variant_get("v", "$.reason", "string").alias("reason"))


@query("f20_json_verdict_all", """with r as (select row_no, regexp_extract(list_last(string_split(raw_response, '<retry>')), '(?s)\\{.*\\}') as j from judge_pp_b)
select row_no, json_extract_string(j, '$.verdict') as verdict, json_extract_string(j, '$.reason') as reason from r where j <> '' and json_valid(j)""")
def _(spark, d):
    from ..functions.jsonx import last_reply, outer_object

    v = _table(spark, d, "judge_pp_b").select("row_no", F.try_parse_json(outer_object(last_reply(F.col("raw_response")))).alias("v"))
    return v.where("v is not null").select("row_no", F.try_variant_get("v", "$.verdict", "string").alias("verdict"), F.try_variant_get("v", "$.reason", "string").alias("reason"))


@query("f21_tidy_aliases", "select group_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(aliases, []), lambda a: trim(a)), lambda a: a is not null and a <> ''))), '|') as aliases from concept_groups")
def _(spark, d):
    return _table(spark, d, "concept_groups").select("group_no", F.array_join(F.sort_array(tx.tidy(F.coalesce("aliases", F.array().cast("array<string>")))), "|").alias("aliases"))


@query("f24_dotted_module", r"select distinct relpath, replace(regexp_replace(regexp_replace(regexp_replace(replace(relpath, '\', '/'), '^src/', ''), '/__init__\.py$', ''), '\.py$', ''), '/', '.') as module from source_files where relpath is not null")
def _(spark, d):
    return _table(spark, d, "source_files").where("relpath is not null").select("relpath", tx.dotted_module(F.col("relpath")).alias("module")).distinct()


@query("f25_leaks", "select distinct id, contains(lower(question), lower(target_semantic)) as leak from dataset where question is not null and target_semantic is not null")
def _(spark, d):
    q = _table(spark, d, "dataset").where("question is not null and target_semantic is not null")
    return q.select("id", F.contains(F.lower("question"), F.lower("target_semantic")).alias("leak")).distinct()


@query("concept_key", r"select id, regexp_replace(lower(trim(name)), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{0085}\x{2028}\x{2029}\x{1680}-]+', '', 'g') as key from concept_staging where name is not null")
def _(spark, d):
    return _table(spark, d, "concept_staging").where("name is not null").select("id", tx.concept_key(F.col("name")).alias("key"))


@query("first_lines", r"""select doc_id, nullif(trim(string_split(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{0085}\x{2028}\x{2029}\x{1680}\x{000B}]+', ''), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{0085}\x{2028}\x{2029}\x{1680}\x{000B}]+$', ''), chr(10))[1]), '') as line from documents where text is not null""")
def _(spark, d):
    return _table(spark, d, "documents").where("text is not null").select("doc_id", tx.first_line_or_null(F.col("text")).alias("line"))


@query("endpoints_of_facts", r"""with x as (select distinct file_id, qualname, run, list_filter(coalesce(decorators, []), lambda a: regexp_matches(a, '(^|\.)(route|get|post|put|delete|patch|cached|property|staticmethod)')) as hit from function_facts)
select distinct file_id, qualname, run, upper(string_split(hit[1], '.')[-1]) as http_method from x where len(hit) > 0""")
def _(spark, d):
    f = _table(spark, d, "function_facts").withColumn("decorators", F.coalesce("decorators", F.array().cast("array<string>")))
    e = tx.endpoint(F.col("decorators"), F.transform("decorators", lambda x: F.lit(None).cast("string")), (r"(^|\.)(route|get|post|put|delete|patch|cached|property|staticmethod)",))
    return f.select("file_id", "qualname", "run", e.alias("e")).where("e is not null").select("file_id", "qualname", "run", "e.http_method").distinct()


def _route_sql() -> str:
    case = ""
    for r in routing.RULES:
        needs = [{"has_code_token": "code", "no_code_token": "not code", "no_linker_hit": "linked = 0", "no_repo_reference": "(linked = 0 and not pronoun and not contains(norm, '`'))"}[n] for n in r.needs]
        conds = needs + ([f"regexp_matches(norm, '{r.pattern}')"] if r.pattern else [])
        case += f" when {' and '.join(conds)} then '{r.id}:{r.label}'"
    return case


@query("f8_route", f"""{QS}, m as (select id, translate(coalesce(question, ''), '{_WIDE}', '{_HALF}') as norm, (length(question) % 3 = 0)::int as linked from q),
s as (select *, {_code_sql('norm')} as code, regexp_matches(norm, '{routing.PRONOUN.replace('(?<!应)该', '(?:^|[^应])该')}') as pronoun from m), r as (select id, case {_route_sql()} end as hit from s)
select id, coalesce(split_part(hit, ':', 2), 'entity_local') as route_label, coalesce('rule:' || split_part(hit, ':', 1), 'fallback:default') as route_source from r""")
def _(spark, d):
    q = questions(spark, d).withColumn("linked", F.coalesce(F.length("question") % 3 == 0, F.lit(False)).cast("int")).withColumn("topic_hits", F.lit(0))
    return routing.route(routing.with_signals(q)).select("id", "route_label", "route_source")


@query("meta_questions", f"{QS} select id, regexp_matches(coalesce(question, ''), '{'|'.join(routing.META_WORDS)}') as meta from q")
def _(spark, d):
    return questions(spark, d).select("id", routing.is_meta_question(F.col("question")).alias("meta"))
