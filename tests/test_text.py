"""Scalar text functions on the fixtures, nulls and empty texts."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasgraph.functions import jsonx
from atlasgraph.functions import text as tx


@pytest.fixture
def ev(spark):
    def run(fn, *values):
        df = spark.createDataFrame([(v,) for v in values], "x string")
        return [r["y"] for r in df.select(fn(F.col("x")).alias("y")).collect()]

    return run


def test_terms(ev):
    assert ev(tx.zh_terms, "终止流程", "Handle TERMINATE v2 3", "", "!?", None) == [["终止", "止流", "流程", "终止流", "止流程", "终止流程"], ["handle", "terminate", "v2"], [], [], []]


def test_stop_words_keep_repeats(ev):
    words = lambda c: tx.drop_stop_words(F.split(c, " "))
    assert ev(words, "怎么 终止 起来 派发 哪个 恢复 终止") == [["终止", "派发", "恢复", "终止"]]


def test_half_width_and_lines(ev):
    assert ev(tx.half_width, "ＡＰＩ１２３", "全　角空格", "终止流程。", None) == ["API123", "全 角空格", "终止流程。", ""]
    assert ev(tx.first_filled_line, "\n\n  b \nc", "", None) == ["b", "", ""]
    assert ev(tx.first_line_or_null, "  a\nb", " \n ", None) == ["a", None, None]


def test_abbreviations(ev):
    assert ev(tx.other_forms, "ctx", "context", "CTX", "nothing") == [["context"], ["ctx"], ["context"], []]
    assert set(ev(tx.other_forms, "config")[0]) == {"cfg", "conf"}


def test_code_tokens(ev):
    assert ev(tx.has_code_token, "run it", "runThread", "a_b", "x.y", "see #12", "GET /api/users", "`x`", "core.py", None) == [False, True, True, True, True, True, True, True, False]


def test_candidates(ev):
    got = set(ev(tx.candidates, "改 ctx 会怎样 Store._begin append system event")[0])
    assert {"Store._begin", "_begin", "append_system_event", "context", "ctx"} <= got
    assert ev(tx.candidates, "", None) == [[], []]


def test_fixes(ev):
    assert [[tuple(x) for x in r] for r in ev(tx.fixes, "fixes #5 and closes #5\n(#9)", "Drop it (#12)", "prefix#3", None)] == [[(5, "closes")], [(12, "pr_ref")], [], []]


def test_module_names_and_keys(ev):
    assert ev(tx.dotted_module, "src/pkg/__init__.py", "src\\a\\b.py", "app.py") == ["pkg", "a.b", "app"]
    assert ev(tx.concept_key, "Alpha Beta", "alpha-beta", "foo_bar", None) == ["alphabeta", "alphabeta", "foo_bar", None]


def test_outer_object(ev):
    assert ev(jsonx.outer_object, 'x {"a": "}"} y', "{", "none", None, '{"a":{"b":1}}') == ['{"a": "}"}', None, None, None, '{"a":{"b":1}}']


def test_very_long_text(ev):
    assert len(ev(tx.zh_terms, "word " * 50_000)[0]) == 50_000


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1终止流程 _.-X", max_size=12), min_size=1, max_size=8))
def test_terms_match_plain_python(ev, texts):
    import re

    def plain(t):
        low = t.lower()
        out = [w for w in re.findall("[a-z0-9]+", low) if len(w) > 1 and not w.isdigit()]
        for run in re.findall("[一-鿿㐀-䶿]+", low):
            out += [run] if len(run) == 1 else [run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)]
        return out

    assert ev(tx.zh_terms, *texts) == [plain(t) for t in texts]


def test_reply_after_the_last_retry_counts(spark, tmp_path):
    from atlasgraph.plans.text_queries import QUERIES

    replies = ['```j\n<retry>\n```json\n{"verdict": "correct", "reason": "a}b"}\n```', '{"verdict": "wrong"}<retry>{"verdict": "partial"}<retry>said {"verdict": "correct"} and {"x": 1}', '{"verdict": "wrong"}', "none", '{"verdict": "wrong"} <retry> none', None]
    spark.createDataFrame(list(enumerate(replies)), "row_no int, raw_response string").write.parquet(str(tmp_path / "judge_pp_b.parquet"))
    got = QUERIES["f20_json_verdict_all"](spark, str(tmp_path))
    assert sorted((r["row_no"], r["verdict"], r["reason"]) for r in got.collect()) == [(0, "correct", "a}b"), (1, "correct", None), (2, "wrong", None)]
