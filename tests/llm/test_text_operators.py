"""Plain form, broken pairs, documented functions, tokens: fixtures, brute force and awkward cases."""

import ast
import random
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atlasgraph.llm import brokenpairs as bp
from atlasgraph.llm import docpairs as dp
from atlasgraph.llm import plainform as pf
from atlasgraph.llm import tokens as tk

from ..conftest import rows

PLAIN = ["Why is the cursor late?", "naïve résumé", "谁会调用、同时让索引。", "Где узел и порог?", "Δ-courier auditor", "a  b", "", "Größe über Straße", "ГДЕ ОТЧЁТ", "façade (demo)", "α and β", "好，是吗？", "Ⅳ. Teil", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ⲧⲁⲥⲡⲉ"]
ODD = {
    "ｔｈｅ cat": "the cat", "docket mаtcher": "docket matcher", "re\u0301sume\u0301": "résumé", "a\u00a0b": "a b", "zero\u200bwidth": "zerowidth", "soft\u00adhyphen": "softhyphen", "non\u2011breaking": "non-breaking", "停⽌轮转": "停止轮转", "Ноw do": "How do",
    "ріесе of": "piece of", "oνer": "over", "Εndpunkt flache": "Endpunkt flache", "full\u3000space": "full space", "жуpнал и узел": "журнал и узел", "\ufeffstart": "start", "⻔户": "门户", "６９９": "699", "ﬁne": "fine", "𝐛old": "bold", "U\u0308bergang": "Übergang",
    "Ꮯursor": "Cursor", "ꓚache": "Cache", "fⲟlder": "folder", "aϲcent": "accent", "ⅽursor": "cursor", "ꓢꓡоw": "SLow", "rоle\u0301": "rolé", "ро\u0301ke": "póke",
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_stays(text):
    assert pf.transducer()(text) == text


@pytest.mark.parametrize("odd, plain", ODD.items())
def test_odd_becomes_plain(odd, plain):
    assert pf.transducer()(odd) == plain


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcⅽꓚᏟᎠХоp е́éｅ\u0301\u200b\u00a0-‑Δν止⽌ü\u0308 ж", max_size=20))
def test_plain_form_is_stable(text):
    t = pf.transducer()
    once = t(text)
    assert t(once) == once and unicodedata.normalize("NFC", once) == once


def test_mapping_is_checked_for_conflicts(monkeypatch):
    monkeypatch.setattr(pf, "HYPHENS", "‐⺠")
    with pytest.raises(ValueError):
        pf.build_mapping()


def test_lookalikes_are_checked_against_the_mapping(monkeypatch):
    monkeypatch.setattr(pf, "LOOKALIKES", pf.LOOKALIKES | {"ｘ": "x"})
    with pytest.raises(ValueError):
        pf.build_lookalikes(pf.build_mapping())


def test_not_plain_rows(spark):
    df = spark.createDataFrame([("1", "ｔhe", "x"), ("1", "ｔhe", "y"), ("2", None, "x"), ("3", "", "x"), ("4", "plain", "x"), ("5", "é" * 200_000 + "\u200b", "x")], "id string, name string, plain string")
    assert rows(pf.not_plain(df, "t", "id", "name"), "table_name", "record_key") == [("t", "1"), ("t", "5")]
    assert pf.plain_form(df.drop("plain"), "name").count() == 6
    assert pf.not_plain(df.limit(0), "t", "id", "name").count() == 0


MODEL = bp.terminal_model({(".", True): 900, (".", False): 500, ("a", False): 90_000, ("a", True): 30, ("。", True): 500, ("字", True): 20, ("字", False): 9000})
Q = "Why was the ambient indexer replaced by SymbolWatcher when parse_counter began to archive rows?"


@pytest.mark.parametrize(
    "raw, question, want",
    [
        (None, Q, "empty"), ("", Q, "empty"), (" \u200b\n", Q, "empty"), ("```json\n{}\n```", Q, "empty"), ('{"verdict": null, "reason": ""}', Q, "empty"), ("null", Q, "empty"),
        ('{"verdict":"correct","reason":"The answer is fi', Q, "truncated"), ('{"verdict":"correct","reason":"The answer points out that the pull"}', Q, "truncated"), ('{"verdict":"partial', Q, "truncated"),
        ('{"verdict":"wrong","reason":"I won\'t give a verdict here; please ask a maintainer."}', Q, "refusal"), ("恕我拒绝给它打分。", "谁会调用索引？", "refusal"), ("Eine Bewertung von x_y lehne ich ab.", "Was geschieht mit der Akte?", "refusal"),
        (Q, Q, "copied_question"), ('{"verdict":"correct","reason":"' + Q.lower() + '"}', Q, "copied_question"), (Q + " " + Q, Q, "copied_question"),
        ('{"verdict":"correct","reason":"Die Antwort stellt klar, dass es keine Akte gibt und nicht mehr."}', Q, "other_language"), ('{"verdict":"correct","reason":"Ответ исправляет посылку про X."}', Q, "other_language"), ("回答明确指出没有使用索引。", Q, "other_language"),
        ('{"verdict":"correct","reason":"The answer is clear, as the word “信标” shows."}', Q, None), ('{"verdict":"wrong","reason":"The candidate answer refuses to name the folder, so the premise stands."}', Q, None),
        ('{"verdict":"cor\n<retry>\n{"verdict":"correct","reason":"The answer names the right folder."}', Q, None), ('{"verdict":"correct","reason":"The answer is right."}<retry>', Q, "empty"), ('{"verdict":"correct","reason":""}', Q, None),
        ('{"verdict":"correct","reason":"The answer is right."}', None, None),
    ],
)
def test_defects(raw, question, want):
    assert bp.defect(question, *bp.read_reply(raw), MODEL) == want


def test_broken_pairs_over_rows(spark):
    fine = '{"verdict":"correct","reason":"The answer points out that the folder %d is right."}'
    data = [(i, Q, fine % i, "x") for i in range(40)] + [(100, Q, "", "x"), (100, Q, "", "x"), (101, None, None, "x"), (102, Q, "x" * 300_000 + ".", "x")]
    df = spark.createDataFrame(data, "row_no long, question string, raw_response string, defect string")
    assert rows(bp.broken_pairs(df)) == [(100, "empty"), (100, "empty"), (101, "empty")]
    assert bp.broken_pairs(df.limit(0)).count() == 0


def test_a_reply_is_found_behind_any_preface():
    assert bp.defect(Q, *bp.read_reply("x y " * 250 + '{"verdict":"","reason":""}'), MODEL) == "empty"
    assert bp.read_reply('{"verdict":"a","reason":"b."} and then {"verdict":"c","reason":"d."} done') == ("c", "d.", False)
    assert bp.read_reply("The set {a} is right.") == (None, "The set {a} is right.", False)
    assert bp.read_reply("so " * 300 + '{"verdict":"correct","reason":"The ans') == ("correct", "The ans", True)
    assert bp.read_reply('{"a":' * 50_000)[2] and bp.read_reply('{"verdict": ' * 50_000)[2]


@pytest.mark.parametrize("question", ["Why?", "run it", "Is it late", "What is run?", "What does run do?", "Is the cursor late?", "哪里？", "Was ist der Rest hier?"])
def test_copies_of_short_questions(question):
    assert bp.defect(question, *bp.read_reply(question.upper()), MODEL) == "copied_question"
    assert not bp.copies(question, "The answer names the right folder, so it holds.")


# None of these phrases is taken from the test tables.
DECLINED = [
    "I must withhold judgement here.", "I'd rather skip this one.", "Please find someone else to grade this.", "We leave this ungraded.", "Judgement withheld.", "Count me out.", "I am not qualified to assess this.", "It would be better to ask a human reviewer.",
    "Ich passe hier.", "Bitte fragen Sie jemand anderen.", "我选择弃权。", "请另找专家来评。", "Воздерживаюсь от оценки.", "Обратитесь к другому эксперту.", "Je me récuse.", "Me abstengo de opinar.",
]
JUDGED = ["The answer withholds the name and is wrong.", "I find the answer right.", "We see that the claim holds.", "The reply skips the second step.", "The folder rates each row once.", "The answer is right because it names another model.", "Die Antwort nennt den anderen Ordner.", "回答请用户另找文件。"]


@pytest.mark.parametrize("text", DECLINED)
def test_refusals(text):
    assert bp.refuses(text)


@pytest.mark.parametrize("text", JUDGED)
def test_judgements_are_no_refusals(text):
    assert not bp.refuses(text)


@pytest.mark.parametrize("text, lang", [("Odpowiedź jest błędna, ponieważ nie podaje nazwy.", "pl"), ("Het antwoord is niet juist omdat het geen map noemt.", "nl"), ("Відповідь є правильною, її дає текст", "uk"), ("The answer is in the folder.", "en"), ("Svaret är inte rätt och det är för kort.", "sv")])
def test_language(text, lang):
    assert bp.language(text) == lang


def test_a_text_of_closing_marks_is_read_once():
    began = time.time()
    bp.breaks_off("a" + ")" * 100_000, MODEL)
    assert bp.context_counts(["a" + ")" * 100_000])[("a)", True)] == 1
    assert time.time() - began < 1


SOURCES = [
    'def f(a, b: int = 3) -> str:\n    """Does a lot of work."""\n    def inner():\n        "Inner words here."\n    return inner\n',
    'class Outer:\n    """Class doc."""\n    async def method(self):\n        # note\n        r"""Raw\n        docs."""\n        class Deep:\n            def leaf(self): "One line."; x = 1\n',
    'if True:\n    def g():\n        ("joined " "text of g")\nelse:\n    def g():\n        pass\n',
    'def fs():\n    f"no {1}"\n\ndef bs():\n    b"bytes"\n\ndef cat():\n    "a" + "b"\n\ndef tup():\n    "a",\n\ndef call():\n    "x".strip()\n',
    "def tabs():\n\t'''Tabbed words.'''\n\treturn 1\r\n\r\ndef cr():\r    'Old line ends.'\r    return 2\r",
    "def broken(:\n    'no'\n", "print 'x'\n", "", "x = 1", "def late():\n    x = 1\n    'not a docstring'\n", "@deco(1, lambda: 2)\ndef dec(x=lambda y: {'a': 1}, *args, **kw):\n    '''Decorated words.'''\n",
    "def first():\n    'First words.'\ndef first():\n    pass\n", "def outer():\n    for i in x:\n        with y:\n            def looped():\n                'Looped words.'\n", "def \u00fcber():\n    'Unicode words \u00e9.'\n", "try:\n    def t():\n        'Try words.'\nfinally:\n    pass\n",
]


def by_ast(source):
    out = set()
    try:
        tree = ast.parse(source)
    except Exception:
        return out

    def walk(node, path):
        for c in ast.iter_child_nodes(node):
            p = path
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                p = [*path, c.name]
                if not isinstance(c, ast.ClassDef) and (d := ast.get_docstring(c, clean=False)) is not None:
                    out.add((".".join(p), d))
            walk(c, p)

    walk(tree, [])
    return out


def test_documented_functions_match_the_parser(spark):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(SOURCES)] + [(1, SOURCES[1], "y"), (99, None, "x"), (None, SOURCES[0], "x")], "file_id long, source_text string, kind string")
    want = {(i, *x) for i, s in enumerate(SOURCES) for x in by_ast(s)}
    got = dp.documented_functions(df)
    assert {(r["file_id"], r["qualname"], r["docstring"]) for r in got.collect()} == want and got.count() == len(want)
    assert {r["qualname"]: r["signature"] for r in got.collect()}["f"] == "(a, b: int = 3) -> str"
    assert dp.documented_functions(df.limit(0)).count() == 0


@pytest.mark.parametrize("doc, name", [("", "f"), (" \n ", "f"), ("...", "f"), ("TODO", "f"), ("TODO: document", "f"), ("待补充", "f"), ("N/A", "f"), ("-----", "f"), ("Warms the supervisor.", "warm_supervisor"), ("warm supervisor", "A.warm_supervisor"), ("Warm Supervisor 6Ni", "warm_supervisor_6ni"), ("rebase_valve()", "rebase_valve"), (":param x:\n:return:", "f"), ("Args:\n    x:\n\nReturns:\n", "f"), ("Warm supervisor.\n\n:param x:\n:return:\n", "warm_supervisor"), (None, "f"), ("Processes the query.", "process_query"), ("Applies the match.", "_apply_match")])
def test_trivial(doc, name):
    assert dp.is_trivial(doc, name)


@pytest.mark.parametrize("doc, name", [("Warm supervisor.\n\nKeeps 3 rows.", "warm_supervisor"), ("打分静默证据并标记黑板。", "f"), ("TODO: route the handler before the loader", "f"), (":param x: the row to keep\n:return:", "f"), ("Drains the other queue.", "drain_queue"), ("Note the order.", "f")])
def test_useful(doc, name):
    assert not dp.is_trivial(doc, name)


def test_facts_and_files_meet(spark):
    files = spark.createDataFrame([(1, SOURCES[0])], "file_id long, source_text string")
    facts = spark.createDataFrame([(2, "C.run", "(self)", "Runs all queued rows twice.", 1), (2, "C.run", "(self)", "Runs all queued rows twice.", 2), (2, "C.stop", "(self)", "Stops.", 1), (2, "C.x", "()", None, 1), (None, "C.y", "()", "Words that help.", 1)], "file_id long, qualname string, signature string, docstring string, run int")
    assert rows(dp.code_description_pairs(files, facts), "file_id", "qualname") == [(1, "f"), (1, "f.inner"), (2, "C.run")]


TEXTS = ["", None, "plain words", "<|endoftext|> is text", "中文与 emoji 🎈👩‍🚀", "a\u0301 \x00 \t\n", "x" * 50_000, "é" * 999, " lead", "\u200b", "naïve café"]


def test_encoding_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(2, TEXTS[2])], "doc_id long, text string").selectExpr("*", "1 as ids")
    ids = {r["doc_id"]: r["ids"] for r in tk.encode(df).collect()}
    assert ids[0] == [] and ids[1] == [] and 50256 not in ids[3]
    plain = tk.tokenizer(tk.TOKENIZERS, tk.NAME)
    assert all(ids[i] == plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS) if t)
    back = rows(tk.decode(tk.encode(df)), "doc_id", "text")
    assert back == sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2])], key=repr)


def test_split_character_and_offsets(spark):
    df = spark.createDataFrame([(1, "a🎈b")], "doc_id long, text string")
    r = tk.encode(df, offsets=True).first()
    assert len(r["ids"]) > 3 and {(s, e) for s, e in zip(r["starts"], r["ends"])} == {(0, 1), (1, 2), (2, 3)}
    cut = spark.createDataFrame([(1, r["ids"][:2]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = dict(rows(tk.decode(cut), "doc_id", "text"))
    assert "\ufffd" in got[1] and got[2] is None and got[3] == ""


def test_empty_corpus(spark):
    assert tk.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_byte_table_is_a_bijection():
    assert sorted(tk.byte_table().values()) == list(range(256))
    assert random.Random(0).choice(list(tk.byte_table())) in tk.byte_table()
