"""Broken prompt and response pairs: each reply's defect, if it has one.

Of a raw reply the part after the last <retry> counts; fences are taken off, and the last JSON object with a verdict or a
reason, whole or broken off and behind whatever preface, is read. Then, in this order:

* empty           neither a verdict nor a reason
* truncated       the JSON or its reason breaks off
* refusal         a dictionary of first-person refusals
* copied_question the reply or its reason, compressed by zstandard with the question as dictionary, shrinks to almost
                  nothing; an exact comparison confirms it
* other_language  dictionaries of function words and scripts place the reason in another language than the question
* truncated       the reason's last characters end no sentence: a terminal-context model, counted over all reasons
                  of the corpus, says how often a text ends after such a context and how often it goes on

What the columns verdict, ok and error say is not used. A null question has no language and nothing to copy.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

_FENCE = re.compile(r"```[\w-]*")
_RETRY = re.compile(r"<\s*retry\s*/?\s*>", re.I)
_VERDICT = re.compile(r'"verdict"\s*:\s*"([^"]*)"?')
_REASON = re.compile(r'"reason"\s*:\s*"((?:[^"\\]|\\.)*)("?)', re.S)
_BRACE = re.compile(r'\{(?=\s*["}])')
_KEY = re.compile(r'"(?:verdict|reason)')
_DECODER = json.JSONDecoder(strict=False)
_INVISIBLE = re.compile(r"[​-‏⁠-⁤﻿­᠎]")
_NOTHING = {"null", "none", "undefined", "n/a", '""', "''", "[]", "{}", "()", "-", "--", "...", "…", "nan"}


def _blank(text) -> bool:
    return text is None or not isinstance(text, str) or not _INVISIBLE.sub("", text).strip() or _INVISIBLE.sub("", text).strip().lower() in _NOTHING


def read_reply(raw: str | None) -> tuple[str | None, str | None, bool]:
    """(verdict, reason, broken) of a raw reply; a reply without JSON is a reason as a whole, broken says that the JSON breaks off."""
    if raw is None:
        return None, None, False
    text = _RETRY.split(raw)[-1]
    body = _INVISIBLE.sub("", _FENCE.sub("", text)).strip()
    found, inner = _last_object(body)
    if inner is None:
        return None, None if _blank(body) else body, False
    if found is not None:
        verdict, reason = found.get("verdict"), found.get("reason")
        return None if _blank(verdict) else verdict, None if _blank(reason) else reason, False
    verdict, reason = _VERDICT.search(inner), _REASON.search(inner)
    whole = inner.rstrip().endswith("}") and reason and reason[2] == '"'  # only ill-formed, not cut
    return verdict and verdict[1] or None, reason and reason[1] or None, not whole


def _last_object(body: str) -> tuple[dict | None, str | None]:
    """The reply's object and the text from its brace on: the last one that speaks of a verdict or a reason, wherever it
    begins; without an object both are None, for one that can't be parsed the first is.

    After a failure the search goes on where the parser stopped, and nothing can begin inside a string without an end, so
    a text is read once however many braces it has.
    """
    value, start, at = None, 0 if body.startswith("{") else -1, 0
    while begin := _BRACE.search(body, at):
        here = begin.start()
        try:
            got, at = _DECODER.raw_decode(body, here)
            if here == 0 or "verdict" in got or "reason" in got:
                value, start = got, here
        except json.JSONDecodeError as e:
            at = max(here + 1, e.pos)
            if at >= len(body) or e.msg.startswith("Unterminated") or _KEY.search(body, here, at):
                value, start = None, here
        except RecursionError:  # nested too deep to be a reply
            value, start = None, here
            break
    return value, body[start:] if start >= 0 else None


# Words of declining, and what is declined.
_TASK = r"(verdicts?|judge?ments?|judging|grad(e|es|ing)|rat(e|ing|ings)|scor(e|es|ing)|assess(ment|ments|ing)?|evaluat(e|ion|ing)|opinions?|comment(s|ary|ing)?|rul(e|ing)|reviews?|reviewing)"
_DECLINE = r"(withhold(ing)?|withheld|skip(ping)?|pass on|pass(ing)? (this|it|here)|sit (this|it) (one )?out|opt(ing)? out|recus(e|ing)|hold(ing)? (back|off)|step(ping)? (aside|back)|bow(ing)? out|beg(ging)? off|stay(ing)? out|keep(ing)? out|be excused|leave (this|it|that|them)( \\w+)? (to|for|open|blank|ungraded|unrated|unjudged)|leav(e|ing) the \\w+ (to|open|blank)|defer(ring)? to|avoid(ing)? " + _TASK + r"|(do not|don't|shall not|shan't|wouldn't|would not|choose not to|decide not to|opt not to|would prefer not to|am not (going|willing|ready|prepared|inclined|entitled|authori[sz]ed|qualified|competent) to) (judge|grade|rate|score|assess|evaluate|comment|answer|rule|decide|take|participate|engage|do)|(have|got) (nothing to say|no (say|comment|standing|authority|mandate|wish|view|verdict|judge?ment|grade|rating))|(lack|miss) (the |any |enough |sufficient )?(authority|competence|expertise|standing|mandate|qualification|permission))"
# Phrases by which a judge declines, by language: first-person forms, requests to ask another, withheld judgements.
REFUSALS = [
    r"\b(i|we)('m|'d|'ll|'ve)?\b[^.!?\n]{0,40}\b" + _DECLINE + r"\b",
    r"\b(find|ask|get|have|let|consult|contact|try|pick|assign|choose|seek|refer|send|forward|hand|turn|leave|give)\b[^.!?\n]{0,30}\b((someone|somebody|anyone|anybody) else|(another|a different|a human|a qualified|an independent|other) (judges?|graders?|reviewers?|raters?|assessors?|evaluators?|persons?|people|models?|experts?|maintainers?|humans?))\b",
    r"\bno " + _TASK + r"\b[^.!?\n]{0,30}\b(from me|by me|on my part|(will|can|shall) be (given|made|issued|offered|provided))\b", r"\b" + _TASK + r" (is |are |was |were |has been |have been )?(hereby )?(withheld|declined|refused|suspended|left (open|blank))\b", r"\bcount me out\b", r"^\W*(no comment|i pass|pass|skip|skipped|declined|abstain(ed|ing)?|request declined)\W*$",
    r"\bich\b[^.!?\n]{0,60}\b(verzichte|passe|überspringe|überlasse|weigere|bin (nicht )?befugt|bin befangen)\b", r"\b(enthalte|weigere) ich\b", r"\b(fragen|suchen|beauftragen|nehmen|wenden) sie\b[^.!?\n]{0,40}\b(ander\w+|jemand\w*|fach\w+|mensch\w*)\b", r"\b(keine?|ohne) (bewertung|urteil|beurteilung|stellungnahme|kommentar) (von mir|meinerseits)\b",
    r"(我|本人)(选择|只能|决定|宁愿)?(弃权|回避|跳过|放弃|保留意见|不作|不做|不想|不愿|不打算|不适合|没有资格|无权)", r"不便(评价|置评|评分|判断|打分|表态)", r"无可奉告", r"请(您|你)?(另|找|换|让|问|联系|咨询)[^。！？\n]{0,10}(人|专家|评审|维护者|同事)",
    r"\b(уклоняюсь|воздерживаюсь|пасую|отказываюсь|не берусь|не возьмусь|пропущу|предпочту не|предпочитаю не|лучше воздержусь)\b", r"\b(обратитесь|спросите|найдите|попросите)\b[^.!?\n]{0,40}\b(друг\w+|кого|человек\w*|эксперт\w*|специалист\w*)\b", r"\bбез комментариев\b",
    r"\bje (passe|m'abstiendrai|me récuse|décline|ne (souhaite|veux|vais|juge|note|donnerai|me prononce))\b", r"\b(demandez|adressez-vous|trouvez)\b[^.!?\n]{0,30}\b(autre|quelqu'un|expert|humain)\b",
    r"\b(me abstengo|paso de|prefiero (no|abstenerme)|no (quiero|voy a|deseo|debo) (evaluar|juzgar|calificar|opinar|dar))\b", r"\b(pregunte|consulte|busque|pida)\b[^.!?\n]{0,30}\b(otr[ao]|alguien|experto|humano)\b",
    r"\b(i|we)('m| am| are| was|'d)?\b[^.!?\n]{0,40}\b(sorry|afraid|unable|not able|not allowed|not permitted|not in a position|cannot|can't|can not|couldn't|could not|won't|will not|wouldn't|would rather not|refuse|declin(e|ing)|must pass|must decline|abstain|refrain|prefer (not|to stay|to remain)|stay neutral|have no opinion|do not feel|don't feel)\b",
    r"\b(sorry|apologi[sz]e|apologies|unfortunately|regrettably)\b[^.!?\n]{0,80}\b(i|me|my|we|request|task|no assessment)\b",
    r"\bas an? (ai|language|large language)( language)? model\b", r"\bas an ai\b", r"\bmy (guidelines|policy|policies|instructions|rules|role|programming)\b", r"\bbeyond my (role|scope|abilit|competence)", r"\boutside (of )?what i (may|can|am)\b",
    r"\b(inappropriate|not appropriate|improper) for me\b", r"\b(told|asked|instructed|advised) to leave alone\b", r"\bnot something i (do|can|will)\b", r"\b(won't|will not|cannot|can't) (give|provide|offer|render|issue|return) (a|any|the)? ?(verdict|judg|grade|assess|rating|score)", r"\b(ask|try|contact|consult) a (maintainer|human)", r"\bby me\b",
    r"\bnot enough (information|context|evidence) for me\b", r"\bi would rather not\b", r"\bleave the verdict open\b", r"\bthis request (falls|is) outside\b",
    r"\b(tut mir leid|bedaure|bedauere|entschuldigung|leider)\b[^.!?\n]{0,60}\b(ich|mir|mich)\b", r"\b(kann|darf|möchte|will|werde|könnte) ich\b[^.!?\n]{0,60}\b(nicht|kein|keine|keinen)\b", r"\bich (kann|darf|möchte|will|werde|lehne|verweigere|gebe|enthalte|sehe mich)\b[^.!?\n]{0,70}\b(nicht|kein|keine|keinen|ab|mich|außerstande)\b", r"\blehne ich\b", r"\bals (ki|sprachmodell|ki-modell)\b", r"\bnicht mein gebiet\b", r"\bgebe ich (hier )?(keine|kein)\b", r"\bfragen sie (bitte )?(jemand|einen)\b", r"\bdarf ich\b[^.!?\n]{0,60}\bkein",
    r"(抱歉|对不起|很遗憾|不好意思)[、，,]?[^。！？\n]{0,12}(我|无法|不能|帮不了|这个请求|超出)", r"我(无法|不能|不便|不会|拒绝|不予|没有看到|没办法|不参与|不回答)", r"恕(我|难)", r"作为(一个)?(ai|人工智能|语言模型|大语言模型)", r"不予(置评|评价|评分)", r"按(照)?规定我", r"我不(回答|参与|评|能|便|会)", r"请换人", r"超出了?我", r"信息不足[、，,]我", r"帮不了",
    r"\b(извините|простите|к сожалению|прошу прощения)\b", r"\bя не (могу|буду|вправе|стану|хочу|в состоянии)\b", r"\bкак языковая модель\b", r"\bотказываюсь\b", r"\bвоздержусь\b",
    r"\b(désolée?|je regrette|malheureusement)\b[^.!?\n]{0,60}\b(je|pas|me|moi)\b", r"\bje (ne peux|ne puis|refuse|ne suis pas|préfère ne|m'abstiens|dois décliner)\b", r"\ben tant que modèle\b",
    r"\b(lo siento|lamentablemente|disculpe)\b", r"\bno puedo\b[^.!?\n]{0,40}\b(evaluar|juzgar|calificar|ayudar|dar|opinar)\b", r"\bprefiero no\b", r"\bcomo modelo de lenguaje\b", r"\bme niego\b", r"\bdebo declinar\b",
]


def _phrases(patterns: list[str]) -> re.Pattern:
    """One expression of many: groups keep nothing, and all that begin at a word's edge look for it once."""
    plain = [re.sub(r"\((?!\?)", "(?:", p) for p in patterns]
    edge = [p[2:] for p in plain if p.startswith(r"\b")]
    return re.compile("|".join([r"\b(?:" + "|".join(edge) + ")"] * bool(edge) + [p for p in plain if not p.startswith(r"\b")]))


# Over lower-cased text; a phrase is looked for only in texts that have its letters.
_LETTERS = {"[一-鿿]": [], "[а-я]": [], "[a-z]": []}
for _p in REFUSALS:
    _LETTERS[next((k for k in _LETTERS if re.search(k, _p.replace(r"\b", ""))))].append(_p)
_BY_LETTERS = [(re.compile(k), _phrases(v)) for k, v in _LETTERS.items()]
# A judge that reports what the judged answer says or refuses doesn't refuse itself.
_THIRD = re.compile(r"^\s*(the|this) (answer|reply|candidate|response)\b|^\s*(回答|答案|该回答)|^\s*(die|diese) antwort\b|^\s*(la respuesta|la réponse|ответ)\b", re.I)


def refuses(text: str) -> bool:
    low = text.replace("’", "'").lower()
    return any(letters.search(low) and phrases.search(low) for letters, phrases in _BY_LETTERS) and not _THIRD.search(text)


_MARKS = regex.compile(r"[\p{P}\p{S}\p{Z}\s\p{Cf}]+")


def _bare(text: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKC", text).casefold())


#: Bytes of a frame of zstandard, and of a piece of the dictionary, however long it is.
FRAME, SEQUENCE = 9, 9


@lru_cache(10_000)
def _packer(question: str) -> zstandard.ZstdCompressor | None:
    """A compressor with the bared question as dictionary; None where it is shorter than a dictionary may be."""
    q = question.encode()
    if len(q) < 8:
        return None
    dictionary = zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


GRAM = 6


def copies(question: str | None, reply: str, limit: float = 0.35) -> bool:
    """The reply holds nothing but the question, whole, broken off, repeated, or with a few characters changed.

    A copy is a piece of the dictionary or several, so it needs at most SEQUENCE bytes and `limit` of its own. A question too
    short for a dictionary is compared as it is."""
    q, r = _bare(question or ""), _bare(reply)
    if not q or not r or len(r) < 0.4 * len(q):
        return False
    packer = _packer(q)
    if packer is not None:
        raw = r.encode()
        if len(packer.compress(raw)) - FRAME > SEQUENCE + limit * len(raw):
            return False
    whole = (q * (len(r) // len(q) + 2))[: len(r)]
    if r == whole or r in q:
        return True
    # A few characters changed: how much of the reply stands in pieces of GRAM characters of the question. Linear.
    known = {(q + q)[i : i + GRAM] for i in range(2 * len(q) - GRAM + 1)}
    said, end = 0, 0
    for i in range(len(r) - GRAM + 1):
        if r[i : i + GRAM] in known:
            said += i + GRAM - max(i, end)
            end = i + GRAM
    return said >= 0.85 * len(r)


# Frequent function words of languages in Latin letters.
WORDS = {
    "en": "the a an of and or to in is are was were be been it its that this these those with for on as at by from but not no only than then which who what why how does do did has have had if so still yet when while because can could would should may might must will there they them their his her he she we you your i my me about into over after before without also just more most some any all each both between never keeps states says mentions doubts names clear correctly correction answer reply",
    "de": "der die das den dem des ein eine einen einem einer eines und oder zu zum zur im in ist sind war waren wird werden wurde nicht kein keine keinen nur als dass daß mit für auf an am bei von vom aus aber sondern denn wenn weil ob wie was wer warum wo welche welcher welches dieser diese dieses sie er es wir ihr ich mich mir sich auch noch nach vor über unter durch ohne gegen um hat haben hatte kann können darf muss soll bleibt nennt antwort richtig falsche falls erst nachdem",
    "fr": "le la les l un une des du de d et ou à au aux en est sont était été être ne pas plus que qui quoi dont où ce cette ces se sa son ses leur avec pour sur dans par mais comme si il elle ils elles nous vous je tu mon aucun aucune sans sous entre reste bien fausse réponse texte cite décrit nomme",
    "es": "el la los las un una unos unas de del y o u a al en es son era fue ser no más que quien cual donde cuando como si se su sus con para por sobre sin pero porque este esta estos estas lo le les ya muy también ninguna ninguno eso queda respuesta falsa error describe menciona corrige señala",
    "it": "il lo la gli le un uno una di del della dei delle e o a al alla in è sono era non più che chi cui dove quando come se si suo sua con per su da dal dalla ma perché questo questa nessun nessuna risposta",
    "pt": "o a os as um uma de do da dos das e ou em no na nos nas é são era foi ser não mais que quem onde quando como se seu sua com para por sobre sem mas porque este esta isso resposta nenhuma",
}
# Frequent function words of further languages; those that a language above has as well don't count.
MORE_WORDS = {
    "pl": "jest nie się że odpowiedź który która które oraz ale jak tak już tylko przez przy bez pod nad dla są był była było być może ponieważ jednak gdy kiedy gdzie czy ten ta tego tej od po ze aby też bardzo żadnej nic",
    "cs": "je není se že odpověď který která které ale jako tak již jen přes při bez pod nad pro jsou byl byla bylo být může protože však když kde zda ten tato tyto toho této od po ze aby také velmi žádné nic",
    "nl": "het een niet van voor met zijn dat deze dit wordt werd worden maar ook naar omdat wanneer waar antwoord geen uit bij nog heeft hebben moet zou zij hij",
    "sv": "och att det som är inte av för på med den till har ett men var sig så från eller när han hon ska skulle svaret inga utan",
    "da": "og at det som er ikke af på med den til har et men var sig så fra eller når hun skal skulle svaret ingen uden",
    "fi": "ja on ei se että vastaus joka mutta kuin niin vain ilman alla yli ovat oli olla voi koska kuitenkin kun missä tämä nämä mitä myös hyvin",
    "hu": "és az nem hogy egy válasz amely de mint így csak által nélkül alatt felett van volt lenni lehet mert azonban amikor hol ez ezek nagyon nincs",
    "ro": "este nu și că răspunsul care sau dar cum așa doar prin fără peste pentru sunt fost poate deoarece însă când unde dacă acest această aceste din după foarte niciun",
    "tr": "ve bir bu değil için ile olarak ama daha çok var yok gibi kadar sonra önce cevap yanıt çünkü ancak nasıl nerede mi mı olduğunu doğru yanlış",
    "vi": "và là không của được trong cho với một các những này đó nhưng khi nào câu trả lời vì như từ đến rất đã sẽ có",
    "id": "yang dan ke dari untuk dengan tidak ini itu adalah pada jawaban karena tetapi atau jika bukan oleh sebagai akan telah dalam juga sudah",
}
_LANGUAGES: dict[str, list[str]] = {}
for _lang, _list in [*WORDS.items(), *MORE_WORDS.items()]:
    for _w in set(_list.split()):
        if _lang in WORDS or not any(x in WORDS for x in _LANGUAGES.get(_w, ())):
            _LANGUAGES.setdefault(_w, []).append(_lang)
_CODE = re.compile(r"`[^`]*`|[A-Za-z0-9_]+(?:[._:/][A-Za-z0-9_]+)*(?:\(\))?")
_CODE_SIGN = re.compile(r"[`_0-9()]|[._:/]|[a-z][A-Z]")


def _without_code(text: str) -> str:
    """The text without code names; every character is looked at once, however long a word is."""
    return _CODE.sub(lambda m: " " if _CODE_SIGN.search(m[0]) else m[0], text)


_QUOTED = re.compile(r"“[^”]{0,60}”|„[^“”]{0,60}[“”]|«[^»]{0,60}»|「[^」]{0,60}」|\"[^\"]{0,60}\"|‘[^’]{0,60}’|(?<!\w)'[^']{0,60}'(?!\w)")
_SCRIPTS = {"zh": r"\p{Han}", "ja": r"[\p{Hiragana}\p{Katakana}]", "ko": r"\p{Hangul}", "ru": r"\p{Cyrillic}", "ar": r"\p{Arabic}", "el": r"\p{Greek}", "he": r"\p{Hebrew}", "th": r"\p{Thai}", "hi": r"\p{Devanagari}"}
_COUNTERS = {k: regex.compile(v) for k, v in _SCRIPTS.items()}
_LATIN = regex.compile(r"\p{Latin}+")
_UKRAINIAN, _RUSSIAN = re.compile("[іїєґІЇЄҐ]"), re.compile("[ыэъёЫЭЪЁ]")


def language(text: str | None) -> str | None:
    """The language a text is mainly in, apart from code names and short quotations; None if it can't be told."""
    if not text:
        return None
    text = _QUOTED.sub(" ", _without_code(text))
    # In letters' worth: a Han character says about as much as two letters.
    weight = dict.fromkeys(_COUNTERS, 0)
    if not text.isascii():
        weight = {k: len(c.findall(text)) * (2 if k == "zh" else 1) for k, c in _COUNTERS.items()}
    words = [w.lower() for w in _LATIN.findall(text)]
    latin = sum(map(len, words))
    best = max(weight, key=weight.get)
    if weight["ja"] > 0.2 * weight["zh"] and weight["ja"]:
        best = "ja"
    if weight[best] > latin * 0.5 and weight[best] >= 2:
        return "uk" if best == "ru" and len(_UKRAINIAN.findall(text)) > len(_RUSSIAN.findall(text)) else best
    if len(words) < 2:
        return None
    score = dict.fromkeys([*WORDS, *MORE_WORDS], 0.0)
    for w in words:
        for lang in _LANGUAGES.get(w, ()):
            score[lang] += 1
    score["de"] += sum(any(c in w for c in "äöüß") for w in words) * 0.5
    first, second = sorted(WORDS, key=lambda k: -score[k])[:2]
    other = max(MORE_WORDS, key=score.get)
    n, m, k = score[first], score[second], score[other]
    if k >= 2 and k > n:
        return other
    return first if n >= 2 and n > m or n >= 1 and n >= m + 1 else None


_language_of_question = lru_cache(10_000)(language)  # one question has many replies


_CLOSERS = "\"'”’»」』）)]}*`_"


_CLOSING = "\"'”’»」』）)]}"


def _context(c: str, before: str) -> str:
    """The class of a text that ends in c, where `before` is the last character that closes nothing."""
    closed = ")" if c in _CLOSING else ""
    c = before if closed else c
    if c in ".。!！?？…;；:：,，、-–—":
        return c + closed
    if c.isspace():
        return " " + closed
    if c.isdigit():
        return "0" + closed
    return ("字" if "一" <= c <= "鿿" else "a" if c.isalpha() else unicodedata.category(c)) + closed


_context = lru_cache(200_000)(_context)


def terminal_context(text: str) -> str:
    """The class of a text's end: the last character's kind, and the mark before it if it closes something."""
    return _context(text[-1], (text.rstrip(_CLOSERS) or text[0])[-1])


#: Marks that end sentences get so many ends for a start, all other contexts so many continuations.
PRIOR = 40
#: A reason is complete if texts end after such a context at least this often.
COMPLETE = 0.05


def context_counts(reasons) -> Counter:
    """(context, ends): how often; each character is looked at once."""
    counts: Counter = Counter()
    for r in reasons:
        r = r.rstrip()
        if not r:
            continue
        before, seen = r[0], []
        for c in r:
            if c not in _CLOSERS:
                before = c
            seen.append((c, before))
        counts[(_context(*seen.pop()), True)] += 1
        for pair, n in Counter(seen).items():
            counts[(_context(*pair), False)] += n
    return counts


def train_terminal(replies: DataFrame) -> dict[str, float]:
    """P(end | context), over all distinct reasons. There are at most some 200 contexts, so the table is small."""
    shape = T.StructType([T.StructField("context", T.StringType()), T.StructField("ends", T.BooleanType()), T.StructField("n", T.LongType())])

    def run(batches):
        for pdf in batches:
            counts = context_counts(pdf["reason"].dropna())
            yield pd.DataFrame([(c, e, n) for (c, e), n in counts.items()], columns=["context", "ends", "n"])

    rows = replies.select("reason").where("reason is not null").distinct().mapInPandas(run, shape).groupBy("context", "ends").agg(F.sum("n").alias("n")).collect()
    return terminal_model({(r["context"], r["ends"]): r["n"] for r in rows})


def terminal_model(counts: dict) -> dict[str, float]:
    model = {}
    for c in {c for c, _ in counts} | set(".。!！?？…"):
        ends, on = counts.get((c, True), 0), counts.get((c, False), 0)
        prior = PRIOR if c[0] in ".。!！?？…" else 0
        model[c] = (ends + prior) / (ends + on + prior + (0 if prior else PRIOR))
    return model


def breaks_off(reason: str, model: dict[str, float]) -> bool:
    r = reason.rstrip()
    if not r:
        return False
    if model.get(terminal_context(r), 0.0) < COMPLETE:
        return True
    last = r.rstrip(_CLOSERS)
    return r.endswith(("...", "…")) or not last


def defect(question: str | None, verdict: str | None, reason: str | None, broken: bool, model: dict[str, float]) -> str | None:
    if broken:
        return "truncated"
    if verdict is None and reason is None:
        return "empty"
    if reason is None:
        return None
    if refuses(reason):
        return "refusal"
    if copies(question, reason):
        return "copied_question"
    asked, said = _language_of_question(question), language(reason)
    if asked and said and asked != said:
        return "other_language"
    return "truncated" if breaks_off(reason, model) else None


def parsed(pairs: DataFrame, key: str = "row_no", question: str = "question", reply: str = "raw_response") -> DataFrame:
    """(key, question, verdict, reason, broken) of every pair."""
    shape = T.StructType([T.StructField("key", T.LongType()), T.StructField("question", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("broken", T.BooleanType())])

    def run(batches):
        for pdf in batches:
            got = [read_reply(r) for r in pdf["raw"]]
            yield pd.DataFrame({"key": pdf["key"], "question": pdf["question"], "verdict": [str(g[0]) if g[0] is not None else None for g in got], "reason": [g[1] for g in got], "broken": [g[2] for g in got]})

    return pairs.select(F.col(key).cast("long").alias("key"), F.col(question).alias("question"), F.col(reply).alias("raw")).mapInPandas(run, shape)


def broken_pairs(pairs: DataFrame, key: str = "row_no", question: str = "question", reply: str = "raw_response") -> DataFrame:
    """(key, defect) of every defective pair, all copies of a row included; an empty table gives an empty result."""
    replies = stored(parsed(pairs, key, question, reply), "broken-pairs")
    model = train_terminal(replies)
    shape = T.StructType([T.StructField(key, T.LongType()), T.StructField("defect", T.StringType())])

    def run(batches):
        judge = lru_cache(20_000)(lambda *x: defect(*x, model))
        for pdf in batches:
            found = [judge(*row) for row in zip(*(pdf[c].where(pdf[c].notna(), None) for c in ("question", "verdict", "reason", "broken")))]
            out = pd.DataFrame({key: pdf["key"], "defect": found})
            yield out[out["defect"].notna()]

    return replies.mapInPandas(run, shape)
