"""Visually identical text with different characters: one plain form for every text.

A mapping from character sequences to their plain spelling is computed by rule from the Unicode database
(widths, compatibility forms, Han radicals, accents, spaces, hyphens, invisible characters), checked for
conflicts together with the look-alike letters, and compiled into a trie that a longest-match pass over grapheme
clusters applies. Which of a letter's look-alikes is meant depends on the word it stands in, so the pass spells each
word in the letters of its own language. Respelled letters may compose with a mark behind them; the pass is repeated
until nothing changes, which takes one further look at almost every text.

Case, punctuation, doubled ordinary spaces, genuine accents, Greek signs and Russian words are left alone.
Null stays null, an empty text stays empty; text that is all ASCII is plain and never leaves the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic, Greek and other letters that look like a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    "ѐ": "è", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "σ": "o",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J", "ϱ": "p", "ϰ": "k", "ϵ": "e",
    "ⲟ": "o", "Ⲟ": "O", "ⲣ": "p", "Ⲣ": "P", "ⲥ": "c", "Ⲥ": "C", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓒ": "d", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
#: Roman numerals of one letter, by rule.
ROMAN = {chr(p): unicodedata.normalize("NFKC", chr(p)) for p in range(0x2160, 0x2180) if len(unicodedata.normalize("NFKC", chr(p))) == 1}
# Letters of the table above that only resemble the Latin letter within a word of Latin letters.
WEAK = set("вкмптгёѐїЁЇεικτυχγηωσαԌϱϰϵ")
# Han radicals without a decomposition in the Unicode database.
RADICALS = {"⺠": "民", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙"}
# Full-width marks that are ordinary in Chinese text.
HAN_MARKS = set("，！？：；（）～")
# Characters that look like a hyphen.
HYPHENS = "‐‑‒⁃−˗﹣－"
# Invisible characters that the database does not class as format characters.
BLANKS = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"


def build_mapping() -> dict[str, str]:
    """Sequence to plain spelling; raises if two rules disagree or a result is not plain itself."""
    mapping: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if mapping.setdefault(key, value) != value:
            raise ValueError(f"two rules for {key!r}: {mapping[key]!r} and {value!r}")

    for c in HYPHENS:
        put(c, "-")
    for c in BLANKS:
        put(c, "")
    for k, v in RADICALS.items():
        put(k, v)
    for point in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]:
        c = chr(point)
        kind = unicodedata.category(c)
        if c in mapping or c in HAN_MARKS:
            continue
        if kind == "Cf" or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            put(c, "")
        elif kind in ("Zs", "Zl", "Zp"):
            put(c, " ")
        elif form := unicodedata.decomposition(c):
            if form.startswith(("<wide>", "<narrow>", "<font>")) or form.startswith("<compat>") and (0x2E80 <= point <= 0x2FDF or 0xFB00 <= point <= 0xFB06):
                put(c, unicodedata.normalize("NFKC", c))
            elif not form.startswith("<"):
                composed = unicodedata.normalize("NFC", c)
                if composed != c:
                    put(c, composed)
                else:  # every canonical spelling of a composed character
                    put(unicodedata.normalize("NFD", c), c)
    for _ in range(3):  # a target that another rule changes is replaced by its own plain spelling
        for k, v in mapping.items():
            mapping[k] = "".join(mapping.get(x, x) for x in v)
    for k, v in mapping.items():
        if any(x in mapping for x in v):
            raise ValueError(f"{k!r} gives {v!r}, which is not plain")
    return mapping


def build_lookalikes(mapping: dict[str, str]) -> dict[str, str]:
    """Letter to the Latin letter it looks like; raises if a letter has a plain spelling already or its double isn't plain."""
    out = LOOKALIKES | ROMAN
    for k, v in out.items():
        if k in mapping or v in mapping or any(x in out for x in v) or unicodedata.normalize("NFC", v) != v:
            raise ValueError(f"{k!r} looks like {v!r}, against the mapping")
    return out


class Transducer:
    """Longest match over the clusters of a text, each word in its own letters."""

    def __init__(self) -> None:
        self.trie: dict = {}
        mapping = build_mapping()
        for key, value in mapping.items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[None] = value
        single = "".join(regex.escape(k) for k in mapping if len(k) == 1)
        self.suspect = regex.compile(f"[{single}\\p{{M}}]")
        self.to_latin = build_lookalikes(mapping)
        scripts = r"\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Coptic}\p{Cherokee}\p{Lisu}"
        self.word = regex.compile(f"[{scripts}][{scripts}\\p{{M}}]*")
        self.foreign = regex.compile("[" + scripts.removeprefix(r"\p{Latin}") + "".join(c for c in self.to_latin if regex.match(r"\p{Latin}", c)) + "]")
        self.cluster = lru_cache(50_000)(self._cluster)
        self.to_cyrillic = {}
        for k, v in self.to_latin.items():
            if "А" <= k <= "я" and k not in WEAK:
                self.to_cyrillic.setdefault(v, k)

    def _cluster(self, cluster: str) -> str:
        base = cluster[0]
        if regex.search(r"\p{Extended_Pictographic}", cluster) or "؀" <= base <= "෿" and ("‌" in cluster or "‍" in cluster):
            return cluster  # joiners that shape emoji or letters are visible
        out, i = [], 0
        while i < len(cluster):
            node, j, best = self.trie, i, None
            while j < len(cluster) and cluster[j] in node:
                node = node[cluster[j]]
                j += 1
                if None in node:
                    best = (j, node[None])
            if best:
                i = best[0]
                out.append(best[1])
            else:
                out.append(cluster[i])
                i += 1
        done = unicodedata.normalize("NFC", "".join(out))
        return done if done == cluster else self._cluster(done) if done else done

    @staticmethod
    @lru_cache(10_000)
    def _script(c: str) -> str:
        name = unicodedata.name(c, "")
        return "L" if name.startswith(("LATIN", "ROMAN", "SMALL ROMAN")) else "C" if name.startswith("CYRILLIC") else "G" if name.startswith("GREEK") else "O"

    def _genuine(self, word: str) -> bool:
        """A word of one foreign script that holds a letter without a Latin double."""
        kinds = {self._script(c) for c in word if c.isalpha()}
        return len(kinds) == 1 and kinds <= {"C", "G", "O"} and any(c not in self.to_latin or c in WEAK for c in word)

    def _respell(self, word: str, russian: bool, greek: bool) -> str:
        kinds = [self._script(c) for c in word if c.isalpha()]
        have = set(kinds)
        if have == {"L"}:
            return "".join(self.to_latin.get(c, c) for c in word) if len(word) > 1 else word
        if len(have) == 1:
            if have == {"G"} and (greek or len(word) == 1):
                return word
            if russian or any(c.isalpha() and (c not in self.to_latin or c in WEAK) for c in word):
                return word
            return "".join(self.to_latin.get(c, c) for c in word)
        fixed = {self._script(c) for c in word if c.isalpha() and self._script(c) != "L" and c not in self.to_latin}
        if "G" in fixed and "C" not in have:  # a Greek sign beside Latin letters
            return word
        latin_only = sum(k == "L" and c not in self.to_cyrillic for k, c in zip(kinds, [c for c in word if c.isalpha()]))
        if ("C" in fixed or kinds.count("C") > kinds.count("L")) and not latin_only:
            return "".join(self.to_cyrillic.get(c, self.to_cyrillic.get(self.to_latin.get(c, ""), c)) if self._script(c) != "C" else c for c in word)
        return "".join(self.to_latin.get(c, c) for c in word)

    def __call__(self, text: str | None) -> str | None:
        seen: list = []
        while text not in seen:  # were spellings ever to alternate, the smallest of them is the plain one
            seen.append(text)
            text = self._once(text)
        return text if text is None else min(seen[seen.index(text) :])

    def _once(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        if self.suspect.search(text):
            text = "".join(map(self.cluster, regex.findall(r"\X", text)))
            text = unicodedata.normalize("NFC", text)
        if self.foreign.search(text):
            words = self.word.findall(text)
            genuine = [w for w in words if self._genuine(w)]
            russian = any(self._script(w[0]) == "C" for w in genuine)
            greek = any(self._script(w[0]) == "G" and len(w) > 1 for w in genuine)
            text = unicodedata.normalize("NFC", self.word.sub(lambda m: self._respell(m[0], russian, greek), text))
        return text


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(T.StringType())
def _plain(texts: pd.Series) -> pd.Series:
    return texts.map(transducer(), na_action="ignore")


def plain_form(df: DataFrame, column: str, out: str = "plain") -> DataFrame:
    """df with its column's plain form; only rows that are not all ASCII pass through Python."""
    odd = F.col(column).rlike(r"[^\x00-\x7F]")
    ascii_rows = df.where(~odd | F.col(column).isNull()).withColumn(out, F.col(column))
    return ascii_rows.unionByName(df.where(odd).withColumn(out, _plain(F.col(column))))


def not_plain(df: DataFrame, table: str, key: str, column: str) -> DataFrame:
    """(table_name, record_key, plain) of the rows whose text is not in plain form, once each."""
    odd = df.where(F.col(column).rlike(r"[^\x00-\x7F]")).select(F.col(key).cast("string").alias("record_key"), F.col(column).alias("text")).distinct()
    found = odd.withColumn("plain", _plain(F.col("text"))).where(~F.col("plain").eqNullSafe(F.col("text")))
    return found.select(F.lit(table).alias("table_name"), "record_key", "plain").distinct()


def bare(column: Column) -> Column:
    """What is left of a plain text once case, spaces and punctuation are ignored."""
    return F.regexp_replace(F.lower(column), r"[\p{P}\p{S}\p{Z}\s]+", "")
