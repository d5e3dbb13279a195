"""Scalar text functions as Spark expressions: all stay in the JVM. Null gives null unless said otherwise."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import STOP_WORDS, TECH_TERMS, equivalents

HAN = "[一-鿿㐀-䶿]+"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def grams(word: Column, n: Column | int) -> Column:
    """All substrings of n characters; none if the word is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(word) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, n))).otherwise(F.array().cast("array<string>"))


def zh_terms(text: Column) -> Column:
    """Search terms, repeats kept: Latin words and mixed numbers in lower case with two characters or more, then of each Han
    run all 2-, 3- and 4-grams (a single character as it is). Null gives an empty list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))
    runs = F.regexp_extract_all(low, F.lit(f"({HAN})"), F.lit(1))
    han = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(grams(r, 2), grams(r, 3), grams(r, 4))))
    return F.concat(words, F.flatten(han))


def drop_stop_words(terms: Column) -> Column:
    """Whole terms only; repeats of the others stay."""
    return F.filter(terms, lambda t: ~t.isin(*sorted(STOP_WORDS)))


def other_forms(word: Column) -> Column:
    """Abbreviations and full words for a word, whatever its case; none gives an empty list."""
    table = F.create_map(*[x for k, v in equivalents().items() for x in (F.lit(k), _strings(*v))])
    return F.coalesce(table[F.lower(word)], F.array().cast("array<string>"))


def tech_terms(text: Column) -> Column:
    """Array of (term, shown) of technologies named in the text at word boundaries, in the list's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(low.rlike(f"(?<![a-z0-9]){t}(?![a-z0-9])"), F.struct(F.lit(t).alias("term"), F.lit(s).alias("shown"))) for t, s in TECH_TERMS.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def half_width(text: Column) -> Column:
    """Full-width ASCII and the ideographic space in their half-width form; case stays. Null gives an empty text."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return F.translate(F.coalesce(text, F.lit("")), wide, plain)


# Forms that make a question name code.
CODE_FORMS = (
    r"`[^`]+`",
    r"[A-Za-z_]*[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]*|_[A-Za-z][A-Za-z0-9_]*",
    r"[A-Za-z][a-z0-9]*[a-z][A-Z][A-Za-z0-9]*",
    r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+",
    r"[A-Za-z0-9_./\-]*[A-Za-z0-9_]\.(?:py|pyi|js|jsx|ts|tsx|json|md|txt|ya?ml|toml|cfg|ini|sql|sh|html?|css|xml|rs|go|java|c|cpp|h)\b",
    r"#\d+",
    r"/[A-Za-z][A-Za-z0-9_\-]*(?:/[A-Za-z0-9_\-{}:]+)*",
)


def has_code_token(text: Column) -> Column:
    """Whether any form of code occurs; a single lower-case word doesn't count. Null counts as no."""
    text = F.coalesce(text, F.lit(""))
    return functools.reduce(operator.or_, (text.rlike(f) for f in CODE_FORMS))


def first_line_or_null(text: Column) -> Column:
    """First line of the trimmed text, null if blank."""
    line = F.trim(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"\r\n|\r|\n")[0])
    return F.when(line != "", line)


def first_filled_line(text: Column) -> Column:
    """First line that isn't blank, trimmed; an empty text if there is none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) for an array-valued body, with the value worked out once."""
    return F.flatten(F.transform(F.array(value), body))


def candidates(question: Column) -> Column:
    """Names a question may mean, distinct: identifier chains, their ends, 1- to 3-grams of words joined by _ and .,
    other forms of each word; with two characters or more and not only digits."""
    none = F.array().cast("array<string>")
    chains = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(f"({IDENT})"), F.lit(1))

    def ends(chain: Column) -> Column:
        p = F.split(chain, r"\.")
        return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.size(p), F.lit(2))), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))).otherwise(none)

    def joined(words: Column, n: int, mark: str) -> Column:
        last = F.size(words) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), mark))).otherwise(none)

    def of_words(words: Column, others: Column) -> Column:
        return F.concat(others, *[joined(words, n, m) for n, m in ((1, "_"), (2, "_"), (2, "."), (3, "_"), (3, "."))])

    # let() hands an array on as a lambda's variable, so what is made from it doesn't work it out again for every element.
    # The other forms join the row of words before it is cut into grams.
    words = F.flatten(F.transform(chains, lambda c: F.split(c, r"\.")))
    grams_of = let(words, lambda w: let(F.flatten(F.transform(w, other_forms)), lambda o: let(F.concat(w, o), lambda every: of_words(every, o))))
    every = F.concat(chains, F.flatten(F.transform(chains, ends)), grams_of)
    return F.array_distinct(F.filter(every, lambda c: (F.length(c) >= 2) & ~c.rlike("^[0-9]+$")))


def concept_key(name: Column) -> Column:
    """Lower case without white space and hyphens."""
    return F.regexp_replace(F.lower(F.trim(name)), r"(?U)[\s\-]+", "")


#: Words of a key filter, 2 MB in all whatever the number of keys, and bits that a key sets in its word.
FILTER_WORDS, FILTER_BITS = 1 << 18, 3


def _filter_place(key: Column) -> tuple[Column, Column]:
    """A key's word in a key filter, and its bits there."""
    h = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", h, F.lit(18 + 6 * i)).bitwiseAND(63).cast("int")) for i in range(FILTER_BITS)]
    return h.bitwiseAND(FILTER_WORDS - 1).cast("int"), functools.reduce(Column.bitwiseOR, bits)


def may_be_in(value: Column, keys: DataFrame, key: str) -> Column:
    """Whether the value may be one of the keys: always true if it is, seldom if it isn't. The keys are handed on as an array
    of bits of fixed size, worked out before the plan that asks; not for use within lambdas."""
    word, bits = _filter_place(F.col(key))
    every = keys.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    words = keys.where(F.col(key).isNotNull()).select(word.alias("w"), bits.alias("b")).unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    known = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("known")).scalar()
    word, bits = _filter_place(value)
    return F.get(known, word).bitwiseAND(bits) == bits


def bigrams(text: Column) -> Column:
    """Distinct character pairs of the lower-case text without white space; a shorter text is its own."""
    t = F.regexp_replace(F.lower(text), r"(?U)\s+", "")
    return F.when(F.length(t) < 2, F.filter(F.array(t), lambda x: x != "")).otherwise(F.array_distinct(grams(t, 2)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements by all elements; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dotted_module(path: Column, roots: tuple[str, ...] = ("src",)) -> Column:
    """Dotted name of a source path: without the source root, /__init__.py and .py."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, f"^(?:{'|'.join(roots)})/", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"/__init__\.py$", ""), r"\.py$", ""), "/", ".")


def tidy(values: Column) -> Column:
    """Trimmed, filled, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")), lambda v: v.isNotNull() & (v != "")))


def identifiers_not_in(text: Column, source: Column) -> Column:
    """Identifiers that the text names but the source doesn't contain."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1)), lambda i: ~F.contains(F.coalesce(source, F.lit("")), i)))


def has_token(text: Column, token: Column) -> Column:
    """Whether the token stands in the text with no identifier character beside it."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), token, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.regexp_like(F.coalesce(text, F.lit("")), quoted)


def fixes(message: Column) -> Column:
    """Array of (number, pattern) of the issues a commit message closes: of each number the last explicit keyword,
    else a plain (#n), which is a pull request."""
    explicit = F.lit(r"(?i)\b(fix(?:es|ed)?|close[sd]?|resolve[sd]?)\s+#(\d+)")
    m = F.coalesce(message, F.lit(""))
    words, numbers = F.regexp_extract_all(m, explicit, F.lit(1)), F.regexp_extract_all(m, explicit, F.lit(2))
    strong = F.zip_with(numbers, words, lambda n, w: F.struct(n.cast("int").alias("number"), F.lower(w).alias("pattern")))
    weak = F.transform(F.regexp_extract_all(F.split(m, "\n")[0], F.lit(r"\(#(\d+)\)"), F.lit(1)), lambda n: F.struct(n.cast("int").alias("number"), F.lit("pr_ref").alias("pattern")))
    known = F.transform(strong, lambda s: s["number"])
    kept = F.filter(strong, lambda s, i: ~F.exists(F.slice(strong, i + 2, F.size(strong)), lambda t: t["number"] == s["number"]))
    return F.concat(kept, F.array_distinct(F.filter(weak, lambda w: ~F.array_contains(known, w["number"]))))


def parsed_time(text: Column) -> Column:
    """ISO-8601 to a timestamp, null where it isn't one."""
    return F.try_to_timestamp(text)


def endpoint(decorators: Column, arguments: Column, patterns: tuple[str, ...]) -> Column:
    """(http_method, route_path) of the first decorator that any pattern matches, else null."""
    rule = "|".join(f"(?:{p})" for p in patterns)
    hit = F.get(F.filter(F.arrays_zip(decorators.alias("d"), arguments.alias("a")), lambda x: x["d"].rlike(rule)), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(F.upper(F.element_at(F.split(hit["d"], r"\."), -1)).alias("http_method"), hit["a"].alias("route_path")))

