"""JSON within prose: the outermost object of a text, loose verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def outermost(text: str | None) -> str | None:
    """The text from the first '{' to its closing '}', strings respected; null if there is none or it doesn't close."""
    if text is None or (start := text.find("{")) < 0:
        return None
    depth, quoted = 0, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted = c != '"' or _odd_backslashes(text, i)
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def _odd_backslashes(text: str, at: int) -> bool:
    n = 0
    while at - n - 1 >= 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


@F.pandas_udf(T.StringType())
def _outermost(texts: pd.Series) -> pd.Series:
    return texts.map(outermost, na_action="ignore")


def last_reply(text: Column) -> Column:
    """What follows the last <retry>, which is the reply that counts; a text without one as it is."""
    return F.substring_index(text, "<retry>", -1)


def outer_object(text: Column) -> Column:
    """outermost() as an expression: brace matching is the one thing here that the JVM's functions can't say. A text that
    is one object as a whole stays in the JVM."""
    whole = F.trim(text).startswith("{") & F.trim(text).endswith("}") & F.try_parse_json(text).isNotNull()
    return F.when(whole, F.trim(text)).otherwise(_outermost(text))
