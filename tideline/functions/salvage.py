"""Lists, objects and ratings out of texts that should be JSON but are cut off or wrapped in prose."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What ends the text of a value that is no string.
_ENDS = ",]} \t\r\n"


def repaired(text: str | None, opening: str) -> str | None:
    """The first array or object ('[' or '{') of a text, closed where it was cut off; None without one.

    A stack holds the brackets that are open. Whenever a value has ended, the text so far and
    the open brackets make a whole one; of a cut text the last such place counts, so what
    was complete is kept and a half value, or a name without a value, goes. A bracket that
    doesn't fit ends the text.
    """
    start = (text or "").find(opening)
    if start < 0:
        return None
    stack, good, i, n = [], None, start, len(text)
    wants_name = False  # the next string of an object is a name, not a value
    while i < n:
        c = text[i]
        if c in "[{":
            stack.append("]" if c == "[" else "}")
            wants_name = c == "{"
            if good is None or len(stack) > 1:
                good = (i + 1, list(stack)) if len(stack) == 1 or stack[-2] == "]" or not wants_name else good
        elif c in "]}":
            if stack[-1] != c:
                break
            stack.pop()
            if not stack:
                return text[start : i + 1]
            wants_name, good = False, (i + 1, list(stack))
        elif c == ",":
            wants_name = stack[-1] == "}"
        elif c == ":":
            wants_name = False
        elif c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            if j >= n:
                break
            if not wants_name:
                good = (j + 1, list(stack))
            i = j
        elif c not in " \t\r\n":
            j = i
            while j < n and text[j] not in _ENDS:
                j += 1
            if j == n:
                break
            good, i = (j, list(stack)), j - 1
        i += 1
    if good is None:
        return None
    return text[start : good[0]].rstrip().rstrip(",") + "".join(reversed(good[1]))


@F.pandas_udf(StringType())
def repaired_list(texts: pd.Series) -> pd.Series:
    """repaired() of the first array."""
    return texts.map(lambda t: repaired(t, "["))


@F.pandas_udf(StringType())
def repaired_object(texts: pd.Series) -> pd.Series:
    """repaired() of the first object."""
    return texts.map(lambda t: repaired(t, "{"))


def phrases(text: Column, most: int, strip: str = "", least: int = 3, longest: int = 120) -> Column:
    """The distinct texts of a list in order, squeezed, of three characters at least, whatever their case; empty if there is no list."""
    found = F.coalesce(F.from_json(repaired_list(text), "array<string>"), F.array().cast("array<string>"))
    clean = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    if strip:
        clean = F.transform(clean, lambda x: F.trim(x, F.lit(strip)))
    clean = F.filter(F.transform(clean, lambda x: F.substring(x, 1, longest)), lambda x: F.length(x) >= least)
    once = lambda kept, x: F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.slice(F.aggregate(clean, F.array().cast("array<string>"), once), 1, most)


def _rated(value: Column) -> Column:
    """score (0 to 10) and reason of an object or a bare number, as JSON text."""
    whole = F.from_json(value, "score double, reason string")
    bare = value.try_cast("double")
    score = F.coalesce(whole["score"], F.get_json_object(value, "$.score").try_cast("double"), bare)
    reason = F.substring(F.trim(F.coalesce(F.get_json_object(value, "$.reason"), F.lit(""))), 1, 200)
    return F.struct(F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))).alias("score"), reason.alias("reason"))


def ratings(text: Column) -> Column:
    """A map from number to (score, reason), of all entries that are complete; null scores are left out."""
    entries = F.from_json(repaired_object(text), "map<string,string>")
    kept = F.map_filter(F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda k, v: k.rlike("^[0-9]+$") & v.isNotNull())
    rated = F.transform_values(F.transform_keys(kept, lambda k, v: k.cast("int")), lambda k, v: _rated(v))
    return F.map_filter(rated, lambda k, v: v["score"].isNotNull())


def rating(text: Column) -> Column:
    """(score, reason) of one rated thing: from an object, else the first number from 0 to 10 in the text; null if it has none."""
    own = _rated(repaired_object(text))
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<![\d.])(10|\d)(?:[.,]\d)?(?!\d)", 1).try_cast("double")
    plain = F.when(number.isNotNull(), F.struct(number.alias("score"), F.lit("").alias("reason")))
    return F.when(own["score"].isNotNull(), own).otherwise(plain)
