"""Matching whole texts and prefixes against patterns: the JVM for portable patterns, an Arrow UDF for the others."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.texts import weight

try:
    import regex as engine

    FULL = True
except ImportError:  # patterns beyond the standard library's are then reported as unsupported
    import re as engine

    FULL = False

_COMPILED: dict = {}
_MOST = 4096

#: Patterns that Java and the UDF's engine read alike, and that both can read: literals, classes, groups to a depth of two,
#: alternation, greedy and lazy quantifiers, anchors. Possessive quantifiers, look-around, back-references, set operations
#: and ranges other than the usual ones are not among them.
_QUANTIFIER = r"(?:(?:[*+?]|\{[0-9]{1,3},?\})\??)?"
_ATOM = (
    r"(?:[A-Za-z0-9 _@#%,:;=<>~!\"'`/&-]|\\[dws.+*?()\[\]{}|^$\\/-]|\."
    r"|\[\^?(?:a-z|A-Z|0-9|\\[dws.\]\[-]|[A-Za-z0-9 _@#%,:;=<>!\"'`/.+*?()|$])+\])" + _QUANTIFIER
)
_FLAT = rf"(?:{_ATOM}|[|^$])*"
_NESTED = rf"(?:{_ATOM}|[|^$]|\((?:\?:)?{_FLAT}\){_QUANTIFIER})*"
PORTABLE = rf"^(?:{_ATOM}|[|^$]|\((?:\?:)?{_NESTED}\){_QUANTIFIER})*$"
_PLAIN = r"^[\x20-\x7e]*$"


def _compiled(pattern: str):
    found = _COMPILED.get(pattern)
    if found is None:
        if len(_COMPILED) >= _MOST:
            _COMPILED.clear()
        found = _COMPILED[pattern] = engine.compile(pattern)
    return found


def match_desc(pattern: str | None, text: str | None, timeout: float | None = None) -> str | None:
    """valid, invalid, timeout or unsupported (the engine can't read the pattern); null for nulls."""
    if pattern is None or text is None:
        return None
    try:
        compiled = _compiled(pattern)
    except Exception:
        return "unsupported"
    try:
        hit = compiled.fullmatch(text, timeout=timeout) if FULL and timeout else compiled.fullmatch(text)
    except TimeoutError:
        return "timeout"
    return "valid" if hit else "invalid"


def prefix_ok(pattern: str | None, text: str | None) -> bool | None:
    """True if the text can be continued to a match of the whole pattern, or is one."""
    if pattern is None or text is None:
        return None
    hit = _compiled(pattern).fullmatch(text, partial=True) if FULL else _compiled(pattern).fullmatch(text)
    return hit is not None


def _udf(timeout: float | None):
    @F.pandas_udf(T.StringType())
    def desc(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for patterns, texts in parts:
            yield pd.Series([match_desc(p, t, timeout) for p, t in zip(patterns, texts)], dtype=object)

    return desc


@F.pandas_udf(T.BooleanType())
def _prefix(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for patterns, texts in parts:
        yield pd.Series([prefix_ok(p, t) for p, t in zip(patterns, texts)], dtype=object)


def score_patterns(df: DataFrame, pattern: str, response: str, timeout: float | None = 5.0) -> DataFrame:
    """df with score (1 or 0) and desc (valid, invalid, timeout, unsupported): does the response match the whole pattern?

    Rows of portable patterns and printable ASCII text are matched in the JVM; of them Python sees nulls only, so the input
    is read once. Null patterns and responses have a null desc and score 0.
    """
    p, t = F.col(pattern), F.col(response)
    marked = df.withColumn("_plain", F.coalesce(p.rlike(PORTABLE) & t.rlike(_PLAIN), F.lit(False)))
    quick = F.when(F.call_function("rlike", t, F.concat(F.lit("^(?:"), p, F.lit(")$"))), "valid").otherwise("invalid")
    slow = _udf(timeout)(F.when(~F.col("_plain"), p), F.when(~F.col("_plain"), t))
    return marked.withColumn("desc", F.when(F.col("_plain"), quick).otherwise(slow)).drop("_plain").withColumn("score", F.when(F.col("desc") == "valid", 1.0).otherwise(0.0))


#: Of the portable patterns those that Java and the UDF's engine read alike over any text, not only ASCII: no dot, no anchors,
#: no classes by letter.
_ANY_TEXT = re.compile(r"^(?:[^\\.^$\[]|\\[.+*?()\[\]{}|^$/-]|\[\^?[^\\\[\]]+\])*$")


def full_match(pattern: str, text: Column, timeout: float | None = 5.0) -> Column:
    """Boolean: does text match the whole of one literal pattern? In the JVM where both engines read it alike."""
    if re.match(PORTABLE, pattern) and _ANY_TEXT.match(pattern):
        return text.rlike(rf"\A(?:{pattern})\z")
    return _udf(timeout)(F.lit(pattern), text) == "valid"


def complete_weight(pattern: Column | str, text: Column, timeout: float | None = 5.0) -> Column:
    """A critic's weight of a complete text: 0 if it matches the whole pattern, else minus infinity. A literal pattern is
    routed as by full_match."""
    if isinstance(pattern, str):
        return weight(full_match(pattern, text, timeout))
    return weight(_udf(timeout)(pattern, text) == "valid")


def prefix_weight(pattern: Column, text: Column) -> Column:
    """A critic's weight of an unfinished text: 0 if it can still become a match, else minus infinity."""
    return weight(_prefix(pattern, text))
