"""Small text functions on columns: code points, lossy decoding, sub-queries, boundaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = float("-inf")
#: Bytes a pattern's text may hold: printable ASCII. Texts of molecules and queries may hold any.
PRINTABLE, BYTES = range(32, 127), range(256)


def weight(allowed: Column) -> Column:
    """A critic's log-weight: 0 where allowed, else minus infinity; null where that is null."""
    return F.when(allowed, F.lit(0.0)).when(~allowed, F.lit(NEVER))


def text_of_codes(codes: Column) -> Column:
    """The text of an array of code points."""
    return F.array_join(F.transform(codes, lambda c: F.when(c < 128, F.char(c)).otherwise(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))), "")


@F.pandas_udf(T.StringType())
def text_of_bytes(raw: pd.Series) -> pd.Series:
    """Bytes as UTF-8, what is none left out, without one leading space."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore").removeprefix(" "))


def is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def latest_subquery(sql: Column) -> Column:
    """The last parenthesised SELECT, closed or open, trimmed; null for none."""
    found = F.regexp_extract_all(sql, F.lit(r"(?is)\(\s*(select[^()]*(?:\([^()]*\)[^()]*)*?)(?:\)|$)"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(F.size(found) > 0, F.regexp_replace(last, r"^\s+|\s+$", ""))


def stripped_at_boundary(sql: Column) -> Column:
    """sql without a trailing WHERE, GROUP BY or ORDER; null where it ends otherwise. The characters of that ending, not the
    word, are trimmed, so that a name made of them loses its end too."""
    out = F.lit(None).cast("string")
    for end in (" ORDER", " GROUP BY", " WHERE"):
        out = F.when(sql.endswith(end), F.rtrim(sql, F.lit(end))).otherwise(out)
    return out


def trimmed(c: Column) -> Column:
    """c without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")
