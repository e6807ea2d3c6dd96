"""The form of a database name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.session import strip


def plain_db_id(c: Column) -> Column:
    """White space trimmed, lower case, each run of spaces, hyphens and underscores one underscore; null for null and blank."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), "[ _-]+", "_"), F.lit(""))
