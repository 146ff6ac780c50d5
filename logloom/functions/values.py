"""Small values that callers hand in: flags, ids, texts for a limited place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean yes, whatever the case; characters of an id besides letters and digits.
YES, ID_SIGNS = ("1", "true", "yes", "on"), "-_"


def flag(c: Column, default: bool = False) -> Column:
    """Whether a text means yes; null gives the default, any other text no."""
    return F.coalesce(F.lower(F.btrim(c)).isin(*YES), F.lit(default))


def safe_id(c: Column) -> Column:
    """The id in lower case, null for one that holds anything but letters, digits, - and _ (an empty one too)."""
    return F.when(c.rlike(rf"^[\p{{L}}\p{{N}}{ID_SIGNS}]+$"), F.lower(c))


def head_and_tail(c: Column, most: int = 60_000, head: float = 0.7) -> Column:
    """A text of more than `most` characters as its begin and its end, with what was left out between them said."""
    first, last = int(most * head), int(most * (1 - head) + 0.5)
    size = F.length(c)
    return F.when(size > most, F.concat(F.substring(c, 1, first), F.format_string("\n\n... [middle truncated, original size %d chars] ...\n\n", size), F.right(c, F.lit(last)))).otherwise(c)
