"""Group keys: text form of a value and intersectional (composite) attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text a missing value takes inside a composite key.
MISSING_TEXT = "nan"


def key_string(c, missing: str = MISSING_TEXT) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(missing))


def composite_key(cols: Sequence[str], sep: str = "_", missing: str = MISSING_TEXT) -> Column:
    """``str(a)_str(b)...``; nulls become ``missing`` (``concat_ws`` would skip them)."""
    if len(cols) == 1:
        return F.col(cols[0])
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(key_string(c, missing))
    return F.concat(*parts)


def composite_name(cols: Sequence[str], sep: str = "_") -> str:
    return sep.join(cols)
