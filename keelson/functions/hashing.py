"""Seeded per-row uniform numbers that any SQL engine can reproduce.

``hash_uniform`` maps (key..., seed) to [0, 1) from the first 32 bits of an
MD5 digest.  It depends only on the row's values, never on partitioning or
task order, so a split or a null mask is the same on 1 or 1000 executors and
the same in DuckDB (``hash_uniform_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def _key(parts) -> Column:
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit("|"))
        # a NULL counts as the empty text (as ``concat`` of DuckDB reads it): no row is without a number
        cols.append(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)))
    return F.concat(*cols)


def hash_uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the given columns / literals."""
    digest = F.md5(_key(parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(_TWO_32)


def hash_uniform_sql(*parts: str) -> str:
    """The DuckDB spelling of ``hash_uniform`` (parts are SQL snippets)."""
    inner = ", '|', ".join(parts)
    return f"(('0x' || substr(md5(concat({inner})), 1, 8))::BIGINT / {_TWO_32})"
