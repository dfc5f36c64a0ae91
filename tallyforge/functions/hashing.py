"""Hash ordering: the same order for any partitioning, engine or rerun."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 4294967296.0


def hash_hex(seed: object, *cols: Column | str) -> Column:
    """md5 hex of ``seed:col:col...``; the seed is a value or a Column, NULL parts are skipped."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [first, *[F.col(c) if isinstance(c, str) else c for c in cols]]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def uniform(hex_col: Column, start: int = 1) -> Column:
    """Eight hex digits from ``start`` as a number in [0, 1)."""
    return F.conv(F.substring(hex_col, start, 8), 16, 10).cast("bigint") / F.lit(UINT32)
