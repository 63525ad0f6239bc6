"""Hash-based draws: reproducible on any engine and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str | int) -> Column:
    """First 32 bits of md5 over the parts joined by '|', as BIGINT."""
    cols = [F.lit(str(p)) if isinstance(p, int) else p for p in parts]
    cols = [F.col(p) if isinstance(p, str) else p.cast("string") for p in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform draw in [0, 1]."""
    return hash32(*parts) / F.lit(4294967295.0)
