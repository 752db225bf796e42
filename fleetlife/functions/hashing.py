"""Deterministic row hashes for sampling: the same on every engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The whole 32-bit prefix of the digest: shares down to 1 in 4 billion can be expressed.
HASH_RANGE = 1 << 32


def hash_slot(*keys: str | Column) -> Column:
    """A number in [0, 2**32) that depends on the keys only. Null keys count as empty."""
    parts = [
        F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys
    ]
    digest = F.md5(F.concat(*parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
