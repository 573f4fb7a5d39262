"""Reproducible sample that is stable as data grows (problem 7): a salted hash of the record key below the rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "corvane-sample-1"
#: Hex digits of the hash that are used: 52 bits, which a double holds exactly.
DIGITS = 13


def unit_hash(key: Column, salt: str = SALT) -> Column:
    """The key's place in [0, 1): equal keys share it in every run, partitioning and later table."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    digest = F.md5(F.concat(F.lit(salt + ":"), text))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def stable_sample(df: DataFrame, key: str, rate: float, salt: str = SALT) -> DataFrame:
    """The rows of ``df`` whose key hashes below ``rate``, all columns kept.

    Rows repeated under a key go in or out together; null keys count as one key. The choice depends on the
    key alone, so later rows never displace a chosen one and a higher rate only adds. No shuffle.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    return df.where(unit_hash(F.col(key), salt) < rate)
