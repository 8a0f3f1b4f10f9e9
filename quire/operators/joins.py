"""Joins in which NULL keys meet (a corpus without a name is a corpus)."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on equal or both NULL columns ``on``; the
    result has the columns of ``left`` and those of ``right`` that are not in ``on``."""
    own = {c: f"_on_{i}" for i, c in enumerate(on)}
    other = right.withColumnsRenamed(own)
    same = None
    for c, o in own.items():
        test = F.col(c).eqNullSafe(F.col(o))
        same = test if same is None else same & test
    return left.join(other, same, how).drop(*own.values())
