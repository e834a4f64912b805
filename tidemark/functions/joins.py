"""Join helpers that treat NULL keys as equal, as grouping does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", extra: Column | None = None
) -> DataFrame:
    """Join on equal keys (NULL equals NULL), keeping the left copy of the keys.

    ``extra`` is a further condition over columns that only one side has.
    """
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    matches = [] if extra is None else [extra]
    matches += [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    condition = reduce(lambda a, b: a & b, matches)
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])
