"""Equi-joins in which a NULL key meets a NULL key, as groups do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_enough


def same_keys(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner",
              broadcast: bool | int = False) -> DataFrame:
    """``left`` with the columns of ``right`` whose keys ``on`` are equal or
    both NULL; the keys are the left side's.  ``broadcast``: whether ``right``
    is known to be small, or the number of rows up to which it is (they are
    counted first, so pass it materialised)."""
    on = [on] if isinstance(on, str) else list(on)
    if broadcast is not True and broadcast is not False:
        broadcast = small_enough(right, broadcast)
    keys = {k: f"_same_{i}" for i, k in enumerate(on)}
    side = right.select(*[F.col(f"`{k}`").alias(v) for k, v in keys.items()], *[f"`{c}`" for c in right.columns if c not in keys])
    side = F.broadcast(side) if broadcast else side
    cond = [F.col(f"`{k}`").eqNullSafe(F.col(v)) for k, v in keys.items()]
    return left.join(side, cond, how).drop(*keys.values())
