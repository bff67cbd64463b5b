"""Array column functions used by packing and collation.

Higher-order functions (``transform``, ``filter``, ``slice``) are evaluated in
the JVM per row; no Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def last_subarray_pos(ids, sep: list[int]) -> Column:
    """K8: 1-based start of the LAST occurrence of ``sep`` inside ``ids``; NULL if absent.

    ``array_position`` would give the first hit of a single element; the
    collator keeps the last match of the whole id sequence.
    """
    a = col(ids)
    n = len(sep)
    sep_arr = F.array(*[F.lit(x) for x in sep])
    last_start = F.size(a) - F.lit(n) + 1
    starts = F.filter(F.sequence(F.lit(1), F.greatest(last_start, F.lit(1))),
                      lambda i: F.slice(a, i, n) == sep_arr)
    # starts ascend, so the last hit is the maximum (NULL when there is none)
    return F.when(last_start >= 1, F.array_max(starts))


def pad_right(arr, length, value) -> Column:
    """Right-pad ``arr`` with ``value`` up to ``length`` (no-op when already longer)."""
    a = col(arr)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(col(length) - F.size(a), F.lit(0))))


def ids_string(arr) -> Column:
    """Comparable text form of an int array: '1,2,3'."""
    return F.array_join(F.transform(col(arr), lambda x: x.cast("string")), ",")
