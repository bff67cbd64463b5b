"""Dataset selection and checks.

Name lists are short (dataset names), so membership tests are ``isin``
expressions and go into the Parquet scan as pushed filters when the column is
a stored one (or prune partitions when the data is ``partitionBy("dataset")``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models.lm import join_checked


def keep_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Keep-list projection (absent names are ignored)."""
    return df.select(*[c for c in keep if c in df.columns])


def tag(df: DataFrame, name: str, col: str = "dataset") -> DataFrame:
    """Constant provenance tag."""
    return df.withColumn(col, F.lit(name))


def include(df: DataFrame, names: list[str] | None, col: str = "dataset") -> DataFrame:
    """Keep the named datasets; disabled when any name is "all"."""
    if not names or "all" in names:
        return df
    return df.filter(F.col(col).isin(list(names)))


def exclude(df: DataFrame, names: list[str] | None, col: str = "dataset") -> DataFrame:
    """Leave the named datasets out (applied after ``include``).  A NULL
    dataset is not named, so it stays."""
    if not names:
        return df
    return df.filter(~F.coalesce(F.col(col).isin(list(names)), F.lit(False)))


def coverage(df: DataFrame, requested: list[str], col: str = "dataset") -> DataFrame:
    """P10: (dataset, requested, found) for the union of requested and present names."""
    spark: SparkSession = df.sparkSession
    req = spark.createDataFrame([(n,) for n in requested],
                                T.StructType([T.StructField(col, T.StringType())]))
    found = df.select(col).distinct().withColumn("found", F.lit(True))
    return (req.withColumn("requested", F.lit(True)).join(found, col, "full")
            .select(col, F.coalesce("requested", F.lit(False)).alias("requested"),
                    F.coalesce("found", F.lit(False)).alias("found")))


def select_datasets(df: DataFrame, include_names=None, exclude_names=None,
                    check: bool = True, col: str = "dataset") -> DataFrame:
    """P8 + P9 + P10: include, leave out, and assert coverage like the reference."""
    out = exclude(include(df, include_names, col), exclude_names, col)
    if check:
        if include_names and "all" not in include_names:
            bad = coverage(include(df, include_names, col), include_names, col) \
                .filter(F.col("requested") != F.col("found")).limit(5).collect()
            if bad:
                raise AssertionError(f"requested datasets not found: {[r[0] for r in bad]}")
        if exclude_names:
            left = out.filter(F.col(col).isin(list(exclude_names))).limit(1).collect()
            if left:
                raise AssertionError("left-out dataset still present")
    return out


def distinct_in_order(df: DataFrame, order: str, col: str = "dataset") -> DataFrame:
    """Distinct names with their first-appearance key and 0-based rank.

    One aggregate (a row per name); the rank is over that small table.
    """
    from pyspark.sql.window import Window
    first = df.groupBy(col).agg(F.min(order).alias("first_key"))
    return first.withColumn("position",
                            (F.row_number().over(Window.orderBy("first_key", col)) - 1).cast("long"))


def attach_labels(df: DataFrame, labels: DataFrame, col: str = "dataset",
                  check: bool = True) -> DataFrame:
    """Dataset-code -> label lookup; a missing code raises (dict KeyError)."""
    if check:
        missing = df.select(col).distinct().join(labels.select(col), col, "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"no label for {[r[0] for r in missing]}")
    return join_checked(df, labels, col, "inner", max_rows=100_000)
