"""Sources and sinks.

Everything is a DataFrame with an explicit schema where the source is
schema-less (CSV, JSON).  A "named set of tables" is ONE DataFrame with a
``dataset`` column, never a Python dict of DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prompt/target pairs: the three string columns of the evaluation CSVs.
# Targets are declared STRING (inference would make numeric targets int64).
PAIR_SCHEMA = T.StructType([
    T.StructField("inputs_pretokenized", T.StringType(), True),
    T.StructField("targets_pretokenized", T.StringType(), True),
    T.StructField("dataset", T.StringType(), True),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_union(frames: list[DataFrame], tag: str | None = None,
               names: list[str] | None = None) -> DataFrame:
    """UNION ALL of several tables (splits or saved directories).

    Missing columns become NULL.  With ``tag``, each input is tagged with its
    name (``names``) and with its position (``part_no``) so that the original
    concatenation order stays recoverable as ``(part_no, key)``.
    """
    if tag is not None:
        frames = [f.withColumn(tag, F.lit(n)).withColumn("part_no", F.lit(i))
                  for i, (f, n) in enumerate(zip(frames, names))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_dirs(spark: SparkSession, dirs: list[str], base_path: str | None = None) -> DataFrame:
    """``concatenate_datasets([load_from_disk(d) for d in dirs])``.

    With ``base_path`` the partition columns encoded in the directory names
    (``dataset=...``) are kept.
    """
    r = spark.read.option("mergeSchema", "true")
    if base_path:
        r = r.option("basePath", base_path)
    return r.parquet(*dirs)


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """prompt/target CSV with header and quoted commas."""
    return (spark.read.schema(PAIR_SCHEMA).option("header", True)
            .option("quote", '"').option("escape", '"').option("multiLine", True)
            .csv(path))


def save_pairs_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S2 counterpart: write prompt/target pairs in the CSV dialect that
    ``read_pairs_csv`` reads (header, double-quote quoting and escaping,
    whitespace kept).  An empty string reads back as NULL, like any empty
    CSV field in the reference's loader."""
    (df.select(*[f.name for f in PAIR_SCHEMA.fields]).write.mode(mode)
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def save(df: DataFrame, path: str, partition_by: list[str] | None = None,
         mode: str = "overwrite") -> None:
    """Parquet sink, partitioned so that dataset/run filters prune."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
