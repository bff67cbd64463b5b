"""The metrics of runs, merged split by split.

Every run has one object of metrics for each split ("train", "eval", ...) and a
merged one of all splits, in which a later split's value replaces an earlier
one of the same name.  A save never touches what is there: it writes a whole
new version next to it

    path/version-<id>/split=<split>/run_id=<run>/...    one flat JSON object a file

and then appends one row (number, version) to ``path/manifest``, which
publishes it.  Readers take the version of the highest number, so a job or
executor lost before that row leaves the former version whole and readable.

A path has one writer at a time: a save that finds another published since it
read fails and may be repeated, but two that append at the same moment are not
told apart.  A run's object is one row: it holds the run's metric names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split under which the merged object is stored.
MERGED = "all"
SCHEMA = "split string, run_id string, metric string, value double"
_MANIFEST = "number long, version string"


def _current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of the published version; (0, None) before the first."""
    try:
        row = (spark.read.schema(_MANIFEST).json(f"{path}/manifest")
               .agg(F.max(F.struct("number", "version")).alias("m")).first())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    return (row.m.number, row.m.version) if row.m else (0, None)


def _scan(spark: SparkSession, path: str, version: str | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], SCHEMA)
    at = f"{path}/{version}"
    raw = spark.read.schema("value string, split string, run_id string").option("basePath", at).text(at, wholetext=True)
    # NaN and infinities are JSON strings; the cast reads them too
    numbers = F.transform_values(F.from_json("value", "map<string, string>"), lambda k, v: v.try_cast("double"))
    return raw.select("split", "run_id", F.explode(numbers).alias("metric", "value"))


def save_metrics(metrics: DataFrame, path: str, split: str) -> str:
    """Publish ``metrics (run_id, metric, value)`` as the runs' objects of ``split``
    and merge them into theirs of all splits; returns the version's folder.

    A run's object of the split is replaced whole; runs not among ``metrics``
    keep theirs.  In the merged object new values replace old ones of the same
    name.  A metric that is there twice counts once (the largest value); rows
    without run, name or value are none.
    """
    if split == MERGED or not split:
        raise ValueError(f"{split!r} can't name a split")
    spark = metrics.sparkSession
    path = path.rstrip("/")
    number, version = _current(spark, path)
    old = _scan(spark, path, version)
    new = (metrics.select(F.col("run_id").cast("string").alias("run_id"), "metric", F.col("value").cast("double").alias("value"))
           .dropna().filter("run_id != ''").groupBy("run_id", "metric").agg(F.max("value").alias("value")))
    rows = old.withColumn("age", F.lit(1)).unionByName(
        new.select(F.explode(F.array(F.lit(split), F.lit(MERGED))).alias("split"), "run_id", "metric", "value",
                   F.lit(0).alias("age")))
    latest = rows.groupBy("split", "run_id", "metric").agg(F.min_by("value", "age").alias("value"), F.min("age").alias("age"))
    objects = (latest.groupBy("split", "run_id")
               .agg(F.min("age").alias("first"),
                    F.array_sort(F.collect_list(F.struct("metric", "value", "age"))).alias("m"))
               # an object of the split that was saved now holds nothing older
               .withColumn("m", F.filter("m", lambda x: (F.col("split") == MERGED) | (x["age"] == F.col("first"))))
               .select("split", "run_id", F.to_json(F.map_from_entries(
                   F.transform("m", lambda x: F.struct(x["metric"], x["value"])))).alias("value")))
    target = f"version-{uuid.uuid4().hex}"
    objects.write.mode("error").partitionBy("split", "run_id").text(f"{path}/{target}")
    if _current(spark, path) != (number, version):
        raise RuntimeError(f"{path} was saved to meanwhile; save again")
    publish = spark.createDataFrame([(number + 1, target)], T.StructType(
        [T.StructField("number", T.LongType()), T.StructField("version", T.StringType())]))
    publish.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return target


def load_metrics(spark: SparkSession, path: str, split: str = MERGED) -> DataFrame:
    """(run_id, metric, value) of one split, or of all merged, as last published."""
    path = path.rstrip("/")
    return _scan(spark, path, _current(spark, path)[1]).filter(F.col("split") == split).drop("split")
