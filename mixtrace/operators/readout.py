"""Step logs, baselines and the influence read-out.

Runs persist their step log as one JSON document per run directory
(``log_history``: a list of ragged objects with ``step``, ``epoch`` and
``eval_loss[_<dataset>]`` or a training ``loss``) and the initial evaluation
as a flat JSON object.  Reading them back goes through ``from_json`` into
MAP columns, so any set of metric names works without schema inference;
everything after the scan is long-form (run, key, eval_dataset, value).
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_prefix
from ..session import cut
from .models.lm import join_checked

#: Values are read as text and cast, so one that is no number erases nothing else.
LOG_SCHEMA = "struct<log_history: array<map<string, string>>>"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file (a document may span lines); partition values stay text."""
    reader = spark.read.schema(schema)
    reader = reader.option("basePath", path) if "run_id" in schema else reader
    return (reader.text(path, wholetext=True)
            .withColumn("_file", F.input_file_name()))


def _or_fail(parsed):
    """The parsed value; a document that holds none is an error, not an empty log."""
    return F.coalesce(parsed, F.raise_error(F.concat(F.lit("unreadable JSON document: "), F.col("_file"))))


def _numbers(m):
    """The numeric entries of a map of texts."""
    return F.map_filter(F.transform_values(m, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())


def write_trainer_state(log: DataFrame, path: str, steps_per_epoch: float) -> None:
    """Long log (run_id, step, eval_dataset, metric, loss) -> one JSON
    document per run under ``path/run_id=<run>/``.

    Each log_history entry is a map: step, epoch and the step's metrics,
    named ``eval_loss`` (overall) / ``eval_loss_<dataset>`` / ``loss``.  A run's
    document holds (steps x metrics) numbers - bounded by the schedule.
    """
    name = (F.when(F.col("metric") != "eval_loss", F.col("metric"))
            .when(F.col("eval_dataset").isNull(), F.lit("eval_loss"))
            .otherwise(F.concat(F.lit("eval_loss_"), F.col("eval_dataset"))))
    entries = (log.withColumn("name", name)
               .groupBy("run_id", "step")
               .agg(F.map_from_entries(F.collect_list(F.struct("name", "loss"))).alias("m"))
               .withColumn("entry", F.map_concat(
                   F.create_map(F.lit("step"), F.col("step").cast("double"),
                                F.lit("epoch"), F.col("step") / F.lit(float(steps_per_epoch))),
                   F.col("m"))))
    docs = (entries.groupBy("run_id")
            .agg(F.array_sort(F.collect_list(F.struct("step", "entry")),
                              lambda x, y: F.signum(x["step"] - y["step"]).cast("int")).alias("e"))
            .select("run_id", F.to_json(F.struct(F.transform("e", lambda x: x["entry"])
                                                 .alias("log_history"))).alias("value")))
    docs.write.mode("overwrite").partitionBy("run_id").text(path)


def write_baseline(log: DataFrame, path: str) -> None:
    """The step-0 evaluation of one run as a flat JSON object (eval_results.json)."""
    first = log.filter(F.col("step") == 0)
    one = first.select(F.min("run_id")).first()[0]
    name = F.when(F.col("eval_dataset").isNull(), F.lit("eval_loss")) \
        .otherwise(F.concat(F.lit("eval_loss_"), F.col("eval_dataset")))
    (first.filter(F.col("run_id") == one)
     .agg(F.map_from_entries(F.collect_list(F.struct(name.alias("k"), F.col("loss").alias("v")))).alias("m"))
     .select(F.to_json("m").alias("value"))
     .coalesce(1).write.mode("overwrite").text(path))


def _plain(path):
    """A folder without scheme, host, repeated or closing slashes."""
    path = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")


def _run_documents(spark: SparkSession, root: str, runs: DataFrame, file: str, check: bool) -> DataFrame:
    """(run_id, value, _file): the whole ``file`` (a glob) of every run's folder
    under the absolute path ``root``; ``runs (run_id, folder)`` names folders
    relative to it.  No folder name reaches the driver but those that lack a file.

    Folders of one depth are listed by a glob, so a folder that no run names is
    read as well and left out by the join; names are compared as they are
    (files' paths are decoded), so they may hold any character.
    """
    if not re.match(r"/|[A-Za-z][A-Za-z0-9+.-]*:/", root):
        raise ValueError(f"root must be an absolute path: {root}")
    root = root.rstrip("/")
    runs = runs.filter("run_id is not null and folder is not null").distinct()
    runs = cut(runs.withColumn("_folder", _plain(F.concat(_plain(F.lit(root)), F.lit("/"), F.col("folder")))))
    depths = [r[0] for r in runs.select(F.size(F.split("_folder", "/"))
                                        - F.size(F.split(_plain(F.lit(root)), "/"))).distinct().collect()]
    literal = re.sub(r"([\\{}\[\]*?])", r"\\\1", root)
    found = None
    for depth in sorted(depths):
        glob = "/".join([literal, *["*"] * depth, file])
        try:
            part = spark.read.option("recursiveFileLookup", "true").text(glob, wholetext=True)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        part = part.withColumn("_file", F.input_file_name())
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "value string, _file string")
    path = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))
    found = found.withColumn("_folder", _plain(F.regexp_replace(path, "/[^/]*$", "")))
    if check:
        missing = runs.join(found.select("_folder"), "_folder", "left_anti").orderBy("run_id").limit(5).collect()
        if missing:
            raise KeyError("no log of " + ", ".join(f"{r.run_id} ({r.folder})" for r in missing))
    return join_checked(found, runs.select("run_id", "_folder"), "_folder").select("run_id", "value", "_file")


def log_scan(spark: SparkSession, path: str, subset: str = "eval_loss", runs: DataFrame | None = None,
             file: str = "trainer_state.json", check: bool = True) -> DataFrame:
    """S5 + R1 + R2: (run_id, step, epoch, metric, value) of the entries that
    carry ``subset``; metrics absent from an entry simply have no row (the
    long form of dropping all-null columns).

    Runs are the ``run_id=`` folders under ``path``, or those of a manifest
    ``runs (run_id, folder)`` (``runs.run_folders``): folders relative to
    ``path``, each with its log in ``file``, tagged with the manifest's run_id.
    Runs that share a folder each get its entries; a run without a log is a
    KeyError that names it (``check=False``: it has no rows); a run or folder
    that is NULL is none.
    """
    if runs is None:
        raw = _documents(spark, path, "value string, run_id string")
    else:
        raw = _run_documents(spark, path, runs, file, check)
    history = _or_fail(F.from_json("value", LOG_SCHEMA)["log_history"])
    e = (raw.select("run_id", F.explode(history).alias("e")).withColumn("e", _numbers("e"))
         .filter(F.col("e")[subset].isNotNull()))
    return e.select("run_id", F.col("e")["step"].cast("long").alias("step"),
                    F.col("e")["epoch"].alias("epoch"),
                    F.explode(F.map_filter("e", lambda k, v: ~k.isin("step", "epoch"))).alias("metric", "value"))


def baseline_scan(spark: SparkSession, path: str) -> DataFrame:
    """Flat JSON object -> (metric, value) rows."""
    raw = _documents(spark, path, "value string")
    return raw.select(F.explode(_numbers(_or_fail(F.from_json("value", "map<string, string>")))).alias("metric", "value"))


def influence(log: DataFrame, baseline: DataFrame, key: str = "epoch", prefix: str = "eval_loss_",
              inverse: bool = False, check: bool = True) -> DataFrame:
    """Long influence table (train_dataset, eval_dataset, key, influence).

    prefix mode: metrics starting with ``prefix`` are per-dataset losses
    (name stripped of the prefix); otherwise ``prefix`` names one metric and
    ``eval_dataset`` is that name (R9, the intended behaviour).  Each value
    minus the baseline of the same name; every (run, dataset) also gets key 0
    with influence 0 (replacing a logged key 0).  ``inverse`` swaps the roles
    (inverse unlearning: runs are evaluation sets).
    """
    if prefix.endswith("_"):
        sel = log.filter(F.col("metric").startswith(prefix)) \
            .withColumn("eval_dataset", strip_prefix("metric", prefix))
        base = baseline.filter(F.col("metric").startswith(prefix)) \
            .select(strip_prefix("metric", prefix).alias("eval_dataset"), F.col("value").alias("_b"))
    else:
        sel = log.filter(F.col("metric") == prefix).withColumn("eval_dataset", F.col("metric"))
        base = baseline.filter(F.col("metric") == prefix) \
            .select(F.col("metric").alias("eval_dataset"), F.col("value").alias("_b"))
    if check:
        missing = sel.select("eval_dataset").distinct().join(base, "eval_dataset", "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"baseline lacks {[r[0] for r in missing]}")
    d = join_checked(sel.filter(F.col(key) != 0), base, "eval_dataset", max_rows=100_000) \
        .select("run_id", "eval_dataset", F.col(key).cast("double").alias(key),
                (F.col("value") - F.col("_b")).alias("influence"))
    zero = sel.select("run_id", "eval_dataset").distinct() \
        .select("run_id", "eval_dataset", F.lit(0.0).alias(key), F.lit(0.0).alias("influence"))
    out = d.unionByName(zero)
    a, b = ("eval_dataset", "train_dataset") if inverse else ("train_dataset", "eval_dataset")
    return out.select(F.col("run_id").alias(a), F.col("eval_dataset").alias(b), key, "influence")


def labelled_series(infl: DataFrame, labels: DataFrame, target: str, key: str = "epoch",
                    col: str = "train_dataset") -> DataFrame:
    """R10 + P12: plot-ready series for one evaluation set: (key, influence,
    label) per training dataset, with the dataset code mapped to its label
    (a code without label raises)."""
    from .selection import attach_labels
    s = infl.filter(F.col("eval_dataset") == target)
    return attach_labels(s.withColumnRenamed(col, "dataset"), labels).select(
        F.col("dataset").alias(col), "label", key, "influence")
