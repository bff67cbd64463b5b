"""Operator 4 (native): mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies.  Prefix
sums of the expected copies run over the source's documents in the order of
their size (then a hash); one offset in [0, 1) per source, drawn from the seed
and the source's name, is added, and a document is emitted once for every
integer that its part of the prefix sum crosses.  As the order is by size, the
words taken differ from the target by about one largest document per source.

Targets: all sizes are shared by weight; a target stops at ``most`` times its
source's size and the rest is shared again by weight, until none is above.
That ends at ``min(most * size, level * weight)``: sorted by size / weight the
stopped sources are a prefix, so one running sum finds the level.

The prefix sums need no source in one task: ranks within a source are those of
its (size, hash slice) groups, summed over a table with one row per group,
plus the rank within a group of about ``GROUP`` rows.

Defined cases: NULL text has size 0; the NULL source is a source (last in
order); a source of size 0 has target 0 and gives no copy; repeated rows are
sampled each by itself; an empty table gives an empty result; extra columns
are ignored (``mix``: kept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .common import WORD_RE, pick, positional

SEED = 42
WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a slice of equal sizes, about.
GROUP = 4096


def n_words(text: Column) -> Column:
    """Words of the contract; NULL: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 2^32) from md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> source, source_size, target.  One row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    at = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    s = sizes.withColumn("weight", weight)
    total = F.sum("source_size").over(Window.partitionBy())
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(),
                           F.col("source").cast("binary"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = (s.withColumn("_pool", (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double"))
         .withColumn("_weights", F.sum("weight").over(rest)))
    # the first source in this order whose share is not above its stop sets the level
    s = s.withColumn("_at", F.row_number().over(ratio))
    s = s.withColumn("_open", F.col("_pool") * F.col("weight") <= most * F.col("source_size") * F.col("_weights"))
    first = F.min(F.when(F.col("_open"), F.struct("_at", "_pool", "_weights"))).over(Window.partitionBy())
    s = s.withColumn("_first", first)
    level = F.col("_first._pool") * F.col("weight") / F.col("_first._weights")
    stop = (most * F.col("source_size")).cast("double")
    return s.select("source", "source_size",
                    F.when(F.col("source_size") == 0, 0.0)
                    .otherwise(F.least(stop, F.coalesce(level, stop))).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (checkpointed narrow rows)."""
    rows = pick(docs, "doc_id", "source", "text").select(
        "doc_id", "source", n_words(F.col("text")).alias("size"))
    return _plan(rows, weights, most, seed)


def _plan(rows: DataFrame, weights, most: int, seed: int, text: tuple[str, ...] = ()) -> DataFrame:
    """``plan`` of doc_id, source, size; ``text`` names a hash of the text, which
    orders and slices rows that share an id (NULL ids all have one ``_h``)."""
    rows = cut(rows.withColumn("_h", unit_hash(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    same = F.col("source").eqNullSafe(F.col("_source"))
    # one row per (source, size); its hash slices keep equal sizes from filling one task
    level = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n"))
    level = level.withColumn("_slices", F.ceil(F.col("_n") / GROUP))
    unit = 1 << 32
    sliced = rows.join(level.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "_slices"),
                       same & (F.col("size") == F.col("_size"))).drop("_source", "_size")
    piece = F.floor(F.col("_h") * F.col("_slices") / F.lit(float(unit)))
    for c in text:  # rows without an id lie between the hashes below and above theirs, in slices of their own
        none, at = F.col("doc_id").isNull(), unit_hash(F.lit(str(seed)), F.lit(""))
        place = F.when(none, 1).when(F.col("_h") <= at, 0).otherwise(2)
        part = F.when(none, F.floor(F.pmod(c, F.lit(unit)) * F.col("_slices") / F.lit(float(unit)))).otherwise(F.lit(0))
        piece = F.struct(piece.alias("h"), place.alias("place"), part.alias("part"))
    sliced = cut(sliced.withColumn("_slice", piece).drop("_slices"))
    groups = sliced.groupBy("source", "size", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("source").orderBy("size", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    sources = level.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    tg = targets(sources, weights, most)
    tg = tg.withColumn("_u", unit_hash(F.lit(f"{seed}:offset"), F.coalesce(F.col("source"), F.lit(""))) / F.lit(float(unit)))
    groups = (groups.join(tg.withColumnRenamed("source", "_source"), same).drop("_source")
              .select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("_slice").alias("_part"),
                      "_before", "source_size", "target", "_u"))
    ranked = sliced.join(groups, same & (F.col("size") == F.col("_size")) & (F.col("_slice") == F.col("_part")))
    inner = Window.partitionBy("source", "size", "_slice").orderBy("_h", "doc_id", *text)
    rank = F.col("_before") + F.row_number().over(inner)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ranked = ranked.withColumn("_rank", rank.cast("double")).withColumn("_rate", rate)
    copies = (F.floor(F.col("_rate") * F.col("_rank") + F.col("_u"))
              - F.floor(F.col("_rate") * (F.col("_rank") - 1) + F.col("_u")))
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *text)


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as the plan says,
    with its own columns.  Only rows that share doc_id, source and text share
    their copies, evenly, the odd ones by a hash of the row.  The texts are
    shuffled once, for the join with the plan."""
    plain, at, names = positional(docs)
    text = F.xxhash64(at["text"])
    rows = plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"),
                        n_words(F.col(at["text"])).alias("size"), text.alias("_t"))
    p = _plan(rows, weights, most, seed, ("_t",)).groupBy(F.struct("doc_id", "source", "_t").alias("_k")).agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0")
    # a struct equals another whose NULL fields are NULL too
    d = plain.withColumn("_key", F.struct(F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), text.alias("_t")))
    out = d.join(p, F.col("_key") == F.col("_k"))
    whole = [c for c, kind in plain.dtypes if "map<" not in kind and "variant" not in kind]
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*whole)))  # the join's own partitioning
    copies = F.floor(F.col("_copies") / F.col("_rows")) + F.when(rank <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    out = out.withColumn("_n", copies.cast("int")).filter("_n > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def oracle_sql(documents: str = "documents", weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> str:
    """DuckDB SQL for the query; targets by the same closed form."""
    case = " ".join(f"when {i} then {float(w)}" for i, w in enumerate(weights))
    return f"""
with d as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from {documents}),
s as (
  select source, sum(size)::bigint as source_size,
         case ((row_number() over (order by source is null, source)) - 1) % {len(weights)} {case} end as weight
  from d group by source),
p as (
  select *, ((sum(source_size) over ()) - {most} * coalesce(sum(source_size) over (
              order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))::double as pool,
         sum(weight) over (order by source_size / weight, source is null, source rows between current row and unbounded following) as weights,
         row_number() over (order by source_size / weight, source is null, source) as pos
  from s),
f as (
  select arg_min(pool, pos) as pool, arg_min(weights, pos) as weights
  from p where pool * weight <= {most} * source_size * weights),
t as (
  select p.source, p.source_size,
         case when p.source_size = 0 then 0.0
              else least(({most} * p.source_size)::double, coalesce(f.pool * p.weight / f.weights, ({most} * p.source_size)::double)) end as target,
         ('0x' || substr(md5('{seed}:offset:' || coalesce(p.source, '')), 1, 8))::bigint / 4294967296.0::double as u
  from p left join f on true),
r as (
  select d.doc_id, d.size, t.source_size, t.target, t.u,
         (case when t.source_size > 0 then t.target / t.source_size else 0.0 end)::double as rate,
         (row_number() over (partition by d.source order by d.size, d.h, d.doc_id))::double as k
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (floor(rate * k + u) - floor(rate * (k - 1) + u))::bigint * size as taken
from r"""
