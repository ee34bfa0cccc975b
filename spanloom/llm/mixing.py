"""Operator 3: mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Sources in code point order, null last, get weights by a repeating rule; their targets share all words, each
at most ``repeats`` times its source's words, the excess going to the others by weight. The targets are found
at once: with sources sorted by cap / weight, the first that stays below its cap gives the common level.

Training time runs from 0 to 1. A source's weight at time t is proportional to 1 + tilt * (2 t - 1), its tilt
going through TILTS with its place; the integral of that schedule, normalised, is the share of its target that
is due by t. A source's documents, ordered by the MD5 of their id, make a stream of words, repeated from its
start until the target is reached; a copy's place in the stream is turned into a training position by
inverting that integral. Rows come range-sorted by position.

The running sums that give each document its place are taken in three levels (about BUCKET documents, groups
of FAN buckets, sources), so a source with a third of all rows is not one task.

``whole``: with False the last copy is cut at the target, to the word; with True a copy is taken if its middle
lies before the target. Defined cases: null or empty text has size 0, takes nothing and has no position; null
source is a source of its own, after all others; null doc_id is ordered first; rows that share an id are documents
of their own, and those equal in all columns are interchangeable; a very long text is one document of its size;
a source without words has target 0; an empty table gives an empty result. ``training_order`` keeps all columns,
whatever their names; names that begin with ``__mix_`` are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, partitions

WEIGHTS, REPEATS, TILTS = (5.0, 2.0, 1.0), 3, (-0.8, 0.0, 0.8)
BUCKET, FAN = 128, 1024
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, place, target: one row a source, from (source, source_size, ...); the one-partition windows see a row a source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rule = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("place", place).withColumn("weight", rule).withColumn("cap", F.col("source_size") * float(repeats))
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    open_ = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("common", open_["level"]).withColumn("target", F.least("cap", F.col("common") * F.col("weight")))


def position(due: Column, tilt: Column) -> Column:
    """The time at which a share ``due`` of a source's target is due: (1 - tilt) t + tilt t^2 = due, solved for t."""
    b = 1 - tilt
    root = F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * tilt * due))
    return F.when(F.abs(tilt) < 1e-9, due).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (root - b) / (2 * tilt))))


def mixed(docs: DataFrame, whole: bool = False, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, tilts: tuple[float, ...] = TILTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies (array of epoch, words, position), position (the first
    copy's, null if none is taken) and the columns in ``keep``, range-sorted by position."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"), *keep)
    rows = materialize(rows.withColumn("at", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = materialize(targets(sizes, weights, repeats).select("source", "source_size", "docs", "place", "target"), "targets")
    n_sources = plan.count()

    share = F.conv(F.substring("at", 1, 12), 16, 10).cast("double") / float(1 << 48)
    plan = plan.select(F.col("source").alias("s"), "source_size", "docs", "place", "target")
    placed = rows.join(F.broadcast(plan) if n_sources <= 100_000 else plan, F.col("source").eqNullSafe(F.col("s")))
    placed = placed.withColumn("bucket", F.floor(share * F.ceil(F.col("docs") / BUCKET))).withColumn("group", F.floor(F.col("bucket") / FAN)).drop("s", "docs")

    key = ["place", "group", "bucket"]
    buckets = placed.groupBy(*key).agg(F.sum("size").alias("words"))
    inside = F.coalesce(F.sum("words").over(W.partitionBy("place", "group").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = buckets.groupBy("place", "group").agg(F.sum("words").alias("words"))
    across = F.coalesce(F.sum("words").over(W.partitionBy("place").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = buckets.withColumn("inside", inside).drop("words").join(groups.withColumn("across", across).drop("words"), ["place", "group"]).select(*key, (F.col("inside") + F.col("across")).alias("base"))
    here = F.sum("size").over(W.partitionBy(*key).orderBy("at", "doc_id", "size", *keep).rowsBetween(W.unboundedPreceding, -1))
    seen = placed.join(base, key).withColumn("start", F.col("base") + F.coalesce(here, F.lit(0)))

    goal = F.floor("target")
    first = lambda k: F.col("start") + k * F.col("source_size")
    if whole:
        part = lambda k: F.when(2 * first(k) + F.col("size") <= 2 * goal, F.col("size")).otherwise(F.lit(0))
    else:
        part = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), goal - first(k)))
    tilt = F.element_at(F.array(*map(F.lit, tilts)), (F.pmod("place", F.lit(len(tilts))) + 1).cast("int"))
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: F.struct(k.alias("epoch"), part(k).cast("long").alias("words"), position(first(k) / F.col("target"), tilt).alias("position"))), lambda c: c["words"] > 0)
    done = seen.withColumn("copies", copies).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    done = done.withColumn("position", F.expr("try_element_at(copies, 1).position"))
    result = done.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position", *keep)
    return result.repartitionByRange(partitions(spark), F.asc_nulls_last("position"), "doc_id").sortWithinPartitions(F.asc_nulls_last("position"), "doc_id")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, whole, each as often as it is repeated, with all columns of docs, range-sorted by training position.

    A row meets its copies by two hashes of all its columns, so that rows which share an id, or have none, follow
    the plan each; rows equal in all columns are one with the copies of all of them.
    """
    spark = docs.sparkSession
    key = ["__mix_a", "__mix_b"]
    each = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({"__mix_a": F.xxhash64(*each), "__mix_b": F.xxhash64(F.lit(3), *each)})
    plan = mixed(rows, True, id_col=id_col, text_col=text_col, source_col=source_col, keep=tuple(key))
    plan = plan.filter("taken > 0").select(*key, F.explode("copies.position").alias("__mix_position"))
    taken = rows.dropDuplicates(key).join(plan, key)
    order = ["__mix_position", *key]
    return taken.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(each)


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and when the mix shows each copy of a document (null: not taken), to six digits."""
    done = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = [F.round(F.expr(f"try_element_at(filter(copies, c -> c.epoch = {k}), 1).position"), 6).alias(f"position_{k + 1}") for k in range(REPEATS)]
    return done.select("doc_id", "size", "source_size", "target", "taken", *shown)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, place, least(cap, weight * (SELECT level FROM l WHERE level <= cap / weight ORDER BY cap / weight, place LIMIT 1)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE t.place % 3 WHEN 0 THEN -0.8::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS tilt,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT p.*, k, greatest(0, least(size, floor(target)::BIGINT - start - k * source_size)) AS words, (start + k * source_size) / target AS due FROM p, (SELECT unnest([0, 1, 2]) AS k)),
f AS (SELECT *, CASE WHEN words > 0 THEN round(CASE WHEN tilt = 0 THEN due
         ELSE least(1.0, greatest(0.0, (sqrt(greatest(0.0, (1 - tilt) * (1 - tilt) + 4 * tilt * due)) - (1 - tilt)) / (2 * tilt))) END, 6) END AS pos FROM e)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(words) AS BIGINT) AS taken,
       max(pos) FILTER (k = 0) AS position_1, max(pos) FILTER (k = 1) AS position_2, max(pos) FILTER (k = 2) AS position_3
FROM f GROUP BY doc_id
"""
