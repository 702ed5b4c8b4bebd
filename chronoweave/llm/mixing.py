"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.llm.staging import read_table, stage
from chronoweave.llm.textops import WORD

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """Adds target to (s_null, s_key, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. All share the
    budget (by default the sum of all sizes) by weight; a target stops at
    max_epochs times its source's size and the excess goes to the others by
    weight until none is above. Clamping in order of size per weight reaches
    that state in one pass: with sources so ordered, the level at k is what is
    left when all before k are clamped, shared by the weights from k on, and
    the first source that can take its share fixes the level. The windows are
    over sources (one row each), never over documents.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    turn = Window.orderBy("s_null", "s_key")
    fill = Window.orderBy("per_weight", "s_null", "s_key")
    everything = Window.partitionBy()
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(everything).cast("double")
    df = sources.withColumn("weight", F.get(cycle, (F.row_number().over(turn) - 1) % len(weights)))
    df = df.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("per_weight", F.col("cap") / F.col("weight"))
    df = df.withColumn("total", total)
    df = df.withColumn("clamped", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("level_here", (F.col("total") - F.col("clamped")) / F.col("open"))
    df = df.withColumn("level", F.min(F.when(F.col("cap") > F.col("level_here") * F.col("weight"), F.struct("per_weight", "s_null", "s_key", "level_here"))).over(everything)["level_here"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return df.select("s_null", "s_key", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken), a row for each row of docs.

    A source whose target is r times its size takes each document floor(r)
    times, and once more those that come first in a seeded order, up to the
    words still missing; the document at that edge is taken if that brings the
    source nearer its target. The order is the MD5 of seed and doc_id, so
    reruns agree. Prefix sums run over 4096 ranges of it per source and only
    then inside a range, so that no task ever holds a whole source.

    Null or empty text has size 0, null source is a source of its own, null
    doc_id is hashed as empty; repeated rows count each; ties in the seeded
    order go by doc_id, then size; a very long text may make its source miss
    the target by half its size, as it is taken whole or not; an empty table
    gives no rows; other columns are ignored.
    """
    base = stage(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.col("source").isNull().alias("s_null"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s_key"),
            n_words(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("turn"),
        ).withColumn("range", F.substring("turn", 1, 3)),
        "mix",
    )
    ranges = base.groupBy("s_null", "s_key", "range").agg(F.sum("size").alias("words"))
    targets = water_fill(ranges.groupBy("s_null", "s_key").agg(F.sum("words").alias("source_size")), weights, max_epochs, budget)
    own, before = ["s_null", "s_key"], Window.partitionBy("s_null", "s_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(targets, own)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    inside = Window.partitionBy("s_null", "s_key", "range").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = base.join(placed.drop("words", "weight"), [*own, "range"])
    out = out.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    once = (F.col("before") * 2 + F.col("size") <= F.col("missing") * 2).cast("long")
    out = out.withColumn("repeats", F.col("whole").cast("long") + once)
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def op10(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source IS NULL AS s_null, coalesce(source, '') AS s_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents),
sources AS (SELECT s_null, s_key, sum(size)::BIGINT AS source_size FROM base GROUP BY ALL),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY s_null, s_key) - 1) % 3] AS weight,
         source_size::DOUBLE * 3 AS cap, (sum(source_size) OVER ())::DOUBLE AS total
  FROM sources),
f AS (
  SELECT *, cap / weight AS per_weight,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, s_null, s_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(weight) OVER (ORDER BY cap / weight, s_null, s_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w),
lv AS (SELECT *, (total - clamped) / open_weight AS level_here FROM f),
top AS (SELECT level_here AS level FROM lv WHERE cap > level_here * weight ORDER BY per_weight, s_null, s_key LIMIT 1),
t AS (SELECT s_null, s_key, source_size, CASE WHEN (SELECT level FROM top) IS NULL THEN cap ELSE least(cap, (SELECT level FROM top) * weight) END AS target FROM lv),
p AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY s_null, s_key ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base JOIN t USING (s_null, s_key))
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN before * 2 + size <= (target - whole * source_size) * 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
