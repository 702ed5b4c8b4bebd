"""Sorted runs: rows written in one global order, with the place of each within its key, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.llm.staging import few, spare, stage


def sorted_runs(df: DataFrame, order: Sequence[str | Column], name: str = "runs") -> DataFrame:
    """df staged in the given order, dealt out by ranges of it; run_at numbers the rows upwards, a run of neighbours in each file.

    Rows that are equal throughout the order are dealt out too: a number of
    their own is its last part, so that no range holds all copies of a row.
    """
    tie = spare(df, "tie")
    keys = [*order, tie]
    rows = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    return stage(rows.withColumn("run_at", F.monotonically_increasing_id()), name)


def placed(runs: DataFrame, key: str | None = None, name: str = "place") -> DataFrame:
    """runs without run_at, with the place (from 0) of each row within its key, or in all: what stands in the runs before, by
    a sum over one row a run and key, and what stands before it in its own. Null keys are one key."""
    run = F.shiftright("run_at", 33)
    by = [] if key is None else [key]
    sizes = runs.groupBy(*by, run.alias("run")).agg(F.count("*").alias("n"), F.min("run_at").alias("from"))
    past = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = few(stage(sizes.select(*[F.col(c).alias("run_key") for c in by], "run", (past - F.col("from")).alias("shift")), "starts"))
    same = run == F.col("run")
    if key is not None:
        same = same & F.col(key).eqNullSafe(F.col("run_key"))
    return runs.join(starts, same).withColumn(name, F.col("run_at") + F.col("shift")).drop("run_at", "run", "run_key", "shift")
