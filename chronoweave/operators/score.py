"""Answer grading over columns, and reports over graded runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from chronoweave.functions import grading

VERDICT = StructType().add("is_correct", BooleanType()).add("manual_check", BooleanType()).add("reason", StringType()).add("mapping", StringType())


@F.pandas_udf(VERDICT)
def _grade(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for kind, answer, truth in batches:
        yield pd.DataFrame([grading.grade(k, a, t) for k, a, t in zip(kind, answer, truth, strict=True)], columns=["is_correct", "manual_check", "reason", "mapping"])


def grade(kind: Column, answer: Column, truth: Column) -> Column:
    """A struct (is_correct, manual_check, reason, mapping) of any kind of answer; truth is JSON text."""
    return _grade(kind, answer, truth)


# Column forms of the commonest rules, for scoring at scale without Python.
_N = r"[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")


def number_verdict(answer: Column, truth: Column) -> Column:
    """single_number by Column operations; the same rules as grading.grade_number."""
    text = normal(answer)
    lead = rf"^(?:(?:the\s+)?(?:final\s+answer|answer)\s*[:\-]\s*|(?:the\s+answer\s+is|it\s+is|it's)\s+)({_N})[\s\W]*$"
    hedged = rf"\b(?:{grading.HEDGES})\b[^0-9\-+]*({_N})\b"
    number = lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double")
    near = lambda x: F.abs(x - truth) <= F.greatest(1e-9 * F.greatest(F.abs(x), F.abs(truth)), F.lit(1e-9))
    found = F.regexp_extract_all(text, F.lit(rf"(?<![a-z0-9])({_N})(?![a-z0-9])"), F.lit(1))
    one = number(F.get(found, F.lit(0)))
    any_near = F.exists(found, lambda t: near(number(t)))
    clean = text.rlike(rf"^[\s\W]*{_N}[\s\W]*$")
    settled = lambda x, manual: F.struct(near(x).alias("is_correct"), manual.alias("manual_check"), F.when(near(x), "matched").otherwise("truth_not_found_in_predicted_numbers").alias("reason"))
    fixed = lambda manual, reason: F.struct(F.lit(False).alias("is_correct"), manual.alias("manual_check"), F.lit(reason).alias("reason"))
    return (
        F.when(text.rlike(lead), settled(number(F.regexp_extract(text, lead, 1)), F.lit(False)))
        .when(text.rlike(hedged), fixed(F.lit(True), "ambiguous_hedged_number"))
        .when(F.size(found) == 0, fixed(F.lit(False), "no_number_found"))
        .when(F.size(found) > 1, fixed(any_near, "ambiguous_multiple_numbers"))
        .otherwise(settled(one, ~clean))
    )


def boolean_verdict(answer: Column, truth: Column) -> Column:
    """boolean by Column operations; the same rules as grading.grade_boolean."""
    text = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    lead = r"^(?:(?:the\s+)?(?:final\s+answer|answer)\s*[:\-]\s*|(?:the\s+answer\s+is|it\s+is|it's)\s+)(yes|no)[\s\W]*$"
    found = F.regexp_extract_all(text, F.lit(r"\b(yes|no)\b"), F.lit(1))
    left = F.regexp_extract_all(F.regexp_extract(text, r"(?s)^(.*?)\b(?:yes|no)\b", 1), F.lit("([a-z]+)"), F.lit(1))
    right = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\b(?:yes|no)\b(.*)$", 1), F.lit("([a-z]+)"), F.lit(1))
    near = F.concat(F.slice(left, F.greatest(F.size(left) - 2, F.lit(1)), F.lit(3)), F.slice(right, 1, 3))
    hedging, connectors = (F.array(*[F.lit(w) for w in sorted(x)]) for x in (grading.HEDGING, grading.CONNECTORS))
    value = F.when(text.rlike(lead), F.regexp_extract(text, lead, 1) == "yes").otherwise(F.get(found, F.lit(0)) == "yes")
    read = lambda v, manual, reason: F.struct(v.alias("v"), F.lit(manual).alias("m"), F.lit(reason).alias("r"))
    none = F.lit(None).cast("boolean")
    x = (
        F.when(text.rlike(r"\b(?:not|never)\s+(yes|no)\b"), read(none, True, "ambiguous_negated_boolean"))
        .when(text.rlike(lead), read(value, False, "parsed_safe_prefixed_boolean"))
        .when(F.size(found) == 0, read(none, False, "invalid_boolean_format"))
        .when(F.size(F.array_distinct(found)) > 1, read(none, True, "ambiguous_multiple_boolean_values"))
        .when(F.size(found) > 1, read(value, True, "ambiguous_repeated_boolean"))
        .when(F.arrays_overlap(near, hedging), read(value, True, "ambiguous_boolean_with_hedging"))
        .when(text.rlike(r"^[\s\W]*(yes|no)[\s\W]*$"), read(value, False, "parsed_clean_boolean"))
        .when(F.size(F.array_except(near, connectors)) == 0, read(value, True, "parsed_boolean_with_formatting_noise"))
        .otherwise(read(value, True, "ambiguous_boolean_with_extra_context"))
    )
    right_ = F.coalesce(x["v"] == truth, F.lit(False))
    return F.struct(right_.alias("is_correct"), x["m"].alias("manual_check"), F.when(right_, "matched").otherwise(x["r"]).alias("reason"))


def canonical(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[\s'\"(\[]+", ""), r"[\s'\")\].,!?;:]+$", "")


def same_set(items: Column, truth: Column) -> Column:
    return F.array_sort(F.transform(items, canonical)) == F.array_sort(F.transform(truth, canonical))


def same_order(items: Column, truth: Column) -> Column:
    return F.transform(items, canonical) == F.transform(truth, canonical)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def accuracy(runs: DataFrame, *by: str) -> DataFrame:
    """n, n_correct, percent and n_manual of graded rows (is_correct, manual_check), in all or by some columns."""
    n = F.count("*")
    right = F.sum(F.col("is_correct").cast("long"))
    return runs.groupBy(*by).agg(n.alias("n"), right.alias("n_correct"), percent(right, n).alias("percent"), F.sum(F.col("manual_check").cast("long")).alias("n_manual"))


def compare_runs(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    """new with the old run's verdict and answer beside it, the change (1, 0, -1; null where the old run lacks the row) and whether the answers agree."""
    o = old.select(key, F.col("is_correct").alias("old_correct"), F.col("answer").alias("old_answer"))
    delta = F.when(F.col("old_correct").isNotNull(), F.col("is_correct").cast("int") - F.col("old_correct").cast("int"))
    return new.join(o, key, "left").withColumns({"delta": delta, "changed": F.when(F.col("old_correct").isNotNull(), ~F.col("answer").eqNullSafe(F.col("old_answer")))})


def improvement(compared: DataFrame) -> DataFrame:
    reused = F.count("delta")
    return compared.agg(reused.alias("n_reused"), F.sum("delta").alias("delta_total"), percent(F.sum("delta"), F.nullif(reused, F.lit(0))).alias("delta_percent"))


def regressions(compared: DataFrame) -> DataFrame:
    """Rows that changed their verdict, marked regression or improvement."""
    return compared.where("delta IN (-1, 1)").withColumn("change", F.when(F.col("delta") < 0, "regression").otherwise("improvement"))


def coverage(df: DataFrame, found: Column) -> DataFrame:
    n, hit = F.count("*"), F.sum(found.cast("long"))
    return df.agg(n.alias("n"), hit.alias("n_found"), percent(hit, n).alias("percent"))
