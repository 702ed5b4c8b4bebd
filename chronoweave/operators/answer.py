"""From questions to results: prompts with or without facts, questions of several parts answered part by part, and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.operators.reason import comprehensive, context_mode, reason, uses_context
from chronoweave.plans.prompts import facts_prompt, parse_split, question_prompt
from chronoweave.plans.question import compile_questions
from chronoweave.sources.work import written


def answer_flow(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """reason(), with found, enough, prompt_used (facts go into the prompt), mode and prompt.

    Facts are used where the question's shape wants them, some were found and
    they suffice; otherwise the prompt is the question alone.
    """
    out = reason(questions, facts)
    found = F.col("derived").isNotNull() | (F.size("reasoned") > 0) | (F.size("raw") > 0)
    out = out.withColumns({"found": found, "enough": comprehensive(out), "mode": context_mode(out)})
    out = out.withColumn("prompt_used", uses_context(out) & F.col("found") & F.col("enough"))
    with_facts = facts_prompt(F.col("question"), F.col("context"), F.when(F.col("plan.has_time"), F.col("plan.time_value")))
    return out.withColumn("prompt", F.when(F.col("prompt_used"), with_facts).otherwise(question_prompt(F.col("question"))))


def sub_questions(compiled: DataFrame, split: Column | None = None) -> DataFrame:
    """Adds parts, the questions of a multi-field plan's fields, and parts_source.

    split: a splitter's answer; it counts only if it has a question for each
    field (llm_splitter), else the fields' own questions do (template_fallback;
    none without fields).
    """
    own = F.filter(F.transform("plan.fields", lambda f: f["sub_question"]), lambda x: x.isNotNull() & (x != ""))
    given = parse_split(F.lit(None).cast("string") if split is None else split, F.size(own))
    df = compiled.withColumns({"_own": own, "_given": given})
    source = F.when(F.size("_own") == 0, "none").when(F.size("_given") > 0, "llm_splitter").otherwise("template_fallback")
    return df.withColumns({"parts": F.when(F.size("_given") > 0, F.col("_given")).otherwise(F.col("_own")), "parts_source": source}).drop("_own", "_given")


def answer_fields(questions: DataFrame, facts: DataFrame, split: str | None = None) -> DataFrame:
    """(qid, answer, parts_source, found, strategies) of the questions that ask for several fields, each answered as a question of its own.

    A part inherits the question's time. Answers are joined with commas;
    strategies is the JSON of each part's field, question, strategy, shape,
    prompt_used and mode.
    """
    q = sub_questions(compile_questions(questions), None if split is None else F.col(split)).where("plan.primary = 'MULTI_FIELD'")
    part = q.select("qid", "parts_source", F.posexplode(F.arrays_zip("plan.fields", "parts")).alias("i", "x"), F.struct(F.col("plan.semantic").alias("semantic"), F.col("plan.time_value").alias("value"), F.col("plan.has_time").alias("has")).alias("time"))
    part = written(part.select(F.col("qid").alias("whole"), "parts_source", "i", F.col("x.fields.name").alias("part"), F.col("x.parts").alias("question"), F.when(F.col("x.fields.answer_type") == "COUNT", "single_number").otherwise("entity").alias("kind"), F.when(F.col("time.has"), F.col("time")).alias("time_override")), "parts")
    part = part.withColumn("qid", F.struct("whole", "i"))
    out = answer_flow(part, facts)
    row = F.struct(F.col("part").alias("field"), F.col("question").alias("sub_question"), "strategy", F.col("plan.primary").alias("primary_type"), F.col("prompt_used").alias("kg_prompt_used"), F.col("mode").alias("kg_context_mode"))
    one = F.array_sort(F.collect_list(F.struct("i", "answer", row.alias("row"))))
    out = out.groupBy(F.col("whole").alias("qid"), "parts_source").agg(one.alias("o"), F.max("found").alias("found"))
    return out.select("qid", F.array_join(F.transform("o", lambda x: x["answer"]), ", ").alias("answer"), "parts_source", "found", F.to_json(F.transform("o", lambda x: x["row"])).alias("strategies"))


def truth_text(value: Column, fields: Column) -> Column:
    """A question's truth as JSON text: its value, else its fields, else empty; both come as JSON text or null."""
    return F.coalesce(value, fields, F.lit(""))


def result_rows(answered: DataFrame, graded: Column, earlier: DataFrame | None = None) -> DataFrame:
    """One row a question, from answer_flow() with kind and ground_truth: what was asked, how it was answered, its verdict, and how
    that compares with an earlier answer (qid, answer, is_correct) of the same question."""
    text = lambda c: F.to_json(F.col(c))
    out = answered.withColumn("verdict", graded).select(
        "qid",
        "question",
        "kind",
        "ground_truth",
        F.col("plan.primary").alias("primary_type"),
        F.upper("plan.semantic").alias("time_semantic"),
        text("plan.modifiers").alias("logical_modifiers"),
        F.col("strategy").alias("reasoning_strategy"),
        "prompt_used",
        F.col("mode").alias("context_mode"),
        "found",
        F.when(F.size("reasoned") > 0, F.size("reasoned")).otherwise(F.size("raw")).alias("facts_count"),
        text("plan.entities").alias("parsed_entities"),
        text("plan.predicates").alias("parsed_predicates"),
        F.col("plan.time_constraint").alias("time_constraint"),
        "answer",
        F.col("verdict.is_correct").alias("is_correct"),
        F.col("verdict.reason").alias("reason"),
    )
    if earlier is None:
        return out
    old = earlier.select("qid", F.col("answer").alias("earlier_answer"), F.col("is_correct").alias("earlier_is_correct"))
    out = out.join(old, "qid", "left")
    same = F.when(F.col("earlier_answer").eqNullSafe(F.col("answer")), "same").otherwise("different")
    return out.withColumns({"earlier_vs_now": same, "improved": F.col("is_correct").cast("int") - F.col("earlier_is_correct").cast("int")})


def timings(runs: DataFrame, *seconds: str) -> DataFrame:
    """The number of runs and, for each column of seconds, their sum and mean."""
    return runs.agg(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{c}_{name}") for c in seconds for name, f in (("total", F.sum), ("mean", F.avg))])
