"""Prompts for questions, alone or with context, and the reading of a splitter's answer, as Columns.

Wordings are parameters: a text with {question}, {context}, {time} and {parts}
where those go.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BARE = "Give the answer alone: a number, yes or no, a name, or names with commas between, in the order asked for.\n\nQuestion:\n{question}\n\nAnswer:\n"
WITH_FACTS = "Answer from these facts where they bear on the question and its time, else from what is known.\nGive the answer alone.\n\nFacts:\n{context}\n{time}\n\nQuestion: {question}\n\nAnswer:\n"
WITH_PASSAGES = "Answer from these passages. If they do not suffice, answer exactly: insufficient context\nGive the answer alone.\n\nPassages:\n{context}\n\nQuestion: {question}\n\nAnswer:\n"
SPLIT = "Split this question into exactly {parts} questions that stand alone, with the same names and times.\nWrite them as\nQuestion 1: ...\nQuestion 2: ...\n\nQuestion:\n{question}\n"


def render(template: str, **values: Column) -> Column:
    """The template with each value, as text, in its place; null values as empty text. Values are not read as templates."""
    parts, left = [], template
    while left:
        at, name = min((left.find("{" + n + "}") % (1 << 30), n) for n in values) if values else (1 << 30, "")
        if not left.startswith("{" + name + "}", at) or not name:
            parts.append(F.lit(left))
            break
        parts += [F.lit(left[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        left = left[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def question_prompt(question: Column, template: str = BARE) -> Column:
    return render(template, question=question)


def facts_prompt(question: Column, context: Column, time: Column, template: str = WITH_FACTS) -> Column:
    """With a block for the question's time only where there is one."""
    block = F.when(time.isNotNull() & (time != ""), F.concat(F.lit("\nTime Constraint from Question:\n"), time, F.lit("\n"))).otherwise("")
    return render(template, question=question, context=context, time=block)


def passages_prompt(question: Column, context: Column, template: str = WITH_PASSAGES) -> Column:
    return render(template, question=question, context=context)


def split_prompt(question: Column, parts: Column, template: str = SPLIT) -> Column:
    return render(template, question=question, parts=parts)


def parse_split(text: Column, parts: Column) -> Column:
    """The questions of a splitter's answer (Question 1: .. Question 2: ..), in order; empty unless all parts are there.

    Of two with one number the later counts; white space is one space.
    """
    # a mark before each label, so that a split at marks gives number and text
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)(?:^|\n)[^\n]*?question[ \t]+(\d+):", "\u0001$1\u0002")
    pieces = F.filter(F.split(marked, "\u0001"), lambda x: x.contains("\u0002"))
    numbered = F.transform(pieces, lambda x: F.struct(F.split_part(x, F.lit("\u0002"), F.lit(1)).try_cast("int").alias("n"), F.regexp_replace(F.btrim(F.split_part(x, F.lit("\u0002"), F.lit(2)), F.lit(" \t\r\n")), r"\s+", " ").alias("q")))
    numbered = F.filter(numbered, lambda x: x["q"] != "")
    last = lambda i: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(numbered, lambda x: x["n"] == i), lambda x: x["q"])), -1)
    found = F.array_compact(F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), last))
    return F.when((F.size(found) == parts) & (parts > 0), found).otherwise(F.array().cast("array<string>"))
