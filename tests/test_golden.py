"""The golden questions, answered from the golden facts and graded."""

import json

import pytest
from pyspark.sql import functions as F

from chronoweave.operators.reason import reason
from chronoweave.operators.score import accuracy, grade
from chronoweave.sources.facts import read_facts
from tests.golden import FACTS, QUESTIONS


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    """As a JSON array of facts in a file."""
    path = tmp_path_factory.mktemp("facts") / "facts.json"
    path.write_text(json.dumps([{"subject": s, "predicate": p, "object": o, "time": t} for s, p, o, t in FACTS]))
    return read_facts(spark, f"file://{path}")


def test_read(facts):
    rows = facts.orderBy("pos").collect()
    assert [(r.subject, r.predicate, r.time) for r in rows] == [(s, p, t) for s, p, _, t in FACTS]
    for r, (_, _, o, _) in zip(rows, FACTS, strict=True):
        assert r.object_num == (float(o) if isinstance(o, (int, float)) or (isinstance(o, str) and o.isdigit()) else None)
        assert r.object_bool == (o if isinstance(o, bool) else None)


def test_all_answers_are_right(spark, facts):
    truth = [(i, q, k, json.dumps([{"name": n, "type": t, "value": x} for n, t, x in v] if k == "multi_field" else v)) for i, q, k, v in QUESTIONS]
    asked = spark.createDataFrame(truth, "qid int, question string, kind string, truth string")
    out = reason(asked, facts).withColumn("verdict", grade(F.col("kind"), F.col("answer"), F.col("truth")))
    rows = out.select("*", "verdict.is_correct", "verdict.manual_check").cache()
    assert {r.qid: r.answer for r in rows.collect() if not r.is_correct} == {}
    assert accuracy(rows).first().percent == 100.0
