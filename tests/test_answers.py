"""Readers, prompts, the answering flow, result rows and fact chunks."""

import json

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import answer, chunk, clean
from chronoweave.operators.score import grade
from chronoweave.plans import prompts
from chronoweave.plans.question import compile_questions
from chronoweave.sources import facts as sources
from tests.golden import FACTS, QUESTIONS


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    rows = []
    for i, q, k, v in QUESTIONS:
        spec = {"kind": k, "fields": [{"name": n, "type": t, "value": x} for n, t, x in v]} if k == "multi_field" else {"kind": k, "value": v}
        rows.append({"id": i, "question": q, "answer_spec": spec, "entities": ["x", "é"], "type": k})
    path = tmp_path_factory.mktemp("q") / "questions.json"
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    return f"file://{path}", rows


@pytest.fixture(scope="module")
def known(spark):
    text = lambda o: o if isinstance(o, str) or o is None else json.dumps(o)
    return sources.facts_from_rows(spark, [(s, p, text(o), t) for s, p, o, t in FACTS])


def test_read_questions(spark, asked):
    path, rows = asked
    got = sources.read_questions(spark, path).orderBy("pos").collect()
    assert [(r.id, r.question, r.kind, r.type, r.entities) for r in got] == [(x["id"], x["question"], x["answer_spec"]["kind"], x["type"], ["x", "é"]) for x in rows]
    for r, x in zip(got, rows, strict=True):
        assert json.loads(r.ground_truth) == x["answer_spec"].get("value", x["answer_spec"].get("fields"))
    assert [r.id for r in sources.read_questions(spark, path, [15, 9]).orderBy("pos").collect()] == [9, 15]
    assert sources.row_by_id(sources.read_questions(spark, path), 9).first().id == 9
    with pytest.raises(Exception, match="no row with id 99"):
        sources.row_by_id(sources.read_questions(spark, path), 99).collect()


def test_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"source_id": "a", "n": 1}\n\n{"source_id": "b", "n": 2}\n  \n{"source_id": "a", "n": 3}\n')
    schema = "source_id string, n int"
    assert sorted(map(tuple, sources.read_lines(spark, f"file://{path}", schema).collect())) == [("a", 1), ("a", 3), ("b", 2)]
    assert sorted(map(tuple, sources.read_lines(spark, f"file://{path}", schema, "source_id").collect())) == [("a", 3), ("b", 2)]
    assert sources.read_lines(spark, f"file://{tmp_path}/none.jsonl", schema).collect() == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456, None, ["é"])], "id int, s double, t string, l array<string>")
    assert df.select(sources.record_json(df, "id", "s", "t", "l")).first()[0] == '{"id":1,"s":0.1235,"t":null,"l":["é"]}'
    for _ in range(2):
        sources.write_results(df, f"file://{tmp_path}/out", "csv", mode="append")
    again = sources.read_results_csv(spark, f"file://{tmp_path}/out")
    assert [(r.id, r.l) for r in again.collect()] == [(1, '["é"]')]


def test_prompts(spark):
    df = spark.createDataFrame([("Who {question}?", "facts {time}", "2020"), ("What?", "c", None)], "q string, c string, t string")
    got = [tuple(r) for r in df.select(prompts.facts_prompt(F.col("q"), F.col("c"), F.col("t"), "<{context}|{time}|{question}>"), prompts.question_prompt(F.col("q"), "{question}!"), prompts.passages_prompt(F.col("q"), F.col("c"))).collect()]
    assert got[0][0] == "<facts {time}|\nTime Constraint from Question:\n2020\n|Who {question}?>" and got[1][0] == "<c||What?>"
    assert got[0][1] == "Who {question}?!" and "Question: What?" in got[1][2] and "\nc\n" in got[1][2]
    assert "exactly 2 " in df.select(prompts.split_prompt(F.col("q"), F.lit(2))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Question 1: When was  it\n found?\nQuestion 2: By whom?", ["When was it found?", "By whom?"]), ("question 2: B\nQuestion 1: A", ["A", "B"]), ("Question 1: A", []), (None, []), ("Question 1: A\nQuestion 2: B\nQuestion 3: C", ["A", "B"]), ("Question 1:\nQuestion 2: B", [])],
)
def test_split(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(prompts.parse_split(F.col("t"), F.lit(2))).first()[0] == want


def test_flow_fields_and_rows(spark, known):
    rows = [(i, q, k, json.dumps([{"name": n, "type": t, "value": x} for n, t, x in v] if k == "multi_field" else v)) for i, q, k, v in QUESTIONS if i in (1, 3, 12)]
    rows.append((50, "What is the weather like?", "entity", '"sunny"'))
    asked = spark.createDataFrame(rows, "qid int, question string, kind string, ground_truth string")
    flow = answer.answer_flow(asked, known)
    got = {r.qid: r for r in flow.collect()}
    assert got[1].prompt_used and got[1].context in got[1].prompt and "Time Constraint from Question:\n2022-11\n" in got[1].prompt
    assert not got[50].prompt_used and not got[50].found and got[50].prompt == prompts.BARE.replace("{question}", rows[-1][1])
    parts = answer.answer_fields(asked, known).collect()
    assert [(r.qid, r.answer, r.parts_source, r.found) for r in parts] in ([(3, f"1846, {n}", "template_fallback", True)] for n in ("Johann Galle", "Johann Gottfried Galle"))
    assert [x["field"] for x in json.loads(parts[0].strategies)] == ["field1", "field2"]
    split = asked.withColumn("s", F.lit("Question 1: In what year was Neptune discovered?\nQuestion 2: Who discovered Neptune?"))
    assert answer.answer_fields(split, known, "s").first().parts_source == "llm_splitter"
    earlier = spark.createDataFrame([(1, "80", True), (12, "Mars", False)], "qid int, answer string, is_correct boolean")
    rows = {r.qid: r for r in answer.result_rows(flow, grade(F.col("kind"), F.col("answer"), F.col("ground_truth")), earlier).collect()}
    assert (rows[1].is_correct, rows[1].earlier_vs_now, rows[1].improved, rows[1].time_semantic) == (True, "same", 0, "EXACT")
    assert (rows[12].is_correct, rows[12].earlier_vs_now, rows[12].improved) == (True, "different", 1) and rows[50].improved is None


def test_time_override(spark, known):
    df = spark.createDataFrame([(1, "How many moons does Jupiter have?", "single_number", None), (2, "How many moons does Jupiter have?", "single_number", ("exact", "2022-11"))], "qid int, question string, kind string, time_override struct<semantic:string,value:string>")
    got = {r.qid: r for r in answer.answer_flow(df, known).collect()}
    assert got[2].answer == "80" and got[1].answer != "80" and got[2].plan.time_value == "2022-11"


def test_truth_and_timings(spark):
    df = spark.createDataFrame([("1", None, 2.0, 1.0), (None, "[]", 4.0, None), (None, None, 0.0, 3.0)], "v string, f string, a double, b double")
    assert [r[0] for r in df.select(answer.truth_text(F.col("v"), F.col("f"))).collect()] == ["1", "[]", ""]
    assert tuple(answer.timings(df, "a", "b").first()) == (3, 6.0, 2.0, 4.0, 2.0)


def test_sub_questions(spark):
    q = compile_questions(spark.createDataFrame([(1, QUESTIONS[2][1])], "qid int, question string"))
    r = answer.sub_questions(q).first()
    assert r.parts == ["In what year was Neptune discovered?", "Who discovered Neptune?"] and r.parts_source == "template_fallback"


def test_fact_chunks(spark):
    table = "Satellites of Saturn:\n2\nI\nMimas\n1789\nx\nMPEC 2003-A01\nS/2004 S 7\n2004\nx\nMPEC 2005-J13\nEnd of it\n" + "and words that fill a chunk of text up to its least length " * 6
    docs = spark.createDataFrame([("a", "A", table), ("b", "B", "plain words of no table at all " * 12)], "source_id string, title string, text string")
    rows = chunk.all_chunks(docs).orderBy("source_id", "nth").collect()
    facts = [r for r in rows if r.content_type == "structured_fact"]
    text = [r for r in rows if r.content_type == "text"]
    assert facts and {r.source_id for r in facts} == {"a"} and {r.source_id for r in text} == {"a", "b"}
    begin = sum(r.source_id == "a" for r in text)
    assert [r.chunk_id for r in facts] == [f"a_fact_{begin + i:04d}" for i in range(len(facts))]
    assert facts[0].structured_fact_id == "saturn_satellite_count_current" and all(r.structured_fact_id is None for r in text)


def test_ingest_limit_and_unknown_cleaner(spark):
    body = "title string, text string, content_hash string, char_count int"
    empty = spark.createDataFrame([], "source_id string, " + body)
    read = spark.createDataFrame([(x, "t", "x", "h", 1) for x in "abc"], "source_id string, " + body)
    sources_ = lambda cleaner: spark.createDataFrame([(x, cleaner) for x in "abc"], "source_id string, cleaner string")
    assert [r.source_id for r in clean.ingest(sources_("wikipedia"), empty, read, limit=2).orderBy("source_id").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="unknown cleaner: other"):
        clean.ingest(sources_("other"), empty, read).collect()
