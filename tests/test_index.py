"""The impact-ordered index against scores of one question at a time."""

import random

import pytest

from chronoweave.functions import text as T
from chronoweave.operators import index, retrieve

CHUNK = "chunk_id string, source_id string, nth int, title string, url string, section string, text string, entities array<string>, predicate_hints array<string>"
Q = f"qid int, {index.QUESTION}"


def made(spark, n, seed=3, words=300, planted=()):
    """Chunks of words whose frequencies fall like 1 / rank."""
    rnd = random.Random(seed)
    known = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rnd.choices(known, weights, k=rnd.randint(20, 60))) for _ in range(n)]
    for i, t in enumerate(planted):
        texts[(i * 37) % n] += " " + t
    rows = [(f"c{i:05d}", f"s{i % 97}", i, ["Mars", "Solar System", "x", None][i % 4], "", ["orbits", "Moons", None][i % 3], t, [], [["mass"], None, []][i % 3]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNK)


QUESTIONS = [
    (1, ["w1", "w40", "w77", "w200", "w1 w2"], ["w3 w1"], ["mass"], ["filter"], ([], [], [])),
    (2, ["w0", "w5", "w250", "w251", "w252"], [], [], [], ([], [], [])),
    (3, ["w90", "discovered", "w91", "moon"], ["mars", "", "mars"], ["moon_count", "distance_from_sun"], ["ordering", "filter"], (["1999"], ["may"], ["may 1999"])),
    (4, ["nowhere"], ["w0"], [], [], ([], [], [])),
    (5, [], [], [], [], ([], [], [])),
    (6, ["w299", "w298"], [], None, None, None),
]
PLANTED = ["as of may 1999 discovered discovered mars has two known moons from the sun", "w90 w91 in order of discovery discovered w90 moon", "dwarf planet w90 w91 1999 may", "the kuiper belt located beyond earth w200 w77"] * 3


@pytest.mark.parametrize("top, per", [(12, 4), (3, 1), (1, 2)])
def test_same_as_one_question_at_a_time(spark, top, per):
    chunks = made(spark, 400, planted=PLANTED)
    got = {}
    for r in index.search(index.build_index(chunks), spark.createDataFrame(QUESTIONS, Q), top, per, 6).ranked.collect():
        got.setdefault(r.qid, []).append((r["rank"], r.chunk_id, round(r.score, 6), r.reasons))
    for qid, terms, entities, predicates, modifiers, times in QUESTIONS:
        years, months, phrases = times or ([], [], [])
        query = {"terms": terms, "entities": entities, "predicates": predicates or [], "modifiers": modifiers or [], "times": {"years": years, "months": months, "phrases": phrases}}
        scored = retrieve.score_chunks(chunks, query).withColumn("score", retrieve.F.round("score", 6))
        want = [(r["rank"], r.chunk_id, round(r.score, 6), r.reasons) for r in retrieve.cap_top(scored, top, per).collect()]
        assert sorted(got.get(qid, [])) == sorted(want), qid


def test_reads_under_a_fifth(spark):
    """Questions with a few good answers among many chunks read few of the postings of their words, the probe included."""
    asked, planted = [], []
    rnd = random.Random(5)
    for q in range(8):
        own = [f"w{i}" for i in rnd.sample(range(20), 6)] + [f"w{i}" for i in rnd.sample(range(20, 300), 14)]
        asked.append((q, own, [], [], [], ([], [], [])))
        planted += [" ".join(own)] * 4
    chunks = made(spark, 4000, planted=planted)
    found = index.search(index.build_index(chunks), spark.createDataFrame(asked, Q), 4, 4)
    assert found.ranked.count() == 32
    total = found.plan.agg({"n": "sum"}).first()[0]
    read = found.plan.where("read").agg({"n": "sum"}).first()[0] + found.probed.agg({"n": "sum"}).first()[0]
    assert read * 5 < total


def test_scores_only_what_parts_of_the_text_can_raise(spark, monkeypatch):
    """Points for parts that hardly any text has let many chunks near the threshold; only those whose text has them are scored in full."""
    rnd = random.Random(7)
    own = [[f"w{i}" for i in rnd.sample(range(40), 12)] for _ in range(6)]
    asked = [(q, w, ["no such part", "nor this", "w1 w0"], [], [], ([], [], [])) for q, w in enumerate(own)]
    chunks = made(spark, 2000)
    made_index, counts, score = index.build_index(chunks), [], index.score_pairs

    def counted(pairs):
        counts.append(pairs.count())
        return score(pairs)

    monkeypatch.setattr(index, "score_pairs", counted)
    monkeypatch.setattr(index, "TRIED", 8)
    found = index.search(made_index, spark.createDataFrame(asked, Q), 4, 4, 6).ranked.collect()
    assert len(found) == 24 and counts[1] * 5 < 6 * 2000
    query = {"terms": own[2], "entities": asked[2][2], "predicates": [], "modifiers": [], "times": {"years": [], "months": [], "phrases": []}}
    want = retrieve.cap_top(retrieve.score_chunks(chunks, query).withColumn("score", retrieve.F.round("score", 6)), 4, 4).collect()
    assert sorted((r.chunk_id, r.score) for r in found if r.qid == 2) == sorted((r.chunk_id, r.score) for r in want)


def test_blocks_are_small_and_whole(spark, monkeypatch):
    """Hot levels are cut into blocks; the postings are those of the chunks."""
    for block, hot in ((16, 1 << 16), (16, 8)):
        monkeypatch.setattr(index, "BLOCK", block)
        monkeypatch.setattr(index, "HOT", hot)
        chunks = made(spark, 500)
        made_index = index.build_index(chunks)
        rows = made_index.postings.collect()
        assert max(len(r.chunks) for r in rows) < 6 * block
        got = sorted((r.token, r.tf, c) for r in rows for c in r.chunks if ":" not in r.token)
        own = chunks.select("chunk_id", retrieve.F.explode(T.tokens(retrieve.F.concat_ws(" ", retrieve.F.coalesce("title", retrieve.F.lit("")), retrieve.F.coalesce("section", retrieve.F.lit("")), "text"))).alias("token"))
        assert got == sorted((r.token, r.tf, r.chunk_id) for r in own.groupBy("chunk_id", "token").agg(retrieve.F.count("*").alias("tf")).collect())


def test_nothing_to_find(spark):
    empty = index.build_index(spark.createDataFrame([], CHUNK))
    assert index.search(empty, spark.createDataFrame(QUESTIONS, Q)).ranked.count() == 0
    some = index.build_index(made(spark, 5))
    assert index.search(some, spark.createDataFrame([], Q)).ranked.count() == 0
