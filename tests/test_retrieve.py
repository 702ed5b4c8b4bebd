"""Scores with their reasons, a question's times, retrieval modes and why they fall back."""

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import text as T, timewin
from chronoweave.operators import retrieve

ASKED = {"terms": ["moons", "saturn moons"], "entities": ["saturn"], "predicates": ["moon_count"], "modifiers": ["time_lookup"], "times": {"years": ["2023"], "months": ["may"], "phrases": ["may 2023"]}}
CHUNKS = [
    ("a_0", "a", "Saturn", "Moons", "As of May 2023 Saturn had 146 confirmed moons. Saturn moons are many moons.", ["moon_count"]),
    ("b_0", "b", "Mars", "Geology", "Dust in may 2023.", []),
    ("c_0", "c", "Else", "", "nothing here", []),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, source_id string, title string, section string, text string, predicate_hints array<string>")


def test_chunk_reasons(chunks):
    got = {r.chunk_id: r for r in retrieve.score_chunks(chunks, ASKED).collect()}
    assert set(got) == {"a_0", "b_0"}
    assert got["a_0"].reasons == ["phrase:saturn moons", "entity:saturn", "predicate:moon_count", "moon_section", "moon_count_terms", "planet_moon_context", "moon_count_claim", "exact_time:may 2023", "year:2023", "month:may", "as_of_time_context"]
    # four times moons: 1 + ln 4; then the points of the reasons
    assert got["a_0"].score == pytest.approx(1 + 1.3862943611 + 3 + 5 + 3 + 5 + 5 + 4 + 8 + 14 + 4 + 2 + 3)
    assert got["b_0"].reasons == ["exact_time_without_entity:may 2023"] and got["b_0"].score == 3.0


def test_source_reasons(spark):
    profile = spark.createDataFrame([("a", "saturn moons and saturn moons in june 2023 ", ["Saturn"], ["moon_count"], "Rings", "http://x.org/rings", "official", 6000, 8), ("b", "saturn", [], [], "t", "", None, 10, 1)], "source_id string, text string, entities array<string>, predicates array<string>, title string, url string, trust_level string, char_count long, token_total int")
    got = {r.source_id: r for r in retrieve.score_sources(profile, ASKED).collect()}
    assert got["a"].reasons == ["density_token:moons:2.00", "density_phrase:saturn moons:2", "entity:saturn", "predicate:moon_count", "time_support", "trust:official", "substantial_source"]
    assert got["a"].score == pytest.approx(1.6 + 2 + 2 * 1.0986122887 + 6 + 5 + 3 + 3 + 1)
    assert got["b"].score == pytest.approx(0.5) and got["b"].reasons == ["text_entity:saturn", "trust:", "short_source_penalty"]


def test_times_of_questions(spark):
    df = spark.createDataFrame([("As of May 2023 and in June, or 1899 and 2023?",), ("no time 1799 12345",), (None,)], "q string")
    got = [r[0] for r in df.select(retrieve.time_terms(F.col("q"))).collect()]
    assert (got[0].years, got[0].months, got[0].phrases) == (["2023", "1899"], ["may", "june"], ["may 2023"])
    assert (got[1].years, got[1].months, got[1].phrases) == ([], [], [])


def test_modes(spark, chunks):
    sources = spark.createDataFrame([("b",)], "source_id string")
    auto = retrieve.retrieve(chunks, ASKED, sources, "auto-source").collect()
    assert [r.chunk_id for r in auto] == ["a_0", "b_0"] and all(r.fallback for r in auto)
    everywhere = retrieve.retrieve(chunks, ASKED).collect()
    assert [r.chunk_id for r in everywhere] == ["a_0", "b_0"] and not any(r.fallback for r in everywhere)
    with pytest.raises(ValueError, match="unknown retrieval mode"):
        retrieve.retrieve(chunks, ASKED, mode="other")


def test_fallback_reason(spark):
    df = spark.createDataFrame([(True, 0, "x"), (False, 0, "x"), (False, 2, "x"), (False, 2, None)], "w boolean, n int, r string")
    assert [r[0] for r in df.select(retrieve.fallback_reason(F.col("w"), F.col("n"), F.col("r"))).collect()] == ["weak_auto_source_chunks", "no_sources_selected", "x", ""]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("one\n two   three", "2020", None)], "t string, d string, c string")
    row = df.select(T.one_line(F.col("t"), 7).alias("short"), T.one_line(F.col("t"), 100).alias("whole"), T.query_predicates(F.lit("how many moons and when was it discovered")).alias("p"), timewin.matches(F.lit(20200101), F.lit(20201231), F.col("c"), F.lit("exact")).alias("all"), timewin.matches(F.lit(20200101), F.lit(20201231), F.lit("1999"), F.lit("exact")).alias("none")).first()
    assert row.whole == "one two three" and row.short.endswith("...") and len(row.short) <= 10 and "moon_count" in row.p and row["all"] and not row["none"]


def test_last_line_over_uneven_files(spark, tmp_path):
    """The last line of a key is that of the last file by path, whatever the sizes of the files and the packing of their splits."""
    import json

    from chronoweave.sources.facts import read_lines, read_results_csv

    line = lambda i, v: json.dumps({"id": i, "v": v}) + "\n"
    (tmp_path / "part-0").write_text(line(1, "old"))
    (tmp_path / "part-1").write_text("".join(line(i, "x" * 50) for i in range(2, 2002)) + "\n" + line(1, "new") + line(7, "seven"))
    (tmp_path / "part-2").write_text(line(7, "last"))
    for most in (128 << 20, 4096):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = {r.id: r.v for r in read_lines(spark, str(tmp_path), "id int, v string", key="id").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == 2001 and got[1] == "new" and got[7] == "last"
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id,pos\n1,old\nx,none\n")
    (folder / "b.csv").write_text("id,pos\n" + "".join(f"{i},y\n" for i in range(2, 2002)) + "1,new\n")
    got = {r.id: r.pos for r in read_results_csv(spark, str(folder)).collect()}
    assert len(got) == 2001 and got[1] == "new"


def test_sources_by_their_chunks(spark):
    """Chunks' counts and seams give what a source's whole text gives: phrases over ends of chunks, overlapping ones, short, empty and missing chunks."""
    import hashlib
    import random

    rng = random.Random(5)
    words = ["moon", "moon", "in", "may", "2019", "x", "", "moon moon", "as", "of", "less", "than", "é", "lessthan", "moons", "oon m", "2019_", "The."]
    rows = [(s, n, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 1, 2, 3, 9)))) if rng.random() < 0.95 else None) for s in ("a", "b", "c", "d", "e", None) for n in range(60 if s in ("a", "b") else 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source_id string, nth long, text string").withColumns({"predicate_hints": F.array().cast("array<string>"), "entities": F.array().cast("array<string>"), "title": F.lit("t"), "url": F.lit("")})
    query = {"terms": ["moon moon", "moon", "in may"], "entities": ["of less", "than x"], "predicates": [], "modifiers": ["filter", "time_lookup"]}
    whole = {}
    for s, _, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        whole.setdefault(s, []).extend([] if t is None else [t.lower()])
    profile = retrieve.profiles(df)
    text = spark.createDataFrame([(s, " ".join(t)) for s, t in whole.items()], "s string, text string")
    told = lambda d: {r.source_id: (round(r.score, 6), r.reasons) for r in d.collect()}
    want = told(retrieve.score_sources(profile.join(text, F.col("source_id").eqNullSafe(F.col("s"))), query))
    assert told(retrieve.score_sources(profile, query, df)) == want and len(want) > 3
    assert {r.source_id: r.text_md5 for r in retrieve.text_digests(df).collect()} == {s: hashlib.md5(" ".join(t).encode()).hexdigest() for s, t in whole.items() if t}
    assert "text" not in profile.columns


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_only_texts_are_shuffled_for_term_scores(spark):
    """Counting and adding up stay where a text was dealt to; a key's several texts count together."""
    chunks = spark.createDataFrame([("a", "sun sun moon"), ("a", "sun"), ("b", "moon")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, ["sun", "moon"])], "qid int, terms array<string>")
    scored = retrieve.term_scores(asked, chunks)
    assert {r.chunk_id: round(r.score, 6) for r in scored.collect()} == {"a": round(2 + 1.0986122887, 6), "b": 1.0}
    from chronoweave import catalog

    dealt = [line for line in _plan(catalog.QUERIES["r_term_scores"](spark, "/root/testdata/sf0.001"), "executedPlan").splitlines() if "Exchange hashpartitioning" in line and "doc_id" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_COL" in dealt[0]


def test_a_chunk_is_scored_once(spark, chunks):
    """A condition on the score takes the score; it does not take the words again."""
    assert _plan(retrieve.score_chunks(chunks, ASKED)).count("regexp_extract_all") == 1


def test_selected_chunks_are_found_once(spark, chunks):
    """Whether the selection is weak and what it is come from one table."""
    selected = retrieve.cap_top(retrieve.score_chunks(chunks, ASKED))
    out = retrieve.with_fallback(selected, selected.where("false"))
    assert "regexp_extract_all" not in _plan(out) and out.count() == 0
