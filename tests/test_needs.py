"""Strings that patterns need, against the patterns alone."""

import re
from itertools import product

from pyspark.sql import functions as F

from chronoweave.plans import question as Q
from tests.golden import QUESTIONS


def test_cheap_searches_hide_no_match(spark, monkeypatch):
    """Names and predicates are those that the patterns find, whatever is searched first; names in other words are none."""
    starts = ("how many of the", "when was", "in what year", "which is", "who", "which astronomer", "was", "is pluto", "name the")
    ends = ("satellites", "orbital bodies", "it found", "discovery year", "finder", "recognition date", "first seen and when", "observation year", "lightest", "farther from the sun", "gravitational pull", "classify as", "gas giant", "found in", "in the asteroid belt", "largest to smallest", "ranked", "compared to", "smaller", "marsh or ionian, mars")
    texts = [q[1] for q in QUESTIONS] + [f"{a} {b}" for a, b in product(starts, ends)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = lambda: df.select("t", Q.predicates(F.col("t")).alias("p"), Q.predicate_mentions(F.col("t")).alias("m"), Q.spot_entities(F.col("t")).alias("e")).collect()
    cheap = got()
    assert set(Q.NEEDS) == {p for p, _ in Q.PREDICATES.values()}
    monkeypatch.setattr(Q, "NEEDS", {})
    assert cheap == got() and len({p for r in cheap for p in r.p}) == len(Q.PREDICATES)
    for r in cheap:
        assert set(r.e) == {n for n in Q.ENTITIES if re.search(rf"\b{n.lower()}\b", r.t.lower())}


def test_names_are_spotted_once(spark):
    """Whether there are names and which take one search."""
    df = spark.createDataFrame([("x",)], "t string")
    searches = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().count("regexp_instr")
    assert searches(Q.entities(F.col("t"))) == searches(Q.spot_entities(F.col("t"))) > 0
