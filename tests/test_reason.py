"""Questions answered from a small set of facts."""

import pytest

from chronoweave.operators.reason import comprehensive, context_mode, reason, uses_context
from chronoweave.sources.facts import facts_from_rows

FACTS = [
    ("Earth", "distance_from_sun", "1.5e8", None), ("Mars", "distance_from_sun", "2.3e8", None), ("Jupiter", "distance_from_sun", "7.8e8", None),
    ("Venus", "distance_from_sun", "1.1e8", None), ("Earth", "mass", "5.97e24", None), ("Earth", "mass", "5.9e24", None), ("Mars", "mass", "6.4e23", None),
    ("Venus", "mass", "4.9e24", None), ("Jupiter", "mass", "1.9e27", None), ("Earth", "planet_type", "terrestrial", None), ("Mars", "planet_type", "terrestrial", None),
    ("Venus", "planet_type", "terrestrial", None), ("Jupiter", "planet_type", "gas giant", None), ("Jupiter", "moon_count", "79", "2020"),
    ("Jupiter", "moon_count", "80", "2022-11"), ("Jupiter", "moon_count", "'", "2023-13"), ("Jupiter", "moon_count", "95", "2023-03"), ("Mars", "moon_count", "2", "1990"),
    ("Earth", "moon_count", "1", "1990"), ("Pluto", "classification", "dwarf planet", "2006"), ("Eris", "classification", "dwarf planet", "2006"),
    ("Pluto", "location", "Kuiper Belt", "2000"), ("Eris", "location", "Scattered Disc", None), ("Pluto", "discovered_on", "1930-02-18", None),
    ("Pluto", "discovered_by", "Clyde Tombaugh", None), ("Eris", "discovered_on", "2005-01", None), ("Pluto", "diameter", "2377", "2000"), ("Eris", "diameter", "2326", "2000"),
]
ASKED = [
    ("As of November 2022, how many confirmed moons orbit Jupiter?", "single_number", "80"),
    ("Before 2022, how many known moons did Jupiter have?", "single_number", "79"),
    ("After 2022, how many known moons does Jupiter have?", "single_number", "95"),
    ("How many known moons does Jupiter have?", "single_number", "95"),
    ("In what year was Pluto discovered, and who discovered it?", "multi_field", "1930, Clyde Tombaugh"),
    ("Which dwarf planet located in the Kuiper Belt was discovered first?", "entity", "Pluto"),
    ("Which planets orbit beyond Earth and have fewer moons than Jupiter?", "entity_list", "Mars"),
    ("List the terrestrial planets in order of decreasing mass.", "ordered_list", "Earth, Venus, Mars"),
    ("Between Earth and Mars, which has the greater mass?", "entity", "Earth"),
    ("As of 2010, is Pluto a dwarf planet located in the Kuiper Belt?", "boolean", "yes"),
    ("As of 2010, is Eris a dwarf planet of the largest diameter?", "boolean", "no"),
    ("What is the weather like?", "entity", ""),
]


@pytest.fixture(scope="module")
def answered(spark):
    q = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(ASKED)], "qid int, question string, kind string")
    out = reason(q, facts_from_rows(spark, FACTS))
    out = out.withColumns({"enough": comprehensive(out), "used": uses_context(out), "mode": context_mode(out)})
    return {r.qid: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(ASKED)))
def test_answers(answered, i):
    assert answered[i].answer == ASKED[i][2], answered[i].strategy


def test_context(answered):
    assert answered[0].strategy == "count_aggregation" and answered[0].context == "Knowledge Graph Facts:\n1. Jupiter | moon_count = 80 | time: 2022-11\n"
    assert answered[6].context.startswith("Derived KG Result:\nFiltered planets matching all conditions:\nMars") and answered[6].mode == "derived_reasoning"
    assert answered[7].context.split("\n")[1] == "Terrestrial planets ordered by decreasing mass:"
    assert answered[11].context == "No relevant facts found in the knowledge graph." and answered[11].mode == "no_kg" and not answered[11].enough
    assert answered[0].enough and answered[0].used
