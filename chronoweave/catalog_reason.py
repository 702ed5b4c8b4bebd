"""Queries that answer questions: pools, plans, reasoning and answers over facts made from suppliers, and the SQL that checks them.

The first ten suppliers bear names that questions can mention. Each table of
questions is asked as one batch through reason(); the SQL works the answers
out from the same suppliers without any plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronoweave.operators import asof
from chronoweave.operators.reason import comprehensive, context_mode, order_value, pools, reason, uses_context
from chronoweave.plans.question import compile_questions
from chronoweave.sources.facts import typed

NAMES = ("Mercury", "Venus", "Earth", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune", "Pluto", "Ceres")
TYPES = ("terrestrial", "gas giant", "ice giant")
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: pos, subject, predicate, object and time of the facts, by the supplier's key k; kept apart by class.
_FACTS = {
    "planet": (("distance_from_sun", "100 + (k * 37) % 101 * 10 + k % 7", None), ("mass", "1000 + (k * 7919) % 99991", None), ("moon_count", "(k * 5) % 17", "1990"), ("moon_count", "(k * 5) % 17 + k % 6", "2010-06"), ("discovered_on", "1600 + (k * 13) % 400", None)),
    "dwarf": (("classification", "'dwarf planet'", "2001"), ("diameter", "CASE WHEN k = 9 THEN 5000 ELSE 200 + (k * 53) % 977 END", "2000"), ("mass", "1000 + (k * 7919) % 99991", None)),
    "moon": (),
}
BODIES = (
    f"""WITH b AS (SELECT s_suppkey + 1 AS k, CASE WHEN s_suppkey < 10 THEN list_extract([{", ".join(f"'{n}'" for n in NAMES)}], s_suppkey::INT + 1) ELSE 'Body ' || (s_suppkey + 1) END AS name,
  CASE WHEN s_suppkey < 8 THEN 'planet' WHEN s_suppkey < 10 OR s_suppkey % 4 = 3 THEN 'dwarf' WHEN s_suppkey % 4 = 2 THEN 'moon' ELSE 'planet' END AS class FROM supplier),
p AS (SELECT *, 100 + (k * 37) % 101 * 10 + k % 7 AS dist, 1000 + (k * 7919) % 99991 AS mass, (k * 5) % 17 AS early, (k * 5) % 17 + k % 6 AS late, 1600 + (k * 13) % 400 AS year,
  CASE k % 3 WHEN 0 THEN '{TYPES[0]}' WHEN 1 THEN '{TYPES[1]}' ELSE '{TYPES[2]}' END AS type, row_number() OVER (ORDER BY 100 + (k * 37) % 101 * 10 + k % 7, k) AS place FROM b WHERE class = 'planet'),
d AS (SELECT *, CASE WHEN k = 9 THEN 5000 ELSE 200 + (k * 53) % 977 END AS diameter, (1700 + (k * 11) % 300) || '-' || lpad((1 + k % 12)::VARCHAR, 2, '0') AS found, CASE WHEN k % 2 = 0 THEN 'Kuiper Belt' ELSE 'Asteroid Belt' END AS belt,
  row_number() OVER (ORDER BY name) AS place FROM b WHERE class = 'dwarf')
"""
)


def _bodies(spark, d) -> DataFrame:
    k = F.col("s_suppkey") + 1
    name = F.when(k <= 10, F.get(F.array(*[F.lit(n) for n in NAMES]), (k - 1).cast("int"))).otherwise(F.concat(F.lit("Body "), k.cast("string")))
    kind = F.when(k <= 8, "planet").when((k <= 10) | (k % 4 == 0), "dwarf").when(k % 4 == 3, "moon").otherwise("planet")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("k"), name.alias("subject"), kind.alias("class"))


def body_facts(spark, d) -> DataFrame:
    """Facts of planets, dwarf planets and moons, a few a supplier."""
    rows = []

    def add(kind: str, predicate: str, value: str, time: str | None = None) -> None:
        rows.append(F.when(F.col("class") == kind, F.struct(F.lit(len(rows)).alias("i"), F.lit(predicate).alias("predicate"), F.expr(value).cast("string").alias("object_raw"), F.lit(time).cast("string").alias("time"))))

    for kind, own in _FACTS.items():
        for fact in own:
            add(kind, *fact)
    types = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES))
    add("planet", "planet_type", f"CASE k % 3 {types} END")
    add("dwarf", "location", "CASE WHEN k % 2 = 0 THEN 'Kuiper Belt' ELSE 'Asteroid Belt' END", "2001")
    add("dwarf", "discovered_on", "concat(1700 + (k * 11) % 300, '-', lpad(1 + k % 12, 2, '0'))")
    for kind in ("planet", "dwarf"):
        add(kind, "discovered_by", "concat('Person ', k)")
    add("moon", "orbits", "CASE WHEN k % 8 = 3 THEN 'Jupiter' ELSE 'Nothing' END")
    facts = _bodies(spark, d).select("k", "subject", F.explode(F.array_compact(F.array(*rows))).alias("f"))
    return typed(facts.select((F.col("k") * 100 + F.col("f.i")).alias("pos"), "subject", "f.predicate", "f.object_raw", "f.time"))


def _ask(spark, d, questions: list[tuple[int, str, str]]) -> DataFrame:
    return reason(spark.createDataFrame(questions, "qid int, kind string, question string"), body_facts(spark, d))


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows) + ")"


@query(
    BODIES
    + """SELECT 'planets' AS class, name AS entity, place::INT AS place FROM p
UNION ALL SELECT 'dwarf_planets', name, place::INT FROM d
UNION ALL SELECT 'moons', name, (row_number() OVER (ORDER BY name))::INT FROM b WHERE class = 'moon' AND k % 8 = 3"""
)
def e_pools(spark, d):
    return pools(body_facts(spark, d)).select("class", "entity", "place")


COUNTED = [(i * 10 + j, year, name, i + 1) for i, name in enumerate(NAMES[:8]) for j, year in enumerate((1985, 1990, 1995, 2010, 2015))]


@query(
    BODIES
    + f"""SELECT qid, CASE WHEN q.year < 1990 THEN '' WHEN q.year < 2010 THEN early::VARCHAR ELSE late::VARCHAR END AS answer, 'count_aggregation' AS strategy,
  CASE WHEN q.year < 1990 THEN 'No relevant facts found in the knowledge graph.' ELSE E'Knowledge Graph Facts:\\n1. ' || p.name || ' | moon_count = ' || (CASE WHEN q.year < 2010 THEN early || ' | time: 1990' ELSE late || ' | time: 2010-06' END) || E'\\n' END AS context,
  q.year >= 1990 AS enough, CASE WHEN q.year < 1990 THEN 'no_kg' ELSE 'raw_retrieval' END AS mode
FROM {_values(COUNTED)} AS q(qid, year, name, k) JOIN p USING (k)"""
)
def l_count(spark, d):
    out = _ask(spark, d, [(i, "single_number", f"As of {year}, how many confirmed moons orbit {name}?") for i, year, name, _ in COUNTED])
    return out.withColumns({"enough": comprehensive(out), "mode": context_mode(out)}).select("qid", "answer", "strategy", "context", "enough", "mode")


WINDOWS = [(i * 10 + j, form, i + 1, name) for i, name in enumerate(NAMES[:8]) for j, form in enumerate(("before", "after", "between"))]


@query(BODIES + f"SELECT qid, CASE form WHEN 'before' THEN early ELSE late END::VARCHAR AS answer FROM {_values(WINDOWS)} AS q(qid, form, k, name) JOIN p USING (k)")
def l_windows(spark, d):
    text = {"before": "Before 2000, how many known moons did {} have?", "after": "After 2000, how many known moons does {} have?", "between": "Between 2005 and 2012, how many moons did {} have?"}
    return _ask(spark, d, [(i, "single_number", text[form].format(name)) for i, form, _, name in WINDOWS]).select("qid", "answer")


@query(
    BODIES
    + f"""SELECT q.k::INT AS qid, coalesce(string_agg(p.name, ', ' ORDER BY p.place), '') AS answer, 'list_filtering' AS strategy
FROM (SELECT k, name, late FROM p WHERE k <= 8) q LEFT JOIN p ON p.late < q.late AND p.dist > (SELECT dist FROM p WHERE name = 'Earth') AND p.name <> q.name AND p.name <> 'Earth'
WHERE q.name <> 'Earth' GROUP BY q.k"""
)
def l_filter(spark, d):
    out = _ask(spark, d, [(i + 1, "entity_list", f"Which planets orbit beyond Earth yet have fewer moons than {name}?") for i, name in enumerate(NAMES[:8]) if name != "Earth"])
    return out.select("qid", "answer", "strategy")


@query(
    BODIES
    + f"""SELECT qid, coalesce(string_agg(p.name, ', ' ORDER BY p.mass DESC, p.place), '') AS answer,
  E'Derived KG Result:\\n' || upper(t[1]) || t[2:] || E' planets ordered by decreasing mass:\\n' || coalesce(string_agg(p.name, ', ' ORDER BY p.mass DESC, p.place), 'No matching entities found.') AS context
FROM {_values([(i, t) for i, t in enumerate(TYPES)])} AS q(qid, t) LEFT JOIN p ON p.type = q.t GROUP BY qid, t
UNION ALL SELECT 9, string_agg(name, ', ' ORDER BY mass DESC, place), E'Derived KG Result:\\nPlanets ordered by decreasing mass:\\n' || string_agg(name, ', ' ORDER BY mass DESC, place) FROM p"""
)
def l_ordered(spark, d):
    asked = [(i, "ordered_list", f"List the {t} planets in order of decreasing mass.") for i, t in enumerate(TYPES)]
    return _ask(spark, d, [*asked, (9, "ordered_list", "List the planets in order of decreasing mass.")]).select("qid", "answer", "context")


@query(
    BODIES
    + """SELECT 1 AS qid, (SELECT name FROM d WHERE belt = 'Kuiper Belt' ORDER BY found, place LIMIT 1) AS answer, 'list_filter_and_order_by_discovered_on_entity_selection' AS strategy
UNION ALL SELECT 2, (SELECT name FROM d WHERE belt = 'Asteroid Belt' ORDER BY found, place LIMIT 1), 'list_filter_and_order_by_discovered_on_entity_selection'
UNION ALL SELECT 3, (SELECT name FROM d WHERE belt = 'Kuiper Belt' ORDER BY found DESC, place LIMIT 1), 'list_filter_and_order_by_discovered_on_entity_selection'"""
)
def l_select(spark, d):
    text = "Which dwarf planet located in the {} was discovered {}?"
    return _ask(spark, d, [(1, "entity", text.format("Kuiper Belt", "first")), (2, "entity", text.format("Asteroid Belt", "first")), (3, "entity", text.format("Kuiper Belt", "last"))]).select("qid", "answer", "strategy")


PAIRS = [(i * 10 + j, i + 1, j + 1) for i in range(8) for j in range(8) if i != j]


@query(
    BODIES
    + f"""SELECT qid, CASE WHEN y.mass > x.mass THEN y.name ELSE x.name END AS heavier, CASE WHEN y.mass < x.mass THEN y.name ELSE x.name END AS lighter, CASE WHEN y.dist > x.dist THEN y.name ELSE x.name END AS farther
FROM {_values(PAIRS)} AS q(qid, i, j) JOIN p x ON x.k = i JOIN p y ON y.k = j"""
)
def l_compare(spark, d):
    forms = (("heavier", "Between {} and {}, which planet has the greater mass?"), ("lighter", "Between {} and {}, which planet is lighter?"), ("farther", "Between {} and {}, which one is farther from the Sun?"))
    asked = [(1000 * f + qid, "entity", text.format(NAMES[i - 1], NAMES[j - 1])) for f, (_, text) in enumerate(forms) for qid, i, j in PAIRS]
    out = _ask(spark, d, asked).select((F.col("qid") % 1000).alias("qid"), (F.col("qid") / 1000).cast("int").alias("f"), "answer")
    return out.groupBy("qid").pivot("f", [0, 1, 2]).agg(F.first("answer")).toDF("qid", *[n for n, _ in forms])


@query(
    BODIES
    + """SELECT k::INT AS qid, year || ', Person ' || k AS answer, 'multi_field_combination' AS strategy FROM p WHERE k <= 8
UNION ALL SELECT k::INT, found[1:4] || ', Person ' || k, 'multi_field_combination' FROM d WHERE k <= 10"""
)
def l_fields(spark, d):
    return _ask(spark, d, [(i + 1, "multi_field", f"In what year was {n} discovered, and who discovered it?") for i, n in enumerate(NAMES)]).select("qid", "answer", "strategy")


@query(
    BODIES
    + """, n AS (SELECT b.k, b.class, d.belt, d.diameter FROM b LEFT JOIN d USING (k) WHERE b.k <= 10), big AS (SELECT name FROM d ORDER BY diameter DESC, place LIMIT 1)
SELECT k::INT AS qid, CASE WHEN class = 'dwarf' AND belt = 'Kuiper Belt' THEN 'yes' ELSE 'no' END AS located, CASE WHEN class = 'dwarf' AND diameter >= (SELECT max(diameter) FROM d) THEN 'yes' ELSE 'no' END AS largest FROM n"""
)
def l_boolean(spark, d):
    asked = [(i + 1, "boolean", f"As of 2010, is {n} a dwarf planet located in the Kuiper Belt?") for i, n in enumerate(NAMES)]
    asked += [(101 + i, "boolean", f"As of 2010, is {n} the dwarf planet with the largest diameter?") for i, n in enumerate(NAMES)]
    out = _ask(spark, d, asked).select((F.col("qid") % 100).alias("qid"), (F.col("qid") / 100).cast("int").alias("f"), "answer")
    return out.groupBy("qid").pivot("f", [0, 1]).agg(F.first("answer")).toDF("qid", "located", "largest")


@query(
    BODIES
    + """SELECT 'mass' AS attribute, name AS subject, mass::DOUBLE AS value FROM p UNION ALL SELECT 'mass', name, 1000 + (k * 7919) % 99991 FROM d
UNION ALL SELECT 'discovered_on', name, year * 10000 + 101 FROM p UNION ALL SELECT 'discovered_on', name, replace(found, '-', '')::INT * 100 + 1 FROM d"""
)
def e_attributes(spark, d):
    facts = asof.latest(body_facts(spark, d).where("predicate IN ('mass', 'discovered_on')"), "subject", "predicate")
    return facts.select(F.col("predicate").alias("attribute"), "subject", order_value(F.col("predicate"), F.struct("object_raw", "object_num")).alias("value"))
