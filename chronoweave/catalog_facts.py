"""Queries over facts, plans and verdicts, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from chronoweave.functions.timewin import bounds, in_bounds, span
from chronoweave.operators import asof, score
from chronoweave.operators.reason import order_value, retrieve_batch, scalar_text, year_text
from chronoweave.plans.question import compile_questions, normalize_time, time_constraint, time_semantic
from chronoweave.sources.facts import facts_from_orders, typed

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, d: str, name: str):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _facts(spark, d):
    return facts_from_orders(table(spark, d, "orders"))


FACTS = """
WITH f AS (
  SELECT o_orderkey AS pos, o_custkey::VARCHAR AS subject, o_orderpriority AS predicate, o_totalprice AS num, o_orderdate AS day,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS time
  FROM orders),
w AS (
  SELECT *, CASE length(time) WHEN 4 THEN time::INT * 10000 + 101 WHEN 7 THEN replace(time, '-', '')::INT * 100 + 1 ELSE replace(time, '-', '')::INT END AS t_start,
         (CASE length(time) WHEN 4 THEN time::INT * 10000 + 1231 WHEN 7 THEN replace(time, '-', '')::INT * 100 + day(last_day((time || '-01')::DATE)) ELSE replace(time, '-', '')::INT END)::INT AS t_end
  FROM f)
"""
LATEST = "t_end DESC NULLS LAST, t_start DESC NULLS LAST, pos"
EARLIEST = "t_start NULLS LAST, t_end NULLS LAST, pos"
OUT = "subject, predicate, pos, time, t_start, t_end"


def _picked(where: str, order: str) -> str:
    return f"{FACTS} SELECT {OUT} FROM w WHERE {where} QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY {order}) = 1"


def _out(df):
    return df.select("subject", "predicate", "pos", "time", "t_start", "t_end")


@query(f"{FACTS} SELECT pos, time, t_start, t_end, t_end - t_start AS width FROM w")
def t_window(spark, d):
    return _facts(spark, d).select("pos", "time", "t_start", "t_end", span(F.col("t_start"), F.col("t_end")).alias("width"))


@query(_picked("true", LATEST))
def t_latest(spark, d):
    return _out(asof.latest(_facts(spark, d), "subject", "predicate"))


@query(_picked("true", EARLIEST))
def t_earliest(spark, d):
    return _out(asof.earliest(_facts(spark, d), "subject", "predicate"))


def _best(spark, d, constraint, semantic):
    return _out(asof.best(_facts(spark, d), F.lit(constraint), F.lit(semantic), "subject", "predicate"))


@query(_picked("t_start <= 19970630", LATEST))
def t_asof(spark, d):
    return _best(spark, d, "1997-06", "EXACT")


@query(_picked("t_end < 19980101", LATEST))
def t_before(spark, d):
    return _best(spark, d, "1998", "BEFORE")


@query(_picked("t_start > 19970630", EARLIEST))
def t_after(spark, d):
    return _best(spark, d, "1997-06", "AFTER")


@query(_picked("t_start >= 19960301 AND t_end <= 19990615", LATEST))
def t_between(spark, d):
    return _best(spark, d, "1996-03..1999-06-15", "BETWEEN")


@query(
    FACTS
    + """SELECT pos, coalesce(CASE pos % 5 WHEN 0 THEN t_start <= 19970630 WHEN 3 THEN true WHEN 4 THEN t_end < 19980101 ELSE false END, false) AS matched FROM w"""
)
def t_unreadable(spark, d):
    """Facts against readable constraints, unreadable ones (which match nothing) and none (which matches all), a row each."""
    k = F.col("pos") % 5
    constraint = F.when(k == 0, "1997-06").when(k == 1, "1997-13").when(k == 2, "soon").when(k == 4, "1998")
    hit = in_bounds(F.col("t_start"), F.col("t_end"), bounds(constraint, F.when(k == 4, "BEFORE").otherwise("EXACT")))
    return _facts(spark, d).select("pos", F.coalesce(constraint.isNull() | hit, F.lit(False)).alias("matched"))


@query(
    FACTS
    + """, r AS (SELECT pos AS qid, subject, predicate, strftime(day, '%Y%m%d')::INT AS c, pos % 3 AS kind FROM w)
SELECT qid, w.pos, w.time FROM r JOIN w USING (subject, predicate)
WHERE CASE kind WHEN 0 THEN t_start <= c WHEN 1 THEN t_end < c ELSE t_start > c END
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN kind = 2 THEN t_start ELSE -t_end END, CASE WHEN kind = 2 THEN t_end ELSE -t_start END, w.pos) = 1"""
)
def t_asof_join(spark, d):
    facts = _facts(spark, d)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "exact").when(F.col("o_orderkey") % 3 == 1, "before").otherwise("after")
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderpriority").alias("predicate"), bounds(day, kind).alias("c"))
    return asof.asof_lookup(asked, facts, ["qid"]).select("qid", "fact.pos", "fact.time")


@query(
    FACTS
    + """, h AS (SELECT *, min(pos) OVER (PARTITION BY subject, predicate) AS g FROM w WHERE subject IN ('1', '2', '4', '5', '7') AND predicate IN ('1-URGENT', '2-HIGH') AND t_start <= 19991231),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY t_end DESC NULLS LAST, t_start DESC NULLS LAST, pos) = 1)
SELECT subject, predicate, pos, time FROM o ORDER BY coalesce(time, '') DESC, g LIMIT 4"""
)
def k_retrieve(spark, d):
    out = asof.retrieve(_facts(spark, d), [" 1", "2", "4", "5", "7"], ["1-urgent ", "2-HIGH"], "1999", "EXACT", 4)
    return out.select("subject", "predicate", "pos", "time")


@query(
    FACTS
    + """, r AS (SELECT c_custkey AS qid, c_custkey::VARCHAR AS subject FROM customer),
h AS (SELECT qid, w.*, min(pos) OVER (PARTITION BY qid, subject, predicate) AS g FROM r JOIN w USING (subject) WHERE t_start <= 19980331),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY qid, subject, predicate ORDER BY -t_end, -t_start, pos) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(time, '') DESC, g)::INT AS rank FROM o)
SELECT qid, rank, pos, time FROM k WHERE rank <= 3"""
)
def k_retrieve_batch(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.array(F.col("c_custkey").cast("string")).alias("entities"), F.array().cast("array<string>").alias("predicates"), bounds(F.lit("1998-03"), F.lit("exact")).alias("c"), F.lit(3).alias("limit"))
    return retrieve_batch(asked, _facts(spark, d)).select("qid", "rank", "fact.pos", "fact.time")


@query(
    """WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, string_agg(n || '. ' || o_custkey || ' | order = ' || o_orderkey, E'\\n' ORDER BY n) AS lines FROM k GROUP BY o_custkey"""
)
def k_fact_lines(spark, d):
    o = table(spark, d, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    line = asof.fact_line(F.col("n"), F.col("o_custkey").cast("string"), F.lit("order"), F.col("o_orderkey").cast("string"), F.lit(None).cast("string"))
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def e_distinct_first(spark, d):
    return asof.distinct_first(table(spark, d, "events").withColumnRenamed("event_id", "pos"), "user_id", "event_type").select("user_id", "event_type", F.col("pos").alias("event_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m%d')::DOUBLE ELSE o_totalprice END AS value FROM orders")
def e_order_value(spark, d):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_totalprice").cast("string"))
    facts = typed(table(spark, d, "orders").select("o_orderkey", raw.alias("object_raw"), F.lit(None).cast("string").alias("time")))
    name = F.when(F.col("o_orderkey") % 2 == 0, "discovered_on").otherwise("mass")
    return facts.select("o_orderkey", order_value(name, F.struct("object_raw", "object_num")).alias("value"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN strftime(ts, '%Y') WHEN 2 THEN event_id::VARCHAR ELSE event_type END AS answer FROM events")
def l_scalar_answer(spark, d):
    e = table(spark, d, "events")
    m = F.col("event_id") % 4
    raw = F.when(m == 0, "true").when(m == 1, F.date_format("ts", "yyyy-MM-dd")).when(m == 2, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" "), "event_type"))
    facts = typed(e.select("event_id", raw.alias("object_raw"), F.lit(None).cast("string").alias("time")))
    f = F.struct("object_raw", "object_num", "object_bool")
    return facts.select("event_id", F.when(F.col("event_id") % 4 == 1, year_text(f)).otherwise(scalar_text(f)).alias("answer"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y')
  WHEN 3 THEN strftime(o_orderdate, '%Y') || '..' || (year(o_orderdate) + 2) WHEN 4 THEN strftime(o_orderdate, '%Y-%m') ELSE NULL END AS value,
  CASE o_orderkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'before' WHEN 2 THEN 'after' WHEN 3 THEN 'between' WHEN 4 THEN 'exact' ELSE 'none' END AS semantic FROM orders"""
)
def q_time_extract(spark, d):
    o, day = table(spark, d, "orders"), F.col("o_orderdate")
    year = F.year(day).cast("string")
    m = F.col("o_orderkey") % 6
    text = (
        F.when(m == 0, F.concat(F.lit("As of "), F.date_format(day, "MMMM yyyy"), F.lit(", how many moons?")))
        .when(m == 1, F.concat(F.lit("What was found before "), F.date_format(day, "MMM d"), F.lit("th, "), year, F.lit("?")))
        .when(m == 2, F.concat(F.lit("Which were seen after "), year, F.lit("?")))
        .when(m == 3, F.concat(F.lit("Found between "), year, F.lit(" and "), (F.year(day) + 2).cast("string")))
        .when(m == 4, F.concat(F.lit("Known by "), F.date_format(day, "M/yyyy")))
        .otherwise("What is the mass of it?")
    )
    t = o.select("o_orderkey", text.alias("t"))
    return t.select("o_orderkey", F.coalesce(time_constraint(F.col("t")), F.lit(None)).alias("value"), time_semantic(F.col("t"))["semantic"].alias("semantic"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS token FROM orders")
def q_normalize_time(spark, d):
    day = F.col("o_orderdate")
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "yyyy/M/d"))
    return table(spark, d, "orders").select("o_orderkey", normalize_time(form).alias("token"))


ASKED = (
    (1, "As of November 2022, how many confirmed moons orbit Jupiter?", "COUNT", "time_lookup", "exact"),
    (2, "In what year was Neptune discovered, and who discovered it?", "MULTI_FIELD", "", "none"),
    (3, "Which planets have fewer moons than Jupiter and orbit beyond Earth?", "LIST", "filter", "none"),
    (4, "Which planet is closer to the Sun, Mars or Venus?", "ENTITY", "comparison", "none"),
    (5, "Is Pluto a dwarf planet?", "BOOLEAN", "", "none"),
    (6, "List the planets in order of decreasing mass.", "LIST", "ordering", "none"),
    (7, "Before 1980, how many moons of Saturn were known?", "COUNT", "time_lookup", "before"),
    (8, "Which dwarf planet located in the Kuiper Belt was discovered first?", "ENTITY", "ordering,filter", "none"),
)


@query(
    "SELECT o_orderkey AS qid, shape, modifiers, semantic FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{shape}', '{mods}', '{when}')" for i, _, shape, mods, when in ASKED) + ") AS t(i, shape, modifiers, semantic) ON i = 1 + o_orderkey % 8"
)
def q_shapes(spark, d):
    """A question for each order, of eight kinds, with a number of the order's own at its end."""
    texts = F.element_at(F.array(*[F.lit(text) for _, text, *_ in ASKED]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.concat(texts, F.lit(" #"), F.col("o_orderkey").cast("string")).alias("question"))
    p = compile_questions(q)
    return p.select("qid", F.col("plan.primary").alias("shape"), F.array_join("plan.modifiers", ",").alias("modifiers"), F.col("plan.semantic").alias("semantic"))


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT AS n, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 6 AS k FROM lineitem)
SELECT k::INT AS k, CASE WHEN k IN (0, 1, 5) THEN true ELSE false END AS is_correct, k IN (2, 3, 5) AS manual_check,
  CASE k WHEN 0 THEN 'matched' WHEN 1 THEN 'matched' WHEN 2 THEN 'ambiguous_hedged_number' WHEN 3 THEN 'ambiguous_multiple_numbers' WHEN 4 THEN 'no_number_found' ELSE 'matched' END AS reason, count(*) AS n
FROM a GROUP BY ALL"""
)
def v_number(spark, d):
    li = table(spark, d, "lineitem")
    n, k = F.col("l_quantity").cast("int").cast("string"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")) % 6).cast("int")
    text = F.when(k == 0, n).when(k == 1, F.concat(F.lit("The answer is "), n, F.lit("."))).when(k == 2, F.concat(F.lit("about "), n)).when(k == 3, F.concat(n, F.lit(" and "), F.lit("9999"))).when(k == 4, "none").otherwise(F.concat(F.lit("it has "), n, F.lit(" pieces")))
    v = score.number_verdict(text, F.col("l_quantity").cast("int").cast("double"))
    return li.select(k.alias("k"), v.alias("v")).groupBy("k", "v.is_correct", "v.manual_check", "v.reason").agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT event_id % 6 AS k, event_id % 2 = 0 AS truth FROM events)
SELECT k, truth, k NOT IN (3, 5) AND truth AS is_correct, k IN (2, 3, 4) AS manual_check,
  CASE WHEN k = 3 THEN 'ambiguous_negated_boolean' WHEN k = 5 THEN 'invalid_boolean_format' WHEN truth THEN 'matched' ELSE CASE k WHEN 0 THEN 'parsed_clean_boolean' WHEN 1 THEN 'parsed_safe_prefixed_boolean' WHEN 2 THEN 'ambiguous_boolean_with_hedging' ELSE 'parsed_boolean_with_formatting_noise' END END AS reason, count(*) AS n
FROM a GROUP BY ALL"""
)
def v_boolean(spark, d):
    k = F.col("event_id") % 6
    text = F.when(k == 0, "Yes!").when(k == 1, "Final answer: yes").when(k == 2, "I think yes").when(k == 3, "not yes").when(k == 4, "so the answer is: yes").otherwise("unknown")
    truth = F.col("event_id") % 2 == 0
    e = table(spark, d, "events").select(k.alias("k"), truth.alias("truth"), score.boolean_verdict(text, truth).alias("v"))
    return e.groupBy("k", "truth", "v.is_correct", "v.manual_check", "v.reason").agg(F.count("*").alias("n"))


@query(
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 3 THEN false ELSE true END AS is_correct, n_nationkey % 4 IN (1, 2, 3) AS manual_check,
  CASE n_nationkey % 4 WHEN 3 THEN 'ambiguous_multiple_entities' ELSE 'matched' END AS reason FROM nation"""
)
def v_entity(spark, d):
    n, m = F.col("n_name"), F.col("n_nationkey") % 4
    text = F.when(m == 0, F.concat(F.lit('"'), n, F.lit('".'))).when(m == 1, F.concat(F.lit("It is "), n)).when(m == 2, F.concat(F.lit("the land named "), n, F.lit(" here"))).otherwise(F.concat(n, F.lit(" or Atlantis")))
    v = score.grade(F.lit("entity"), text, F.to_json(F.array(n)).substr(F.lit(2), F.length(F.to_json(F.array(n))) - 2))
    return table(spark, d, "nation").select("n_nationkey", v.alias("v")).select("n_nationkey", "v.is_correct", "v.manual_check", "v.reason")


@query(
    """WITH r AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1)
SELECT k AS n_regionkey, k % 3 = 0 AS set_correct, k % 3 = 0 AND n < 2 AS order_correct,
  CASE k % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'entity_list_not_matched' ELSE 'entity_list_length_not_matched' END AS set_reason,
  CASE k % 3 WHEN 0 THEN CASE WHEN n < 2 THEN 'matched' ELSE 'ordered_list_order_not_matched' END WHEN 1 THEN 'ordered_list_not_matched' ELSE 'ordered_list_length_not_matched' END AS order_reason FROM r"""
)
def v_lists(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("truth"))
    k, given = F.col("n_regionkey") % 3, F.reverse("truth")
    given = F.when(k == 0, given).when(k == 1, F.concat(F.array(F.lit("Atlantis")), F.slice(given, 2, 100))).otherwise(F.concat(given, F.array(F.lit("Atlantis"))))
    answer, truth = F.array_join(given, ", "), F.to_json("truth")
    df = n.select("n_regionkey", score.grade(F.lit("entity_list"), answer, truth).alias("s"), score.grade(F.lit("ordered_list"), answer, truth).alias("o"))
    return df.select("n_regionkey", F.col("s.is_correct").alias("set_correct"), F.col("o.is_correct").alias("order_correct"), F.col("s.reason").alias("set_reason"), F.col("o.reason").alias("order_reason"))


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AS is_correct, CASE WHEN s_suppkey % 2 = 0 THEN 'matched' ELSE 'multi_field_not_matched' END AS reason, CASE WHEN s_suppkey % 3 = 0 THEN 'labeled' ELSE 'ordered' END AS mapping FROM supplier")
def v_fields(spark, d):
    key = F.col("s_suppkey")
    fields = F.to_json(F.array(F.struct(F.lit("number").alias("name"), F.lit("year").alias("type"), key.cast("string").alias("value")), F.struct(F.lit("who").alias("name"), F.lit("entity").alias("type"), F.col("s_name").alias("value"))))
    year = (key + F.when(key % 2 == 0, 0).otherwise(1)).cast("string")
    answer = F.when(key % 3 == 0, F.concat(F.lit("who: "), F.col("s_name"), F.lit("; number: "), year)).otherwise(F.concat(year, F.lit(", "), F.col("s_name")))
    v = score.grade(F.lit("multi_field"), answer, fields)
    return table(spark, d, "supplier").select("s_suppkey", v.alias("v")).select("s_suppkey", "v.is_correct", "v.reason", "v.mapping")


@query(
    """WITH a AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS other FROM part)
SELECT p_partkey, p_brand = other OR p_type = other AS sets, p_brand = other AND p_brand <= p_type AS orders FROM a WHERE p_brand <> p_type AND p_type <> other"""
)
def v_arrays(spark, d):
    """A given list of two against the sorted truth; a third of the parts have another second member."""
    p = table(spark, d, "part").withColumn("other", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_brand"))).where("p_brand <> p_type AND p_type <> other")
    truth = F.array_sort(F.array("p_type", "other"))
    return p.select("p_partkey", score.same_set(F.array("p_type", "p_brand"), truth).alias("sets"), score.same_order(F.array("p_brand", "p_type"), truth).alias("orders"))


def _runs(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    old = j.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("is_correct"), F.col("quality").cast("string").alias("answer")).where("id % 5 <> 0")
    new = j.select(F.col("doc_id").alias("id"), "lang", (F.col("toxic") == 0).alias("is_correct"), (F.col("toxic") == 1).alias("manual_check"), F.col("toxic").cast("string").alias("answer"))
    return new, old


RUNS = """WITH j AS (SELECT l.*, d.lang FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT doc_id AS id, lang, toxic = 0 AS now, CASE WHEN doc_id % 5 <> 0 THEN quality = 1 END AS was, CASE WHEN doc_id % 5 <> 0 THEN toxic <> quality END AS changed FROM j)
"""


@query(RUNS + "SELECT lang, count(*) AS n, sum(now::INT)::BIGINT AS n_correct, sum(now::INT) * 100.0::DOUBLE / count(*) AS percent, sum((NOT now)::INT)::BIGINT AS n_manual FROM c GROUP BY lang")
def a_by_group(spark, d):
    return score.accuracy(_runs(spark, d)[0], "lang")


@query(RUNS + "SELECT count(*) AS n, sum(now::INT)::BIGINT AS n_correct, sum(now::INT) * 100.0::DOUBLE / count(*) AS percent, sum((NOT now)::INT)::BIGINT AS n_manual FROM c")
def a_accuracy(spark, d):
    return score.accuracy(_runs(spark, d)[0])


@query(RUNS + "SELECT id, now::INT - was::INT AS delta, changed FROM c")
def a_delta(spark, d):
    return score.compare_runs(*_runs(spark, d)).select("id", "delta", "changed")


@query(RUNS + "SELECT count(was) AS n_reused, sum(now::INT - was::INT)::BIGINT AS delta_total, sum(now::INT - was::INT) * 100.0::DOUBLE / count(was) AS delta_percent FROM c")
def a_improvement(spark, d):
    return score.improvement(score.compare_runs(*_runs(spark, d)))


@query(RUNS + "SELECT id, CASE WHEN now THEN 'improvement' ELSE 'regression' END AS change FROM c WHERE now <> was")
def a_regressions(spark, d):
    return score.regressions(score.compare_runs(*_runs(spark, d))).select("id", "change")


@query("SELECT count(*) AS n, count(l.doc_id) AS n_found, count(l.doc_id) * 100.0::DOUBLE / count(*) AS percent FROM documents d LEFT JOIN labels l USING (doc_id)")
def a_coverage(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("hit", F.lit(True)), "doc_id", "left")
    return score.coverage(j, F.col("hit").isNotNull())


#: Answers for a person of two given names and a surname that is the nation's, and whether they are right and by which reason.
PERSONS = (
    ("Ann Beth {}", True, False, "matched"), ("Ann {}", True, True, "matched"), ("A. B. {}", True, True, "matched"), ("Ann B. {}", True, True, "matched"), ("{}", False, False, "entity_not_matched"),
    ("It was Ann {} who saw it", True, True, "matched"), ("Carl {}", False, False, "entity_not_matched"), ("Ann Beth", False, False, "entity_not_matched"),
)


@query(
    "SELECT n_nationkey, k::INT AS k, is_correct, manual_check, reason FROM nation, (VALUES " + ", ".join(f"({i}, {r}, {m}, '{why}')" for i, (_, r, m, why) in enumerate(PERSONS)) + ") AS p(k, is_correct, manual_check, reason)"
    " WHERE NOT contains(n_name, ' ')"
)
def v_persons(spark, d):
    n = table(spark, d, "nation").where("NOT contains(n_name, ' ')").withColumn("name", F.regexp_replace(F.initcap(F.translate("n_name", "_-0123456789", "abcdefghijkl")), "[^A-Za-z]", ""))
    forms = F.array(*[F.struct(F.lit(i).alias("k"), F.replace(F.lit(form), F.lit("{}"), F.col("name")).alias("answer")) for i, (form, *_) in enumerate(PERSONS)])
    df = n.select("n_nationkey", "name", F.inline(forms)).withColumn("truth", F.concat(F.lit('"Ann Beth '), "name", F.lit('"')))
    return df.select("n_nationkey", "k", score.grade(F.lit("entity"), F.col("answer"), F.col("truth")).alias("v")).select("n_nationkey", "k", "v.is_correct", "v.manual_check", "v.reason")


@query(
    "SELECT s_suppkey::INT AS k, s_suppkey % 3 <> 2 AS is_correct, CASE s_suppkey % 3 WHEN 2 THEN 'entity_list_not_matched' ELSE 'matched' END AS reason FROM supplier"
)
def v_assignment(spark, d):
    """Lists whose answers fit several goals, so that only an assignment of all shows whether they are right."""
    k = F.col("s_suppkey")
    truth = F.to_json(F.array(F.lit("Ann Beth Stone"), F.lit("Ann Carla Stone"), F.concat(F.lit("Item "), k.cast("string"))))
    given = F.when(k % 3 == 0, F.concat(F.lit("Ann Stone, Ann Beth Stone, Item "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("Item "), k.cast("string"), F.lit(", A. C. Stone, Ann Stone"))).otherwise(F.concat(F.lit("Ann Carla Stone, A. C. Stone, Item "), k.cast("string")))
    df = table(spark, d, "supplier").select(k.cast("int").alias("k"), score.grade(F.lit("entity_list"), given, truth).alias("v"))
    return df.select("k", "v.is_correct", "v.reason")
