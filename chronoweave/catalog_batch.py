"""Queries that put many questions or requests through one plan, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.catalog_facts import FACTS, table
from chronoweave.catalog_text import CHUNKS, HINTS, NAMES, STOP, _chunks
from chronoweave.functions import text as T
from chronoweave.functions.timewin import bounds
from chronoweave.operators import asof, index, retrieve
from chronoweave.sources.facts import facts_from_orders

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


FILTER, BEYOND = _has(("kuiper belt", "trans-neptunian", "located")), _has(("fewer", "less than", "beyond earth", "orbit beyond", "moons"))


@query(
    CHUNKS
    + f""", zz AS (SELECT chunk_id, source_id, lower(doc_id || ' ' || heading || ' ' || text) AS low, {HINTS} AS hints FROM chunks),
ff AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS token FROM zz) GROUP BY ALL),
ii AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t, {HINTS} AS preds FROM benchmark),
ee(token, term) AS (VALUES """ + ", ".join(f"('{k}', '{w}')" for k, v in T.EXPANSIONS.items() for w in v) + f"""),
kk AS (SELECT item_id, token FROM (SELECT item_id, unnest(t) AS token FROM ii) WHERE token NOT IN ({STOP})),
qq AS (SELECT item_id, token AS term FROM kk UNION SELECT item_id, term FROM kk JOIN ee USING (token)),
ww AS (SELECT item_id, chunk_id, sum(1 + ln(tf)) AS score FROM qq JOIN ff ON term = token GROUP BY ALL),
pp AS (SELECT item_id, count(*) AS n, list(term ORDER BY term) AS phrases FROM qq WHERE contains(term, ' ') GROUP BY ALL),
bb AS (SELECT ii.item_id, chunk_id, source_id, list_concat(
    list_transform(list_filter(coalesce(phrases, []), lambda x: contains(low, x)), lambda x: 'phrase:' || x),
    CASE WHEN contains(low, t[1] || ' ' || t[2]) THEN ['entity:' || t[1] || ' ' || t[2]] ELSE [] END,
    list_transform(list_filter(preds, lambda x: list_contains(hints, x)), lambda x: 'predicate:' || x),
    CASE WHEN ii.item_id % 2 = 0 AND {FILTER} THEN ['filter_context'] ELSE [] END, CASE WHEN ii.item_id % 2 = 0 AND {BEYOND} THEN ['comparative_filter_context'] ELSE [] END,
    CASE WHEN contains(low, 'dwarf planet') THEN ['dwarf_planet_context'] ELSE [] END) AS reasons FROM ii LEFT JOIN pp USING (item_id), zz),
ss AS (SELECT bb.item_id, bb.chunk_id, source_id, array_to_string(reasons, ';') AS reasons, round(coalesce(ww.score, 0) + coalesce(list_sum(list_transform(reasons, lambda x:
    CASE WHEN x LIKE 'entity:%' THEN 5.0 WHEN x LIKE 'phrase:%' OR x LIKE 'predicate:%' THEN 3.0 WHEN x = 'dwarf_planet_context' THEN 2.0 ELSE 2.5 END)), 0), 6) AS score FROM bb LEFT JOIN ww USING (item_id, chunk_id)),
cc AS (SELECT * FROM ss WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, source_id ORDER BY score DESC, chunk_id) <= 4)
SELECT item_id AS qid, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::INT AS rank, score, reasons FROM cc QUALIFY rank <= 12"""
)
def r_batch(spark, d):
    """The best chunks of all documents for each item of the benchmark."""
    text, named = F.col("text"), F.slice(T.tokens(F.col("text")), 1, 2)
    none = F.array().cast("array<string>")
    asked = table(spark, d, "benchmark").select(
        F.col("item_id").alias("qid"), T.query_terms(text).alias("terms"), F.array(F.array_join(named, " ")).alias("entities"), T.tags(text, NAMES).alias("predicates"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.lit("filter"))).otherwise(none).alias("modifiers"), retrieve.time_terms(text).alias("times"),
    )
    found = index.search(index.build_index(_chunks(spark, d)), asked, digits=6).ranked
    return found.select("qid", "chunk_id", "rank", "score", F.array_join("reasons", ";").alias("reasons"))


@query(
    FACTS
    + """, r AS (SELECT o_orderkey AS qid, o_custkey::VARCHAR AS subject, o_orderpriority AS predicate, strftime(o_orderdate - INTERVAL 1 DAY * (o_orderkey % 700), '%Y%m%d')::INT AS s,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 900), '%Y%m%d')::INT WHEN 1 THEN year(o_orderdate) * 10000 + 1231
    ELSE strftime(last_day(o_orderdate + INTERVAL 1 DAY * 400), '%Y%m%d')::INT END AS e FROM orders)
SELECT qid, w.pos, w.time FROM r JOIN w USING (subject, predicate) WHERE t_start >= s AND t_end <= e
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY t_end DESC, t_start DESC, w.pos) = 1"""
)
def t_spans(spark, d):
    """The latest fact of each order's customer and priority within a span of its own, which ends on a day, with a year or with a month."""
    orders = table(spark, d, "orders")
    day, key, days = F.col("o_orderdate").cast("date"), F.col("o_orderkey"), lambda n: n.cast("int")
    begin = F.date_format(F.date_sub(day, days(key % 700)), "yyyy-MM-dd")
    end = F.when(key % 3 == 0, F.date_format(F.date_add(day, days(key % 900)), "yyyy-MM-dd")).when(key % 3 == 1, F.date_format(day, "yyyy")).otherwise(F.date_format(F.date_add(day, 400), "yyyy-MM"))
    asked = orders.select(key.alias("qid"), F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderpriority").alias("predicate"), bounds(F.concat(begin, F.lit(".."), end), F.lit("between")).alias("c"))
    return asof.asof_lookup(asked, facts_from_orders(orders), ["qid"]).select("qid", "fact.pos", "fact.time")
