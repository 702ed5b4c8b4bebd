"""The as-of lookup against a plain scan, also for keys with very many facts and requests."""

import calendar
import random
import time

from pyspark.sql import functions as F

from chronoweave.functions.timewin import bounds
from chronoweave.operators import asof
from chronoweave.operators.asof import asof_lookup, best_so_far
from chronoweave.sources.facts import facts_from_rows


def pick(facts, kind, value):
    """The place of the best fact of a key by the rules, over (start, end, pos)."""
    if kind is None:
        hits = facts
    else:
        s, e = value
        test = {"exact": lambda f: f[0] <= e, "before": lambda f: f[1] < s, "after": lambda f: f[0] > e, "between": lambda f: f[0] >= s and f[1] <= e}[kind]
        hits = [f for f in facts if f[0] is not None and test(f)]
    if not hits:
        return None
    none = 10**9
    if kind == "after":
        return min(hits, key=lambda f: f)[2]
    return min(hits, key=lambda f: (-f[1] if f[1] is not None else none, -f[0] if f[0] is not None else none, f[2]))[2]


def window(t):
    if t is None:
        return None, None
    y, m = int(t[:4]), int(t[5:7]) if len(t) > 4 else None
    return (y * 10000 + 101, y * 10000 + 1231) if m is None else (y * 10000 + m * 100 + 1, y * 10000 + m * 100 + 28 + {2: 0}.get(m, 2 if m in (4, 6, 9, 11) else 3))


def test_like_a_scan(spark):
    rnd = random.Random(3)
    when = lambda: rnd.choice([None, *[f"{y}" for y in range(2001, 2006)], *[f"{y}-{m:02d}" for y in (2001, 2003, 2005) for m in (1, 2, 6)]])
    rows = [(rnd.choice("aBc"), rnd.choice(("p", "Q")), str(i), when()) for i in range(120)]
    asked = []
    for i in range(300):
        kind = rnd.choice((None, "exact", "before", "after", "between"))
        t = when() or "2003"
        asked.append((i, rnd.choice("AbCd"), rnd.choice("Pq"), kind, f"{t}..2005" if kind == "between" else t))
    df = spark.createDataFrame(asked, "qid int, subject string, predicate string, kind string, t string")
    df = df.withColumn("c", F.when(F.col("kind").isNotNull(), bounds(F.col("t"), F.col("kind")))).drop("kind", "t")
    got = {r.qid: r.fact.pos for r in asof_lookup(df, facts_from_rows(spark, rows), ["qid"]).collect()}
    keyed = {}
    for i, (s, p, _, t) in enumerate(rows):
        keyed.setdefault((s.lower(), p.lower()), []).append((*window(t), i))
    for i, s, p, kind, t in asked:
        value = (window(t.split("..")[0])[0], window(t.split("..")[-1])[1])
        assert got.get(i) == pick(keyed.get((s.lower(), p.lower()), []), kind, value), (kind, t)


def test_one_key_with_very_many_rows(spark):
    """Requests plus facts, not their product."""
    facts = spark.range(30_000).select(F.col("id").alias("pos"), F.lit("k").alias("subject"), F.lit("p").alias("predicate"), F.col("id").cast("string").alias("object_raw"), (F.col("id") + 10_000_000).cast("int").alias("t_start"), (F.col("id") + 10_000_000).cast("int").alias("t_end"))
    c = F.struct((F.col("id") + 10_000_000).cast("int").alias("s"), (F.col("id") + 10_000_000).cast("int").alias("e"), F.lit("exact").alias("kind"))
    asked = spark.range(30_000).select(F.col("id").alias("qid"), F.lit("K").alias("subject"), F.lit("p").alias("predicate"), c.alias("c"))
    begin = time.time()
    out = asof_lookup(asked, facts, ["qid"])
    assert out.where("fact.pos = qid").count() == 30_000 and time.time() - begin < 120


def test_spans_over_all_grains(spark):
    """Facts of days, months and years, and of windows that are none of these, within spans of any ends."""
    rnd = random.Random(8)
    day = lambda: (rnd.choice((1899, 1999, 2000, 2001, 2010)) * 10000) + rnd.choice((101, 131, 228, 301, 415, 1130, 1201, 1231))
    facts = []
    for i in range(500):
        a = day()
        kind = rnd.randrange(4)
        y = a // 10000
        facts.append([(a, a), window(f"{y}-{a // 100 % 100:02d}") if a // 100 % 100 != 2 else (y * 10000 + 201, y * 10000 + (229 if y % 4 == 0 and y != 1900 else 228)), window(str(y)), tuple(sorted((a, day())))][kind] + (i,))
    df = spark.createDataFrame([(i, "k", "p", "", a, b) for a, b, i in facts], "pos long, subject string, predicate string, object_raw string, t_start int, t_end int")
    spans = [(day(), day()) for _ in range(400)] + [(19990101, 20011231), (18000101, 29991231), (20000229, 20000229), (20000230, 20010101)]
    asked = spark.createDataFrame([(q, "K", "P", (s, e, "between")) for q, (s, e) in enumerate(spans)], "qid int, subject string, predicate string, c struct<s:int,e:int,kind:string>")
    got = {r.qid: r.fact.pos for r in asof_lookup(asked, df, ["qid"]).collect()}
    for q, span in enumerate(spans):
        assert got.get(q) == pick(facts, "between", span), span


def test_spans_of_one_key_take_linear_time(spark):
    """20,000 spans and 20,000 facts of one key; four times the rows take far less than sixteen times the time."""
    took = []
    for n in (5_000, 5_000, 20_000):
        day = lambda x: F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), x.cast("int")), "yyyyMMdd").cast("int")
        facts = spark.range(n).select(F.col("id").alias("pos"), F.lit("k").alias("subject"), F.lit("p").alias("predicate"), F.lit("").alias("object_raw"), day(F.col("id")).alias("t_start"), day(F.col("id")).alias("t_end"))
        asked = spark.range(n).select(F.col("id").alias("qid"), F.lit("k").alias("subject"), F.lit("p").alias("predicate"), F.struct(day(F.col("id") / 2).alias("s"), day(F.col("id")).alias("e"), F.lit("between").alias("kind")).alias("c"))
        begin = time.time()
        assert asof_lookup(asked, facts, ["qid"]).where("fact.pos = qid").count() == n
        took.append(time.time() - begin)
    assert took[2] < 8 * took[1]


def test_best_so_far_like_a_scan(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), rnd.choice((1, -1)) * (rnd.choice((1999, 2000, 2001)) * 10_000 + rnd.randrange(101, 1232)), rnd.choice((None, rnd.randrange(1000)))) for _ in range(600)]
    got = {(r.k, r.at): r.v for r in best_so_far(spark.createDataFrame(rows, "k string, at int, v int"), ["k"], "at", "v").collect()}
    assert set(got) == {(k, at) for k, at, _ in rows}
    for (k, at), v in got.items():
        assert v == min((x for kk, a, x in rows if kk == k and a <= at and x is not None), default=None)


def test_one_key_is_dealt_out(spark):
    """120,000 facts of one key over 40 years: a row a day is left of them, and each of 8 partitions has some years of the key."""
    n = 120_000
    day = lambda x: F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), (x % 14_600).cast("int")), "yyyyMMdd").cast("int")
    events = spark.range(n).select(F.lit("k").alias("k"), day(F.col("id")).alias("at"), F.col("id").alias("v"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        best = best_so_far(events, ["k"], "at", "v")
        parts = [r["count"] for r in best.groupBy(F.spark_partition_id()).count().collect()]
        assert best.where("v <> 0").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(parts) == 14_600 and max(parts) < 0.35 * 14_600


def test_one_day_of_one_key(spark):
    """Facts and requests that all have one key and one day."""
    n = 20_000
    facts = spark.range(n).select(F.col("id").alias("pos"), F.lit("k").alias("subject"), F.lit("p").alias("predicate"), F.lit("").alias("object_raw"), F.lit(20000101).alias("t_start"), F.lit(20000101).alias("t_end"))
    kind = F.element_at(F.array(*map(F.lit, ("exact", "before", "after"))), (F.col("id") % 3 + 1).cast("int"))
    c = F.struct((F.lit(20000101) + (F.col("id") % 3 == 1).cast("int") - (F.col("id") % 3 == 2).cast("int")).alias("s"), (F.lit(20000101) - (F.col("id") % 3 == 2).cast("int")).alias("e"), kind.alias("kind"))
    asked = spark.range(n).select(F.col("id").alias("qid"), F.lit("k").alias("subject"), F.lit("p").alias("predicate"), c.alias("c"))
    assert asof_lookup(asked, facts, ["qid"]).where("fact.pos = 0").count() == n


def test_spans_are_not_cut_into_nodes(spark):
    """A span of nearly four years costs one row, not one for each of its days, months and years."""
    facts = facts_from_rows(spark, [("k", "p", str(i), f"200{i % 5}-0{i % 9 + 1}") for i in range(40)])
    asked = spark.createDataFrame([(0, "k", "p", (20000102, 20031230, "between"))], "qid int, subject string, predicate string, c struct<s:int,e:int,kind:string>")
    found = asof_lookup(asked, facts, ["qid"])
    assert [r.fact.time for r in found.collect()] == ["2003-09"]
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_requests_share_one_window_with_facts(spark):
    """Requests as of, before and after a time cost one shuffle with the facts, one by their ids and the join of whole facts; no rule that none has is looked up."""
    facts = facts_from_rows(spark, [("k", "p", str(i), f"200{i % 5}-0{i % 9 + 1}") for i in range(40)])
    kinds = ("exact", "before", "after")
    asked = spark.createDataFrame([(i, "k", "p", (20020101, 20020101, kinds[i % 3])) for i in range(9)], "qid int, subject string, predicate string, c struct<s:int,e:int,kind:string>")
    found = asof_lookup(asked, facts, ["qid"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Window [") == 2 and "Aggregate" not in plan
    assert len(found.collect()) == 9


def test_keys_of_crowded_buckets_are_found_alike(spark, monkeypatch):
    """A key with very many rows, dealt out by days and years, beside keys with few."""
    monkeypatch.setattr(asof, "CROWDED", 20)
    rnd = random.Random(17)
    when = lambda: f"{rnd.randint(2001, 2009)}-{rnd.randint(1, 12):02d}"
    rows = [("hot" if i % 3 else f"k{i}", "p", str(i), when()) for i in range(600)]
    asked = [(i, "HOT" if i % 3 else f"K{i}", "p", rnd.choice(("exact", "before", "after")), when()) for i in range(600)]
    df = spark.createDataFrame(asked, "qid int, subject string, predicate string, kind string, t string").select("qid", "subject", "predicate", bounds(F.col("t"), F.col("kind")).alias("c"))
    found = asof_lookup(df, facts_from_rows(spark, rows), ["qid"])
    assert "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()
    got, keyed = {r.qid: r.fact.pos for r in found.collect()}, {}
    for i, (s, p, _, t) in enumerate(rows):
        keyed.setdefault(s, []).append((*bounds_of(t), i))
    for i, s, p, kind, t in asked:
        assert got.get(i) == pick(keyed.get(s.lower(), []), kind, bounds_of(t)), (kind, t)


def bounds_of(t):
    """The first and last day of a month as numbers."""
    y, m = int(t[:4]), int(t[5:7])
    return y * 10000 + m * 100 + 1, y * 10000 + m * 100 + calendar.monthrange(y, m)[1]
