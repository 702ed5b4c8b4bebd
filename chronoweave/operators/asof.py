"""The latest, earliest or as-of fact of each key, and raw retrieval of facts for requests.

Lookups are running minima over the days of a key's facts and requests, in two
levels; where the rule has two sides, one for each grain of time. Only places and times
take part in them; facts are joined to what was found at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.functions.timewin import bounds, in_bounds, is_calendar
from chronoweave.sources.work import written


def latest_order() -> list[Column]:
    """Latest end, then narrowest window, then input order; undated facts last."""
    return [F.col("t_end").desc_nulls_last(), F.col("t_start").desc_nulls_last(), F.col("pos").asc()]


def earliest_order() -> list[Column]:
    return [F.col("t_start").asc_nulls_last(), F.col("t_end").asc_nulls_last(), F.col("pos").asc()]


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest(facts: DataFrame, *keys: str) -> DataFrame:
    return _first(facts, list(keys), latest_order())


def earliest(facts: DataFrame, *keys: str) -> DataFrame:
    return _first(facts, list(keys), earliest_order())


def distinct_first(facts: DataFrame, *keys: str) -> DataFrame:
    """One row of each key, the first in input order."""
    return _first(facts, list(keys), [F.col("pos").asc()])


def best(facts: DataFrame, constraint: Column, semantic: Column, *keys: str) -> DataFrame:
    """Of the facts that match, each key's earliest if the rule is after, else its latest. A null or empty constraint matches all."""
    b = bounds(constraint, semantic)
    none = constraint.isNull() | (constraint == "")
    hit = facts.withColumn("_b", b).where(none | in_bounds(F.col("t_start"), F.col("t_end"), F.col("_b")))
    after = (F.col("_b")["kind"] == "after") & ~none
    return _first(hit, list(keys), best_order(after)).drop("_b")


def best_order(after: Column) -> list[Column]:
    """One order for both rules: -end, -start, or start, end where after holds."""
    return [F.when(after, F.col("t_start")).otherwise(-F.col("t_end")).asc_nulls_last(), F.when(after, F.col("t_end")).otherwise(-F.col("t_start")).asc_nulls_last(), F.col("pos").asc()]


#: Times are days as numbers, YYYYMMDD: the quotient by this is the year.
YEAR = 10_000
KEY = ["_s", "_p"]
#: Keys are counted in so many buckets; those with more rows than CROWDED are dealt out by days and years.
BUCKETS, CROWDED = 1 << 16, 4096


def computed_once(df: DataFrame) -> DataFrame:
    """df through a generator of one row: what reads its columns does not repeat the expressions that made them, each time in each condition."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def spans_lookup(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, requests (_s, _p, c, ..) for facts within c.s to c.e, with _a, _b, _n of the latest such fact of right (_s, _p, _a, _b, _n).

    Days are apart or equal, and so are months and years. So of a key's days,
    of its months and of its years the last one that ends by c.e also begins
    last, and if it begins before c.s no other of these lies in the span: the
    answer is the best of three running bests at c.e, and a key costs its
    facts plus its requests. Facts whose window is no day, month or year meet
    all requests of their key.
    """
    dated = right.where("_a IS NOT NULL AND _b IS NOT NULL")
    plain = is_calendar(F.col("_a"), F.col("_b"))
    kept = [c for c in left.columns if c not in (*KEY, "_h", "c")]
    asked = left.where("c.s <= c.e").select(*kept, *KEY, F.col("c.s").alias("_from"), F.col("c.e").alias("_at"))
    grain = F.when(F.col("_a") == F.col("_b"), 0).when(F.col("_b") - F.col("_a") == 1130, 2).otherwise(1)
    order = F.struct((-F.col("_b")).alias("x"), (-F.col("_a")).alias("y"), F.col("_n").alias("z"))
    grains = ["_days", "_months", "_years"]
    held = dated.where(plain).select(*KEY, F.col("_b").alias("_at"), *[F.when(grain == i, order).alias(g) for i, g in enumerate(grains)])
    best = best_so_far(held.unionByName(asked.select(*KEY, "_at"), allowMissingColumns=True), KEY, "_at", *grains)
    within = [F.when(-F.col(f"{g}.y") >= F.col("_from"), F.col(g)) for g in grains]
    found = asked.join(best, [*KEY, "_at"]).withColumn("_o", F.least(*within)).where("_o IS NOT NULL")
    found = found.select(*kept, *KEY, (-F.col("_o.y")).alias("_a"), (-F.col("_o.x")).alias("_b"), F.col("_o.z").alias("_n"))
    # empty where all windows are those of the calendar, so its join costs nothing then
    other = left.join(dated.where(~plain).drop("_h"), KEY).where((F.col("_a") >= F.col("c.s")) & (F.col("_b") <= F.col("c.e")))
    return found.unionByName(other.select(*kept, *KEY, "_a", "_b", "_n"))


def best_so_far(events: DataFrame, keys: list[str], at: str, *values: str) -> DataFrame:
    """The least of each value of a key up to each of its times: (keys, at, values), a row for each time of each key; nulls count as no value.

    First each day keeps its least values, before rows are shuffled; then the
    days of a year run on within that year, and the least of each year is
    carried into the next ones by a window over years. So the rows of one key
    are dealt out by days and years, and no task has more of a key than the
    days of its years or its years.
    """
    each = lambda f, to="{}", of="{}": [f(of.format(v)).alias(to.format(v)) for v in values]
    days = events.groupBy(*keys, at).agg(*each(F.min)).withColumn("_y", F.floor(F.col(at) / YEAR))
    years = days.groupBy(*keys, "_y").agg(*each(F.min, "{}_carried"))
    before = Window.partitionBy(*keys).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    years = years.select(*keys, "_y", *each(lambda v: F.min(v).over(before), "{}_carried", "{}_carried"))
    within = Window.partitionBy(*keys, "_y").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = days.select(*keys, at, "_y", *each(lambda v: F.min(v).over(within))).join(years, [*keys, "_y"])
    return out.select(*keys, at, *each(lambda v: F.least(v, f"{v}_carried")))


def _crowded(rows: DataFrame) -> list[int]:
    """Buckets of keys, of BUCKETS, with over CROWDED rows and over eight times the mean."""
    counts = rows.groupBy("_h").count()
    found = counts.crossJoin(counts.agg(F.avg("count").alias("mean"))).where((F.col("count") > CROWDED) & (F.col("count") > 8 * F.col("mean")))
    return [r["_h"] for r in found.select("_h").collect()]


def timed_lookup(left: DataFrame, right: DataFrame, kinds: list[str], crowded: list[int]) -> DataFrame:
    """left, requests (_s, _p, _h, c, ..) of these kinds as of, before or after a time, with _after and the best fact's _a, _b, _n.

    Facts as of a time begin by then, those before it have ended by the day
    before, those after it begin on the day after or later; time runs
    backwards for these. Requests run along with the facts of their key in
    one window; those of keys in crowded buckets meet by the running best of
    their key's days.
    """
    kind = F.col("c")["kind"]
    kept = [c for c in left.columns if c not in (*KEY, "_h", "c")]
    late, early = F.struct((-F.col("_b")).alias("x"), (-F.col("_a")).alias("y"), F.col("_n").alias("z")), F.struct(F.col("_a").alias("x"), F.col("_b").alias("y"), F.col("_n").alias("z"))
    rules = [r for r in (("exact", F.col("_a"), late, F.col("c.e")), ("before", F.col("_b"), late, F.col("c.s") - 1), ("after", -F.col("_a"), early, -F.col("c.e") - 1)) if r[0] in kinds]
    at = F.lit(None).cast("int")
    for name, _, _, when in rules:
        at = F.when(kind == name, when).otherwise(at)
    asked = left.select(F.struct(*kept).alias("_kept"), *KEY, "_h", kind.alias("_k"), at.alias("_at")).where("_at IS NOT NULL")
    events = F.array(*[F.struct(F.lit(name).alias("_k"), day.alias("_at"), order.alias("_o")) for name, day, order, _ in rules])
    facts = right.where("_a IS NOT NULL").select(*KEY, "_h", F.inline(events)).where("_at IS NOT NULL")

    hot, by = F.col("_h").isin(crowded), [*KEY, "_k"]
    so_far = Window.partitionBy(*by).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.where(~hot).unionByName(facts.where(~hot), allowMissingColumns=True).withColumn("_o", F.min("_o").over(so_far))
    found = both.where("_kept IS NOT NULL AND _o IS NOT NULL").select("_kept", *by, "_o")
    if crowded:
        rows = facts.where(hot).unionByName(asked.where(hot).drop("_kept"), allowMissingColumns=True)
        best = best_so_far(rows, by, "_at", "_o").where("_o IS NOT NULL")
        found = found.unionByName(asked.where(hot).join(best, [*by, "_at"]).select("_kept", *by, "_o"))
    after, x, y = F.col("_k") == "after", F.col("_o.x"), F.col("_o.y")
    return found.select("_kept.*", *KEY, after.alias("_after"), F.when(after, x).otherwise(-y).alias("_a"), F.when(after, y).otherwise(-x).alias("_b"), F.col("_o.z").alias("_n"))


def asof_lookup(requests: DataFrame, facts: DataFrame, ids: list[str]) -> DataFrame:
    """One best fact for each request.

    requests: ids, subject, predicate, and the constraint's c (struct of
    bounds; null for none). Keys compare in lower case. Facts come back as a
    struct column fact, and requests without one are not in the result. Of
    requests with the same ids one fact, the best of all, is found. pos tells
    facts apart.

    A key costs its requests plus its facts, not their product, and one with
    very many is dealt out by its days (see timed_lookup, spans_lookup).
    Times are read once, requests and the facts' places written with them; of
    the rules only those that some request has are looked up, and only facts
    that were found are taken whole, by one join at the end.
    """
    keyed = lambda df, *columns: df.select(*columns, F.lower("subject").alias("_s"), F.lower("predicate").alias("_p")).withColumn("_h", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int"))
    left = written(keyed(requests, *[c for c in requests.columns if c not in ("subject", "predicate")]), "requests")
    kept = [c for c in left.columns if c not in (*KEY, "_h", "c")]
    whole = facts.select(F.lower("subject").alias("_s"), F.lower("predicate").alias("_p"), F.col("pos").alias("_n"), F.struct(*facts.columns).alias("fact"))
    right = written(keyed(facts, F.col("t_start").alias("_a"), F.col("t_end").alias("_b"), F.col("pos").alias("_n")), "places")
    kinds = [r[0] for r in left.select(F.when(F.col("c").isNull(), "free").otherwise(F.col("c.kind"))).distinct().collect()]

    one = lambda df, after: df.select(*kept, *KEY, after.alias("_after"), "_a", "_b", "_n")
    out = []
    if "free" in kinds:
        nulls_last = F.struct(F.col("_b").isNull().alias("u"), (-F.col("_b")).alias("x"), F.col("_a").isNull().alias("v"), (-F.col("_a")).alias("y"), F.col("_n").alias("z"))
        latest_one = right.groupBy(*KEY).agg(F.min(nulls_last).alias("_o")).select(*KEY, (-F.col("_o.y")).alias("_a"), (-F.col("_o.x")).alias("_b"), F.col("_o.z").alias("_n"))
        out.append(one(left.where("c IS NULL").join(latest_one, KEY), F.lit(False)))
    if "between" in kinds:
        out.append(one(spans_lookup(left.where(F.col("c.kind") == "between"), right), F.lit(False)))
    timed = [k for k in kinds if k in ("exact", "before", "after")]
    if timed or not out:
        crowded = _crowded(left.select("_h").unionAll(right.select("_h"))) if timed else []
        out.append(one(timed_lookup(left, right, timed or ["exact"], crowded), F.col("_after")))
    early, late = F.col("_a"), F.col("_b")
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy(F.when(F.col("_after"), early).otherwise(-late).asc_nulls_last(), F.when(F.col("_after"), late).otherwise(-early).asc_nulls_last(), F.col("_n")))
    found = reduce(DataFrame.unionAll, out).withColumn("_r", rank).where("_r = 1")
    return found.join(whole, [*KEY, "_n"]).select(*kept, "fact")


def retrieve(facts: DataFrame, entities: list[str], predicates: list[str], constraint: str | None = None, semantic: str | None = None, limit: int = 3) -> DataFrame:
    """Facts of the named entities and predicates (both where both are given), one best fact of each subject and
    predicate, ranked by entity hit, predicate hit and time text, all descending, then by the group's first place."""
    es, ps = [e.strip().lower() for e in entities], [p.strip().lower() for p in predicates]
    e = F.lower(F.trim("subject")).isin(es) if es else F.lit(False)
    p = F.lower(F.trim("predicate")).isin(ps) if ps else F.lit(False)
    hit = facts.where(e & p if es and ps else e | p)
    c, s = F.lit(constraint).cast("string"), F.lit(semantic).cast("string")
    group = Window.partitionBy("subject", "predicate")
    b = bounds(c, s)
    hit = hit.where(in_bounds(F.col("t_start"), F.col("t_end"), b)) if constraint else hit
    one = best(hit.withColumn("group_pos", F.min("pos").over(group)), c, s, "subject", "predicate")
    ranked = one.withColumn("entity_hit", e.cast("int")).withColumn("predicate_hit", p.cast("int"))
    return ranked.orderBy(F.desc("entity_hit"), F.desc("predicate_hit"), F.coalesce("time", F.lit("")).desc(), F.col("group_pos")).limit(limit)


def fact_line(number: Column, subject: Column, predicate: Column, obj: Column, time: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(". "), subject, F.lit(" | "), predicate, F.lit(" = "), F.coalesce(obj, F.lit("None")), F.when(time.isNotNull() & (time != ""), F.concat(F.lit(" | time: "), time)).otherwise(F.lit("")))


def facts_text(facts: Column) -> Column:
    """Numbered lines under a heading from an array of facts in rank order."""
    lines = F.transform(facts, lambda f, i: F.concat(fact_line(i + 1, f["subject"], f["predicate"], f["object_raw"], f["time"]), F.lit("\n")))
    return F.when(F.size(facts) > 0, F.concat(F.lit("Knowledge Graph Facts:\n"), F.array_join(lines, ""))).otherwise(F.lit("No relevant facts found in the knowledge graph."))
