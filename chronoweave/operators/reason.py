"""Batches of questions answered from facts: candidate pools, filters, order, comparison, fields, raw retrieval and answers.

All lookups of all questions go through one as-of join: each question's plan
is exploded into requests (role, place, subject, predicate, constraint), the
found facts are grouped again, and the answer is read from them by the
question's shape. Work per question is bounded by its pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.functions.timewin import bounds, in_bounds, time_start
from chronoweave.operators.asof import asof_lookup, best_order, facts_text
from chronoweave.plans.question import ORDERABLE, compile_questions
from chronoweave.sources.facts import to_number
from chronoweave.sources.work import written

# Words and labels that decide results.
ATTRIBUTES = {
    "moons": "moon_count", "distance": "distance_from_sun", "discovered": "discovered_on", "recognized": "recognized_on",
    "observed": "first_observed_on", "size": "diameter", "mass": "mass", "classification": "classification", "planet_type": "planet_type",
    "surface_gravity": "surface_gravity", "location": "location", "diameter": "diameter",
}
LABELS = {
    "moon_count": "number of moons", "distance_from_sun": "distance from the Sun", "discovered_on": "discovery year", "recognized_on": "recognition year",
    "first_observed_on": "first observation year", "diameter": "diameter", "mass": "mass", "surface_gravity": "surface gravity",
}
MOON_KINDS = ("moon", "natural satellite", "satellite")
PLANETS = ("earth", "mars", "jupiter", "saturn", "uranus", "neptune", "pluto")
CHECKED = ("classification", "is_largest_dwarf_planet_by_size", "diameter", "location")


def attribute_predicate(attribute: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ATTRIBUTES.items() for x in kv])
    return F.coalesce(F.element_at(names, attribute), attribute)


def pools(facts: DataFrame) -> DataFrame:
    """(class, entity, place): planets by least distance from the sun, dwarf planets and moons by name.

    Moons are those typed as one or said to orbit a known planet; only if
    there are none, the objects of latest_known_moon.
    """
    predicate, value = F.lower("predicate"), F.lower("object_raw")
    planets = facts.where(predicate == "distance_from_sun").groupBy(F.col("subject").alias("entity")).agg(F.min(F.coalesce("object_num", F.lit(0.0))).alias("by"), F.min("pos").alias("pos")).select(F.lit("planets").alias("class"), "entity", "by", "pos")
    named = lambda df, name, what: df.select(F.lit(name).alias("class"), what.alias("entity")).where("entity IS NOT NULL AND entity <> ''").distinct().withColumns({"by": F.lit(0.0), "pos": F.lit(0).cast("long")})
    dwarfs = named(facts.where((predicate == "classification") & (value == "dwarf planet")), "dwarf_planets", F.col("subject"))
    is_moon = (predicate.isin("classification", "planet_type") & value.isin(*MOON_KINDS)) | ((predicate == "orbits") & value.isin(*PLANETS))
    moons = named(facts.where(is_moon), "moons", F.col("subject"))
    known = named(facts.where(predicate == "latest_known_moon"), "moons", F.trim("object_raw"))
    known = known.join(moons.limit(1).select(F.lit(1).alias("any")), how="left").where("any IS NULL").drop("any")
    every = planets.unionByName(dwarfs).unionByName(moons).unionByName(known)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("by", "pos", "entity"))).drop("by", "pos")


def order_value(predicate: Column, fact: Column) -> Column:
    """What an attribute orders by: a date's first day for date-like predicates, else the number."""
    return F.when(predicate.isin(*ORDERABLE), time_start(fact["object_raw"]).cast("double")).otherwise(fact["object_num"])


def scalar_text(fact: Column) -> Column:
    """An object as an answer: yes or no, whole numbers without a fraction, else the trimmed text."""
    raw, num = fact["object_raw"], fact["object_num"]
    whole = num.isNotNull() & raw.rlike(r"[.eE]") & (num == F.floor(num))
    return F.when(raw.isNull(), "").when(fact["object_bool"].isNotNull(), F.when(fact["object_bool"], "yes").otherwise("no")).when(whole, num.cast("decimal(38,0)").cast("string")).otherwise(F.trim(raw))


def year_text(fact: Column) -> Column:
    text = scalar_text(fact)
    return F.when(text.rlike("^[0-9]{4}"), F.substring(text, 1, 4)).otherwise(text)


def retrieve_batch(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, rank, fact): retrieve() for many requests (qid, entities, predicates, c, limit) by equi-joins."""
    norm = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x))))
    r = requests.select("qid", "c", "limit", norm("entities").alias("es"), norm("predicates").alias("ps"))
    f = facts.withColumn("_s", F.lower(F.trim("subject"))).withColumn("_p", F.lower(F.trim("predicate")))
    both = r.where("size(es) > 0 AND size(ps) > 0").withColumn("_s", F.explode("es")).withColumn("_p", F.explode("ps")).join(f, ["_s", "_p"])
    by_e = r.where("size(es) > 0 AND size(ps) = 0").withColumn("_s", F.explode("es")).join(f, "_s")
    by_p = r.where("size(es) = 0 AND size(ps) > 0").withColumn("_p", F.explode("ps")).join(f, "_p")
    met = both.unionByName(by_e).unionByName(by_p)
    met = met.where(F.col("c").isNull() | in_bounds(F.col("t_start"), F.col("t_end"), F.col("c")))
    group = Window.partitionBy("qid", "subject", "predicate")
    after = F.coalesce(F.col("c")["kind"] == "after", F.lit(False))
    met = met.withColumn("_g", F.min("pos").over(group)).withColumn("_n", F.row_number().over(group.orderBy(*best_order(after)))).where("_n = 1")
    rank = Window.partitionBy("qid").orderBy(F.array_contains("es", F.col("_s")).desc(), F.array_contains("ps", F.col("_p")).desc(), F.coalesce("time", F.lit("")).desc(), "_g")
    met = met.withColumn("rank", F.row_number().over(rank)).where("rank <= limit")
    return met.select("qid", "rank", F.struct(*facts.columns).alias("fact"))


def _requests(q: DataFrame, pool: DataFrame) -> DataFrame:
    """(qid, role, k, place, entity, subject, predicate, c) of every lookup that a question may need."""
    p = "plan."
    base = ["qid", "c"]
    asked = q.select(*base, F.posexplode(p + "entities").alias("i", "subject"), F.col(p + "predicates").alias("ps")).select(*base, "i", "subject", F.posexplode("ps").alias("j", "predicate"))
    direct = asked.select("qid", F.lit("direct").alias("role"), F.lit(0).alias("k"), (F.col("i") * 1000 + F.col("j")).alias("place"), F.col("subject").alias("entity"), "subject", "predicate", "c")
    compare = q.where(F.array_contains(p + "modifiers", "comparison")).select(*base, "attribute", F.posexplode(p + "entities").alias("i", "subject"))
    compare = compare.select("qid", F.lit("compare"), F.lit(0), "i", "subject", "subject", "attribute", "c")
    fields = q.select(*base, F.posexplode(p + "fields").alias("i", "f")).select("qid", F.lit("field"), F.lit(0), "i", "f.entity", "f.entity", "f.predicate", "c")
    members = pool.join(q.select(*base, "attribute", F.col(p + "conditions").alias("cs")), "qid")
    ordered = members.select("qid", F.lit("order"), F.lit(0), "place", "entity", "entity", "attribute", "c")
    tested = members.select(*base, "place", "entity", F.posexplode("cs").alias("k", "x")).select("qid", F.lit("test"), "k", "place", "entity", "entity", attribute_predicate(F.col("x.attribute")), "c")
    reference = q.select(*base, F.col(p + "helpers").alias("hs"), F.col(p + "entities").alias("es"), F.posexplode(p + "conditions").alias("k", "x"))
    reference = reference.withColumn("r", _reference()).where("r IS NOT NULL").select("qid", F.lit("reference"), "k", F.lit(0), "r", "r", attribute_predicate(F.col("x.attribute")), "c")
    checks = q.where("head IS NOT NULL").select(*base, "head", F.posexplode(F.array(*[F.lit(c) for c in CHECKED])).alias("i", "predicate")).select("qid", F.lit("check"), F.lit(0), "i", "head", "head", "predicate", "c")
    out = direct
    for part in (compare, fields, ordered, tested, reference, checks):
        out = out.union(part)
    return out


def _reference() -> Column:
    """A condition's reference entity: its own, else (without a value) the last helper, else the only entity."""
    open_ = F.col("x.reference").isNull() & F.col("x.value").isNull()
    last = F.when(F.size("hs") > 0, F.element_at("hs", -1)).when(F.size("es") == 1, F.get("es", F.lit(0)))
    return F.when(open_, last).otherwise(F.col("x.reference"))


def reason(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Answers (qid, question, kind, ...) from facts alone.

    A struct column time_override (semantic, value), where not null, stands in
    for the question's own time. Adds plan, strategy, derived (entities, null unless a pool answered),
    reasoned and raw (arrays of facts), context (their text) and answer.
    """
    q = compile_questions(questions)
    if "time_override" in questions.columns:
        other = F.col("time_override")
        own = F.col("plan").withField("semantic", other["semantic"]).withField("time_value", other["value"]).withField("has_time", F.lit(True)).withField("time_constraint", other["value"])
        q = q.withColumn("plan", F.when(other.isNotNull(), own).otherwise(F.col("plan")))
    p = lambda name: F.col(f"plan.{name}")
    has = lambda m: F.array_contains("plan.modifiers", m)
    pool_class = F.coalesce(p("target_class"), p("list_target"))
    q = q.withColumns(
        {
            "c": F.when(p("has_time"), bounds(p("time_value"), p("semantic"))),
            "attribute": F.coalesce(attribute_predicate(p("ordering_attribute")), F.lit("mass")),
            "head": F.coalesce(F.get(p("entities"), F.lit(0)), F.get(p("majors"), F.lit(0))),
            "class": F.when((p("primary") == "LIST") | p("target_class").isNotNull(), pool_class),
        }
    )
    q = q.withColumn("uses", (p("primary") == "MULTI_FIELD") | has("filter") | has("ordering") | has("comparison") | p("has_time"))
    direct_class = (p("primary") == "ENTITY") & ~has("comparison") & p("target_class").isNotNull()
    mode = F.when((p("primary") == "LIST") | direct_class, F.when(has("ordering") & has("filter"), "filter_order").when(has("ordering") | (direct_class & p("ordering_attribute").isNotNull()), "order").when((p("primary") == "LIST") | (F.size(p("conditions")) > 0), "filter"))
    q = q.withColumn("mode", F.when(F.col("uses"), mode))

    q = written(q, "plans")  # read by every branch below
    every = pools(facts)
    pool = q.where("mode IS NOT NULL").select("qid", "class").join(every, "class").select("qid", "entity", "place")
    bare = q.where("mode IN ('order', 'filter_order')").join(pool.select("qid").distinct(), "qid", "left_anti").select("qid", F.lower("attribute").alias("_p"))
    own = bare.join(facts.select(F.lower("predicate").alias("_p"), F.col("subject").alias("entity")).distinct(), "_p").select("qid", "entity")
    pool = written(pool.unionByName(own.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("entity")))), "pool")
    found = asof_lookup(_requests(q, pool), facts, ["qid", "role", "k", "place", "entity"])
    found = written(found, "found")

    conditions = q.select("qid", "mode", F.col("plan.entities").alias("es"), F.col("plan.helpers").alias("hs"), F.posexplode("plan.conditions").alias("k", "x")).withColumn("r", _reference())
    reference = found.where("role = 'reference'").select("qid", "k", F.col("fact.object_num").alias("limit_num"))
    conditions = conditions.join(reference, ["qid", "k"], "left").withColumn("bound", F.coalesce("limit_num", to_number(F.col("x.value"))))
    literal = (F.col("x.operator") == "==") & F.col("x.value").isNotNull()
    in_force = F.when(F.col("mode") == "order", (F.col("x.attribute") == "planet_type") & (F.col("x.operator") == "==")).otherwise(literal | F.col("bound").isNotNull())
    conditions = conditions.where(in_force)
    tests = conditions.join(pool, "qid").join(found.where("role = 'test'").select("qid", "k", "entity", "fact"), ["qid", "k", "entity"], "left")
    number, op = F.col("fact.object_num"), F.col("x.operator")
    passed = F.when(literal, F.lower("fact.object_raw") == F.lower("x.value")).when(F.lower("entity") == F.lower("r"), False).otherwise(F.when(op == "<", number < F.col("bound")).when(op == ">", number > F.col("bound")).otherwise(number == F.col("bound")))
    failed = tests.where(~F.coalesce(passed, F.lit(False))).select("qid", "entity").distinct()
    kept = pool.join(failed, ["qid", "entity"], "left_anti")
    order = found.where("role = 'order'").join(q.select("qid", "attribute"), "qid").select("qid", "entity", order_value(F.col("attribute"), F.col("fact")).alias("value"))
    kept = kept.join(order, ["qid", "entity"], "left").join(q.select("qid", "mode", F.col("plan.direction").alias("direction")), "qid")
    by_order = F.col("mode") != "filter"
    key = F.when(~by_order, 0.0).when(F.col("direction") == "descending", -F.col("value")).otherwise(F.col("value"))
    kept = kept.where(~by_order | F.col("value").isNotNull()).withColumn("key", key)
    lists = kept.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "place", "entity"))), lambda x: x["entity"]).alias("derived"))
    pooled = pool.select("qid").distinct().withColumn("has_pool", F.lit(True))

    hits = found.where("role IN ('direct', 'compare', 'field', 'check')").groupBy("qid", "role").agg(F.array_sort(F.collect_list(F.struct("place", "fact"))).alias("found"))
    hits = hits.groupBy("qid").pivot("role", ["direct", "compare", "field", "check"]).agg(F.first("found"))
    raw_limit = F.when(has("filter") | has("ordering"), 4).when(has("comparison"), 3).when(p("primary") == "BOOLEAN", 3).when(p("primary").isin("COUNT", "ENTITY"), 1).otherwise(4)
    raw_c = F.when(p("time_constraint").isNotNull(), bounds(p("time_constraint"), p("semantic")))
    ask = q.select("qid", p("entities").alias("entities"), p("predicates").alias("predicates"), raw_c.alias("c"), raw_limit.alias("limit"))
    raw = retrieve_batch(ask, facts).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fact"))), lambda x: x["fact"]).alias("raw"))
    loose = _loose(q, facts)

    out = q.join(lists, "qid", "left").join(pooled, "qid", "left").join(hits, "qid", "left").join(raw, "qid", "left").join(loose, "qid", "left")
    none = F.filter(F.array(F.get(F.col("raw"), F.lit(0))), lambda x: F.lit(False))
    take = lambda c: F.coalesce(F.transform(F.col(c), lambda x: x["fact"]), none)
    in_pool = F.col("mode").isNotNull() & F.coalesce("has_pool", F.lit(False))
    derived = F.when(in_pool, F.coalesce("derived", F.array().cast("array<string>")))
    selecting = p("primary") == "ENTITY"
    derived = F.when(selecting & in_pool, F.slice(derived, 1, 1)).otherwise(derived)
    direct = take("direct")
    looked = F.when(F.size(direct) > 0, F.slice(F.array_distinct(direct), 1, 1)).otherwise(F.coalesce(F.filter(F.array("loose"), lambda x: x.isNotNull()), none))
    reasoned = (
        F.when(~F.col("uses") | in_pool, none)
        .when(p("primary") == "BOOLEAN", F.when(F.size(direct) > 0, F.array_distinct(direct)).otherwise(F.coalesce("any_time", none)))
        .when((p("primary") == "ENTITY") & has("comparison"), F.array_distinct(take("compare")))
        .when(p("primary") == "MULTI_FIELD", F.array_distinct(take("field")))
        .when(p("primary") == "COUNT", F.slice(F.array_distinct(direct), 1, 1))
        .otherwise(looked)
    )
    strategy = (
        F.when(~F.col("uses"), "vanilla_retrieval")
        .when(F.col("mode") == "filter_order", F.concat(F.lit("list_filter_and_order_by_"), "attribute"))
        .when(F.col("mode") == "order", F.concat(F.lit("ordered_list_by_"), "attribute", F.lit("_"), F.coalesce(p("direction"), F.lit("None"))))
        .when((F.col("mode") == "filter") & in_pool, "list_filtering")
        .when(F.col("mode") == "filter", "generic_fallback")
        .when(p("primary") == "BOOLEAN", "boolean_direct_lookup")
        .when((p("primary") == "ENTITY") & has("comparison"), F.concat(F.lit("comparison_by_"), "attribute"))
        .when(p("primary") == "ENTITY", "entity_lookup")
        .when(p("primary") == "COUNT", "count_aggregation")
        .otherwise("multi_field_combination")
    )
    strategy = F.when(selecting & in_pool & (F.size("derived_") > 0), F.concat(strategy, F.lit("_entity_selection"))).otherwise(strategy)
    out = out.withColumn("derived_", derived).withColumns({"reasoned": reasoned, "strategy": strategy, "raw": F.when(in_pool & F.col("uses"), none).otherwise(F.coalesce("raw", none))})
    out = out.drop("derived").withColumnRenamed("derived_", "derived").withColumns({"fields_found": F.coalesce("field", F.filter(F.array(F.struct(F.lit(0).alias("place"), F.get("raw", F.lit(0)).alias("fact"))), lambda x: F.lit(False)))})
    dwarf = _largest_dwarf(q, every, facts)
    out = out.join(dwarf, "qid", "left")
    out = out.withColumn("answer", _answer()).withColumn("context", _context())
    return out.select(*questions.columns, "plan", "strategy", "derived", "reasoned", "raw", "context", "answer")


def _loose(q: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, loose, any_time): the best fact of the named subjects over all their asked predicates, and for yes/no
    questions the first three facts of subject and predicate whatever their time."""
    ask = q.where("uses").select("qid", "c", F.transform("plan.predicates", lambda x: F.lower(x)).alias("ps"), F.explode("plan.entities").alias("e"))
    met = ask.withColumn("_s", F.lower("e")).join(facts.withColumn("_s", F.lower("subject")), "_s")
    met = met.where((F.size("ps") == 0) | F.array_contains("ps", F.lower("predicate"))).withColumn("fact", F.struct(*facts.columns))
    ok = F.col("c").isNull() | in_bounds(F.col("t_start"), F.col("t_end"), F.col("c"))
    after = F.coalesce(F.col("c")["kind"] == "after", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("qid", ok).orderBy(*best_order(after)))
    early = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    met = met.withColumns({"_ok": ok, "_n": rank, "_e": early}).where("(_ok AND _n = 1) OR _e <= 3")
    pick = F.array_sort(F.collect_list(F.when(F.col("_e") <= 3, F.struct("pos", "fact"))))
    return met.groupBy("qid").agg(F.first(F.when(F.col("_ok") & (F.col("_n") == 1), F.col("fact")), ignorenulls=True).alias("loose"), F.transform(pick, lambda x: x["fact"]).alias("any_time"))


def _largest_dwarf(q: DataFrame, every: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, largest): the dwarf planet of greatest diameter at the question's time, for questions that ask for it."""
    asks = q.where(F.lower("question").contains("largest diameter") | F.lower("question").contains("largest size")).select("qid", "c")
    members = asks.withColumn("class", F.lit("dwarf_planets")).join(every, "class").drop("class")
    found = asof_lookup(members.withColumns({"subject": F.col("entity"), "predicate": F.lit("diameter")}), facts, ["qid", "entity"])
    return found.where("fact.object_num IS NOT NULL").groupBy("qid").agg(F.max_by(F.struct("entity", F.col("fact.object_num").alias("value")), F.struct(F.col("fact.object_num"), -F.col("place"))).alias("largest"))


def _checked(i: int) -> Column:
    return F.get(F.filter("check", lambda x: x["place"] == i), F.lit(0))["fact"]


def _boolean() -> Column:
    low = F.lower("question")
    same = lambda fact, text: F.coalesce(F.lower(F.trim(fact["object_raw"])) == text, F.lit(False))
    flag, diameter = _checked(1), _checked(2)
    own = F.coalesce(F.col("largest.value") <= diameter["object_num"], F.lit(True)) | (F.lower("largest.entity") == F.lower("head"))
    size = F.when(flag.isNotNull(), F.coalesce(flag["object_bool"], flag["object_raw"].isNotNull())).when(diameter.isNotNull(), own)
    inside = low.contains("located in") | low.contains("found in")
    checks = F.array_compact(
        F.array(
            F.when(low.contains("dwarf planet"), same(_checked(0), "dwarf planet")),
            F.when(low.contains("largest diameter") | low.contains("largest size"), size),
            F.when(inside & low.contains("kuiper belt"), same(_checked(3), "kuiper belt")),
            F.when(inside & low.contains("asteroid belt"), same(_checked(3), "asteroid belt")),
        )
    )
    first = F.get(_facts(), F.lit(0))["object_bool"]
    alone = F.when(first.isNotNull(), F.when(first, "yes").otherwise("no")).otherwise("")
    return F.when(F.col("head").isNull(), "").when(F.size(checks) == 0, alone).otherwise(F.when(F.forall(checks, lambda x: x), "yes").otherwise("no"))


def _facts() -> Column:
    return F.when(F.size("reasoned") > 0, F.col("reasoned")).otherwise(F.col("raw"))


def _answer() -> Column:
    """The answer by the kind asked for: the facts' first, the pool's entities, the greatest or least, or one part a field."""
    first = F.get(_facts(), F.lit(0))
    dated = lambda f: F.lower(f["predicate"]).isin(*ORDERABLE)
    number = F.coalesce(F.when(dated(first), year_text(first)).otherwise(scalar_text(first)), F.lit(""))
    is_date = dated(first)
    values = F.transform(_facts(), lambda f, i: F.struct(F.when(is_date, F.coalesce(time_start(f["object_raw"]), f["t_start"]).cast("double")).otherwise(f["object_num"]).alias("v"), (-i).alias("i"), f["subject"].alias("s")))
    values = F.filter(values, lambda x: x["v"].isNotNull())
    turned = F.transform(values, lambda x: F.struct((-x["v"]).alias("v"), x["i"].alias("i"), x["s"].alias("s")))
    chosen = F.array_max(F.when(F.col("plan.comparison") == "<", turned).otherwise(values))["s"]
    entity = F.when(first["predicate"].isin("discovered_by", "classification", "planet_type", "location"), scalar_text(first)).otherwise(F.trim(first["subject"]))
    entity = (
        F.when((F.col("plan.primary") == "BOOLEAN"), _boolean())
        .when(F.size(F.coalesce("derived", F.array().cast("array<string>"))) > 0, F.get("derived", F.lit(0)))
        .when(F.array_contains("plan.modifiers", "comparison"), F.coalesce(chosen, F.lit("")))
        .otherwise(F.coalesce(entity, F.lit("")))
    )
    subjects = F.array_distinct(F.filter(F.transform(_facts(), lambda f: F.trim(f["subject"])), lambda s: s != ""))
    many = F.when(F.size(F.coalesce("derived", F.array().cast("array<string>"))) > 0, F.array_join("derived", ", ")).otherwise(F.array_join(subjects, ", "))
    parts = F.transform("fields_found", lambda x: F.when(x["fact"]["predicate"].isin(*ORDERABLE), year_text(x["fact"])).otherwise(scalar_text(x["fact"])))
    fields = F.array_join(F.filter(parts, lambda s: s != ""), ", ")
    kind = F.col("kind")
    return F.when(kind == "single_number", number).when(kind == "boolean", _boolean()).when(kind == "entity", entity).when(kind.isin("entity_list", "ordered_list"), many).when(kind == "multi_field", fields).otherwise("")


def _context() -> Column:
    """The text of what was found: a derived list under its title, else the facts' lines."""
    target = F.col("class")
    typed = F.get(F.filter("plan.conditions", lambda x: (x["attribute"] == "planet_type") & (x["operator"] == "==")), F.lit(0))["value"]
    capital = F.concat(F.upper(F.substring(typed, 1, 1)), F.lower(F.substring(typed, 2, 100)))
    name = F.when(target == "planets", F.coalesce(F.concat(capital, F.lit(" planets")), F.lit("Planets"))).when(target == "dwarf_planets", "Dwarf planets").when(target == "moons", "Moons").otherwise("Entities")
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    label = F.coalesce(F.element_at(labels, F.col("attribute")), F.replace("attribute", F.lit("_"), F.lit(" ")))
    how = F.when(F.col("plan.direction") == "descending", "decreasing").otherwise("increasing")
    ordered = F.concat(F.lit(" ordered by "), how, F.lit(" "), label)
    title = F.when(F.col("plan.primary") == "ENTITY", F.concat(F.lit("Selected "), F.lower(F.regexp_replace(name, "s+$", "")))).when(F.col("mode") == "filter_order", F.concat(F.lit("Filtered "), F.lower(name), ordered)).when(F.col("mode") == "order", F.concat(name, ordered)).otherwise(F.concat(F.lit("Filtered "), F.lower(name), F.lit(" matching all conditions")))
    listed = F.concat(F.lit("Derived KG Result:\n"), title, F.lit(":\n"), F.when(F.size("derived") > 0, F.array_join("derived", ", ")).otherwise("No matching entities found."))
    return F.when(F.col("derived").isNotNull(), listed).otherwise(facts_text(_facts()))


def comprehensive(df: DataFrame) -> Column:
    """Whether what was found suffices as context, for rows of reason()."""
    facts = _facts()
    subjects = F.transform(facts, lambda f: F.lower(f["subject"]))
    seen = F.size(F.filter("plan.entities", lambda e: F.exists(subjects, lambda s: s.contains(F.lower(e)))))
    two = (F.size(facts) >= 2) & (seen >= 2)
    return F.when(F.col("derived").isNotNull(), F.size("derived") > 0).when(F.col("plan.primary").isin("COUNT", "ENTITY", "BOOLEAN"), F.size(facts) >= 1).when(F.array_contains("plan.modifiers", "comparison"), two).otherwise(two | (F.size(facts) >= 3))


def uses_context(df: DataFrame) -> Column:
    return (F.col("plan.primary") != "LIST") | (F.size("plan.modifiers") > 0)


def context_mode(df: DataFrame) -> Column:
    """derived_reasoning, raw_retrieval or no_kg; facts found by reasoning alone report no_kg."""
    return F.when(F.col("derived").isNotNull(), "derived_reasoning").when(F.size("raw") > 0, "raw_retrieval").otherwise("no_kg")
