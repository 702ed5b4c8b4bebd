"""Questions as small plans: entity and predicate spotting, time, answer shape, modifiers, ordering, filters and fields.

Every part is a Column over the question's text, so a batch of questions is
compiled by one projection and no Python runs per row. Word lists and patterns
are parameters (a Lexicon); the default is the astronomy one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Names, words and patterns that decide results.
ENTITIES = (
    "Mercury", "Venus", "Earth", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune", "Pluto", "Ceres", "Eris", "Makemake", "Haumea", "Charon",
    "Triton", "Europa", "Ganymede", "Callisto", "Io", "Johann Galle", "Clyde Tombaugh", "Johann Gottfried Galle", "Kuiper Belt", "Asteroid Belt",
    "Solar System", "Oort Cloud",
)
MONTHS = {
    "jan": "01", "january": "01", "feb": "02", "february": "02", "mar": "03", "march": "03", "apr": "04", "april": "04", "may": "05", "jun": "06",
    "june": "06", "jul": "07", "july": "07", "aug": "08", "august": "08", "sep": "09", "sept": "09", "september": "09", "oct": "10", "october": "10",
    "nov": "11", "november": "11", "dec": "12", "december": "12",
}
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
TOKEN = rf"(?:{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,)?\s+\d{{4}}|{MONTH}\s+\d{{4}}|\d{{4}}[-/]\d{{1,2}}(?:[-/]\d{{1,2}})?|\d{{1,2}}[-/]\d{{4}}|\d{{4}})"
MOONS = "(?:moons|satellites|orbital bodies)"
PREDICATES = {
    "moon_count": (rf"(?:how\s+many(?:\s+of\s+.+?)?\s+(?:officially\s+)?(?:confirmed\s+)?(?:known\s+)?{MOONS}|(?:count|number|total\s+number)\s+of\s+(?:officially\s+)?(?:confirmed\s+)?(?:known\s+)?{MOONS})", ()),
    "discovered_on": (r"(?:when|what year|which year|in what year)\s+(?:was\s+)?(?:.*\s+)?(?:discovered|found)|\b(?:discovered|found)\b\s+.*\bwhen\b|\bdiscovery year\b", ("discovered", "discovery", "when discovered", "found", "when found", "discovery year", "found in")),
    "discovered_by": (r"(?:who|which)\s+(?:astronomer\s+)?(?:discovered|found)|(?:discovered|found)\s+by|who\s+was\s+.*(?:discovered|found)\s+by|name\s+the\s+(?:astronomer|discoverer|finder)", ("discovered by", "who discovered", "discoverer", "found by", "who found", "finder")),
    "recognized_on": (r"(?:when|what year|which year|in what year)\s+(?:was\s+)?(?:.*\s+)?recognized|(?:officially\s+)?recognized\s+.*\bwhen\b|\brecognition\s+(?:date|year)\b", ("recognized on", "recognized when", "when recognized", "recognition date", "recognition year", "officially recognized")),
    "first_observed_on": (r"(?:when|what year|which year|in what year)\s+(?:was\s+)?(?:.*\s+)?(?:first\s+observed|first\s+seen|observed)|(?:first\s+observed|first\s+seen)\s+.*\bwhen\b|\b(?:first\s+)?observation\s+(?:date|year)\b", ("first observed", "first observation", "when first observed", "observation date", "observation year", "first seen")),
    "mass": (r"(?:what\s+is\s+the\s+mass|mass\s+of|greater\s+mass|more\s+massive|less\s+massive|heaviest|lightest|heavier|lighter)", ("mass", "weight", "massive", "heavier", "lighter", "heaviest", "lightest")),
    "distance_from_sun": (r"(?:distance\s+(?:from|to)\s+the?\s*sun|distance\s+from\s+sun|far(?:ther)?\s+from\s+the?\s*sun|closer\s+to\s+the?\s*sun|which\s+.*(?:farther\s+from|closer\s+to)\s+the?\s*sun)", ("distance from sun", "distance to sun", "away from sun", "far from sun", "farther from sun", "closer to sun")),
    "surface_gravity": (r"(?:surface\s+gravity|gravity\s+of|gravitational\s+pull|stronger\s+(?:surface\s+)?gravity|weaker\s+(?:surface\s+)?gravity|higher\s+(?:surface\s+)?gravity|lower\s+(?:surface\s+)?gravity)", ("surface gravity", "gravitational pull", "gravity of", "stronger gravity", "weaker gravity", "higher gravity", "lower gravity", "stronger surface gravity", "weaker surface gravity", "higher surface gravity", "lower surface gravity")),
    "classification": (r"(?:classification\s+of|how\s+is\s+.*classified|classif(?:y|ied)\s+as|is\s+.*(?:a|an)\s+(?:dwarf\s+)?planet|recogniz(?:e|ed)\s+.*(?:as\s+)?(?:a\s+)?(?:dwarf\s+)?planet|recognized\s+as)", ("classification", "classified", "recognized as", "classify as")),
    "planet_type": (r"(?:type\s+of\s+planet|planet\s+type|what\s+type\s+of\s+planet|terrestrial|gas\s+giant|ice\s+giant)", ("type of planet", "planet type", "terrestrial", "ice giant", "gas giant")),
    "location": (r"(?:location\s+of|located\s+in|where\s+is\s+.*(?:located|found)|found\s+in|in\s+the\s+kuiper\s+belt|in\s+the\s+asteroid\s+belt)", ("location", "located in", "found in", "in the kuiper belt", "in the asteroid belt")),
    "ordering": (r"(?:order\s+of|in\s+order|rank(?:ed)?|decreasing\s+order|increasing\s+order|smallest\s+to\s+largest|largest\s+to\s+smallest)", ("order", "rank", "decreasing", "increasing", "smallest to largest", "largest to smallest")),
    "comparison": (r"(?:between\s+.*\s+which|compared\s+to|greater\s+than|less\s+than|more\s+than|fewer\s+than|which\s+is\s+(?:greater|larger|smaller|farther|closer))", ("between", "compared to", "greater than", "less than", "more than", "fewer than")),
}
#: Strings of which every match of a rule's pattern has one: a text without them need not be tried.
NEEDS = {
    PREDICATES[name][0]: needs
    for name, needs in {
        "moon_count": ("moons", "satellites", "bodies"), "discovered_on": ("discover", "found"), "discovered_by": ("discover", "found", "astronomer", "finder"),
        "recognized_on": ("recogni",), "first_observed_on": ("observ", "seen"), "mass": ("mass", "heav", "light"), "distance_from_sun": ("sun",), "surface_gravity": ("gravit",),
        "classification": ("classif", "planet", "recogni"), "planet_type": ("planet", "terrestrial", "giant"), "location": ("locat", "found", "belt"),
        "ordering": ("order", "rank", "smallest"), "comparison": ("between", "compared", "than", "which"),
    }.items()
}
HELPERS = ("ordering", "comparison")
ORDERABLE = ("discovered_on", "recognized_on", "first_observed_on")
BODIES = r"(?:planets|dwarf\s+planets|dwarfs|moons|satellites|objects|bodies)"
QUALIFIED = rf"(?:the\s+)?(?:(?:terrestrial|gas\s+giant|ice\s+giant|confirmed|known)\s+){{0,2}}{BODIES}\b"
ONE = r"(?:(?:dwarf\s+)?planet|object|body)\b"
SHAPES = {
    "BOOLEAN": ((r"^(?:is|are|was|were|does|did)\b(?!.*\bhow\s+many\b)", r"^(?:does|did)\s+.*\b(?:have|orbit|orbits|contain)\b(?!.*\bhow\s+many\b)", r"^(?:is|are|was|were)\s+.*\b(?:a|an|the)\b", r"^(?:is|are|was|were)\s+.*\b(?:located\s+in|found\s+in|recognized\s+as)\b"), ()),
    "COUNT": ((r"\bhow\s+many\b", r"\b(?:count|number)\s+of\b", r"\btotal\s+(?:number|count)\s+of\b", r"\bwhat\s+(?:is|was)\s+the\s+number\s+of\b"), ("how many", "count of", "number of", "total number of", "total count of")),
    "LIST": ((rf"\bwhich\s+{BODIES}\b", rf"\b(?:list|name)\s+{QUALIFIED}", rf"\border\s+{QUALIFIED}", rf"\ball\s+{BODIES}\b", r"\bwhat\s+are\s+the\s+(?:planets|dwarf\s+planets|moons|satellites|objects|bodies)\b"), ("which planets", "which dwarf planets", "which moons", "all planets", "all dwarf planets")),
    "ENTITY": ((rf"\bwhich\s+{ONE}", r"\bwho\s+(?:discovered|found)\b", r"\bwhat\s+type\s+of\s+planet\b", rf"\bwhat\s+{ONE}", rf"\bname\s+(?:the|a)\s+{ONE}", r"\bwhich\s+(?:astronomer|discoverer)\b"), ("who discovered", "who found", "what type of planet", "which discoverer")),
}
LIST_TARGET = rf"^(?:which|list|name|all|what\s+are\s+the)\s+{BODIES}\b"
ORDERING_PATTERNS = (
    r"\bin\s+order\b",
    r"\border\s+of\b",
    r"\brank(?:ed)?\b",
    r"\b(?:in|of)\s+decreasing\s+order\b",
    r"\b(?:in|of)\s+increasing\s+order\b",
    r"\bby\s+decreasing\b",
    r"\bby\s+increasing\b",
    r"\border(?:ed)?\s+by\b",
    r"\bsort(?:ed)?\s+by\b",
    r"\bsmallest\s+to\s+largest\b",
    r"\blargest\s+to\s+smallest\b",
    r"\bfrom\s+smallest\s+to\s+largest\b",
    r"\bfrom\s+largest\s+to\s+smallest\b",
)
COMPARISON_PATTERNS = (
    r"\bbetween\b.*\bwhich\b",
    r"\bcompared\s+to\b",
    r"\b(?:greater|less|more|fewer|larger|smaller|heavier|lighter|farther|closer)\s+than\b",
    r"\bwhich\s+(?:is|planet\s+is|one\s+is)\s+(?:greater|larger|smaller|heavier|lighter|farther|closer)\b",
)
FILTER_PATTERNS = (
    r"\bfewer\s+than\b",
    r"\bmore\s+than\b",
    r"\bless\s+than\b",
    r"\bgreater\s+than\b",
    r"\bcloser\s+than\b",
    r"\bfarther\s+than\b",
    r"\blocated\s+in\b",
    r"\bfound\s+in\b",
    r"\bin\s+the\s+kuiper\s+belt\b",
    r"\bin\s+the\s+asteroid\s+belt\b",
    r"\borbit(?:s|ing)?\s+beyond\b",
    r"\bbeyond\s+earth\b",
)
ORDERING, COMPARISON, FILTER = ("|".join(p) for p in (ORDERING_PATTERNS, COMPARISON_PATTERNS, FILTER_PATTERNS))
ORDER_WORDS = (("mass", "mass|heaviest|lightest|heavier|lighter|weight"), ("distance", "distance|farther|closer"), ("size", "size|diameter|largest|smallest"), ("discovered", r"discovery\s+date|discovery\s+year|when\s+discovered"), ("moons", r"moons|moon\s+count|satellites"))
COMPARE_WORDS = ((">", ("greater", "larger", "heavier", "farther")), ("<", ("fewer", "smaller", "lighter", "closer")), ("==", ("same", "equal")))
TEMPLATES = {
    "moon_count": "How many moons does {} have?",
    "discovered_on": "In what year was {} discovered?",
    "discovered_by": "Who discovered {}?",
    "recognized_on": "In what year was {} recognized?",
    "first_observed_on": "In what year was {} first observed?",
    "mass": "What is the mass of {}?",
    "distance_from_sun": "What is {}'s distance from the Sun?",
    "surface_gravity": "What is the surface gravity of {}?",
    "classification": "What is the classification of {}?",
    "planet_type": "What type of planet is {}?",
    "location": "Where is {} located?",
}
PREPOSITIONS = {"exact": r"as\s+of(?:\s+the\s+(?:start|end)\s+of)?|by|on|at|during|in", "before": r"before|prior\s+to|until|up\s+to", "after": "after|since"}
PARSER_PREPOSITIONS = ("as of|by|on|during|in", "before|prior to|until|up to", "after|since")


@dataclass(frozen=True)
class Lexicon:
    entities: Sequence[str] = ENTITIES
    predicates: Mapping[str, tuple[str, Sequence[str]]] = field(default_factory=lambda: PREDICATES)


def literal(text: str) -> str:
    """A pattern that matches the text itself."""
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in text)


def _pos(text: Column, pattern: str) -> Column:
    """Place of the first match, from 1; 0 if none."""
    return F.regexp_instr(text, F.lit(f"({pattern})"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sorted_names(found: list[tuple[Column, int, str]]) -> Column:
    """Names by place, then by the number given with them; those at place 0 left out."""
    rows = F.array(*[F.struct(p.alias("p"), F.lit(o).alias("o"), F.lit(n).alias("n")) for p, o, n in found])
    return F.transform(F.array_sort(F.filter(rows, lambda x: x["p"] > 0)), lambda x: x["n"])


def spot_entities(text: Column, names: Sequence[str] = ENTITIES) -> Column:
    """Known names in the order of their first places, the longer first at one place."""
    low = F.lower(text)
    # a plain search is far cheaper than a pattern, which most names need not meet
    return _sorted_names([(F.when(low.contains(n.lower()), _pos(low, rf"\b{literal(n.lower())}\b")).otherwise(0), -len(n), n) for n in names])


def entities(text: Column, names: Sequence[str] = ENTITIES) -> Column:
    """Known names; without any, Moon and Moons stand in where those words do."""
    low, known = F.lower(text), spot_entities(text, names)
    stand_in = F.array_compact(F.array(F.when(low.rlike(r"\bmoon\b"), F.lit("Moon")), F.when(low.rlike(r"\bmoons\b"), F.lit("Moons"))))
    return _once(known, lambda k: F.when(F.size(k) > 0, k).otherwise(stand_in))


def predicates(text: Column, rules: Mapping = PREDICATES) -> Column:
    """Predicates the text asks about, in the rules' order: by pattern or else by a word of theirs."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(_hit(low, *rule), F.lit(name)) for name, rule in rules.items()]))


def _needed(low: Column, pattern: str) -> Column:
    """Whether a text has one of the strings without which the pattern has no match; true where none are known."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in NEEDS[pattern]]) if pattern in NEEDS else F.lit(True)


def _hit(low: Column, pattern: str, words: Sequence[str]) -> Column:
    out = _needed(low, pattern) & low.rlike(pattern)
    for w in words:
        out = out | low.contains(w)
    return out


def predicate_mentions(text: Column, rules: Mapping = PREDICATES) -> Column:
    """Predicates in the order of their mentions: the pattern's place, or else the first place of a word."""
    low, found = F.lower(text), []
    for i, (name, (pattern, words)) in enumerate(rules.items()):
        at = F.nullif(F.when(_needed(low, pattern), _pos(low, pattern)), F.lit(0))
        spots = [F.nullif(F.instr(low, w), F.lit(0)) for w in words]
        word = F.least(*spots) if len(spots) > 1 else spots[0] if spots else F.lit(None).cast("int")
        found.append((F.coalesce(at, word, F.lit(0)), i, name))
    return _sorted_names(found)


def normalize_time(token: Column) -> Column:
    """A date expression as YYYY, YYYY-MM or YYYY-MM-DD; null if it is none."""
    text = F.regexp_replace(F.trim(F.lower(F.translate(token, ",", ""))), r"\s+", " ")
    text = F.regexp_replace(text, r"(\d)(st|nd|rd|th)\b", "$1")
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    two = lambda c: F.lpad(c, 2, "0")
    got = lambda pattern, i: F.regexp_extract(text, pattern, i)
    month = F.element_at(months, F.regexp_extract(text, r"^([a-z]+)", 1))
    full, short, iso, back = rf"^({MONTH}) (\d{{1,2}}) (\d{{4}})$", rf"^({MONTH}) (\d{{4}})$", r"^(\d{4})[-/](\d{1,2})(?:[-/](\d{1,2}))?$", r"^(\d{1,2})[-/](\d{4})$"
    return (
        F.when(text.rlike(full), F.concat(got(full, 3), F.lit("-"), month, F.lit("-"), two(got(full, 2))))
        .when(text.rlike(short), F.concat(got(short, 2), F.lit("-"), month))
        .when(text.rlike(iso), F.concat(got(iso, 1), F.lit("-"), two(got(iso, 2)), F.when(got(iso, 3) != "", F.concat(F.lit("-"), two(got(iso, 3)))).otherwise(F.lit(""))))
        .when(text.rlike(back), F.concat(got(back, 2), F.lit("-"), two(got(back, 1))))
        .when(text.rlike(r"^\d{4}$"), text)
    )


def _dated(low: Column) -> Column:
    """Whether there are four digits in a row, as in every TOKEN: else no pattern with one needs to be tried."""
    return low.rlike(r"\d{4}")


def _range(low: Column, joiners: str) -> tuple[Column, Column, Column]:
    pattern = rf"(?:between|from)\s+({TOKEN})\s+(?:{joiners})\s+({TOKEN})"
    return _dated(low) & low.rlike(pattern), F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)


def time_constraint(text: Column) -> Column:
    """The parser's time value: a range first, then as-of, before and after forms, each only if it normalises."""
    low = F.lower(text)
    hit, a, b = _range(low, "and|to")
    out = [F.when(hit, F.concat(normalize_time(a), F.lit(".."), normalize_time(b)))]
    for words in PARSER_PREPOSITIONS:
        pattern = rf"(?:{words})\s+({TOKEN})"
        out.append(F.when(_dated(low) & low.rlike(pattern), normalize_time(F.regexp_extract(low, pattern, 1))))
    return F.coalesce(*out)


def time_semantic(text: Column) -> Column:
    """struct(semantic, value) of the classifier, whose forms and precedence differ from the parser's; semantic none without a time."""
    low = F.lower(text)
    hit, a, b = _range(low, "and|to|through")
    dated = _dated(low)
    both = F.concat(F.coalesce(normalize_time(a), a), F.lit(".."), F.coalesce(normalize_time(b), b))
    both = F.when(normalize_time(a).isNotNull() & normalize_time(b).isNotNull(), both).otherwise(F.concat(a, F.lit(".."), b))
    name, value = F.when(hit, "between"), F.when(hit, both)
    for kind in ("before", "after", "exact"):
        pattern = rf"(?:{PREPOSITIONS[kind]})\s+({TOKEN})"
        token, hit = F.regexp_extract(low, pattern, 1), dated & low.rlike(pattern)
        name, value = name.when(hit, kind), value.when(hit, F.coalesce(normalize_time(token), token))
    return F.struct(name.otherwise("none").alias("semantic"), value.alias("value"))


def type_scores(text: Column) -> dict[str, Column]:
    """Score of each answer shape: 0.7 for any pattern, 0.2 for any word, with the floors and caps of counts, lists and yes/no questions."""
    low, out = F.lower(text), {}
    for name, (patterns, words) in SHAPES.items():
        score = F.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), 0.7).otherwise(0.0)
        for i, w in enumerate(words):
            hit = low.contains(w) if not i else hit | low.contains(w)
        out[name] = score + F.when(hit, 0.2).otherwise(0.0) if words else score
    counting = low.rlike("|".join(SHAPES["COUNT"][0]))
    target = low.rlike(LIST_TARGET)
    out["COUNT"] = F.when(counting, F.greatest(out["COUNT"], F.lit(0.9))).otherwise(out["COUNT"])
    out["LIST"] = F.when(target | low.rlike(rf"\border\s+{QUALIFIED}"), F.greatest(out["LIST"], F.lit(0.8))).otherwise(out["LIST"])
    capped = F.least(out["BOOLEAN"], F.lit(0.1))
    out["BOOLEAN"] = F.when(low.rlike(r"\bhow\s+many\b"), 0.0).when(target | low.rlike(COMPARISON) | low.rlike(ORDERING), capped).otherwise(out["BOOLEAN"])
    return out


def compile_questions(df: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Adds plan, a struct, to rows with a question text.

    Fields: entities, predicates, time_constraint (parser); semantic,
    time_value, has_time, logic, majors, helpers, major_predicates,
    helper_predicates, fields, field_mode, primary, secondary, scores,
    confidence, modifiers, ordering_attribute, direction, comparison,
    boolean_word, list_target, target_class, conditions (classifier). Where the
    original's order is that of a hash set, the rules' order stands.
    """
    q, low = F.col("question"), F.lower("question")
    df = df.withColumns({"_e": entities(q, lexicon.entities), "_p": predicates(q, lexicon.predicates), "_m": predicate_mentions(q, lexicon.predicates), "_t": time_semantic(q)})
    helper = F.array(*[F.lit(h) for h in HELPERS])
    df = df.withColumns({"_mp": F.array_except("_m", helper), "_hp": F.array_intersect("_m", helper)})
    target, comparing = low.rlike(LIST_TARGET), low.rlike(COMPARISON)
    logic = F.when(low.rlike(r"\band\b"), "and").when(low.rlike(r"\bor\b"), "or").otherwise("none")
    n = F.size("_e")
    none = F.array().cast("array<string>")
    first = lambda k: F.slice("_e", 1, k)
    rest = lambda k: F.when(n > k, F.slice("_e", k + 1, F.size("_e"))).otherwise(none)
    two = comparing & (n >= 2)
    yes_no = low.rlike(r"^(?:is|are|was|were|does|did)\b") & (n >= 2)
    whole = ((n >= 2) & (F.size("_mp") == 1) & low.rlike(r"\band\b")) | ((n == 1) & (F.size("_mp") > 0))
    df = df.withColumns(
        {
            "_major": F.when(target, none).when(two, first(2)).when(yes_no, first(1)).when(whole, F.col("_e")).otherwise(first(1)),
            "_helper": F.when(target, F.col("_e")).when(two, rest(2)).when(yes_no, rest(1)).when(whole, none).otherwise(rest(1)),
            "_logic": logic,
        }
    )
    df = df.withColumn("_fields", _fields(low, target, comparing))
    multi = F.size("_fields") > 0
    df = df.withColumn("_scores", F.struct(*[v.alias(k) for k, v in type_scores(q).items()]))
    ranked = F.array_sort(F.array(*[F.struct((-F.col("_scores")[k]).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(SHAPES)]))
    df = df.withColumn("_ranked", ranked)
    top = F.col("_ranked")[0]
    second = F.transform(F.filter(F.slice("_ranked", 2, 2), lambda x: x["s"] < -0.2), lambda x: x["k"])
    df = df.withColumns(
        {
            "_primary": F.when(multi, "MULTI_FIELD").when(top["s"] < 0, top["k"]).otherwise("ENTITY"),
            "_confidence": F.when(multi | (top["s"] == 0), 1.0).otherwise(-top["s"]),
            "_secondary": F.when(multi | (top["s"] == 0), none).otherwise(second),
        }
    )
    class_of = F.when(low.rlike(r"\b(?:which|what)\s+dwarf\s+planet\b|\bname\s+(?:the|a)\s+dwarf\s+planet\b"), "dwarf_planets")
    class_of = class_of.when(low.rlike(r"\b(?:which|what)\s+planet\b|\bname\s+(?:the|a)\s+planet\b"), "planets").when(low.rlike(r"\b(?:which|what)\s+(?:moon|satellite)\b|\bname\s+(?:the|a)\s+(?:moon|satellite)\b"), "moons")
    df = df.withColumn("_class", F.when((F.col("_primary") == "ENTITY") & ~(comparing & (F.size("_major") >= 2)), class_of))
    pooled = (F.col("_primary") == "LIST") | F.col("_class").isNotNull()
    orderable = F.array_intersect("_mp", F.array(*[F.lit(x) for x in ORDERABLE]))
    temporal = (F.size(orderable) > 0) & low.rlike(r"\b(?:first|earliest|last|latest|most\s+recently)\b")
    open_type = F.col("_primary") != "BOOLEAN"
    has_time = F.col("_t.semantic") != "none"
    modifiers = F.array_compact(
        F.array(
            F.when(has_time, F.lit("time_lookup")),
            F.when(open_type & (low.rlike(ORDERING) | temporal), F.lit("ordering")),
            F.when(open_type & comparing, F.lit("comparison")),
            F.when(open_type & pooled & (low.rlike(FILTER) | (F.col("_logic") == "and")), F.lit("filter")),
        )
    )
    attribute = F.when(temporal, orderable[0])
    for name, words in ORDER_WORDS:
        attribute = attribute.when(low.rlike(words), name)
    up = F.when(temporal & low.rlike(r"\b(?:first|earliest)\b"), "ascending").when(temporal, "descending").when(low.rlike("decreasing|most|largest|highest|heaviest|farthest"), "descending").otherwise("ascending")
    df = df.withColumns({"_modifiers": modifiers, "_attribute": attribute})
    compare = F.when(F.lit(False), "")
    for op, words in COMPARE_WORDS:
        compare = compare.when(low.rlike("|".join(words)), op)
    boolean_word = F.when(F.lit(False), "")
    for w in ("yes", "no", "true", "false"):
        boolean_word = boolean_word.when(low.rlike(rf"\b{w}\b"), w)
    list_target = F.when(low.rlike(r"\bdwarf\s+planets\b|\bdwarfs?\b"), "dwarf_planets").when(low.rlike(r"\bplanets\b"), "planets").when(low.rlike(r"\b(?:moons|satellites)\b"), "moons")
    conditions = F.when(pooled, _conditions(low)).otherwise(F.array().cast("array<struct<operator:string,attribute:string,value:string,reference:string>>"))
    plan = F.struct(
        F.col("_e").alias("entities"),
        F.col("_p").alias("predicates"),
        time_constraint(q).alias("time_constraint"),
        F.col("_t.semantic").alias("semantic"),
        F.col("_t.value").alias("time_value"),
        has_time.alias("has_time"),
        F.col("_logic").alias("logic"),
        F.col("_major").alias("majors"),
        F.col("_helper").alias("helpers"),
        F.col("_mp").alias("major_predicates"),
        F.col("_hp").alias("helper_predicates"),
        F.col("_fields").alias("fields"),
        F.when(multi, F.when(F.size("_major") == 1, "single_entity_multi_predicate").otherwise("multi_entity_single_predicate")).alias("field_mode"),
        F.col("_primary").alias("primary"),
        F.col("_secondary").alias("secondary"),
        F.col("_scores").alias("scores"),
        F.col("_confidence").alias("confidence"),
        F.col("_modifiers").alias("modifiers"),
        F.col("_attribute").alias("ordering_attribute"),
        F.when(F.col("_attribute").isNotNull(), up).alias("direction"),
        compare.alias("comparison"),
        boolean_word.alias("boolean_word"),
        F.when(pooled, list_target).alias("list_target"),
        F.col("_class").alias("target_class"),
        conditions.alias("conditions"),
    )
    hidden = [c for c in df.columns if c.startswith("_")]
    return df.withColumn("plan", plan).drop(*hidden)


def _fields(low: Column, target: Column, comparing: Column) -> Column:
    """Two fields at most: one entity's two predicates or two entities' one, if the question's structure asks for two answers."""
    compound = target | low.rlike(r"\b(?:yet|that|which)\s+(?:have|has|orbit|orbits|are|were|contain|contains|lie|lies)\b") | low.rlike(r"\band\s+(?:have|has|orbit|orbits|are|were|is|located|found|contains|lies|with)\b") | comparing
    ask = r"(?:who|what|which|when|where|how\s+many|in\s+what\s+year|what\s+year|which\s+year)"
    when = rf"(?:(?:as\s+of|by|on|at|during|in|before|after|since|from|between)\s+{TOKEN}\s*,?\s+)?"
    scaffold = low.rlike(rf"^{when}(?:what|which)\s+(?:is|are|was|were)\b")
    one_predicate = scaffold | low.rlike(rf"^\s*{when}{ask}\b.*\band\b")
    two_predicates = low.rlike(rf",\s*and\s+{ask}\b") | low.rlike(rf"^\s*{when}{ask}\b.*\band\s+{ask}\b") | scaffold
    template = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])
    counted = F.array(*[F.lit(x) for x in ("moon_count", *ORDERABLE)])

    def one(name: Column, entity: Column, predicate: Column) -> Column:
        return F.struct(
            name.alias("name"),
            entity.alias("entity"),
            F.when(F.array_contains(counted, predicate), "COUNT").otherwise("ENTITY").alias("answer_type"),
            predicate.alias("predicate"),
            F.replace(F.element_at(template, predicate), F.lit("{}"), entity).alias("sub_question"),
        )

    name = lambda i: F.concat(F.lit("field"), (i + 1).cast("string"))
    by_predicate = F.transform(F.slice("_mp", 1, 2), lambda p, i: one(name(i), F.col("_major")[0], p))
    by_entity = F.transform(F.slice("_major", 1, 2), lambda e, i: one(name(i), e, F.col("_mp")[0]))
    both = (F.col("_logic") == "and") & ~compound
    single = (F.size("_major") == 1) & (F.size("_mp") >= 2)
    shared = (F.size("_major") >= 2) & (F.size("_mp") == 1)
    return F.when(both & single & two_predicates, by_predicate).when(both & shared & one_predicate, by_entity).otherwise(F.array().cast("array<struct<name:string,entity:string,answer_type:string,predicate:string,sub_question:string>>"))


def _conditions(low: Column) -> Column:
    kind = "struct<operator:string,attribute:string,value:string,reference:string>"

    def one(op: str, attribute: Column, value: Column | None = None, reference: Column | None = None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(F.lit(op).alias("operator"), attribute.alias("attribute"), (null if value is None else value).alias("value"), (null if reference is None else reference).alias("reference")).cast(kind)

    filtering = F.array_contains("_modifiers", "filter")
    own = F.coalesce("_attribute", F.lit("unknown"))
    helper = F.get("_helper", F.lit(0))
    sun = F.lit("distance_from_sun")
    rows = [
        F.when(filtering & low.rlike(r"\b(?:fewer|less)\b.*\bthan\b"), one("<", own)).when(filtering & low.rlike(r"\b(?:more|greater)\b.*\bthan\b"), one(">", own)),
        F.when(filtering & helper.isNotNull() & low.rlike(r"\bfarther\b.*\bthan\b"), one(">", sun, reference=helper)).when(filtering & helper.isNotNull() & low.rlike(r"\bcloser\b.*\bthan\b"), one("<", sun, reference=helper)),
    ]
    for pattern, value in ((r"\bterrestrial\b", "terrestrial"), (r"\bgas\s+giant\b", "gas giant"), (r"\bice\s+giant\b", "ice giant")):
        rows.append(F.when(low.rlike(pattern), one("==", F.lit("planet_type"), F.lit(value))))
    for pattern, value in ((r"\bin\s+the\s+kuiper\s+belt\b", "Kuiper Belt"), (r"\bin\s+the\s+asteroid\s+belt\b", "Asteroid Belt")):
        rows.append(F.when(low.rlike(pattern), one("==", F.lit("location"), F.lit(value))))
    rows.append(F.when(low.rlike(r"\bbeyond\s+earth\b"), one(">", sun, reference=F.lit("Earth"))))
    return F.array_compact(F.array(*rows))
