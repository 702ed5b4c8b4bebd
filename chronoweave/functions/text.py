"""Text normalising, tokens, query terms, URLs and tags as Column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Word lists and patterns that decide results.
STOPWORDS = "a an and are as by did does first for from had has have how in is it its of on or the than to was were what which who with yet".split()
EXPANSIONS = {
    "beyond": ["beyond", "farther", "outer", "orbit beyond"],
    "confirmed": ["confirmed", "officially recognized", "known"],
    "discovered": ["discovered", "discovery", "found", "first observed"],
    "dwarf": ["dwarf", "dwarf planet", "minor planet"],
    "fewer": ["fewer", "less", "moon", "moons", "satellite", "satellites"],
    "jupiter": ["jupiter", "jovian"],
    "kuiper": ["kuiper", "kuiper belt", "trans-neptunian", "beyond neptune"],
    "located": ["located", "location", "region", "belt"],
    "mars": ["mars"],
    "mass": ["mass", "massive", "heavier", "lighter"],
    "moon": ["moon", "moons", "satellite", "satellites"],
    "moons": ["moon", "moons", "satellite", "satellites"],
    "orbit": ["orbit", "orbital", "distance", "semi-major axis"],
    "orbits": ["orbit", "orbital", "distance", "semi-major axis"],
    "planet": ["planet", "planets"],
    "planets": ["planet", "planets"],
    "saturn": ["saturn", "saturnian"],
}
QUERY_PREDICATES = {
    "moon_count": r"\b(?:moon|moons|satellite|satellites|fewer\s+moons|more\s+moons)\b",
    "distance_from_sun": r"\b(?:orbit|orbits|beyond|farther|closer|distance|from the sun)\b",
    "classification": r"\b(?:dwarf planet|classified|classification|recognized as)\b",
    "location": r"\b(?:located|location|kuiper belt|asteroid belt|found in)\b",
    "discovered_on": r"\b(?:discovered|discovery|found|first observed|first)\b",
    "mass": r"\b(?:mass|massive|heavier|lighter)\b",
}
CHUNK_ENTITIES = (
    "Mercury", "Venus", "Earth", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune", "Pluto", "Ceres", "Eris", "Makemake", "Haumea", "Gonggong",
    "Quaoar", "Sedna", "Orcus", "Kuiper Belt", "Asteroid Belt", "Solar System", "Clyde Tombaugh",
)
PREDICATE_HINTS = {
    "classification": r"\b(?:dwarf planet|planet|classified|classification|recognized)\b",
    "location": r"\b(?:kuiper belt|asteroid belt|trans-neptunian|beyond neptune|located|region)\b",
    "discovered_on": r"\b(?:discovered|discovery|found|first observed|year)\b",
    "discovered_by": r"\b(?:discovered by|discoverer|found by|clyde tombaugh)\b",
    "moon_count": r"\b(?:moon|moons|satellite|satellites)\b",
    "mass": r"\b(?:mass|massive|heavier|lighter)\b",
    "distance_from_sun": r"\b(?:distance from the sun|farther from the sun|semi-major axis|orbit)\b",
}
SPACE = " \t\n\x0b\x0c\r"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """Line ends as LF, one space for blanks, none around line ends, at most one empty line."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), " *\n *", "\n")
    return F.btrim(F.regexp_replace(t, "\n{3,}", "\n\n"), F.lit(SPACE))


def query_terms(text: Column, stopwords: Sequence[str] = STOPWORDS, expansions: Mapping[str, Sequence[str]] = EXPANSIONS) -> Column:
    """Tokens that are no stopwords, each followed by its expansions, each term once."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    more = F.create_map(*[x for k, v in expansions.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    own = F.filter(tokens(text), lambda t: ~F.array_contains(stop, t))
    return F.array_distinct(F.flatten(F.transform(own, lambda t: F.concat(F.array(t), F.coalesce(F.element_at(more, t), F.array().cast("array<string>"))))))


def tags(text: Column, rules: Mapping[str, str]) -> Column:
    """Names of the rules whose pattern stands in the lower-cased text, in their order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in rules.items()]))


def query_predicates(text: Column) -> Column:
    return tags(text, QUERY_PREDICATES)


def entity_tags(text: Column, names: Sequence[str] = CHUNK_ENTITIES) -> Column:
    return tags(text, {n: rf"\b{n.lower()}\b" for n in names})


def predicate_hints(text: Column, rules: Mapping[str, str] = PREDICATE_HINTS) -> Column:
    return tags(text, rules)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def trust(url: Column, official: Sequence[str] = ("nasa.gov",), reference: Sequence[str] = ("wikipedia.org", "britannica.com")) -> Column:
    h = host(url)
    hit = lambda names: F.greatest(*[h.contains(n) for n in names], F.lit(False)) if names else F.lit(False)
    return F.when(hit(official), "official").when(hit(reference), "reference").otherwise("article")


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves + alone."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def slug(url: Column) -> Column:
    return unquote(F.translate(path(url), "/_", "  "))


def safe_id(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("_")), "[^A-Za-z0-9_.-]+", "_"), "_+", "_")
    t = F.lower(F.btrim(t, F.lit("._-")))
    return F.when(t == "", "wikipedia_page").otherwise(t)


def page_id(url: Column) -> Column:
    return safe_id(unquote(F.substring_index(F.rtrim(path(url), F.lit("/")), "/", -1)))


def one_line(text: Column, width: int) -> Column:
    flat = F.array_join(words(text), " ")
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, width - 3)), F.lit("...")))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")
