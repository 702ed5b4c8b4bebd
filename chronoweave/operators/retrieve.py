"""Two-stage lexical retrieval: sources by their profiles, then chunks, capped per source and packed into a context."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.functions import text as T
from chronoweave.operators.asof import computed_once
from chronoweave.sources.work import written

MONTHS = "january february march april may june july august september october november december".split()
NAMES = ("mercury", "venus", "earth", "mars", "jupiter", "saturn", "uranus", "neptune")
TRUST = {"official": 3.0, "reference": 2.0, "article": 1.0}
COUNT_WORD = r"(?:\d+|one|two|three|four|five|sixteen|twenty[- ]?nine|hundred)"
MOON_WORD = r"(?:moon|moons|satellite|satellites)"
MOON_CLAIMS = (
    rf"\b(?:has|have|had|includes?|possesses?)\s+(?:at\s+least\s+)?{COUNT_WORD}\s+(?:known\s+|confirmed\s+|natural\s+)?{MOON_WORD}\b",
    rf"\b{COUNT_WORD}\s+(?:\w+\s+){{0,4}}{MOON_WORD}\b",
    rf"\b(?:mercury|venus|earth|mars|jupiter|saturn|uranus|neptune)'?s\s+{COUNT_WORD}\s+(?:\w+\s+){{0,4}}{MOON_WORD}\b",
    rf"\b(?:mercury|venus|earth|mars|jupiter|saturn|uranus|neptune)\s+has\s+{COUNT_WORD}.{{0,90}}?\b{MOON_WORD}\b",
)


# The points that a hit gives, by the name of its reason.
POINTS = {
    "title_url_phrase": 6.0, "title_url_token": 2.5, "title_url_entity": 8.0, "source_entity": 6.0, "text_entity": 3.0, "source_predicate": 5.0,
    "short_source_penalty": -3.0, "substantial_source": 1.0, "phrase": 3.0, "entity": 5.0, "predicate": 3.0, "exact_time": 14.0,
    "exact_time_without_entity": 3.0, "year": 4.0, "month": 2.0, "as_of_time_context": 3.0, "moon_count_claim": 8.0, "planet_order_section": 5.0,
}
DENSITY = {"phrase_most": 8.0, "phrase_base": 2.0, "phrase_log": 2.0, "token_most": 6.0, "token_weight": 0.8, "token_named": 1.0}
SHORT_SOURCE, LONG_SOURCE, OTHER_TRUST = 1000, 5000, 0.5
#: (modifier, points, reason, words of which a source's text has one, or a pattern).
SUPPORT = (
    ("filter", 3.0, "filter_support", ("fewer than", "less than", "beyond", "located", "kuiper belt")),
    ("ordering", 3.0, "ordering_support", ("discovered", "discovery", "in order", "first")),
    ("comparison", 3.0, "comparison_support", ("greater", "less", "more", "fewer", "mass", "distance")),
    ("time_lookup", 3.0, "time_support", r"\b(?:as of|by|before|after|in)\s+(?:[a-z]+\s+)?\d{4}\b"),
)
#: (modifier or predicate asked for, or none, points, reason, part of the chunk, words of which that has one, only for planets' own pages).
CONTEXTS = (
    ("filter", 2.5, "filter_context", "text", ("kuiper belt", "trans-neptunian", "located"), False),
    ("filter", 2.5, "comparative_filter_context", "text", ("fewer", "less than", "beyond earth", "orbit beyond", "moons"), False),
    ("moon_count", 5.0, "moon_section", "section", ("moon", "satellite"), False),
    ("moon_count", 5.0, "moon_count_terms", "text", ("known moons", "confirmed moons", "natural satellites", "confirmed satellites"), False),
    ("moon_count", 4.0, "planet_moon_context", "text", ("moon", "satellite"), True),
    ("distance_from_sun", 3.0, "planet_orbit_context", "text", ("from the sun", "au", "orbit", "fifth planet", "seventh planet", "eighth planet", "fourth planet"), True),
    ("ordering", 2.5, "ordering_context", "text", ("discovered", "discovery", "first observed"), False),
    ("ordering", 5.0, "ordered_discovery_section", "text", ("in order of discovery",), False),
    (None, 2.0, "dwarf_planet_context", "text", ("dwarf planet",), False),
)
ORDER_SECTIONS, SYSTEM_TITLE, SYSTEM_POINTS, SYSTEM_WORDS = ("inner planets", "outer planets", "orbits"), "solar system", 4.0, ("inner planets", "outer planets", "au)", "from the sun")
MENTIONS = {"word": "discovered", "least": 2, "base": 2.0, "reason": "multiple_discovery_mentions"}
WEAK_CHUNKS, WEAK_SCORE = 3, 8.0


class Sheet:
    """Points and reasons of a score: each entry counts where its condition holds."""

    def __init__(self) -> None:
        self.points: list[Column] = [F.lit(0.0)]
        self.reasons: list[Column] = []

    def add(self, hit: Column, points: Column | float, reason: Column | str | None, named: Column | None = None) -> None:
        """named: where the reason is told, if not wherever the points count."""
        points = points if isinstance(points, Column) else F.lit(points)
        hit = F.coalesce(hit, F.lit(False))
        self.points.append(F.when(hit, points).otherwise(0.0))
        if reason is not None:
            self.reasons.append(F.when(hit if named is None else hit & named, reason if isinstance(reason, Column) else F.lit(reason)))

    def score(self) -> Column:
        return reduce(lambda a, b: a + b, self.points)

    def told(self) -> Column:
        return F.array_compact(F.array(*self.reasons)) if self.reasons else F.array().cast("array<string>")


def _any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _is(term: str):
    return lambda t: t == F.lit(term)


def is_planet_title(title: Column) -> Column:
    return F.trim(F.replace(F.lower(title), F.lit(" (planet)"), F.lit(""))).isin(*NAMES)


def profiles(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row a source: token counts, entities, predicates, title, url, trust_level, char_count, chunk_count.

    chunks(source_id, nth, text, entities, predicate_hints, title, url); a
    document's title, url, trust_level and char_count go before the first chunk's.
    Texts stay with their chunks: score_sources reads them there.
    """
    own = chunks.groupBy("source_id").agg(
        F.array_distinct(F.flatten(F.collect_set("entities"))).alias("entities"),
        F.array_distinct(F.flatten(F.collect_set("predicate_hints"))).alias("predicates"),
        F.min_by("title", "nth").alias("_title"),
        F.min_by("url", "nth").alias("_url"),
        F.sum(F.length("text")).alias("_chars"),
        F.count("*").alias("chunk_count"),
        F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.size(T.tokens(F.col("text"))))), F.lit(0)).cast("int").alias("token_total"),
    )
    docs = documents.select("source_id", "title", "url", "trust_level", "char_count") if documents is not None else own.select("source_id", *[F.lit(None).cast(t).alias(n) for n, t in (("title", "string"), ("url", "string"), ("trust_level", "string"), ("char_count", "long"))]).where("false")
    url = F.coalesce(F.nullif("url", F.lit("")), "_url", F.lit(""))
    out = own.join(docs, "source_id", "left")
    return out.select(
        "source_id", "entities", "predicates", "chunk_count",
        F.coalesce(F.nullif("title", F.lit("")), "_title", "source_id").alias("title"),
        url.alias("url"),
        F.coalesce("trust_level", T.trust(url)).alias("trust_level"),
        F.coalesce(F.nullif("char_count", F.lit(0)), "_chars").alias("char_count"),
        "token_total",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """md5 of each source's texts, joined by spaces, from rows in the order of sources and places; only the running hash is kept."""
    source, running = None, None
    out = lambda: pa.RecordBatch.from_pydict({"source_id": pa.array([source], pa.string()), "text_md5": pa.array([running.hexdigest()], pa.string())})
    for batch in batches:
        for own, text in zip(batch.column("source_id").to_pylist(), batch.column("text"), strict=True):
            if running is None or own != source:
                if running is not None:
                    yield out()
                source, running = own, hashlib.md5()
            elif text.is_valid:
                running.update(b" ")
            running.update((text.as_py() or "").encode())
    if running is not None:
        yield out()


def text_digests(chunks: DataFrame) -> DataFrame:
    """(source_id, text_md5) of a source's whole lower-case text, its chunks joined by spaces in the order of nth. A hash runs
    through a source in order, so each source is one task's; that holds one batch of chunks at a time."""
    df = chunks.where("text IS NOT NULL").select(F.col("source_id").cast("string").alias("source_id"), "nth", F.lower("text").alias("text"))
    df = df.repartition("source_id").sortWithinPartitions("source_id", "nth", "text").select("source_id", "text")
    return df.mapInArrow(_digests, "source_id string, text_md5 string")


def token_counts(df: DataFrame, key: str, terms: Column | None = None) -> DataFrame:
    """(key, token, tf) of df(key, text)."""
    return df.select(key, F.explode(T.tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


class _Whole:
    """What stands in a source's text, from a row with its text and _tokens."""

    def words(self, term: str) -> Column:
        return F.size(F.filter("_tokens", _is(term)))

    def phrases(self, term: str) -> Column:
        return T.occurrences(F.col("text"), F.lit(term))

    def any(self, parts: str | Sequence[str]) -> Column:
        return F.col("text").rlike(parts) if isinstance(parts, str) else _any(F.col("text"), parts)


class _Counted:
    """What stands in a source's text, from a row with the counts of source_counts."""

    def __init__(self, query: dict) -> None:
        self.word, self.part, self.pattern = _asked_parts(query)

    def words(self, term: str) -> Column:
        return F.col(f"_word{self.word.index(term)}")

    def phrases(self, term: str) -> Column:
        return F.col(f"_part{self.part.index(term)}")

    def any(self, parts: str | Sequence[str]) -> Column:
        if isinstance(parts, str):
            return F.col(f"_pattern{self.pattern.index(parts)}") > 0
        return reduce(lambda a, b: a | b, [self.phrases(p) > 0 for p in parts])


def _asked_parts(query: dict) -> tuple[list[str], list[str], list[str]]:
    """Words, strings and patterns that a question looks for in a source's text."""
    asked = [what for modifier, _, _, what in SUPPORT if modifier in query["modifiers"]]
    words = [t for t in query["terms"] if " " not in t]
    parts = [t for t in query["terms"] if " " in t] + [e for e in query["entities"] if e] + [w for what in asked if not isinstance(what, str) for w in what]
    return list(dict.fromkeys(words)), list(dict.fromkeys(parts)), [what for what in asked if isinstance(what, str)]


#: A match of SUPPORT's patterns has so many words at most.
PATTERN_WORDS = 4


def source_counts(chunks: DataFrame, query: dict) -> DataFrame:
    """(source_id, _word<i>, _part<i>, _pattern<i>): how often a source's text, its chunks joined by spaces in the order of nth,
    has what a question looks for.

    Counted in each chunk; what may run on from one chunk into the next is
    counted in the seams. A string has none but its own characters: so it can
    cross an end of a chunk only in the run of such characters there, and the
    runs of following chunks, whole chunks of such characters between them,
    make a seam. So no more of a source's text comes together than a seam.
    """
    words, parts, patterns = _asked_parts(query)
    df = chunks.where("text IS NOT NULL").select("source_id", "nth", F.lower("text").alias("_t"))
    df = df.withColumns({"_k": T.tokens(F.col("_t")), "_n": F.length("_t")})
    counts = {f"_word{i}": F.size(F.filter("_k", _is(w))).cast("long") for i, w in enumerate(words)}
    sets = [F.lit("".join(sorted(set(p)))) for p in parts]
    df = df.withColumns({f"_l{i}": F.col("_n") - F.length(F.ltrim(F.col("_t"), own)) for i, own in enumerate(sets)} | {f"_r{i}": F.length(F.rtrim(F.col("_t"), own)) for i, own in enumerate(sets)})
    df = df.withColumns({f"_h{i}": F.substring(F.col("_t"), F.lit(1), F.col(f"_l{i}")) for i in range(len(parts))} | {f"_e{i}": F.substring(F.col("_t"), F.col(f"_r{i}") + 1, F.col("_n")) for i in range(len(parts))})
    ends = []
    for i, p in enumerate(parts):
        whole, n = F.col(f"_l{i}") == F.col("_n"), lambda x, p=p: T.occurrences(F.col(x), F.lit(p)).cast("long")
        counts[f"_part{i}"] = F.when(whole, 0).otherwise(n("_t") - n(f"_h{i}") - n(f"_e{i}"))
        ends.append(F.struct(F.lit(f"_part{i}").alias("what"), whole.alias("whole"), F.col(f"_h{i}").alias("head"), F.col(f"_e{i}").alias("tail")))
    if patterns:
        df = df.withColumn("_w", T.words(F.col("_t")))
    for i, p in enumerate(patterns):
        w, most = F.col("_w"), PATTERN_WORDS
        counts[f"_pattern{i}"] = F.col("_t").rlike(p).cast("long")
        few = F.size(w) <= most
        edge = lambda x: F.array_join(x, " ")
        ends.append(F.struct(F.lit(f"_pattern{i}").alias("what"), few.alias("whole"), edge(F.slice(w, 1, most)).alias("head"), edge(F.when(few, w).otherwise(F.slice(w, -most, most))).alias("tail")))
    names = list(counts)
    inside = df.select("source_id", *[c.alias(n) for n, c in counts.items()]).groupBy("source_id").agg(*[F.sum(n).alias(n) for n in names])
    if ends:
        at = df.select("source_id", "nth", F.inline(F.array(*ends)))
        seam = F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(Window.partitionBy("source_id", "what").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
        piece = lambda k, side, text: F.struct(k.alias("seam"), F.lit(side).alias("side"), text.alias("piece"))
        pieces = F.when(F.col("whole"), F.array(piece(F.col("k"), 1, F.col("head")))).otherwise(F.array(piece(F.col("k") - 1, 0, F.col("head")), piece(F.col("k"), 1, F.col("tail"))))
        at = at.withColumn("k", seam).select("source_id", "what", "nth", F.inline(pieces))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "side", "piece"))), lambda x: x["piece"]), " ")
        seams = at.groupBy("source_id", "what", "seam").agg(joined.alias("_t"))
        found = {f"_part{i}": T.occurrences(F.col("_t"), F.lit(p)).cast("long") for i, p in enumerate(parts)} | {f"_pattern{i}": F.col("_t").rlike(p).cast("long") for i, p in enumerate(patterns)}
        more = seams.select("source_id", *[F.when(F.col("what") == n, found[n]).otherwise(0).alias(n) if n in found else F.lit(0).cast("long").alias(n) for n in names])
        inside = inside.unionByName(more.groupBy("source_id").agg(*[F.sum(n).alias(n) for n in names])).groupBy("source_id").agg(*[F.sum(n).alias(n) for n in names])
    return inside


def source_sheet(query: dict, found: _Whole | _Counted) -> Sheet:
    """What counts for a profile row for one question.

    query: terms, entities (lower case), predicates and modifiers. Phrases and
    words count in title, url and slug, then by their density in the text, both
    capped; entities and predicates by where they are known; support words by
    the question's modifiers; trust and size of the source.
    """
    where = F.lower(F.concat_ws(" ", "title", "url", T.slug(F.col("url"))))
    total = F.greatest(F.lit(1.0), F.col("token_total") / 1000.0)
    sheet = Sheet()
    for term in query["terms"]:
        if " " in term:
            n = found.phrases(term)
            sheet.add(where.contains(term), POINTS["title_url_phrase"], f"title_url_phrase:{term}")
            sheet.add(n > 0, F.least(F.lit(DENSITY["phrase_most"]), DENSITY["phrase_base"] + F.log(n + F.lit(1.0)) * DENSITY["phrase_log"]), F.concat(F.lit(f"density_phrase:{term}:"), n.cast("string")))
        else:
            density = found.words(term) / total
            points = F.least(F.lit(DENSITY["token_most"]), density * DENSITY["token_weight"])
            sheet.add(where.contains(term), POINTS["title_url_token"], f"title_url_token:{term}")
            sheet.add(density > 0, points, F.concat(F.lit(f"density_token:{term}:"), F.format_string("%.2f", density)), points >= DENSITY["token_named"])
    known = F.transform("entities", lambda e: F.lower(e))
    for e in [e for e in dict.fromkeys(query["entities"]) if e]:
        titled, listed = where.contains(e), F.array_contains(known, e)
        sheet.add(titled, POINTS["title_url_entity"], f"title_url_entity:{e}")
        sheet.add(~titled & listed, POINTS["source_entity"], f"entity:{e}")
        sheet.add(~titled & ~listed & found.any([e]), POINTS["text_entity"], f"text_entity:{e}")
    for p in query["predicates"]:
        sheet.add(F.array_contains("predicates", p), POINTS["source_predicate"], f"predicate:{p}")
    for modifier, points, reason, words in SUPPORT:
        if modifier in query["modifiers"]:
            sheet.add(found.any(words), points, reason)
    level = F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])
    sheet.add(F.lit(True), F.coalesce(F.element_at(level, F.col("trust_level")), F.lit(OTHER_TRUST)), F.concat(F.lit("trust:"), F.coalesce("trust_level", F.lit(""))))
    sheet.add(F.col("char_count") < SHORT_SOURCE, POINTS["short_source_penalty"], "short_source_penalty")
    sheet.add(F.col("char_count") > LONG_SOURCE, POINTS["substantial_source"], "substantial_source")
    return sheet


def score_sources(profile: DataFrame, query: dict, chunks: DataFrame | None = None) -> DataFrame:
    """profile rows with score, 0 at least, and reasons; those without a score go. Texts are read from chunks(source_id, nth,
    text), without gathering a source's, or where none are given from the profile's text."""
    if chunks is None:
        df, sheet = profile.withColumn("_tokens", T.tokens(F.col("text"))), source_sheet(query, _Whole())
        extra = ["_tokens"]
    else:
        counts = source_counts(chunks, query).withColumnRenamed("source_id", "_source")
        extra = counts.columns
        df = computed_once(profile).join(computed_once(counts), F.col("source_id").eqNullSafe(F.col("_source")), "left").fillna(0, [c for c in extra if c != "_source"])
        sheet = source_sheet(query, _Counted(query))
    scored = df.withColumns({"score": F.greatest(sheet.score(), F.lit(0.0)), "reasons": sheet.told()}).drop(*extra)
    return computed_once(scored).where("score > 0")


def select_sources(scored: DataFrame, profile: DataFrame, top: int = 5, least: float = 8.0, planet_list: bool = False) -> DataFrame:
    """(source_id, rank, fallback): the best sources with score least or more; all planets' own for a list of planets; the best whatever their score if these are under two."""
    top = max(top, 12) if planet_list else top
    better = Window.orderBy(F.desc("score"), "source_id")
    ranked = scored.orderBy(F.desc("score"), "source_id").limit(top).withColumn("rank", F.row_number().over(better)).withColumn("_strong", F.col("score") >= least)
    if not planet_list:
        ranked = ranked.withColumn("fallback", F.sum(F.col("_strong").cast("int")).over(Window.partitionBy()) < 2)
        return ranked.where("_strong OR fallback").select("source_id", "rank", "fallback")
    strong = ranked.where("_strong").select("source_id", "rank")
    more = profile.where(is_planet_title(F.col("title"))).select("source_id").join(strong, "source_id", "left_anti").withColumn("rank", F.lit(top) + F.row_number().over(Window.orderBy("source_id")))
    strong = strong.unionByName(more)
    n = strong.agg(F.count("*").alias("n"))
    some = strong.crossJoin(F.broadcast(n)).where("n >= 2").select("source_id", "rank", F.lit(False).alias("fallback"))
    weak = ranked.crossJoin(F.broadcast(n)).where("n < 2").select("source_id", "rank", F.lit(True).alias("fallback"))
    return some.unionByName(weak)


def time_terms(question: Column) -> Column:
    """struct(years, months, phrases) that a question names: years from 1800 to 2099, months, and months with a year that stand together."""
    low = F.lower(question)
    years = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b((?:18|19|20)\d{2})\b"), F.lit(1)))
    months = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{m}\b"), F.lit(m)) for m in MONTHS]))
    both = F.flatten(F.transform(months, lambda m: F.transform(years, lambda y: F.concat(m, F.lit(" "), y))))
    return F.struct(years.alias("years"), months.alias("months"), F.filter(both, lambda x: low.contains(x)).alias("phrases"))


def chunk_sheet(query: dict) -> Sheet:
    """What counts for a chunk row (with _all, its lower-case title, section and text, and _tokens) for one question: words by
    1 + ln tf, phrases, entities, hints, and the contexts of filters, counts, times, orbits and order."""
    text, sheet = F.col("_all"), Sheet()
    tf = lambda term: F.size(F.filter("_tokens", _is(term)))
    for term in query["terms"]:
        if " " in term:
            sheet.add(text.contains(term), POINTS["phrase"], f"phrase:{term}")
        else:
            sheet.add(tf(term) > 0, 1.0 + F.log(tf(term)), None)
    entities = [e for e in dict.fromkeys(query["entities"]) if e]
    for e in entities:
        sheet.add(text.contains(e), POINTS["entity"], f"entity:{e}")
    for p in query["predicates"]:
        sheet.add(F.array_contains("predicate_hints", p), POINTS["predicate"], f"predicate:{p}")
    section, title = F.lower(F.coalesce("section", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    planet = F.replace(title, F.lit(" (planet)"), F.lit("")).isin(*NAMES)
    wanted = {None, *query["modifiers"], *query["predicates"]}
    for what, points, reason, part, words, own_page in CONTEXTS:
        if what in wanted:
            hit = _any(section if part == "section" else text, words)
            sheet.add(planet & hit if own_page else hit, points, reason)
    if "moon_count" in wanted:
        sheet.add(reduce(lambda a, b: a | b, [text.rlike(c) for c in MOON_CLAIMS]), POINTS["moon_count_claim"], "moon_count_claim")
    if "distance_from_sun" in wanted:
        sheet.add(section.isin(*ORDER_SECTIONS), POINTS["planet_order_section"], "planet_order_section")
        sheet.add((title == SYSTEM_TITLE) & _any(text, SYSTEM_WORDS), SYSTEM_POINTS, "solar_system_order_context")
    if "ordering" in wanted:
        n = tf(MENTIONS["word"])
        sheet.add(n >= MENTIONS["least"], MENTIONS["base"] + F.log(n), MENTIONS["reason"])
    times = query.get("times") or {"years": [], "months": [], "phrases": []}
    named = _any(text, entities) if entities else F.lit(False)
    for x in times["phrases"]:
        sheet.add(named & text.contains(x), POINTS["exact_time"], f"exact_time:{x}")
        sheet.add(~named & text.contains(x), POINTS["exact_time_without_entity"], f"exact_time_without_entity:{x}")
    for unit in ("year", "month"):
        for x in times[f"{unit}s"]:
            sheet.add(named & text.rlike(rf"\b{x}\b"), POINTS[unit], f"{unit}:{x}")
    if times["phrases"]:
        sheet.add(named & text.contains("as of") & _any(text, times["phrases"]), POINTS["as_of_time_context"], "as_of_time_context")
    return sheet


def score_chunks(chunks: DataFrame, query: dict) -> DataFrame:
    """chunks with score and reasons; those without a score go. A chunk's words are taken once, whatever the question's terms."""
    sheet = chunk_sheet(query)
    df = chunks.withColumn("_all", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("section", F.lit("")), "text")))
    df = df.withColumn("_tokens", T.tokens(F.col("_all")))
    # scored once: a condition on the score would repeat it, words and all, in the filter
    return computed_once(df.withColumns({"score": sheet.score(), "reasons": sheet.told()}).drop("_all", "_tokens")).where("score > 0")


def term_scores(queries: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(qid, key, score) of the word part of the score for many questions at once: terms meet token counts in one equi-join, not questions times chunks.

    Texts are dealt out by key once; counting, meeting and adding up then stay
    where a key's text is, so that only texts are shuffled.
    """
    tf = token_counts(chunks.select(key, "text").repartition(key), key)
    asked = queries.select("qid", F.explode("terms").alias("token")).distinct()
    return tf.join(asked, "token").groupBy("qid", key).agg(F.sum(1.0 + F.log("tf")).alias("score"))


def cap_top(scored: DataFrame, top: int = 12, per_source: int = 4, order: str = "chunk_id", by: Sequence[str] = ()) -> DataFrame:
    """The best top chunks, of each source per_source at most, with their rank; of each by-group if one is given. A top of 0 gives one."""
    better = [F.desc("score"), F.col(order)]
    df = scored.withColumn("_s", F.row_number().over(Window.partitionBy(*by, "source_id").orderBy(*better))).where(F.col("_s") <= per_source)
    if by:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*better))).where(F.col("rank") <= max(top, 1)).drop("_s")
    return df.orderBy(*better).limit(max(top, 1)).withColumn("rank", F.row_number().over(Window.orderBy(*better))).drop("_s")


def is_weak(ranked: DataFrame) -> DataFrame:
    """(weak): under three chunks, or a best score under 8."""
    return ranked.agg(((F.count("*") < WEAK_CHUNKS) | (F.coalesce(F.max("score"), F.lit(0.0)) < WEAK_SCORE)).alias("weak"))


def with_fallback(selected: DataFrame, everywhere: DataFrame) -> DataFrame:
    """selected, or everywhere if selected is weak, with fallback. selected is some rows, which are found once."""
    selected = written(selected, "selected")
    weak = F.broadcast(is_weak(selected))
    own = selected.crossJoin(weak).where("NOT weak")
    other = everywhere.crossJoin(weak).where("weak")
    return own.unionByName(other).withColumnRenamed("weak", "fallback")


def fallback_reason(weak: Column, selected: Column, source_reason: Column) -> Column:
    """Why chunks of all sources were taken or sources chosen anyway: weak chunks first, then no sources, then the selection's own reason."""
    return F.when(weak, "weak_auto_source_chunks").when(selected == 0, "no_sources_selected").otherwise(F.coalesce(source_reason, F.lit("")))


def retrieve(chunks: DataFrame, query: dict, sources: DataFrame | None = None, mode: str = "global", top: int = 12, per_source: int = 4, is_list: bool = False) -> DataFrame:
    """The best chunks for a question, of all sources or (auto-source) of the selected ones unless these give a weak result."""
    if mode not in ("global", "auto-source"):
        raise ValueError(f"unknown retrieval mode: {mode}")
    per_source = min(per_source, 2) if is_list else per_source
    if mode == "global":
        return cap_top(score_chunks(chunks, query), top, per_source).withColumn("fallback", F.lit(False))
    inside = written(cap_top(score_chunks(chunks.join(sources.select("source_id"), "source_id", "left_semi"), query), top, per_source), "selected")
    # all chunks are scored only where the selected ones are weak: else the other side of this join is empty
    needed = chunks.crossJoin(F.broadcast(is_weak(inside).where("weak").select()))
    return with_fallback(inside, cap_top(score_chunks(needed, query), top, per_source))


def pack(ranked: DataFrame, max_chars: int = 12_000, by: Sequence[str] = ()) -> DataFrame:
    """(by, context, n): the blocks of the best chunks in rank order, up to the first that would pass max_chars."""
    block = F.concat(F.lit("[R"), F.col("rank").cast("string"), F.lit(" | source_id="), "source_id", F.lit(" | section="), F.coalesce("section", F.lit("")), F.lit(" | score="), F.format_string("%.2f", "score"), F.lit("]\nURL: "), F.coalesce("url", F.lit("")), F.lit("\n"), "text", F.lit("\n"))
    run = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = ranked.withColumn("block", block).withColumn("_c", F.sum(F.length("block")).over(run)).where(F.col("_c") <= max_chars)
    return kept.groupBy(*by).agg(F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n"), F.lit(T.SPACE)).alias("context"), F.count("*").alias("n"))


def sufficient(context: Column, n: Column) -> Column:
    """The context, or 'insufficient context' for no chunk or under 200 characters."""
    return F.when((n >= 1) & (F.length(context) >= 200), context).otherwise("insufficient context")
