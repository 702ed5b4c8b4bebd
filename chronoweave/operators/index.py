"""Retrieval for many questions at once over an impact-ordered inverted index of chunks.

A token's postings lie by how often a chunk has it, which is their impact, in
blocks of bounded size, so that all of a block have one impact. For each
question a threshold is found from a few probed postings; then only those
levels of impact are read without which a chunk can still pass it, and only
chunks whose upper bound passes it are scored in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.functions import text as T
from chronoweave.operators import retrieve as R
from chronoweave.sources.work import written

#: Postings in a block, about; levels of over 1 / HOT of all postings are HOT at most.
BLOCK, HOT = 128, 1 << 16
#: Postings probed for a question's threshold: so many for each chunk that is asked for, or this share of all of its words.
PROBE, SHARE = 20, 1 / 64
#: Of the chunks probed, those with the most points so far are scored in full: so many for each that is asked for. Their number does not
#: grow with the chunks, but what passes the threshold does.
TRIED = 32
#: So many questions at most are sent to all tasks.
FEW_QUESTIONS = 2000
#: Scores are sums of fractions; a bound may fall short of one by that much.
SLACK = 1e-6
#: Hints and contexts are indexed beside words, under names that no word has.
PREDICATE, CONTEXT = "predicate:", "context:"
NUMBER = "chunk_no"
QUESTION = "terms array<string>, entities array<string>, predicates array<string>, modifiers array<string>, times struct<years:array<string>,months:array<string>,phrases:array<string>>"


@dataclass
class Index:
    """chunks: with chunk_no (a number for its name), tfs (token of title, section and text to count) and hits (reasons that hold
    whatever the question's words). postings: (token, tf, block, chunks by their numbers), of words and of hints and hits. levels: (token, tf, n). most: the
    largest tf."""

    chunks: DataFrame
    postings: DataFrame
    levels: DataFrame
    most: int


def impact(tf: Column) -> Column:
    return 1.0 + F.log(tf)


def _low() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("section", F.lit("")), F.coalesce("text", F.lit(""))))


def _context_hits() -> list[tuple[str | None, float, str, Column]]:
    """(modifier or predicate asked for, points, reason, hit) that hold whatever the question's words."""
    low, section, title = F.col("low"), F.lower(F.coalesce("section", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    planet = F.replace(title, F.lit(" (planet)"), F.lit("")).isin(*R.NAMES)
    out = []
    for what, points, reason, part, words, own_page in R.CONTEXTS:
        hit = R._any(section if part == "section" else low, words)
        out.append((what, points, reason, planet & hit if own_page else hit))
    claims = low.rlike(R.MOON_CLAIMS[0])
    for c in R.MOON_CLAIMS[1:]:
        claims = claims | low.rlike(c)
    out.append(("moon_count", R.POINTS["moon_count_claim"], "moon_count_claim", claims))
    out.append(("distance_from_sun", R.POINTS["planet_order_section"], "planet_order_section", section.isin(*R.ORDER_SECTIONS)))
    out.append(("distance_from_sun", R.SYSTEM_POINTS, "solar_system_order_context", (title == R.SYSTEM_TITLE) & R._any(low, R.SYSTEM_WORDS)))
    return out


def build_index(chunks: DataFrame) -> Index:
    """The index of chunks (chunk_id, source_id, title, section, text, predicate_hints, further columns), written once.

    A chunk's counts come from its own row; levels of many postings are cut
    into blocks by the chunk's hash, the hottest by a broadcast of their sizes,
    which are HOT at most, the others by a join, so that no key gathers more
    than a block. Postings hold chunks' numbers, which are given as chunks are
    written, in place of their names. Null texts count as empty.
    """
    df = chunks.withColumn(NUMBER, F.monotonically_increasing_id()).withColumn("low", _low()).withColumn("tokens", F.array_sort(T.tokens(F.col("low"))))
    new = lambda i: (i == 0) | (F.get(F.col("tokens"), i) != F.get(F.col("tokens"), i - 1))
    df = df.withColumn("starts", F.when(F.size("tokens") > 0, F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), new)).otherwise(F.array().cast("array<int>")))
    count = lambda i, k: F.coalesce(F.get(F.col("starts"), k + 1), F.size("tokens")) - i
    tfs = F.map_from_arrays(F.transform("starts", lambda i: F.get(F.col("tokens"), i)), F.transform("starts", count))
    hits = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(reason)) for _, _, reason, hit in _context_hits()]))
    df = written(df.withColumn("tfs", tfs).withColumn("hits", hits).drop("low", "tokens", "starts"), "indexed")
    marks = lambda c, kind: F.transform(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), lambda x: F.struct(F.concat(F.lit(kind), x).alias("key"), F.lit(1).alias("value")))
    rows = df.select(NUMBER, F.inline(F.concat(F.map_entries("tfs"), marks(F.col("predicate_hints"), PREDICATE), marks(F.col("hits"), CONTEXT))).alias("token", "tf"))
    levels = written(rows.groupBy("token", "tf").agg(F.count("*").alias("n")), "levels")
    size = levels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("tf"), F.lit(1)).alias("most")).first()
    limit = max(BLOCK, size.n // HOT)
    hot, cold = levels.where(F.col("n") > limit), levels.where((F.col("n") <= limit) & (F.col("n") > BLOCK))
    gathered = lambda d: d.groupBy("token", "tf", "block").agg(F.collect_list(NUMBER).alias("chunks"))
    cut = lambda d: gathered(d.withColumn("block", F.pmod(F.xxhash64(NUMBER), F.ceil(F.col("n") / BLOCK)).cast("int")))
    rest = rows.join(F.broadcast(hot.select("token", "tf")), ["token", "tf"], "left_anti")
    if limit > BLOCK:
        rest = cut(rest.join(cold.unionByName(levels.where(F.col("n") <= BLOCK)), ["token", "tf"]))
    else:
        rest = gathered(rest.withColumn("block", F.lit(0)))
    # hot levels and others are gathered apart: the others lie by token and tf since their join, and are not shuffled again
    postings = cut(rows.join(F.broadcast(hot), ["token", "tf"])).unionByName(rest)
    postings = written(postings.sortWithinPartitions("token", F.desc("tf")), "postings")
    return Index(df, postings, levels, size.most)


def _asks(what: str | None) -> Column:
    if what is None:
        return F.lit(True)
    return F.array_contains("q.modifiers", what) | F.array_contains("q.predicates", what)


def _single(terms: Column) -> Column:
    return F.filter(F.array_distinct(terms), lambda t: ~t.contains(" "))


def _wanted() -> Column:
    """What the question in q looks up in the index, each once: (token, points), null points for words, whose impact depends on their count."""
    words = F.transform(_single(F.col("q.terms")), lambda t: F.struct(t.alias("token"), F.lit(None).cast("double").alias("points")))
    times = lambda x: F.size(F.filter("q.predicates", lambda y: y == x)).cast("double")
    hints = F.transform(F.array_distinct("q.predicates"), lambda x: F.struct(F.concat(F.lit(PREDICATE), x).alias("token"), (times(x) * R.POINTS["predicate"]).alias("points")))
    contexts = [F.when(_asks(what), F.struct(F.lit(CONTEXT + reason).alias("token"), F.lit(points).alias("points"))) for what, points, reason, _ in _context_hits()]
    return F.concat(words, hints, F.array_compact(F.array(*contexts)))


def _parts(index: Index) -> list[Column]:
    """What the question in q can find in a chunk that the index does not hold: parts, parts of texts with their points, and
    fixed, the most points for words said often and for a time beside its context."""
    p = R.POINTS
    worth = lambda c, points: F.transform(c, lambda x: F.struct(x.alias("part"), F.lit(points).alias("points")))
    parts = [worth(F.filter("q.terms", lambda t: t.contains(" ")), p["phrase"]), worth("q.entities", p["entity"]), worth("q.times.phrases", p["exact_time"])]
    parts += [worth("q.times.years", p["year"]), worth("q.times.months", p["month"])]
    fixed = F.when(_asks("ordering"), R.MENTIONS["base"] + F.log(F.lit(float(index.most)))).otherwise(0.0)
    fixed = fixed + F.when(F.size("q.times.phrases") > 0, p["as_of_time_context"]).otherwise(0.0)
    return [F.concat(*parts).alias("parts"), fixed.alias("fixed")]


def bonus(low: Column | None = None) -> Column:
    """The most points that a question with parts and fixed can give a chunk for what the index does not hold. With low, the chunk's
    text in lower case, only for those parts that stand in it."""
    return F.aggregate("parts", F.col("fixed"), lambda a, x: a + (x["points"] if low is None else F.when(low.contains(x["part"]), x["points"]).otherwise(0.0)))


def _each(hits: Column, reason: str) -> Column:
    return F.transform(hits, lambda x: F.concat(F.lit(f"{reason}:"), x))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """pairs of a question q and a chunk of the index, with its title, section and text in lower case (low), with score and
    reasons, as score_chunks gives them for one question."""
    p, low = R.POINTS, F.col("low")
    found = {
        "_phrases": F.filter("q.terms", lambda t: t.contains(" ") & low.contains(t)),
        "_entities": F.filter(F.array_distinct("q.entities"), lambda e: (e != "") & low.contains(e)),
        "_predicates": F.filter("q.predicates", lambda x: F.coalesce(F.array_contains("predicate_hints", x), F.lit(False))),
        "_times": F.filter("q.times.phrases", lambda x: low.contains(x)),
        "_years": F.filter("q.times.years", lambda x: F.rlike(low, F.concat(F.lit(r"\b"), x, F.lit(r"\b")))),
        "_months": F.filter("q.times.months", lambda x: F.rlike(low, F.concat(F.lit(r"\b"), x, F.lit(r"\b")))),
        "_words": F.aggregate(_single(F.col("q.terms")), F.lit(0.0), lambda a, t: a + F.coalesce(impact(F.element_at("tfs", t)), F.lit(0.0))),
        "_order": F.when(_asks("ordering"), F.element_at("tfs", F.lit(R.MENTIONS["word"]))),
    }
    pairs = pairs.withColumns(found)
    num, named = lambda c: F.size(c).cast("double"), F.size("_entities") > 0
    score = F.col("_words") + num("_phrases") * p["phrase"] + num("_entities") * p["entity"] + num("_predicates") * p["predicate"]
    reasons = [_each(F.col("_phrases"), "phrase"), _each(F.col("_entities"), "entity"), _each(F.col("_predicates"), "predicate")]

    def once(hit: Column, points: Column | float, reason: str) -> None:
        nonlocal score
        hit = F.coalesce(hit, F.lit(False))
        score = score + F.when(hit, points).otherwise(0.0)
        reasons.append(F.when(hit, F.array(F.lit(reason))).otherwise(F.array().cast("array<string>")))

    for what, points, reason, _ in _context_hits():
        once(F.array_contains("hits", reason) & _asks(what), points, reason)
    once(F.col("_order") >= R.MENTIONS["least"], R.MENTIONS["base"] + F.log("_order"), R.MENTIONS["reason"])
    score = score + num("_times") * F.when(named, p["exact_time"]).otherwise(p["exact_time_without_entity"])
    reasons.append(F.when(named, _each(F.col("_times"), "exact_time")).otherwise(_each(F.col("_times"), "exact_time_without_entity")))
    none = F.array().cast("array<string>")
    for unit in ("year", "month"):
        hits = F.when(named, F.col(f"_{unit}s")).otherwise(none)
        score = score + num(hits) * p[unit]
        reasons.append(_each(hits, unit))
    once(named & low.contains("as of") & (F.size("_times") > 0), p["as_of_time_context"], "as_of_time_context")
    return pairs.withColumns({"score": score, "reasons": F.flatten(F.array(*reasons))}).drop(*found)


@dataclass
class Search:
    """plan: (qid, token, tf, n, read), each level of each asked token and whether its postings are read after the probe.
    probed: (qid, n), the postings probed. ranked: the result."""

    plan: DataFrame
    probed: DataFrame
    ranked: DataFrame


def _postings(index: Index, levels: DataFrame) -> DataFrame:
    return levels.join(index.postings.select("token", "tf", "chunks"), ["token", "tf"]).withColumn(NUMBER, F.explode("chunks")).drop("chunks")


def _scored(index: Index, questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores and reasons of pairs (qid, chunk_no); with have (the most points by what the index holds) and need, only of those
    that reach need with what stands in their text, which is far cheaper to find than a score."""
    # pairs are short, scoring them is not: they stay dealt out, where adaptive execution would put them together by size
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = questions.count() <= FEW_QUESTIONS
    pairs = (pairs if few else pairs.join(questions.select("qid", "q", "parts", "fixed"), "qid")).repartition(n, NUMBER)
    chunks = index.chunks.select(NUMBER, "chunk_id", "source_id", "predicate_hints", "tfs", "hits", _low().alias("low"))
    both = pairs.join(chunks, NUMBER)
    both = both.join(F.broadcast(questions.select("qid", "q", "parts", "fixed")), "qid") if few else both
    if "have" in pairs.columns:
        both = both.where(F.col("have") + bonus(F.col("low")) >= F.col("need")).drop("have", "need")
    return score_pairs(both).select("qid", NUMBER, "chunk_id", "source_id", "score", "reasons")


def search(index: Index, questions: DataFrame, top: int = 12, per_source: int = 4, digits: int | None = None) -> Search:
    """The best top chunks of each question, of each source per_source at most: (qid, chunk columns, score, reasons, rank).

    questions: qid and the columns of QUESTION; nulls count as empty. First
    the rarest words' postings are probed, and the best chunks found there scored in full: the worst of the best of these is the
    threshold, which more chunks can only raise. Then levels are given up,
    those with the most postings for their points first, as long as all that
    is given up and all other points together stay under it; a chunk that no
    level left has can't pass. Others pass by the sum of what was read and
    the most that was not. Only a question whose threshold other points than
    words reach meets all chunks. digits: to which scores are rounded.
    """
    full = {c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), f"{kind}")) for c, kind in (("terms", "array<string>"), ("entities", "array<string>"), ("predicates", "array<string>"), ("modifiers", "array<string>"))}
    none = F.from_json(F.lit("[]"), "array<string>")
    times = F.struct(*[F.coalesce(F.col(f"times.{c}"), none).alias(c) for c in ("years", "months", "phrases")])
    packed = questions.select("qid", F.struct(*[v.alias(c) for c, v in full.items()], times.alias("times")).alias("q"))
    asked = written(packed.select("qid", "q", *_parts(index)), "questions")
    levels = asked.select("qid", F.inline(_wanted())).join(index.levels, "token")
    levels = written(levels.select("qid", "token", "tf", "n", F.coalesce("points", impact(F.col("tf"))).alias("impact")), "asked_levels")

    cheap = Window.partitionBy("qid").orderBy(F.col("rarest"), "token", "tf").rowsBetween(Window.unboundedPreceding, 0)
    probe = levels.withColumn("rarest", F.sum("n").over(Window.partitionBy("qid", "token"))).withColumn("upto", F.sum("n").over(cheap))
    share = F.greatest(F.lit(float(PROBE * max(top, 1))), F.sum("n").over(Window.partitionBy("qid")) * SHARE)
    probe = probe.withColumn("share", share).where(F.col("upto") - F.col("n") < F.col("share"))
    probed = probe.groupBy("qid").agg(F.sum("n").alias("n"))
    tried = _postings(index, probe.select("qid", "token", "tf", "impact")).groupBy("qid", NUMBER).agg(F.sum("impact").alias("part"))
    tried = tried.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part"), NUMBER))).where(F.col("nth") <= TRIED * max(top, 1))
    first = _scored(index, asked, tried.select("qid", NUMBER)).select("qid", "source_id", "chunk_id", "score")
    best = R.cap_top(first, top, per_source, by=["qid"]).groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    bound = asked.join(best.where(F.col("n") >= max(top, 1)), "qid", "left").select("qid", bonus().alias("bonus"), (F.coalesce("least", F.lit(0.0)) - SLACK).alias("need"))
    bound = written(bound.withColumn("room", F.col("need") - F.col("bonus")), "bounds")

    own = Window.partitionBy("qid", "token").orderBy("tf")
    gain = F.col("impact") - F.coalesce(F.lag("impact").over(own), F.lit(0.0))
    ratio = F.min(F.col("n") / F.col("gain")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    dear = Window.partitionBy("qid").orderBy(F.desc("ratio"), "token", "tf").rowsBetween(Window.unboundedPreceding, 0)
    plan = levels.withColumn("gain", gain).withColumn("ratio", ratio).withColumn("given_up", F.sum("gain").over(dear)).join(bound.select("qid", "room"), "qid")
    plan = plan.withColumn("read", F.col("given_up") >= F.col("room"))
    unread = F.coalesce(F.max(F.when(~F.col("read"), F.col("impact"))).over(Window.partitionBy("qid", "token")), F.lit(0.0))
    plan = written(plan.withColumn("unread", unread).select("qid", "token", "tf", "n", "impact", "read", "unread"), "read_levels")
    rest = plan.select("qid", "token", "unread").distinct().groupBy("qid").agg(F.sum("unread").alias("rest"))
    met = _postings(index, plan.where("read").select("qid", "token", "tf", (F.col("impact") - F.col("unread")).alias("more")))
    met = met.groupBy("qid", NUMBER).agg(F.sum("more").alias("more")).join(bound.join(rest, "qid"), "qid")
    pairs = met.where("more + rest >= room").select("qid", NUMBER, (F.col("more") + F.col("rest")).alias("have"), "need")
    open_ones = bound.where("room <= 0").select("qid", "need")
    if not open_ones.isEmpty():
        # these questions meet all chunks: of chunks without any of their words, which points for parts of the text alone may put
        # among the best, those that have such parts
        other = index.chunks.select(NUMBER, _low().alias("low")).crossJoin(F.broadcast(open_ones.join(asked.select("qid", "parts", "fixed"), "qid")))
        more = bonus(F.col("low"))
        other = other.where((more > 0) & (more >= F.col("need"))).select("qid", NUMBER, F.lit(0.0).alias("have"), "need")
        pairs = pairs.unionByName(other).groupBy("qid", NUMBER).agg(F.max("have").alias("have"), F.first("need").alias("need"))
    scored = _scored(index, asked, pairs)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    # chunks without a score come last, so that they go after the ranking: a condition before it would take each score twice
    ranked = R.cap_top(scored, top, per_source, by=["qid"]).where("score > 0")
    ranked = ranked.join(index.chunks.drop("chunk_id", "source_id", "tfs", "hits"), NUMBER).drop(NUMBER)
    return Search(plan.select("qid", "token", "tf", "n", "read"), probed, ranked)
