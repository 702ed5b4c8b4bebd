"""Benchmark decontamination on templates: numbers, names and units become typed placeholders, windows of the
templates meet in a hash join, and the slots' values must map consistently."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronoweave.llm.staging import few, read_table, spare, stage
from chronoweave.llm.textops import U, Words, mix, sub_batches, window, windows, words_of

KEYS = ["doc_id", "version", "item_id", "item_version", "item_words", "passage"]

WINDOW, MIN_LITERALS = 5, 3
FILTER_BITS = 24
COVERED, CONSISTENT = 0.75, 0.8
#: Of a leaking passage so many tokens lie under matches of different places of the item.
DENSE = 0.6
#: A re-parameterised question must share so many different literal words with the item, an exact copy needs none.
EVIDENCE = 6
#: Items with fewer tokens than a window, but so many words, are looked for word for word; shorter ones identify nothing.
MIN_WORDS = 3
#: More windows of items than that are not broadcast to the documents' windows.
BROADCAST_ROWS = 500_000
NUMBER, NAME, UNIT = (U(x) for x in (0x11, 0x22, 0x33))
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks "
    "month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms "
    "liter liters litre litres dollar dollars euro euros cent cents percent degree degrees mph kmh km/h hz khz mhz ghz kb mb gb tb w kw v"
).split()

_DIGIT, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_STOP[list(b".!?:;")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"'()[]{}")] = True


def _trimmed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words without punctuation at their ends, unless nothing else is left."""
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(3):
        move = (ends - starts > 1) & _PUNCT[w.data[starts]]
        starts += move
    for _ in range(3):
        move = (ends - starts > 1) & _PUNCT[w.data[ends - 1]]
        ends -= move
    return starts, ends


def _unit_hashes() -> np.ndarray:
    return np.sort(words_of(pa.array([" ".join(UNITS)]), lower=True).hashes())


@dataclass
class Tokens:
    """Template tokens of some texts. words: their words; starts, ends: the words' spans without punctuation; begin, finish:
    the words of each token; first: the tokens of each text; exact, code: hashes of the token itself and as a template's;
    kinds: 0 literal, 1 number, 2 name, 3 unit, 4 literal that may be a name; hashes: of the words."""

    words: Words
    starts: np.ndarray
    ends: np.ndarray
    begin: np.ndarray
    finish: np.ndarray
    first: np.ndarray
    exact: np.ndarray
    code: np.ndarray
    kinds: np.ndarray
    hashes: np.ndarray


def templates(column: pa.Array) -> Tokens:
    """The template tokens of texts.

    A number has a digit. A name begins with A-Z and does not follow the end
    of a sentence or line; where it does, it may be a name, and is one if
    another name follows. Names in a row are one token. A unit stands in
    UNITS and follows a number. Literals compare in lower case without
    punctuation at their ends.
    """
    raw = words_of(column, lower=False)
    starts, ends = _trimmed(raw)
    lowered = Words(np.where(_UPPER[raw.data], raw.data + 32, raw.data).astype(np.uint8), raw.offsets, starts, ends, raw.first)
    codes = lowered.hashes()
    n = len(codes)
    if not n:
        none = np.empty(0, np.int64)
        return Tokens(raw, starts, ends, none, none, raw.first, codes, codes, np.empty(0, np.uint8), codes)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw.data])])
    number = digits[ends] > digits[starts]
    lines = np.concatenate([[0], np.cumsum(raw.data == 10)])
    fresh = np.ones(n, bool)  # at the start of a sentence
    fresh[1:] = _STOP[raw.data[raw.ends[:-1] - 1]] | (lines[raw.starts[1:]] > lines[raw.ends[:-1] - 1])
    first = raw.first[:-1]
    fresh[first[first < n]] = True
    name = _UPPER[raw.data[starts]] & ~fresh & ~number
    may = _UPPER[raw.data[starts]] & fresh & ~number
    may[:-1] &= ~name[1:]
    opens = _UPPER[raw.data[starts]] & fresh & ~number & ~may
    known = _unit_hashes()
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    unit = np.zeros(n, bool)
    unit[1:] = (known[at[1:]] == codes[1:]) & number[:-1] & ~fresh[1:]
    kinds = np.zeros(n, np.uint8)
    kinds[may], kinds[name | opens], kinds[unit], kinds[number] = 4, 2, 3, 1
    follows = np.zeros(n, bool)
    follows[1:] = name[1:] & (kinds[:-1] == 2)
    begin = np.flatnonzero(~follows)
    finish = np.append(begin[1:], n)
    nth = np.arange(n) - np.repeat(begin, finish - begin)
    exact = mix(np.add.reduceat(mix(codes + nth.astype(U)), begin))
    kinds = kinds[begin]
    code = exact.copy()
    for kind, one in ((1, NUMBER), (2, NAME), (3, UNIT)):
        code[kinds == kind] = one
    return Tokens(raw, starts, ends, begin, finish, np.searchsorted(begin, raw.first), exact, code, kinds, codes)


def _windows_in(t: Tokens):
    """Windows of each text: hash, index of the first token, bits of the words read as names that may be one, and whether every
    token is read as it stands, as it is in windows with few literals too."""
    codes, at = windows(t.code, t.first, WINDOW)
    exact = mix(windows(t.exact, t.first, WINDOW)[0] + U(WINDOW))
    literal = np.concatenate([[0], np.cumsum((t.kinds == 0) | (t.kinds == 4))])
    plain = literal[at + WINDOW] - literal[at]
    may = np.zeros(len(at), np.uint8)
    for j in range(WINDOW):
        may |= (t.kinds[at + j] == 4).astype(np.uint8) << j
    some = np.flatnonzero((may > 0) & (plain > MIN_LITERALS))
    ok = plain >= MIN_LITERALS
    out = [(codes[ok], at[ok], np.zeros(int(ok.sum()), np.uint8), np.zeros(int(ok.sum()), bool)), (exact, at, np.zeros(len(at), np.uint8), np.ones(len(at), bool))]
    for mask in range(1, 1 << WINDOW):
        pick = some[(may[some] & mask == mask) & (plain[some] - mask.bit_count() >= MIN_LITERALS)]
        if len(pick):
            read = [np.where(mask >> j & 1, NAME, t.code[at[pick] + j]) for j in range(WINDOW)]
            out.append((window(read), at[pick], np.full(len(pick), mask, np.uint8), np.zeros(len(pick), bool)))
    return [np.concatenate(x) for x in zip(*out, strict=True)], plain


def _bits(codes: np.ndarray) -> np.ndarray:
    return (codes >> U(64 - FILTER_BITS)).astype(np.int64)


def _short(t: Tokens) -> np.ndarray:
    """Of each text, its words if it has fewer tokens than a window, else 0."""
    n = np.diff(t.words.first)
    return np.where((np.diff(t.first) < WINDOW) & (n >= MIN_WORDS), n, 0)


def _windows_of(key: str, bits, lengths=()):
    """Rows of windows. Of items (bits is None): those of which a template has enough literals, the others as they stand, and
    whole items of few tokens; of documents: those whose bit is set, and runs of as many words as such items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for batch in sub_batches(batches):
            t = templates(batch.column("text"))
            (codes, at, named, exact), plain = _windows_in(t)
            if may is not None:
                ok = may[_bits(codes)]
            else:
                few = np.ones(len(t.code) + 1, bool)
                few[windows(t.code, t.first, WINDOW)[1][plain >= MIN_LITERALS]] = False
                ok = ~exact | few[at]
            codes, at, named, exact = codes[ok], at[ok], named[ok], exact[ok]
            begin, finish, whole = t.begin[at], t.finish[at + WINDOW - 1], np.zeros(len(at), np.int64)
            doc, size = np.searchsorted(t.first, at, side="right") - 1, np.diff(t.first)
            pos = at - t.first[doc]
            sizes = size[doc]
            short = _short(t)
            for n in sorted(set(short[short > 0].tolist())) if may is None else lengths:
                more, where = windows(t.hashes, t.words.first, n)
                more = mix(more + U(1000 + n))
                owner = np.searchsorted(t.words.first, where, side="right") - 1
                ok = short[owner] == n if may is None else may[_bits(more)]
                more, where, owner = more[ok], where[ok], owner[ok]
                codes, begin, finish, doc = (np.concatenate(x) for x in ((codes, more), (begin, where), (finish, where + n), (doc, owner)))
                zero = np.zeros(len(more), np.int64)
                at, named, exact, whole, pos, sizes = (np.concatenate(x) for x in ((at, zero - 1), (named, zero.astype(np.uint8)), (exact, zero == 0), (whole, zero + n), (pos, zero), (sizes, zero + n)))
            if not len(codes):
                continue
            data = t.words.data.tobytes()
            lower = data.lower()
            slots, literals = [], []
            for i, m, x in zip(at.tolist(), named.tolist(), exact.tolist(), strict=True):
                slot = [not x and (0 < t.kinds[i + j] < 4 or m >> j & 1) for j in range(WINDOW)]
                span = lambda j: slice(t.starts[t.begin[i + j]], t.ends[t.finish[i + j] - 1])  # noqa: E731, B023
                slots.append([" ".join(lower[span(j)].decode("utf-8", "replace").split()) if slot[j] else None for j in range(WINDOW)] if any(slot) else None)
                literals.append([None if i < 0 or t.kinds[i + j] in (1, 2, 3) else int(t.exact[i + j].view(np.int64)) for j in range(WINDOW)] if may is None else None)
            first = t.words.first[doc]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(doc)), batch.column("version").take(pa.array(doc)), pa.array(codes.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array((begin - first).astype(np.int32)), pa.array((finish - first).astype(np.int32))]
                + [pa.array(sizes.astype(np.int32)), pa.array(np.bitwise_count(named).astype(np.int32)), pa.array(whole.astype(np.int32)), pa.array(slots, pa.list_(pa.string())), pa.array(literals, pa.list_(pa.int64()))],
                names=[key, "version", "code", "pos", "begin", "finish", "words", "named", "whole", "slots", "literals"],
            )

    return run


def _filter_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_bits(batch.column("code").to_numpy().view(U))] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def _rows(df: DataFrame, key: str, bits, lengths=()) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    df = df.select(key, F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("version"))
    return df.mapInArrow(_windows_of(key, bits, lengths), f"{key} {kind}, version long, code long, pos int, begin int, finish int, words int, named int, whole int, slots array<string>, literals array<long>")


def _consistency(slots: list[tuple]) -> float:
    """Of the placeholders in pairs of windows, the share whose value goes with the most frequent one of the other side, of the side where that is less."""
    worst = 1.0
    for own, other in ((0, 1), (1, 0)):
        counts: dict[str, dict[str, int]] = {}
        for pair in slots:
            for a, b in zip(pair[own] or (), pair[other] or (), strict=True):
                if a is not None and b is not None:
                    to = counts.setdefault(a, {})
                    to[b] = to.get(b, 0) + 1
        total = sum(sum(to.values()) for to in counts.values())
        worst = min(worst, sum(max(to.values()) for to in counts.values()) / total if total else 1.0)
    return worst


@dataclass
class Matches:
    """Matches of a document's and an item's windows: places of both, slots of both, and the different literals of the item's."""

    pos: np.ndarray
    item_pos: np.ndarray
    slots: list[tuple]
    literals: list[list]


def alignments(m: Matches, item_words: int, covered: float, consistent: float) -> list[tuple]:
    """(matches, coverage, consistency, literals) of the alignments in a passage that leak the item and don't overlap.

    Around each diagonal (pos - item_pos) every place of the item takes its
    match nearest to it, at most a passage's gap away, so that insertions
    pass and a phrase that repeats, or a variant next to this one, stays apart.
    """
    diagonal = m.pos - m.item_pos
    anchors, support = np.unique(diagonal, return_counts=True)
    places = np.unique(m.item_pos)
    reach = max(item_words / 2, WINDOW * 2)
    chosen = np.full((len(anchors), len(places)), -1, np.int32)
    for k, place in enumerate(places):
        mine = np.flatnonzero(m.item_pos == place)
        mine = mine[np.argsort(diagonal[mine], kind="stable")]
        own = diagonal[mine]
        right = np.minimum(np.searchsorted(own, anchors), len(own) - 1)
        left = np.maximum(right - 1, 0)
        near = np.where(np.abs(own[left] - anchors) < np.abs(own[right] - anchors), left, right)
        chosen[:, k] = np.where(np.abs(own[near] - anchors) <= reach, mine[near], -1)
    taken, out = [], []
    cover = lambda at: len(np.unique((m.item_pos[at][:, None] + np.arange(WINDOW)).ravel()))
    for x in np.lexsort((anchors, -support)).tolist():
        at = chosen[x][chosen[x] >= 0]
        begin, finish = int(m.pos[at].min()), int(m.pos[at].max()) + WINDOW
        if cover(at) < max(covered * item_words, DENSE * (finish - begin)) or any(begin < f and b < finish for b, f in taken):
            continue
        share = _consistency([m.slots[i] for i in at.tolist()])
        evidence = len({c for i in at.tolist() for c in m.literals[i] or () if c is not None})
        same = np.array([i for i in at.tolist() if m.slots[i][0] == m.slots[i][1]], np.int64)
        if share >= consistent and evidence >= EVIDENCE or len(same) and cover(same) == cover(at):
            taken.append((begin, finish))
            out.append((at, cover(at) / item_words, share, evidence))
    return out


def _aligned(covered: float, consistent: float):
    def run(table: pa.Table) -> pa.Table:
        pos, item_pos, begin, finish = (table.column(c).to_numpy().astype(np.int64) for c in ("pos", "item_pos", "begin", "finish"))
        m = Matches(pos, item_pos, list(zip(table.column("item_slots").to_pylist(), table.column("slots").to_pylist(), strict=True)), table.column("literals").to_pylist())
        found = alignments(m, table.column("item_words")[0].as_py(), covered, consistent)
        out = table.select(KEYS).take(pa.array([0] * len(found), pa.int64()))
        values = [[int(begin[x[0]].min()) for x in found], [int(finish[x[0]].max()) for x in found], *([x[k] for x in found] for k in (1, 2, 3))]
        for c, v, t in zip(("begin", "finish", "coverage", "consistency", "literals"), values, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()), strict=True):
            out = out.append_column(c, pa.array(v, t))
        return out

    return run


def _same(left: str, right: str, by: list[str]):
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def matches(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, consistent: float = CONSISTENT) -> DataFrame:
    """(doc_id, version, item_id, begin, finish, coverage, consistency, literals): passages of docs that repeat benchmark items.

    Windows of WINDOW template tokens, of which MIN_LITERALS are literal, meet
    by hash, others as they stand; a capital word at the start of a sentence
    is read as itself and as a name. Documents first pass a bit filter of the
    items' windows: 2 MB whatever the benchmark's size, and no window that
    meets an item is lost. Matches of a document and item whose places lie
    within an item's length make a passage; coverage is the share of the
    item's tokens under matched windows. consistency: of the slots
    (placeholders) in matched windows, the share whose value goes with its most
    frequent value on the other side, in the worse direction; 1 if there are
    none. A re-parameterised question replaces each value by one other
    throughout, so it is consistent; tables of numbers are not. literals: the
    different literal words of the item under matched windows; re-parameterised
    questions need EVIDENCE of them, so that "what is 9 times 6" is no leak of
    "what is 7 times 8", while passages with the item's own values in all
    slots are leaks whatever their number. A passage that does not pass as a
    whole is judged by its alignments, a row for each that does: phrases that
    repeat within an item and variants that follow each other don't count
    against one another. Pieces of an item with more text between than DENSE
    allows are no leak.

    Items of fewer tokens than a window are found word for word (coverage and
    consistency 1), if they have MIN_WORDS words; shorter ones match nothing.
    Null or empty text has no windows; very long texts are read whole; rows
    alike in id and text count as one; ties between alignments go to the one
    with more matches, then the earlier; null ids and other columns pass;
    empty tables give no rows.
    """
    spark = docs.sparkSession
    items = stage(_rows(benchmark, "item_id", None), "items")
    parts = items.select("code").coalesce(8).mapInArrow(_filter_of, "bits binary").collect()
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts:
        bits |= np.frombuffer(r.bits, np.uint8)
    lengths = sorted(r.whole for r in items.where("whole > 0").select("whole").distinct().collect())
    found = _rows(docs, "doc_id", spark.sparkContext.broadcast(bits.tobytes()), lengths).drop("literals", "words")
    item = items.select("code", "whole", "item_id", F.col("version").alias("item_version"), F.col("pos").alias("item_pos"), F.col("words").alias("item_words"), F.col("named").alias("item_named"), F.col("slots").alias("item_slots"), "literals")
    met = found.join(F.broadcast(item) if items.count() <= BROADCAST_ROWS else item, ["code", "whole"]).drop("code")
    own = Window.partitionBy("doc_id", "version", "item_id", "item_version", "whole").orderBy("pos", "item_pos", F.col("named") + F.col("item_named"), "named", "begin")
    # of two readings of one pair the one with fewer names
    again = (F.col("whole") == 0) & F.lag("pos").over(own).eqNullSafe(F.col("pos")) & F.lag("item_pos").over(own).eqNullSafe(F.col("item_pos"))
    gap = (F.col("pos") - F.lag("pos").over(own) > F.greatest(F.col("item_words") / 2, F.lit(WINDOW * 2))).cast("int")
    met = met.withColumn("passage", F.sum(F.coalesce(gap, F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    met, by = stage(met.withColumn("again", again).where("NOT again").drop("again", "named", "item_named"), "met"), KEYS
    short = met.where("whole > 0").select(*by, "begin", "finish", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("consistency"), F.lit(0).cast("long").alias("literals")).distinct()
    met = met.where("whole = 0")
    spots = F.inline(F.transform(F.coalesce("literals", F.array_repeat(F.lit(None).cast("long"), WINDOW)), lambda x, j: F.struct((F.col("item_pos") + j).alias("spot"), x.alias("literal"))))
    cover = met.select(*by, "pos", "begin", "finish", spots).groupBy(*by).agg(
        F.count_distinct("spot").alias("n"), F.count_distinct("literal").alias("literals"), F.min("begin").alias("begin"), F.max("finish").alias("finish"), (F.max("pos") - F.min("pos") + WINDOW).alias("span")
    )
    pairs = met.where("item_slots IS NOT NULL").select(*by, F.explode(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))).alias("x"))
    pairs = pairs.where("x.a IS NOT NULL AND x.b IS NOT NULL").groupBy(*by, F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.count("*").alias("c"))
    best = lambda side: pairs.groupBy(*by, side).agg(F.max("c").alias("best"), F.sum("c").alias("all")).groupBy(*by).agg((F.sum("best") / F.sum("all")).alias(f"by_{side}"))
    both = best("a").alias("a").join(best("b").alias("b"), _same("a", "b", by)).select(*[F.col(f"a.{c}") for c in by], F.least("by_a", "by_b").alias("consistency"))
    whole = cover.alias("c").join(both.alias("s"), _same("c", "s", by), "left")
    whole = whole.select(*[F.col(f"c.{c}") for c in by], "begin", "finish", (F.col("n") / F.col("c.item_words")).alias("coverage"), F.coalesce("consistency", F.lit(1.0)).alias("consistency"), "literals", (F.col("n") >= DENSE * F.col("span")).alias("dense"))
    whole = stage(whole.where(F.col("coverage") >= covered), "covered")
    leak = F.col("dense") & (F.col("consistency") >= consistent) & (F.col("literals") >= EVIDENCE)
    apart = met.alias("m").join(whole.where(~leak).alias("w"), _same("m", "w", by), "left_semi").groupBy(*by)
    apart = apart.applyInArrow(_aligned(covered, consistent), whole.drop("dense").schema)
    out = whole.where(leak).drop("dense").unionByName(apart).unionByName(short)
    return out.select("doc_id", "version", "item_id", "begin", "finish", F.round("coverage", 6).alias("coverage"), F.round("consistency", 6).alias("consistency"), "literals")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that repeat a benchmark item."""
    own = spare(docs, "version")
    bad = few(stage(matches(docs, benchmark).select("doc_id", "version").distinct(), "leaks"))
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"d.{own}") == F.col("b.version"))
    return docs.withColumn(own, F.xxhash64("text")).alias("d").join(bad.alias("b"), same, "left_anti").drop(own)


def op6(spark, sf_dir: str) -> DataFrame:
    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("version")
