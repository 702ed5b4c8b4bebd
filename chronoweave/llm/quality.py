"""Quality rules with thresholds learnt per language and source from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.llm.staging import read_table, stage
from chronoweave.llm.textops import sub_batches, windows, words_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Integer features (measure, per, scale): scale * measure div per, the more telling reasons first.
FEATURES = {"symbols": ("n_symbols", "n_words", 1000), "dup_lines": ("n_dup_lines", "n_lines", 1000), "repeats": ("n_repeat_words", "n_words", 1000), "word_length": ("word_chars", "n_words", 100)}
#: Quantiles of the accepted documents, per mille: a fence lies as far beyond the outer one as that is from the median.
LOW, MIDDLE, HIGH = 25, 500, 975
#: A group's fences weigh as its documents, those of the group above it as so many.
PRIOR = 200
#: More fences than that are not broadcast but joined, each once for each of SALTS parts of its group.
BROADCAST_ROWS, SALTS = 50_000, 64


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        w = words_of(batch.column("text"), lower=False)
        n = batch.num_rows
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
        total = np.concatenate([[0], np.cumsum(points[w.ends] - points[w.starts])])
        codes, at = windows(w.hashes(), w.first, 5)
        bounds = np.searchsorted(at, w.first)
        lines, again, repeated = (np.zeros(n, np.int64) for _ in range(3))
        raw = w.data.tobytes()
        for d in range(n):
            if w.first[d] == w.first[d + 1]:
                continue
            own = [x for x in raw[w.offsets[d] : w.offsets[d + 1]].split(b"\n") if x and not x.isspace()]
            lines[d], again[d] = len(own), len(own) - len(set(own))
            c = codes[bounds[d] : bounds[d + 1]]
            if len(c) > 1:
                order = np.argsort(c, kind="stable")
                same = c[order][1:] == c[order][:-1]
                if same.any():
                    hit = np.zeros(len(c), bool)
                    hit[order[1:][same]] = hit[order[:-1][same]] = True
                    cover = np.zeros(len(c) + 5, np.int64)
                    spot = np.flatnonzero(hit)
                    np.add.at(cover, spot, 1)
                    np.add.at(cover, spot + 5, -1)
                    repeated[d] = np.count_nonzero(np.cumsum(cover))
        values = [w.counts, np.diff(total[w.first]), np.diff(symbols[w.offsets]), lines, again, repeated]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(v, pa.int64()) for v in values)], names=["doc_id", "lang", "source", *MEASURES])


def measures(docs: DataFrame) -> DataFrame:
    """The base measures of whole texts, one row for each row of docs; doc_id, lang and source come along."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES)
    df = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return df.mapInArrow(_measure, schema)


def bucket(v: Column) -> Column:
    """The lower edge of a value's sketch bucket: exact below 64, else its 6 leading bits, an error of 1/32 at most."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (F.floor(v / F.pow(F.lit(2.0), shift)) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(df: DataFrame, by: list[str]) -> DataFrame:
    """A quantile sketch for each group and feature: counts by bucket. Sketches merge by adding counts.

    A sketch has at most 64 + 32 * 57 buckets whatever it has seen.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), bucket(F.expr(f"{scale} * {a} div {b}")).alias("edge")) for f, (a, b, scale) in FEATURES.items()])
    return df.select(*by, F.inline(pairs)).groupBy(*by, "feature", "edge").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """low, middle, high (bucket edges) and n of each group and feature."""
    from pyspark.sql import Window

    run = Window.partitionBy(*by, "feature").orderBy("edge")
    df = sketch.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*by, "feature")))
    edge = lambda q, name: F.min(F.when(F.col("upto") * 1000 >= F.col("all") * q, F.col("edge"))).alias(name)
    return df.groupBy(*by, "feature").agg(edge(LOW, "low"), edge(MIDDLE, "middle"), edge(HIGH, "high"), F.max("all").alias("n"))


def thresholds(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(g_lang, g_source, <feature>_low, <feature>_high): fences from the quantiles of each language and source.

    The high fence lies as far above the high quantile as that lies above the
    median, the low one likewise below. All documents' fences pull those of a
    language as prior documents would, and the language's those of a source
    in it, so that small groups, where a quantile is one document, follow the
    groups they belong to.
    """
    fine = stage(sketches(measured, ["g_lang", "g_source"]), "sketches")
    levels = []
    for by in ([], ["g_lang"], ["g_lang", "g_source"]):
        merged = fine.groupBy(*by, "feature", "edge").agg(F.sum("n").alias("n"))
        own = quantiles(merged, by).select(*by, "feature", "n", F.greatest(2 * F.col("low") - F.col("middle"), F.lit(0)).alias("low"), (2 * F.col("high") - F.col("middle")).alias("high"))
        if levels:
            above = levels[-1].withColumnsRenamed({"low": "above_low", "high": "above_high"}).drop("n")
            pull = lambda side: F.expr(f"(n * {side} + {prior} * above_{side}) div (n + {prior})").alias(side)
            own = own.join(above, [*by[:-1], "feature"]).select(*by, "feature", "n", pull("low"), pull("high"))
        levels.append(own)
    pick = lambda f, side: F.max(F.when(F.col("feature") == f, F.col(side))).alias(f"{f}_{side}")
    return levels[-1].groupBy("g_lang", "g_source").agg(*[pick(f, side) for f in FEATURES for side in ("low", "high")])


def _with_fences(df: DataFrame, fences: DataFrame) -> DataFrame:
    """df with its group's fences: broadcast if they are few, else joined by group and a part of it, so that a great group is many tasks'."""
    if fences.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(fences), ["g_lang", "g_source"], "left")
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    spread = fences.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", salt).join(spread, ["g_lang", "g_source", "salt"], "left").drop("salt")


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The measures of each row of docs with base_failed, kept and reason.

    base_failed: under 10 words, or more than a fifth of the words lie in
    5-word windows that the text repeats. The others teach the thresholds of
    their language and source, and are kept if word_length lies within both
    fences and symbols, dup_lines and repeats do not exceed the high one.
    reason: base, the first feature beyond its fence, or null.

    Null or empty text has no words and fails; null lang or source is a group
    of its own; repeated rows count each; values at a fence (ties) are kept;
    very long texts are measured whole; other columns are ignored; an empty
    table gives no rows.
    """
    group = lambda c: F.concat(F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(c), F.lit("")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = stage(measures(docs).withColumn("base_failed", failed).withColumn("g_lang", group("lang")).withColumn("g_source", group("source")), "measures")
    out = _with_fences(df, stage(thresholds(df.where("NOT base_failed"), prior), "fences"))
    reason = F.when(F.col("base_failed"), "base")
    for f, (a, b, scale) in FEATURES.items():
        value = F.expr(f"CASE WHEN {b} > 0 THEN {scale} * {a} div {b} ELSE 0 END")
        off = value > F.col(f"{f}_high")
        reason = reason.when(off | (value < F.col(f"{f}_low")) if f == "word_length" else off, f)
    return out.withColumn("reason", reason).select("doc_id", "lang", "source", *MEASURES, "base_failed", F.col("reason").isNull().alias("kept"), "reason")


def op1(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    feats = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, {s} * {a} // {b} AS v FROM b WHERE NOT base_failed" for f, (a, b, s) in FEATURES.items())
    edge = "(v // (1 << greatest(length(bin(v)) - 6, 0)::BIGINT)) * (1 << greatest(length(bin(v)) - 6, 0)::BIGINT)"

    def level(name: str, by: list[str], above: str = "") -> str:
        pre = "".join(f"{c}, " for c in by)
        at = lambda q: f"min(edge) FILTER (upto * 1000 >= total * {q})"
        same = "".join(f"o.{c} IS NOT DISTINCT FROM a.{c} AND " for c in by[:-1])
        pull = ", ".join(f"(o.n * o.{x} + {PRIOR} * a.{x}) // (o.n + {PRIOR}) AS {x}" for x in ("low", "high"))
        own = "".join(f"o.{c}, " for c in by)
        return f"""
{name}c AS (SELECT {pre}feature, edge, count(*) AS n FROM e GROUP BY ALL),
{name}r AS (SELECT *, sum(n) OVER (PARTITION BY {pre}feature ORDER BY edge) AS upto, sum(n) OVER (PARTITION BY {pre}feature) AS total FROM {name}c),
{name}q AS (SELECT {pre}feature, max(total) AS n, greatest(2 * {at(LOW)} - {at(MIDDLE)}, 0) AS low, 2 * {at(HIGH)} - {at(MIDDLE)} AS high FROM {name}r GROUP BY ALL),
{name} AS (""" + (f"SELECT {own}o.feature, o.n, {pull} FROM {name}q o JOIN {above} a ON {same}o.feature = a.feature)" if above else f"SELECT * FROM {name}q)")

    checks = []
    for f, (a, b, s) in FEATURES.items():
        v = f"{s} * {a} // nullif({b}, 0)"
        side = f"coalesce({v}, 0) > t.high" + (f" OR coalesce({v}, 0) < t.low" if f == "word_length" else "")
        checks.append(f"(t.feature = '{f}' AND ({side}))")
    return rf"""
WITH w AS (SELECT doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM w),
ld AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(len(words) - 4)) AS pos, unnest(list_transform(range(len(words) - 4), lambda i: words[i + 1 : i + 5])) AS win FROM w WHERE len(words) >= 5),
gr AS (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g),
rp AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2, pos + 3, pos + 4]) AS p FROM gr WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0)::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN ld USING (doc_id) LEFT JOIN rp USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS ({feats}),
e AS (SELECT lang, source, feature, {edge} AS edge FROM f),
{level("t0", [])},
{level("t1", ["lang"], "t0")},
{level("t", ["lang", "source"], "t1")},
bad AS (SELECT DISTINCT doc_id FROM b JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source WHERE {" OR ".join(checks)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM b
"""


OP1_SQL = _sql()
