"""URL filters: character language models of accepted and rejected URLs, compared by calibrated length-normalised log-likelihood."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.llm.staging import read_table

#: Verdict, host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 3
#: Symbols: a-z, 0-9, these, any other byte, and the edge of a URL; the model has at most 2 * 48 ** 4 counts.
MARKS = "./-_?&=#%:"
EDGE, OTHER, SYMBOLS = 0, 47, 48
FOLDS = 5
BINS, BIN = 1200, 0.01

_SYMBOL = np.full(256, OTHER, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = np.arange(27, 37)
for _i, _c in enumerate(MARKS):
    _SYMBOL[ord(_c)] = 37 + _i


@dataclass
class Model:
    """ratio: log-likelihood of accepted less that of rejected URLs, by three symbols and the next. threshold: least mean that is accepted."""

    ratio: np.ndarray
    threshold: float


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host and path as the rules read them, and what the models read: the host and all that follows it, query and fragment too."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, path, F.concat(host, F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each character and the end of each URL: its code (the preceding symbols and itself), and its URL. Empty URLs have none."""
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.empty(0, np.uint8)
    sizes = np.diff(offsets)
    used = np.flatnonzero(sizes)
    lengths = sizes[used] + 1 + order
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    flat = np.zeros(int(lengths.sum()), np.int64)
    owner = np.repeat(used, sizes[used])
    at = np.arange(len(data)) - np.repeat((offsets[:-1] - offsets[0])[used], sizes[used]) + np.repeat(first + order, sizes[used])
    flat[at] = _SYMBOL[data]
    code = flat.copy()
    for k in range(1, order + 1):
        code[k:] += flat[:-k] * SYMBOLS**k
    place = np.arange(len(flat)) - np.repeat(first, lengths)
    ok = place >= order
    return code[ok], np.repeat(used, lengths)[ok]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, owner = _grams(batch.column("text"), ORDER)
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64)
        keys, n = np.unique(code * 2 + good[owner], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """log P(next | preceding) for counts of shape (SYMBOLS,) * (ORDER + 1), by Witten-Bell smoothing from order 0 up.

    Each order mixes its own relative frequency with the order below, the
    weight of the latter growing with the number of distinct continuations, so
    an unseen context falls back on the longest seen one. Every context's
    probabilities sum to 1.
    """
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(ORDER + 1):
        c = counts.sum(axis=tuple(range(ORDER - k))) if k < ORDER else counts
        total, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        below = np.broadcast_to(p, c.shape)
        p = np.where(total > 0, (c + kinds * below) / np.maximum(total + kinds, 1), below)
    return np.log(p)


def _scorer(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code, owner = _grams(batch.column("__text"), ORDER)
            total = np.bincount(owner, weights=ratio.value[code], minlength=n)
            score = total / np.maximum(np.bincount(owner, minlength=n), 1)
            arrays = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(score, pa.float64())], names=[*batch.schema.names, "__score"])

    return run


def score(df: DataFrame, ratio: np.ndarray) -> DataFrame:
    """df with __score: the mean over the characters of __text of the log-likelihood ratio; 0 for an empty text."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("__score", T.DoubleType())])
    return df.mapInArrow(_scorer(df.sparkSession.sparkContext.broadcast(ratio)), schema)


def learn(labelled: DataFrame) -> Model:
    """From (text, good): models of four fifths of the URLs by hash, and on the last fifth the threshold that parts the
    two best (the mean of their hit rates); ties go to the threshold nearest 0. Without URLs of both kinds: ratio 0, threshold 0.

    Counts are over all URLs, added up before they are sent; what the driver
    gets is bounded by the number of symbols, whatever the input.
    """
    part = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(FOLDS))
    rows = labelled.where(part != 0).mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(2 * SYMBOLS ** (ORDER + 1), np.float64)
    counts[rows["key"].to_numpy(np.int64)] = rows["n"].to_numpy()
    both = counts.reshape(*[SYMBOLS] * (ORDER + 1), 2)
    if not both[..., 0].any() or not both[..., 1].any():
        return Model(np.zeros(SYMBOLS ** (ORDER + 1), np.float32), 0.0)
    ratio = (log_likelihoods(both[..., 1]) - log_likelihoods(both[..., 0])).astype(np.float32).reshape(-1)
    tried = score(labelled.where(part == 0).withColumnRenamed("text", "__text"), ratio)
    spot = F.least(F.greatest(F.floor(F.col("__score") / BIN), F.lit(-BINS)), F.lit(BINS)).cast("int")
    found = tried.groupBy("good", spot.alias("bin")).count().collect()
    return Model(ratio, calibrate({(r["good"], r["bin"]): r["count"] for r in found}))


def calibrate(found: dict[tuple[bool, int], int]) -> float:
    totals = {g: sum(n for (x, _), n in found.items() if x == g) for g in (False, True)}
    if not all(totals.values()):
        return 0.0
    best, below = (-1.0, 0.0, 0.0), {False: 0, True: 0}
    for b in range(-BINS, BINS + 2):
        hit = below[False] / totals[False] + 1 - below[True] / totals[True]
        best = max(best, (round(hit, 12), -abs(b * BIN), b * BIN))
        for g in below:
            below[g] += found.get((g, b), 0)
    return best[2]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of pages.

    The rules' verdicts are also what the two models learn from: URLs that a
    rule allows are the accepted, those that one blocks the rejected. URLs
    without a rule are allowed if their score reaches the threshold. The
    models read all that follows ://.

    A null url, or one without ://, has an empty host and path and score 0.
    Null ids, repeated rows and other columns pass; very long urls are scored
    whole; a score at the threshold (a tie) is allowed, and of rules that fit
    with the same length the last by name counts; an empty table gives no rows; with rules that meet URLs of one kind only, all others are allowed.
    """
    host, path, whole = split_url(F.col("url").cast("string"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"), whole.alias("__text"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("known"), "__text")
    model = learn(df.where("known IS NOT NULL").select(F.col("__text").alias("text"), (F.col("known") == "allow").alias("good")))
    out = score(df, model.ratio)
    guess = F.when(F.col("__score") >= model.threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("known", guess).alias("verdict"), F.col("__score").alias("score"))


def op2(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
