"""Document fingerprints against plain ones."""

import math
from base64 import b64decode, b64encode
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from chronoweave.llm import digests
from chronoweave.llm.staging import read_table
from tests.llm.common import corpus, table
from tests.oracle import SMALL

W, P = digests.WIDTH, digests.REACH
TOTAL = [0, *(round(10_000 * c * math.log2(c)) for c in range(1, W + 1))]


def step_of(window):
    total = sum(TOTAL[c] for c in Counter(window).values())
    return (TOTAL[W] - total) * digests.STEPS // (TOTAL[W] + 1)


def steps_of(data):
    return [step_of(data[i : i + W]) for i in range(len(data) - W + 1)]


def plain_ranks(texts):
    n = Counter(s for t in texts for s in steps_of(t))
    order = sorted(range(digests.STEPS), key=lambda s: (s < digests.WEAK, n[s], s))
    return np.array([order.index(s) for s in range(digests.STEPS)])


def plain_filters(data, ranks):
    if not data:
        return b""
    steps = steps_of(data)
    keys = [(int(ranks[s]), i) for i, s in enumerate(steps)]
    wins = Counter(min(keys[i : i + P])[1] for i in range(len(keys) - P + 1))
    chosen = sorted(i for i, c in wins.items() if c >= min(digests.FAVOURED, len(keys) - P + 1))
    if not chosen:
        chosen = [min(keys)[1] if keys else 0]
    seen = {}
    for i in chosen:
        seen.setdefault(data[i : i + W], i)
    codes = [int(digests._hashes(np.frombuffer(data, np.uint8), np.array([i]), np.array([len(x)]))[0]) for x, i in seen.items()]
    out = b""
    for k in range(0, len(codes), digests.PER_FILTER):
        bits = [0] * digests.BITS
        for c in codes[k : k + digests.PER_FILTER]:
            for j in range(digests.HASHES):
                bits[(c >> (11 * j)) % digests.BITS] = 1
        out += bytes(int("".join(map(str, bits[b : b + 8])), 2) for b in range(0, digests.BITS, 8))
    return out


def plain_likeness(a, b):
    if a == b or not a or not b:
        return float(a == b)
    size = digests.BITS // 8
    x, y = ([int.from_bytes(v[i : i + size], "big") for i in range(0, len(v), size)] for v in (a, b))
    weight = lambda v: sum(f.bit_count() for f in v)
    if (len(x), weight(x), a) > (len(y), weight(y), b):
        x, y = y, x
    share = lambda f, g: max(0.0, ((f & g).bit_count() - f.bit_count() * g.bit_count() / digests.BITS) / (min(f.bit_count(), g.bit_count()) - f.bit_count() * g.bit_count() / digests.BITS))
    return sum(f.bit_count() * max(share(f, g) for g in y) for f in x) / weight(x)


def plain(rows, tie):
    """rows: (doc_id, text)."""
    rows = sorted(((d is not None, d or 0, tie[t]), d, t or "") for d, t in rows)
    ranks = plain_ranks([t.encode() for _, _, t in rows])
    made = {t: plain_filters(t.encode(), ranks) for _, _, t in rows}
    out = []
    for (_, d, t), (_, _, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edit = t[: len(t) - half] + u[:half]
        mark = plain_filters(edit.encode(), ranks)
        out.append((d, len(t), sha256(edit.encode()).hexdigest(), b64encode(made[t]).decode(), b64encode(mark).decode(), round(plain_likeness(made[t], mark), 9), round(plain_likeness(made[t], made[u]), 9)))
    return out


def same(df):
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in digests.edits(df).collect()]
    tie = {r[0]: r[1] for r in df.selectExpr("text", "xxhash64(text)").collect()}
    want = plain([(r.doc_id, r.text) for r in df.collect()], tie)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_whole_query(spark):
    df = read_table(spark, SMALL, "documents")
    same(df)
    assert digests.op13(spark, SMALL).columns == digests.OUT.names


def test_odd_rows(spark):
    rows = [*corpus(n=30), (2000, "ab" * 40), (2001, "x" * 64), (2002, "x" * 63), (2003, "é" * 70), (2004, "-" * 400), (2005, "".join(map(chr, range(300, 900))))]
    df = table(spark, rows).withColumn("fingerprint", digests.F.lit("x")).withColumn("bucket", digests.F.lit(0)).withColumn("head", digests.F.lit(0))
    same(df)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    same(table(spark, [(i, "word " * (50 + i)) for i in range(n)]))


def test_fingerprints_and_compare(spark):
    """Copies are alike throughout, texts that share a half about by half, others hardly; a very long text needs several filters."""
    rnd = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rnd.choice(list("abcdefghijklmnop"), rnd.integers(2, 9))) for _ in range(n))
    a, b, long = prose(600), prose(600), prose(6000)
    docs = table(spark, [(1, a), (2, a), (3, a[: len(a) // 2] + b[: len(b) // 2]), (4, b), (5, long), (6, long + " end")])
    made = {r.doc_id: r.fingerprint for r in digests.fingerprints(docs).select("doc_id", "fingerprint").collect()}
    assert made[1] == made[2] and len(b64decode(made[5])) > 2 * digests.BITS // 8
    pairs = spark.createDataFrame([(x, y, made[x], made[y]) for x, y in ((1, 2), (1, 3), (4, 3), (1, 4), (5, 6))], "x int, y int, a string, b string")
    near = {(r.x, r.y): r.likeness for r in digests.compare(pairs, "a", "b").collect()}
    assert near[1, 2] == 1 and near[5, 6] > 0.95 and near[1, 4] < 0.1
    assert 0.35 < near[1, 3] < 0.65 and near[4, 3] > 0.2
