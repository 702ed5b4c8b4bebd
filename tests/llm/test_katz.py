"""Katz backoff against dictionaries and the recursion as written."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import katz
from chronoweave.llm.textops import WORD
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, n_words int"


def words(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(WORD, text or "")] + ["</s>"]


def brute(rows, order=katz.ORDER):
    """{doc_id: (n_tokens, n_known, train_tokens, base, score)} and P(w | h), by dictionaries."""
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows}
    counts = [Counter() for _ in range(order + 1)]
    for d, t in rows:
        if not held[d]:
            ws = ["<s>"] * (order - 1) + words(t)
            for i in range(order - 1, len(ws)):
                for k in range(1, order + 1):
                    counts[k][tuple(ws[i - k + 1 : i + 1])] += 1
    total, kinds = sum(counts[1].values()), len(counts[1])
    lost = [None] + [katz.discounts(np.bincount(np.minimum(list(c.values()) or [0], katz.CUT + 2), minlength=katz.CUT + 3)) for c in counts[1:]]
    star = lambda c, k: c - lost[k][min(c, katz.CUT + 1)]
    free = (total - sum(star(c, 1) for c in counts[1].values())) / total if total else 1.0
    after, history = {}, Counter()
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            after.setdefault(g[:-1], []).append((g[-1], c))
            history[g[:-1]] += c
    weights = {}

    def p(w, h):
        if not h:
            return star(counts[1][w,], 1) / total if (w,) in counts[1] else free
        if h not in history:
            return p(w, h[1:])
        k = len(h) + 1
        if (*h, w) in counts[k]:
            return star(counts[k][*h, w], k) / history[h]
        if h not in weights:
            weights[h] = (1 - sum(star(c, k) for _, c in after[h]) / history[h]) / (1 - sum(p(x, h[1:]) for x, _ in after[h]))
        return weights[h] * p(w, h[1:])

    out = {}
    for d, t in rows:
        ws = words(t)
        base = sum(math.log10((counts[1][w,] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        full = ["<s>"] * (order - 1) + ws
        out[d] = (len(ws), sum((w,) in counts[1] for w in ws), total, base, sum(math.log10(p(full[i], tuple(full[i - order + 1 : i]))) for i in range(order - 1, len(full))))
    return out, p, after, [w for w, in counts[1]]


def test_like_brute_force(spark):
    rows = [(i, " ".join(f"W{(i * i * j + j * j) % (7 + i % 5)}" for j in range(i % 40))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "the " * 3000), (104, "nowhere else"), (110, "é É x\x0by"), (None, "w1 w2 w3")]
    got = {r.doc_id: r for r in katz.score(spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)).collect()}
    want, p, after, uni = brute(rows)
    assert len(got) == len(rows)
    assert any(r.held_out for r in got.values())
    for d, x in want.items():
        g = got[d]
        assert (g.n_tokens, g.n_known, g.train_tokens) == x[:3]
        assert g.base_score == pytest.approx(x[3], rel=1e-9)
        assert g.score == pytest.approx(x[4], rel=1e-6)
    for h in list(after)[:20]:
        assert sum(p(w, h) for w in [*uni, "<unseen>"]) == pytest.approx(1)
    assert {len(h) for h in after} == set(range(1, katz.ORDER))


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b a b", 1)] * 3 + [(2, "a b", 1)]
    got = katz.score(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert katz.score(spark.createDataFrame([], SCHEMA)).collect() == []


def mixed_rows():
    return [(i, " ".join("the" if j % 3 == 0 else f"w{(i * j) % 50}" for j in range(60 + i))) for i in range(50)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_small_chunks_and_split_histories_like_brute_force(spark, order):
    """Chunks of a few documents, histories dealt to many buckets, every order."""
    rows = mixed_rows()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(4)
    want = brute(rows, order)[0]
    got = katz.score(df, order=order, chunk_bytes=1000, bucket_tokens=100).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.score == pytest.approx(want[r.doc_id][4], rel=1e-6)


def test_input_in_another_order_at_each_read(spark):
    """Scores belong to their documents though a read of the input gives its rows in another order than the read before."""
    rows = mixed_rows()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).withColumn("turn", F.rand()).orderBy("turn").drop("turn")
    shaken = df.mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), df.schema)
    want = brute(rows)[0]
    for r in katz.score(shaken, chunk_bytes=2000).collect():
        assert (r.n_tokens, r.score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][4], rel=1e-6))


def test_query_moves_answers_only(spark):
    """op7 over the smallest tables gives each document a row; the table of chunks is bucketed, so that evaluation shuffles nothing but the answers."""
    got = katz.op7(spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(chunk") == 1
