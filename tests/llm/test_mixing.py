"""Water-filling against rounds of clamping, and what the mix takes."""

import pytest

from chronoweave.llm import mixing
from tests.llm.common import corpus, table, words


def rounds(sizes, weights, cap):
    """Targets by sharing, clamping and sharing the excess again."""
    fixed, open_ = {}, set(sizes)
    total = sum(sizes.values())
    while open_:
        share = (total - sum(fixed.values())) / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * share > cap * sizes[s] * (1 + 1e-12)]
        if not over:
            return {**fixed, **{s: weights[s] * share for s in open_}}
        for s in over:
            fixed[s] = cap * sizes[s]
            open_.remove(s)
    return fixed


def test_targets_and_words(spark):
    rows = [(i, t, "en", [None, "b", "a", "é", "c", ""][(i or 0) % 6 if (i or 0) % 11 else 1]) for i, t in corpus(5)]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = rounds(sizes, weights, 3)
    largest, taken = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(table(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_odd_tables(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    got = mixing.mix(table(spark, [(1, None, "en", None), (1, None, "en", None)])).collect()
    assert [(r.size, r.taken) for r in got] == [(0, 0), (0, 0)]
