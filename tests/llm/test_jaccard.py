"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from chronoweave.llm import jaccard
from tests.llm.common import corpus, table, words


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(spark, seed):
    rows = corpus(seed)
    got = jaccard.classes(table(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_one_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        own[i] = f"x{i}"
        if i % 4 == 0:
            own[(i * 7) % 60] = f"y{i}"
        rows.append((i, " ".join(own)))
    got = jaccard.classes(table(spark, rows).repartition(4)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_pivots_spare_pairs_and_lose_no_link(spark, monkeypatch):
    """Many variants of one text, with others that link only with some of them, in small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rnd.choice((1, 1, 2, 3))):
            own[rnd.randrange(80)] = f"x{rnd.randrange(1000)}"
        if i % 9 == 0:
            own = own[: 60 + i // 9] + [f"z{i // 18}{k}" for k in range(14)]
        rows.append((i, " ".join(own)))
    got = jaccard.classes(table(spark, rows).repartition(4)).collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want and len({c for _, _, c in want}) > 1
    members = spark.createDataFrame([(1, bytes([i]), 10, 12) for i in range(90)], "leader long, s binary, n long, blocks int")
    near = members.where("s <> X'00'").select("leader", "s")
    assert jaccard._pairs_of_blocks(members, near).count() <= 2 * 90 + 12


def test_links_of_great_sets_at_the_edge():
    """A link of exactly 75 percent between sets whose sizes a 32-bit float can't multiply."""
    n, both = 226_779, 194_382
    a = np.arange(n, dtype=np.uint64)
    b = np.concatenate([a[:both], np.arange(n, 2 * n - both, dtype=np.uint64)])
    assert 100 * both == 75 * (2 * n - both) and jaccard.links_within([a, b]) == [(0, 1)]
    assert jaccard.links_within([a, np.concatenate([b[1:], [np.uint64(10**9)]])]) == []


def test_filter_never_drops_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 600))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        k = int(rng.integers(0, n // 5 + 1))
        b[:k] = rng.integers(0, 1 << 62, k).astype(np.uint64)
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(jaccard.may_link([len(a), len(b)], [jaccard.parity(a), jaccard.parity(b)])) == 2


def test_keep_one(spark):
    rows = corpus(4)
    docs = table(spark, rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    # one row a component, named by its least id; rows without words stay as they are
    want = {(c if n else d, n > 0, c if n else d) for d, n, c in brute(rows)}
    assert got == sorted(x[0] for x in want)


def test_empty_table(spark):
    assert jaccard.classes(table(spark, [])).collect() == []


def test_prefixes_are_not_written(spark, monkeypatch):
    """Prefix shingles outweigh all else of a signature and are read once."""
    held, stage = {}, jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name, *a: held.setdefault(name, stage(df, name, *a)))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(1, 60, 8)], "doc_id long, text string")
    jaccard.classes(docs)
    assert not [f.name for f in held["signatures"].schema if f.dataType.typeName() == "array"]
    assert held["shared"].count() > 0
