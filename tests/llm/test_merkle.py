"""The Merkle manifest against plain trees."""

from hashlib import sha256
from zlib import crc32

import pytest

from chronoweave.llm import merkle
from chronoweave.llm.staging import read_table
from tests.llm.common import corpus, table
from tests.oracle import SMALL


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        pair = range(i - i % 2, min(i - i % 2 + 2, len(nodes)))
        out.append(([nodes[j] for j in pair if j < i], [nodes[j] for j in pair if j > i]))
        i //= 2
    return out


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: levels_of([t[2] for t in sorted(trees[x], key=lambda t: t[:3])]) for x in order}
    top = levels_of([levels[x][-1][0] for x in order])
    out = []
    for j, x in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(trees[x], key=lambda t: t[:3])):
            path = path_of(levels[x], i) + path_of(top, j)
            told = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            at = leaf_of((*r[:3], r[3] + 1, r[4])) if told else own
            for left, right in path:
                at = h(*left, at, *right)
            out.append((r[0], own, levels[x][-1][0], top[-1][0], h(*[s for a, b in path for s in a + b]), at, at == top[-1][0]))
    return out


def same(df, rows):
    got = df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def columns(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_whole_query(spark):
    same(merkle.op12(spark, SMALL), columns(read_table(spark, SMALL, "documents")))


@pytest.mark.parametrize("span", [1, 4])
def test_several_scans(spark, span):
    """Trees higher than a scan's levels, one key with most leaves, a key with one leaf, null keys."""
    rows = [(i, f"text {i}", [None, "é", "zz", "en"][min(i % 9, 3)] if i != 5 else "lone") for i in range(61)]
    df = table(spark, rows)
    same(merkle.audit(df, span), columns(df))


def test_odd_rows(spark):
    df = table(spark, [(*r, "en", None) if i % 3 else (*r, None, "ü|") for i, r in enumerate(corpus())])
    df = df.withColumn("digest", df.n).withColumn("k", df.n).withColumn("at", df.n)
    same(merkle.audit(df), columns(df))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    df = table(spark, [(i, "x" * 9000 if i else None) for i in range(n)])
    same(merkle.audit(df), columns(df)) if n else None
    assert merkle.audit(df).count() == n


def test_store_and_proofs(spark):
    """Levels lie in folders of their own, and each proof leads from its leaf to the root."""
    docs = table(spark, [(i, f"t{i % 7}", "ab"[i % 2]) for i in range(21)])
    m = merkle.manifest(merkle.document_leaves(docs), ["doc_id"])
    counts = {(r.k, r.level): r["count"] for r in spark.read.parquet(m.tree.store).groupBy("k", "level").count().collect()}
    assert counts == {(k, i): n for k, c in (("=a", (6, 3, 2, 1)), ("=b", (5, 3, 2, 1))) for i, n in enumerate(c, 1)}
    leaves = {(r.k, r["at"]): r.digest for r in m.tree.leaves.collect()}
    proofs = m.proofs().collect()
    assert len(proofs) == 21
    for p in proofs:
        assert merkle.fold(leaves[p.k, p["at"]], p.path) == m.root
