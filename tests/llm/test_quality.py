"""Quality measures against plain Python, and the sketch's error."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import quality
from tests.llm.common import corpus, table, words
from tests.oracle import same_rows


def measure(text):
    w = words(text, lower=False)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(wins)
    covered = {i + j for i, x in enumerate(wins) if often[x] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    rows = [*corpus(3), (2000, "a b c d e f a b c d e g\n# é|\n# é|\nd"), (2001, "a a a a a a")]
    got = quality.measures(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), *[r[m] for m in quality.MEASURES]) for r in got) == sorted((str(d), *measure(t)) for d, t in rows)


def test_buckets(spark):
    rows = spark.range(0, 5000).select(F.col("id").alias("v"), quality.bucket(F.col("id")).alias("b")).collect()
    for r in rows:
        assert r.b <= r.v and r.v - r.b <= r.v / 32
    edges = [r.b for r in sorted(rows, key=lambda r: r.v)]
    assert edges == sorted(edges)


def test_outliers_go_and_clean_rows_stay(spark):
    text = lambda i: " ".join(f"word{(i * j) % 97}x{j % 7}" for j in range(1, 40))
    rows = [(i, text(i), "en", "a") for i in range(1, 81)] + [(500, "|| ".join(text(3).split()), "en", "a"), (501, "short text", "en", "a"), (502, None, None, None)]
    got = {r.doc_id: r for r in quality.judge(table(spark, rows)).collect()}
    assert all(got[i].kept for i in range(1, 81))
    assert not got[500].kept and not got[500].base_failed and got[500].reason == "symbols"
    assert got[501].base_failed and not got[501].kept and got[502].base_failed


def varied():
    """Two sources of one language, one of which is full of symbols and has long words; a small source; another language."""
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        source = "ab"[i % 2] if i % 50 else "small"
        word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5) + 6 * (source == "b")))
        own = [word() + ("#" if source == "b" and rnd.random() < 0.3 else "") for _ in range(rnd.randint(20, 80))]
        rows.append((i, "\n".join(" ".join(own[k : k + 9]) for k in range(0, len(own), 9)), "en" if i % 3 else "fr", source))
    return rows


def test_fences_differ_between_groups(spark):
    """What is usual in one source is beyond the fence of another."""
    heavy = " ".join(f"wordword{i}#" if i % 3 == 0 else f"wordword{i}" for i in range(60))
    rows = [*varied(), (9000, heavy, "en", "a"), (9001, heavy, "en", "b"), (9002, heavy.replace("#", ""), "en", "b")]
    df = quality.measures(table(spark, rows)).withColumn("g_lang", F.col("lang")).withColumn("g_source", F.col("source"))
    fences = {(r.g_lang, r.g_source): r for r in quality.thresholds(df).collect()}
    assert fences["en", "a"].symbols_high * 3 < fences["en", "b"].symbols_high * 2 and fences["en", "a"].word_length_high < fences["en", "b"].word_length_high
    assert fences["en", "a"].symbols_high != fences["fr", "a"].symbols_high or fences["en", "b"].symbols_high != fences["fr", "b"].symbols_high
    got = {r.doc_id: r for r in quality.judge(table(spark, rows)).collect()}
    assert not got[9000].kept and got[9001].kept and got[9002].kept
    assert sum(r.kept for r in got.values()) > 0.95 * len(rows)


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = table(spark, varied())
    want = sorted(map(str, quality.judge(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(map(str, quality.judge(docs).collect())) == want


def test_same_as_sql_on_varied_rows(spark, tmp_path):
    table(spark, [*varied(), (9000, None, None, None), (9001, "", "en", None)]).write.parquet(f"{tmp_path}/documents.parquet")
    same_rows(quality.op1(spark, str(tmp_path)), quality.OP1_SQL, str(tmp_path), tables=["documents"])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)]])
def test_odd_tables(spark, rows):
    assert quality.judge(table(spark, rows)).count() == len(rows)
