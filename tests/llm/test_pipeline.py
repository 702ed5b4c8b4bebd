"""The pipeline's stages on a small corpus with odd rows."""

import importlib
import random
import subprocess
import sys
import zlib

import corpus_pipeline
from chronoweave.llm import queries
from tests.llm.common import corpus, table, words
from tests.llm.test_jaccard import brute
from tests.llm.test_leaks import ITEM
from tests.llm.test_lines import BLANK, deleted

BENCH = "item_id long, text string"


def folder(spark, tmp_path, rows):
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    rows = [*corpus(11), (3000, "A leak: " + ITEM), (3001, "12 34 56")]
    d = folder(spark, tmp_path, rows)
    docs = start = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources"]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = f(spark, docs, d)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        if i < 4:
            assert docs.columns == start.columns
        if i == 0:
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {1000, 1001, 1002, 3001}
        if i == 1:
            assert all(words(r.text) for r in after) and sum(len(r.text) for r in after) < sum(len(r.text) for r in before)
        if i == 2:
            assert len(after) == len({c for _, _, c in brute([(r.doc_id, r.text) for r in before])})
        if i == 3:
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {3000}
    assert docs.count() == len(before) and all(r.taken == r.size * r.repeats for r in docs.collect())


def cut_lines(rows):
    """The texts without what test_lines' brute force deletes, line by line; documents that lose their last word go."""
    gone = deleted(rows, lambda x: (x[0], x[2]))
    out = []
    for d, t in rows:
        own = gone.get((d, t), set())
        nth, kept = -1, []
        for line in (t or "").split("\n"):
            word = bool(line.strip(BLANK))
            nth += word
            if not (word and nth in own):
                kept.append(line)
        if not own or any(x.strip(BLANK) for x in kept):
            out.append((d, "\n".join(kept)))
    return out


def test_run_like_brute_force(spark, tmp_path):
    """run() against plain Python for every stage: which documents are left, and with how many words."""
    rows = [r for r in dict.fromkeys(corpus(21)) if r[0] is not None] + [(3000, "A leak: " + ITEM), (3001, "12 34 56")]
    d = folder(spark, tmp_path, rows)
    left = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    left = cut_lines(left)
    least = {c for _, n, c in brute(left) if n}
    left = [(i, t) for i, t in left if str(i) in least and ITEM not in t]
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(words(t))) for i, t in left)
    assert all(r.taken == r.size * r.repeats for r in got)
    total = sum(r.size for r in got)
    assert all(r.source_size == total and abs(r.target - total) < 1e-6 for r in got), "one source takes its own size"
    assert sum(r.taken for r in got) == total


def test_labels_that_the_text_contradicts_go(spark, tmp_path):
    rnd = random.Random(2)
    lexicon = {k: ["".join(rnd.choice(a) for _ in range(rnd.randint(2, 7))) for _ in range(200)] for k, a in (("xx", "abcdefgh"), ("yy", "mnopqrst"))}
    rows = [(i, " ".join(rnd.choices(lexicon[k], k=40)), k) for i in range(60) for k in [("xx", "yy")[i % 2]]]
    wrong = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows += [(wrong, " ".join(rnd.choices(lexicon["xx"], k=40)), "yy"), (300, " ".join(rnd.choices(lexicon["xx"], k=40)), None)]
    docs = table(spark, rows)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {wrong}


def test_run_and_empty(spark, tmp_path):
    d = folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, d).collect() == []


def test_ten_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_nothing_else_imports_the_subpackage():
    code = "import sys; import chronoweave.catalog, chronoweave.operators.reason, chronoweave.streaming.follow; sys.exit(any(m.startswith('chronoweave.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
    assert importlib.import_module("__spark_entry__").queries().keys() >= queries.QUERIES.keys()
