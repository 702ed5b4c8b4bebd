"""Cross-parsing against plain longest matches, and held-out accuracy on the driver's documents."""

import random
import zlib

from pyspark.sql import functions as F

from chronoweave.llm import language
from tests.conftest import SF
from tests.llm.common import table


def brute(text, known):
    """Phrases of a text: longest matches in known, or single symbols."""
    count = i = 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in known:
            n += 1
        i += max(1, n - 1)
        count += 1
    return count


def test_phrases_like_longest_matches():
    """Texts over many blocks, whose phrases run across their bounds."""
    rnd = random.Random(2)
    make = lambda n, a: "".join(rnd.choice(a) for _ in range(n))
    known = {"a": make(300, "xyz"), "b": make(2000, "yzuv") + "x" * 900, "c": "y", "d": "", "e": make(400, "xyzuvwst") * 2}
    m = language.model_of(known)
    texts = [make(rnd.randint(0, 1500), "xyzuvwq") for _ in range(40)] + ["x" * 5000, (known["e"] + "q") * 9, known["b"], "xyz" * 1000, "q" * 600]
    got = language.phrases([language.symbols_of(t, m.symbol)[0] for t in texts], m)
    assert got.tolist() == [[brute(t, known[k]) for k in m.languages] for t in texts]


def test_scripts_of_many_letters(spark):
    """Every letter counts, however many there are: two languages of Han letters, one of kana among them, beside Latin and Cyrillic."""
    rnd = random.Random(5)
    han = [chr(0x4E00 + i) for i in range(3000)]

    def lexicon(letters, n, size):
        return ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, size))) for _ in range(n)]

    kana = [chr(0x3041 + i) for i in range(80)]
    words = {"en": lexicon("abcdefghijklmnopqrstuvwxyz", 400, 7), "ru": lexicon([chr(0x430 + i) for i in range(32)], 400, 7), "zh": lexicon(han[:2500], 900, 3)}
    words["ja"] = lexicon(kana, 300, 4) + lexicon(han[500:], 300, 2)
    rows = [(i, " ".join(rnd.choices(words[k], k=60)), k) for i in range(240) for k in [("en", "ru", "zh", "ja")[i % 4]]]
    held = [r for r in language.predict(table(spark, rows)).collect() if r.held_out]
    right = {d: k for d, _, k in rows}
    assert len(held) > 50 and sum(right[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_a_language_with_little_text_is_no_worse_off():
    rnd = random.Random(6)
    lexicon = {k: ["".join(rnd.choice(a) for _ in range(rnd.randint(2, 7))) for _ in range(300)] for k, a in (("big", "abcdefghijklmnop"), ("small", "ijklmnopqrstuvwx"))}
    m = language.model_of({"big": " ".join(rnd.choices(lexicon["big"], k=3000)), "small": " ".join(rnd.choices(lexicon["small"], k=150))})
    for k in lexicon:
        texts = [language.symbols_of(" ".join(rnd.choices(lexicon[k], k=40)), m.symbol)[0] for _ in range(50)]
        best = language.normalised(language.phrases(texts, m), m.learnt).argmin(1)
        assert sum(m.languages[i] == k for i in best) >= 48


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, " 12 !? \n"), (4, "the " * 50_000), (None, "the end of the day"), (5, "Ж"), (5, "Ж")]
    train = [(100 + i, "the cat of the house and the dog" if i % 2 else "le chat de la maison et le chien", "en" if i % 2 else "fr") for i in range(40)]
    out = language.predict(table(spark, odd + train)).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[None][0] == "en" and got[5][0] in ("en", "fr") and len(out) == 47
    a, b, c = [i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 3 == 1][:3]
    docs = table(spark, [*odd, *train, (a, "le chat de la maison et le chien", "en"), (b, "le chat de la maison", None), (c, "the dog", "xx")]).withColumn("lang_pred", F.lit(1)).withColumn("Score", F.lit(2))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted([4, 0, 5, 5, b, c, *range(100, 140)])
    assert language.predict(table(spark, [])).collect() == []
    assert {r.lang_pred for r in language.predict(table(spark, [(1, "words", None)])).collect()} == {"und"}
