"""Sections, windows, table entries and pages on small texts; brute force for windows."""

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import chunk, clean, retrieve

TABLE = "Satellites of Saturn:\n3\nI\nMimas\n1789\nx\nold book\nLIII\nAegaeon\nS/2008 S1\n2008\nx\nMPEC 2009-E12\nS/2019 S1\n2019\nx\nMPEC 2021-W14\nnoise\n"


def test_table_entries(spark):
    assert [e[3:] for e in chunk.table_entries(TABLE)] == [("Mimas", "", "1789", "old book"), ("Aegaeon", "S/2008 S1", "2008", "MPEC 2009-E12"), ("S/2019 S1", "S/2019 S1", "2019", "MPEC 2021-W14")]
    df = spark.createDataFrame([("a", TABLE), ("b", None), ("c", "nothing")], "source_id string, text string")
    got = {r.fact_id: r.text for r in chunk.count_facts(chunk.satellite_entries(df)).collect()}
    assert set(got) == {"saturn_satellite_count_current", "saturn_satellite_count_as_of_2009_03", "saturn_satellite_count_as_of_2021_11"}
    assert "had 2 confirmed" in got["saturn_satellite_count_as_of_2009_03"] and "through MPEC 2021-W14 (S/2019 S1)" in got["saturn_satellite_count_as_of_2021_11"]


@pytest.mark.parametrize(("size", "overlap"), [(140, 30), (10, 3), (5, 5), (7, 0)])
def test_windows_cover_all_words(spark, size, overlap):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, size, size + 1, 3 * size + 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = chunk.word_windows(df, size, overlap).orderBy("id", "window").collect()
    step = max(1, size - overlap)
    for i, t in enumerate(texts):
        w, own = t.split(), [r.text.split() for r in got if r.id == i]
        assert own[-1] == w[(len(own) - 1) * step :] and all(x == w[k * step : k * step + size] for k, x in enumerate(own))


def test_page(spark):
    html = "<html><head><title>A &amp; B | Site</title><style>p{}</style></head><body><nav>menu</nav><h1>Top</h1><p>one<br>two <b>three</p><script>var x='</p>';</script><footer>end</footer></body></html>"
    r = clean.clean(spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert r[0].title == "A & B" and "menu" not in r[0].text and "end" not in r[0].text and r[0].text.startswith("A & B\n\nA & B | Site\n\nTop\n\none two three")
    assert r[1].title == "2" and len(r[0].content_hash) == 64


def test_greedy_cap(spark):
    rows = [(f"c{i:02d}", f"s{i % 3}", float((i * 7) % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id string, source_id string, score double")
    for top, per in ((5, 2), (12, 4), (0, 3), (50, 1)):
        want, seen = [], {}
        for c, s, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
            if seen.get(s, 0) < per:
                seen[s] = seen.get(s, 0) + 1
                want.append(c)
                if len(want) >= top:
                    break
        assert [r.chunk_id for r in retrieve.cap_top(df, top, per).orderBy("rank").collect()] == want


def test_pack_stops_at_the_first_block_too_many(spark):
    df = spark.createDataFrame([(i, "s", "h", "u", 1.0, "x" * n) for i, n in ((1, 10), (2, 500), (3, 5))], "rank int, source_id string, section string, url string, score double, text string")
    r = retrieve.pack(df, 200).collect()[0]
    assert r.n == 1 and r.context.startswith("[R1 | source_id=s | section=h | score=1.00]\nURL: u\nxxxxxxxxxx")
    assert df.select(retrieve.sufficient(F.lit("short"), F.lit(1)).alias("c")).first().c == "insufficient context"
