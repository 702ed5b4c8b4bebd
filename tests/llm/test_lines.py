"""Line dedup against windows of lines."""

import random
import time

import pytest

from chronoweave.llm import lines
from tests.llm.common import corpus, table

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, k=2):
    """{(doc_id, text): positions of deleted lines}; rows alike count once."""
    seen, out = {}, {}
    docs = list(dict.fromkeys(rows))
    where = {}
    for d, t in docs:
        own = [x.strip(BLANK) for x in (t or "").split("\n")]
        own = [x for x in own if x]
        for p in range(len(own) - k + 1):
            where.setdefault(tuple(own[p : p + k]), []).append((d, t, p))
    return where, out, seen


def deleted(rows, order, k=2):
    where, _, _ = brute(rows, k)
    gone = {}
    for places in where.values():
        first = min(places, key=order)
        for d, t, p in places:
            if (d, t, p) != first:
                gone.setdefault((d, t), set()).update(range(p, p + k))
    return gone


def test_like_windows(spark):
    rows = [r for r in corpus(7) if r[0] is not None]
    got = lines.dedup_report(table(spark, rows)).collect()
    want = deleted(rows, lambda x: (x[0], x[2]))
    assert len(got) == len(rows)
    by = {d: v for (d, _), v in want.items()}
    for r in got:
        assert r.deleted == ",".join(map(str, sorted(by.get(r.doc_id, ())))), r.doc_id
        assert r.n_deleted == len(by.get(r.doc_id, ()))
    assert sum(r.n_deleted for r in got) > 50


def test_dedup_text(spark):
    rows = [(1, "a b\nc d\n\ne f"), (2, "x\na b\n\nc d\ny"), (3, "a b\nc d\ne f"), (4, "q\nr"), (5, None), (6, ""), (None, "a b\nc d")]
    docs = table(spark, rows)
    out = lines.dedup(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    # the row without an id comes first, so it keeps its lines
    assert got[None] == "a b\nc d"
    assert got[1] == "\ne f" and got[2] == "x\n\ny" and 3 not in got
    assert got[4] == "q\nr" and got[5] is None and got[6] == ""


def test_longer_runs(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "z\nb\nc\nd\nz"), (3, "a\nb\nc\nd\ne")]
    got = {r.doc_id: r.deleted for r in lines.dedup_report(table(spark, rows), 4).collect()}
    assert got == {1: "", 2: "", 3: "0,1,2,3,4"}


def longest_runs(rows, k=2):
    """{doc_id: runs} by comparing each place with every earlier one, line for line."""
    docs = sorted((d, [x for x in (y.strip(BLANK) for y in (t or "").split("\n")) if x]) for d, t in dict(rows).items())
    places = [(d, p) for d, own in docs for p in range(len(own))]
    texts, out = dict(docs), {d: [] for d, _ in docs}
    ends = dict.fromkeys(texts, 0)
    for at, (d, p) in enumerate(places):
        best, where = 0, None
        for fd, fp in places[:at]:
            a, b, n = texts[d], texts[fd], 0
            while p + n < len(a) and fp + n < len(b) and a[p + n] == b[fp + n]:
                n += 1
            if n > best:
                best, where = n, (fd, fp)
        if best >= k and p + best > ends[d]:
            out[d].append(f"{p}+{best}<{where[0]}.{where[1]}")
            ends[d] = p + best
    return {d: ",".join(r) for d, r in out.items()}


def test_later_holder_of_a_longer_run(spark):
    rows = [(1, "A\nB\nx"), (2, "A\nB\nC\ny"), (3, "A\nB\nC\nz")]
    got = {r.doc_id: (r.runs, r.n_runs, r.longest) for r in lines.dedup_report(table(spark, rows)).collect()}
    assert got == {1: ("", 0, 0), 2: ("0+2<1.0", 1, 2), 3: ("0+3<2.0", 1, 3)}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_runs_like_all_places(spark, k, monkeypatch):
    """With k = 2 frequent lines and blocks are joined as hot ones are."""
    monkeypatch.setattr(lines, "MANY", 3 if k == 2 else lines.MANY)
    monkeypatch.setattr(lines, "HOT", 40 if k == 2 else lines.HOT)
    rnd = random.Random(k)
    rows = [(i, "\n".join(rnd.choice("ab" if i % 3 else "abcde") for _ in range(rnd.randint(0, 25)))) for i in range(14)]
    rows += [(30 + i, "\n".join([f"p{n}" for n in range(i, 40 - 3 * i)] + [f"end {i}"])) for i in range(8)]
    got = {r.doc_id: r.runs for r in lines.dedup_report(table(spark, rows), k).collect()}
    assert got == longest_runs(rows, k)


def test_maximal_runs(spark):
    rnd = random.Random(3)
    line = lambda: rnd.choice("abcdefgh") * 2
    long = [f"line {i}" for i in range(77)]
    rows = [(i, "\n".join(line() for _ in range(rnd.randint(0, 30)))) for i in range(12)]
    rows += [(20, "\n".join(["x", *long, "y"])), (21, "\n".join([*long[:40], "z", *long[37:]])), (22, "\n".join(["u", *long, *long])), (23, "\n".join(["same"] * 50)), (24, "\n".join(long[9:20]))]
    got = {r.doc_id: r for r in lines.dedup_report(table(spark, rows)).collect()}
    want = longest_runs(rows)
    assert {d: r.runs for d, r in got.items()} == want
    assert want[21] == "0+40<20.1,41+40<20.38" and want[22] == "1+77<20.1,78+77<20.1" and want[23] == "1+49<23.0" and want[24] == "0+11<20.10"
    assert (got[21].n_runs, got[21].longest, got[21].n_deleted) == (2, 40, 80)


def test_long_single_lines(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n {long}\nd"), (3, f"e\n{long[:-4]}\nf"), (4, f"{long[:-4]}")]
    got = {r.doc_id: (r.deleted, r.runs) for r in lines.dedup_report(table(spark, rows)).collect()}
    assert got == {1: ("", ""), 2: ("1", "1+1<1.1"), 3: ("", ""), 4: ("", "")}
    assert {r.doc_id: r.text for r in lines.dedup(table(spark, rows)).collect()}[2] == "c\nd"


def test_documents_of_very_many_lines(spark):
    """In time proportional to the lines."""
    times = []
    for n in (30_000, 60_000):
        own = [f"line {i}" for i in range(n)]
        docs = table(spark, [(1, "\n".join(own)), (2, "new\n" + "\n".join(own) + "\nnew"), (3, "\n".join(own[::2]))])
        begin = time.time()
        got = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
        times.append(time.time() - begin)
        assert got[2] == "new\nnew" and got[1] == "\n".join(own) and got[3] == "\n".join(own[::2])
    assert times[1] < 2.5 * times[0]


def test_clashing_columns(spark):
    docs = table(spark, [(1, "a\nb\nc"), (2, "x\na\nb")]).selectExpr("doc_id", "text", "1 AS version", "2 AS cut", "3 AS __version", "4 AS pos", "5 AS runs")
    out = lines.dedup(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", 1, 2, 3, 4, 5), (2, "x", 1, 2, 3, 4, 5)]


def test_no_repeats_and_empty(spark):
    assert [r.n_deleted for r in lines.dedup_report(table(spark, [(1, "a\nb")])).collect()] == [0]
    assert lines.dedup_report(table(spark, [])).collect() == []
    assert lines.dedup(table(spark, [])).collect() == []
