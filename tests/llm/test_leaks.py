"""Decontamination of plain, re-parameterised and clean texts."""

import pytest

from chronoweave.llm import leaks
from tests.conftest import SF
from tests.llm.common import table

ITEM = "If a train leaves for Boston at 60 mph and another train leaves Boston at 45 km later, how far has the train gone in 60 minutes when the driver calls Alice about it and then waits for Alice again"


def find(spark, texts, items=((1, ITEM),)):
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in leaks.matches(table(spark, list(enumerate(texts))), bench).collect()}


def test_like_text_search(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " ".join(t.lower().split())
    want = {(d.doc_id, b.item_id) for b in bench.collect() for d in docs.collect() if flat(b.text) in flat(d.text)}
    got = {(r.doc_id, r.item_id) for r in leaks.matches(docs, bench).collect()}
    assert want and got == want


def test_re_parameterised(spark):
    other = ITEM.replace("Boston", "Denver").replace("60", "75").replace("45", "30").replace("Alice", "Bob")
    mixed = ITEM
    for x in ("Denver", "Oslo"):
        mixed = mixed.replace("Boston", x, 1)
    mixed = mixed.replace("60", "75", 1).replace("Alice", "Bob", 1)
    clean = "Some other words that have nothing to do with it, " * 30
    got = find(spark, ["before it. " + ITEM + " after it", f"Well. {other}.", f"Well. {mixed}.", clean, None, "", "one"])
    assert {(0, 1), (1, 1)} <= set(got) and {d for d, _ in got} == {0, 1}
    assert got[1, 1].consistency == 1.0 and got[0, 1].begin >= 2
    assert got[0, 1].coverage == 1.0


def test_edited_partial_and_scattered(spark):
    own = ITEM.split()
    edited = [*own]
    edited[15] = "changed"
    scattered = " filler words stand here between pieces of it ".join(" ".join(own[i : i + 6]) for i in range(0, len(own), 6))
    got = find(spark, [" ".join(edited), " ".join(own[: len(own) // 3]), scattered * 2])
    assert set(got) == {(0, 1)}


@pytest.mark.parametrize(("texts", "items"), [([], [(1, ITEM)]), ([ITEM], []), ([ITEM, None], [(1, None), (None, ""), (2, "too short")])])
def test_odd_tables(spark, texts, items):
    assert find(spark, texts, items) == {}


def test_remove(spark):
    docs = table(spark, [(1, ITEM), (2, "clean text of its own"), (None, None), (3, ITEM + " " + ITEM), (2, "clean text of its own")])
    out = leaks.remove_leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "2", "None"]


def test_alignments_are_judged_apart(spark):
    boxes = "Then the red box holds 3 apples, the red box holds 8 apples, the red box holds 12 apples, the red box holds 40 apples and nobody knows why"
    variant = lambda a, b, c: ITEM.replace("Boston", a).replace("60", b).replace("45", b + "5").replace("Alice", c)
    row = [variant("Denver", "75", "Bob"), variant("Oslo", "81", "Eve"), variant("Rome", "99", "Kim")]
    texts = ["Well, " + boxes, ITEM + " " + row[0], " ".join(row[:2]), " ".join(row), "Then the red box is here. " * 30]
    got = find(spark, texts, [(1, ITEM), (2, boxes)])
    assert {(0, 2), (1, 1), (2, 1), (3, 1)} == set(got)
    assert all(r.coverage >= leaks.COVERED and r.consistency >= leaks.CONSISTENT for r in got.values())


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Ann has 3 more apples. Tom gives 2 apples away. How many are left?"
    other = "Sara has 9 apples. Luis has 4 more apples. Sara gives 6 apples away. How many are left?"
    mixed = "Sara has 9 apples. Luis has 4 more apples. Omar gives 6 pears home. Where were they?"
    got = find(spark, [item, "Read this.\n" + other + "\nThe end.", mixed], [(1, item)])
    assert set(got) == {(0, 1), (1, 1)} and got[1, 1].consistency == 1.0
    assert find(spark, ["Well, " + item.replace("Tom has", "tom has")], [(1, item)])[0, 1].coverage >= leaks.COVERED


def test_names_of_several_words(spark):
    item = "Alice Smith lives in New York with two cats and pays the rent to Robert Brown every month. How much does Alice Smith pay Robert Brown in a year?"
    other = "Bob Jones lives in Boston with two cats and pays the rent to Ann every month. How much does Bob Jones pay Ann in a year?"
    got = find(spark, [other, item, "Yesterday we said: " + other], [(1, item)])
    assert set(got) == {(0, 1), (1, 1), (2, 1)} and got[0, 1].consistency == 1.0 and got[0, 1].begin == 0
    assert got[0, 1].finish == len(other.split()) and got[2, 1].begin == 3


def test_short_and_bare_items(spark):
    """Word for word what has few tokens or literals; too little evidence is no leak of a template."""
    items = [(1, "What is 7 times 8"), (2, "Capital of France?"), (3, "1 2 3 5 8 13 21 34 55"), (4, "Barack Hussein Obama II"), (5, "Paris")]
    texts = ["what is 9 times 6 and more", "She asked: what is 7 times 8? He knew.", "the capital of France, is it?", "capital of Spain and Paris", "count 1 2 3 5 8 13 21 34 55 on", "count 2 3 4 6 9 14 22 35 56 on", "as Barack Hussein Obama II said", "as Barack Hussein Obama I said", "What is 7 times 8. " * 3]
    assert set(find(spark, texts, items)) == {(1, 1), (2, 2), (4, 3), (6, 4), (8, 1)}


def test_slots_map_one_to_one(spark):
    """Different values of the item that all become one are no consistent variant."""
    item = "the first box holds 3 apples and then the second bag has 8 pears and then the third sack has 12 plums and then the last cart has 40 figs at 9 cents"
    same = item
    for x in ("3", "8", "12", "40", "9"):
        same = same.replace(f" {x} ", " 7 ")
    moved = item.replace(" 3 ", " 4 ").replace(" 8 ", " 5 ").replace(" 12 ", " 6 ").replace(" 40 ", " 70 ").replace(" 9 ", " 11 ")
    got = find(spark, [same, moved, item], [(1, item)])
    assert set(got) == {(1, 1), (2, 1)}


def test_very_long_text_and_salted_join(spark, monkeypatch):
    filler = "words that say nothing at all about it " * 40_000
    texts = [filler + ITEM + " " + filler, filler]
    assert set(find(spark, texts)) == {(0, 1)}
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 0)
    assert set(find(spark, texts)) == {(0, 1)}
