"""Licence sequences on small texts."""

import textwrap

from chronoweave.llm import licenses
from tests.llm.common import corpus, table
from tests.oracle import same_rows

S, IDS = licenses.SENTENCES, licenses.IDS
GRANT, NOTICE, AS_IS = (S[k] for k in ("mit.grant", "mit.notice", "mit.warranty"))
MIT = f"Copyright someone.\n{GRANT.capitalize()}:\n\n{NOTICE}.\n{AS_IS}."
BSD = ("bsd.use", "bsd.source", "bsd.binary", "bsd.names")
BSD3 = "\n".join(f"* {S[k]}." for k in BSD)


def ids(*keys):
    return " ".join(str(IDS[k]) for k in keys)


def test_rules(spark):
    o, p, q = (S[k] for k in BSD[:3])
    texts = {
        1: "Released under the MIT License.",
        2: MIT,
        3: BSD3,
        4: BSD3.rsplit("\n", 1)[0],
        5: "Licensed under the Apache License, Version 2.0.\nAnd text. This work is licensed under the GNU General Public License, version 3.",
        6: f"{q}.\n{p}.\n{o}.",
        7: "A licence is mentioned. Software too. Nothing is known.",
        8: f"{o}. One. Two. {p}. {q}.",
        9: f"{o}. One. Two. Three. Four. {p}. {'Five. ' * 50} {q}.",
        10: "LICENSED under CC BY-NC 4.0!",
        11: None,
        12: "",
        13: f"{o}. {p}. {AS_IS}. {q}.",
    }
    got = {r.doc_id: r for r in licenses.scan(table(spark, list(texts.items()))).collect()}
    found = {k: (r.licenses, r.n_matches) for k, r in got.items()}
    assert found[1] == ("MIT", 1) and found[2] == ("MIT", 1) and found[3] == ("BSD-3-Clause", 1) and found[4] == ("BSD-2-Clause", 1)
    assert found[5] == ("Apache-2.0,GPL-3.0-only", 2)
    assert found[6] == ("unknown-licence", 3), "sentences out of order match no rule"
    assert found[7] == found[11] == found[12] == ("", 0)
    assert found[8] == found[9] == ("BSD-2-Clause", 1) and found[10] == ("CC-BY-NC-4.0", 1)
    assert found[13] == ("unknown-licence", 4), "another known sentence between ends a match"
    assert got[2].sequence == ids("mit.grant", "mit.notice", "mit.warranty") and got[5].known == 2


def test_odd_rows(spark):
    rows = corpus(8)
    got = licenses.scan(table(spark, [*rows, (2000, "word " * 300_000 + MIT)])).collect()
    assert len(got) == len(rows) + 1 and {(r.known, r.licenses) for r in got if r.doc_id != 2000} == {(0, "")}
    assert [r.licenses for r in got if r.doc_id == 2000] == ["MIT"]
    assert licenses.scan(table(spark, [])).collect() == []


def test_every_known_sentence_is_found_alone(spark):
    docs = table(spark, [(IDS[k], f"{s.capitalize()}.") for k, s in S.items()])
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert all(any(a in s for a in licenses.ANCHORS) for s in S.values())
    assert all(got[i].known == 1 and got[i].sequence == str(i) and got[i].n_matches == 1 for i in IDS.values())


def test_wrapped_notices(spark):
    wrap = lambda k, mark="": "\n".join(mark + x for x in textwrap.wrap(S[k].capitalize() + ".", 70))
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(wrap(k) for k in ("mit.grant", "mit.notice", "mit.warranty")) + "\n"
    apache = "/*\n" + wrap("apache.licensed", " * ") + "\n *\n" + wrap("apache.use", " * ") + "\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n" + wrap("apache.basis", " * ") + "\n */\ncode"
    gpl = wrap("gpl.later3", "# ") + "\n#\n" + wrap("gpl.hope", "# ").replace("any warranty", "any warranty;").replace("any\n# warranty", "any\n# warranty;")
    bsd = "\n\n".join(f"{i}. {wrap(k)}" if i else wrap(k).rstrip(".") + ":" for i, k in enumerate(BSD))
    parted = "Licensed under the\n\nMIT License\n\nsoftware"
    lines = "Licensed under the Apache License,\r\nVersion 2.0 (the \"License\");\r\nyou may not use this file except in\r\ncompliance with the License."
    one_line = f"MIT License Copyright (c) 2020 Someone {GRANT}: {NOTICE}. {AS_IS.upper()}."
    gpl_as_it_is = (
        "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n"
        "    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n"
        "    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n"
        "    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU General Public License for more details.\n"
    )
    texts = [mit, apache, gpl, bsd, parted, lines, "A title\nReleased under the MIT License\nand more", wrap("mpl.form", "// ").replace("license v ", "license, v. "), one_line, gpl_as_it_is, "* Licensed under the Apache License, Version 2.0\n* You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"]
    got = {r.doc_id: r for r in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    want = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "BSD-3-Clause", "", "Apache-2.0", "MIT", "MPL-2.0", "MIT", "GPL-3.0-or-later", "Apache-2.0,unknown-licence"]
    assert [got[i].licenses for i in range(len(texts))] == want
    assert [got[i].known for i in range(len(texts))] == [3, 4, 2, 4, 0, 2, 1, 1, 3, 3, 2] and got[2].n_matches == got[9].n_matches == 1
    assert got[5].sequence == ids("apache.header", "apache.use")


def test_same_as_sql_on_odd_and_wrapped_texts(spark, tmp_path):
    wrap = lambda k, mark, n: "\n".join(mark + x for x in textwrap.wrap(S[k].capitalize() + ".", n))
    keys = sorted(S)
    rows = [*corpus(9), *((3000 + i, wrap(k, ("", "// ", " * ", "#\t")[i % 4], 30 + i) + ("\n\n", "\n", " ", "; ")[i % 3] + wrap(keys[i - 1], "", 50)) for i, k in enumerate(keys))]
    seen, once = set(), []
    for d, t in rows:
        if d not in seen:
            seen.add(d), once.append((d, t))
    table(spark, once).write.parquet(f"{tmp_path}/documents.parquet")
    same_rows(licenses.op5(spark, str(tmp_path)), licenses.OP5_SQL, str(tmp_path), tables=["documents"])
