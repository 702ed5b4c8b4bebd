"""Small tables and plain word handling for the tests."""

import random
import re

from chronoweave.llm.textops import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    found = re.findall(WORD, text or "")
    return [w.translate(LOWER) for w in found] if lower else found


def table(spark, rows):
    """Documents from (doc_id, text[, lang, source]), with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", 0, 1, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed=1, n=60):
    """Texts with exact copies, near copies, shared lines and passages, and odd cases."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(3, 12)))
    passage = "\n".join(line() for _ in range(12))
    rows = []
    for i in range(n):
        text = "\n".join(line() for _ in range(rnd.randint(1, 12)))
        if i % 5 == 1:
            text = rows[rnd.randrange(len(rows))][1] or ""
        elif i % 5 == 2 and len(rows[-2][1].split()) > 20:
            own = rows[-2][1].split(" ")
            for _ in range(rnd.randint(1, 4)):
                own[rnd.randrange(len(own))] = word()
            text = " ".join(own)
        elif i % 7 == 3:
            text = text + "\n" + passage + "\n" + line()
        rows.append((i, text))
    rows += [(1000, None), (1001, ""), (1002, " \n\t\x0b "), (1003, "One two"), (1004, "one TWO"), (1005, "x"), (1006, "a b c d e"), (1007, "é É ñ \x85 z"), (1008, "loop " * 4000), (None, "null id text of seven words here"), (None, None)]
    rows += [rows[5], rows[5]]
    return rows
