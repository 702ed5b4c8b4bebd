"""Licence scans by sentence rules: known sentences become identifiers, identifier sequences are matched against ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.llm.license_data import RULES, SENTENCES
from chronoweave.llm.staging import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Identifiers count from 1, in the order of SENTENCES.
IDS = {key: i for i, key in enumerate(SENTENCES, 1)}
#: Sentences of so many words are known wherever they stand, shorter ones only as whole pieces of text.
LONG = 12
UNKNOWN = "unknown-licence"


def anchors(sentences: list[str]) -> list[str]:
    """Beginnings of words, six letters each, of which every sentence has one: each time that in most of the rest, of ties the one of the longest word."""
    left, out = list(sentences), []
    while left:
        counts: dict[str, tuple] = {}
        for s in left:
            for w in {w for w in s.split() if len(w) >= 6 and w.isalpha()}:
                counts[w[:6]] = (counts.get(w[:6], (0,))[0] + 1, len(w), w)
        out.append(max(counts, key=lambda w: counts[w]))
        left = [s for s in left if out[-1] not in s]
    return out


ANCHORS = anchors(list(SENTENCES.values()))

#: In turn, the changes that normalise a lower-cased text to pieces, each between line ends of its own; ! is a blank line or one of comment marks.
STEPS = (
    (r"[^a-z0-9.!?;:\n]+", " "),
    (r"[!?;:.]+[ \n]", "\n"),
    (r"\n[^a-z0-9\n]*\n[^a-z0-9]*", "\n_\n"),
    (r"[^a-z0-9._\n]+", " "),
    (r"[ .]*\n[ .]*", "\n\n"),
)


def _pattern() -> str:
    """One pattern for all known sentences, the longest first; spaces of a sentence may be the ends of pieces."""
    whole, inside = [], []
    for s in sorted(SENTENCES.values(), key=lambda s: (-len(s), s)):
        own = s.replace(".", r"\.").replace(" ", "(?: |\n\n)")
        (inside if s.count(" ") + 1 >= LONG else whole).append(own)
    return f"[ \n](?:{'|'.join(inside)})[ \n]|\n(?:{'|'.join(whole)})\n"


PATTERN = _pattern()


def _rule(sequence: str) -> str:
    """The pattern of a rule over identifiers written as <1><2>."""
    out = ""
    for part in sequence.split():
        one = "|".join(f"<{IDS[k]}>" for k in part.rstrip("?").split("|"))
        out += f"(?:{one})" + ("?" if part.endswith("?") else "")
    return out


PATTERNS = [(name, _rule(sequence)) for name, sequence in RULES] + [(UNKNOWN, "<[0-9]+>")]


def known_sentences(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order.

    Pieces end at a line's end, or at . ! ? ; : before white space. A sentence
    is a piece, or pieces in a row, as where it is wrapped or has a ; or : in
    it; LONG words or more are also known within a piece, as after a title
    or a copyright notice on the same line. Blank lines, also of comment
    marks only, end a sentence.
    """
    s = F.concat(F.lit("\n"), F.translate(text, UPPER, LOWER), F.lit("\n"))
    for pattern, to in STEPS:
        s = F.regexp_replace(s, pattern, to)
    found = F.regexp_extract_all(s, F.lit(PATTERN), F.lit(0))
    names = F.create_map(*[F.lit(x) for key, s in SENTENCES.items() for x in (s, IDS[key])])
    return F.transform(found, lambda x: F.element_at(names, F.regexp_replace(F.regexp_replace(x, r"^[ \n]+|[ \n]+$", ""), r"\n+", " ")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, known, sequence, licenses, n_matches), a row for each row of docs.

    known: how many known licence sentences the text has; sequence: their
    identifiers in order, with spaces between; licenses: what the rules find,
    each once, by code point, with commas between; n_matches: rule matches.
    Known sentences that no rule consumes are 'unknown-licence', one match
    each. Of two sentences that begin alike the longer counts. No shuffle:
    every whole text is scanned where it lies, if it has a word of ANCHORS, as
    every known sentence has.

    Null or empty text: 0, '', '', 0. Null ids, repeated rows and other columns
    pass, very long texts take time in proportion; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    may = F.translate(text, UPPER, LOWER).rlike("|".join(ANCHORS))
    df = docs.select("doc_id", F.when(may, known_sentences(text)).otherwise(F.array().cast("array<int>")).alias("ids"))
    df = df.select("doc_id", "ids", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">"))), "").alias("left"))
    left, counts, names = F.col("left"), [], []
    for name, pattern in PATTERNS:
        hit = F.regexp_count(left, F.lit(pattern))
        counts.append(hit)
        names.append(F.when(hit > 0, F.lit(name)))
        left = F.regexp_replace(left, pattern, "#")
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    some = lambda x, none: F.when(F.size("ids") > 0, x).otherwise(F.lit(none))
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("known"),
        F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("sequence"),
        some(F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), ","), "").alias("licenses"),
        some(total.cast("long"), 0).cast("long").alias("n_matches"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "E'" + s.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "''") + "'"
    text = f"E'\\n' || translate(coalesce(text, ''), '{UPPER}', '{LOWER}') || E'\\n'"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'g')"
    pairs = ", ".join(f"'{s}': {IDS[key]}" for key, s in SENTENCES.items())
    steps = []
    for i, (_, pattern) in enumerate(PATTERNS):
        steps.append(f"r{i} AS (SELECT *, regexp_replace(seq{i}, '{pattern}', '#', 'g') AS seq{i + 1}, len(regexp_extract_all(seq{i}, '{pattern}')) AS n{i} FROM {'s' if not i else f'r{i - 1}'})")
    n = len(PATTERNS)
    names = ", ".join(f"CASE WHEN n{i} > 0 THEN '{name}' END" for i, (name, _) in enumerate(PATTERNS))
    return rf"""
WITH plain AS (SELECT doc_id, {text} AS t FROM documents),
f AS (
  SELECT doc_id, list_transform(regexp_extract_all(t, {quote(PATTERN)}), lambda x: MAP {{{pairs}}}[regexp_replace(trim(x, E' \n'), E'\n+', ' ', 'g')]) AS ids
  FROM plain),
s AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS seq0 FROM f),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS known, coalesce(array_to_string(ids, ' '), '') AS sequence,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ','), '') AS licenses,
       ({" + ".join(f"n{i}" for i in range(n))})::BIGINT AS n_matches
FROM r{n - 1}
"""


OP5_SQL = _sql()
