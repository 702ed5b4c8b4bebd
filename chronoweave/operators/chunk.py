"""Documents to tagged chunks: headings, sections, overlapping word windows, tags, and count facts from satellite tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.functions import text as T

HEADING = r"^[A-Z][A-Za-z0-9 ,:'()/.-]+$"
WIKI = r"^=+\s*(.*?)\s*=+$"
MIN_CHARS = 80
MPEC = r"\bMPEC\s+([0-9]{4})-([A-Z])[0-9]+\b"
# Half months of circular numbers, two letters a month without I.
HALF_MONTHS = "ABCDEFGHJKLMNOPQRSTUVWXY"
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def heading(line: Column) -> Column:
    """The heading a line is, or null: text between = signs, or a short line of plain characters that begins with a capital."""
    t = F.btrim(line, F.lit(T.SPACE))
    inner = F.regexp_extract(t, WIKI, 1)
    return F.when(t.rlike(WIKI), F.nullif(inner, F.lit(""))).when((F.length(t) <= 80) & t.rlike(HEADING), t)


def sections(docs: DataFrame, key: str = "doc_id", fallback: Column | None = None) -> DataFrame:
    """(key, section, heading, text) of docs(key, text): lines under their headings; sections without lines go.

    A document is one row's array all along, so nothing is shuffled.
    """
    fallback = F.col(key).cast("string") if fallback is None else fallback
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.struct(F.btrim(x, F.lit(T.SPACE)).alias("s"), heading(x).alias("h"))), lambda x: x["s"] != "")
    df = docs.select(key, fallback.alias("_f"), F.btrim("text", F.lit(T.SPACE)).alias("_t"), lines.alias("_l"))
    heads = F.filter(F.transform("_l", lambda x, i: F.struct(i.alias("i"), x["h"].alias("h"))), lambda x: x["h"].isNotNull())
    df = df.withColumn("_h", F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.col("_f").alias("h"))), heads))
    stop = lambda k: F.coalesce(F.get("_h", k + 1)["i"], F.size("_l"))
    part = lambda x, k: F.array_join(F.transform(F.slice(F.col("_l"), x["i"] + 2, F.greatest(stop(k) - x["i"] - 1, F.lit(0))), lambda y: y["s"]), "\n")
    cut = F.filter(F.transform("_h", lambda x, k: F.struct(x["h"].alias("heading"), part(x, k).alias("text"))), lambda x: x["text"] != "")
    whole = F.array(F.struct(F.col("_f").alias("heading"), F.col("_t").alias("text")))
    df = df.withColumn("_c", cut)
    cut = F.col("_c")
    return df.select(key, F.posexplode(F.when(F.size(cut) > 0, cut).otherwise(whole)).alias("section", "s")).select(key, "section", "s.heading", "s.text")


def word_windows(df: DataFrame, size: int = 140, overlap: int = 30) -> DataFrame:
    """df with one row for each window of its text's words: windows of size words every size - overlap, the last one ending with the text."""
    step = max(1, size - overlap)
    df = df.withColumn("_w", T.words(F.col("text")))
    last = F.when(F.size("_w") <= size, 0).otherwise(F.ceil((F.size("_w") - size) / step))
    # windows are cut before rows are made of them, so that a row has its own words only
    cut = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.array_join(F.slice("_w", i * step + 1, size), " "))
    return df.select(*[c for c in df.columns if c not in ("text", "_w")], F.posexplode(cut).alias("window", "_t")).withColumn("text", F.col("_t")).drop("_t")


def chunks(docs: DataFrame, size: int = 140, overlap: int = 30, entities=T.CHUNK_ENTITIES, hints=T.PREDICATE_HINTS) -> DataFrame:
    """Chunks of docs(source_id, title, text): numbered within the source over sections and windows; those under 80 characters do not count."""
    cut = sections(docs, "source_id", F.coalesce("title", "source_id")).withColumnRenamed("heading", "section_heading")
    cut = word_windows(cut, size, overlap).where(F.length("text") >= MIN_CHARS)
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("section", "window")) - 1
    out = cut.withColumn("nth", nth).join(docs.drop("text"), "source_id")
    return out.select(
        F.format_string("%s_%04d", "source_id", "nth").alias("chunk_id"),
        *docs.drop("text").columns,
        F.col("section_heading").alias("section"),
        "text",
        T.entity_tags(F.col("text"), entities).alias("entities"),
        T.predicate_hints(F.col("text"), hints).alias("predicate_hints"),
        F.greatest(F.size(T.words(F.col("text"))), F.lit(1)).alias("tokens_estimate"),
        F.lit("text").alias("content_type"),
        "nth",
    )


def circular_month(reference: Column) -> Column:
    """Year * 100 + month of a circular's number, month 0 for a letter of no half month; null without one."""
    year, letter = F.regexp_extract(reference, MPEC, 1), F.regexp_extract(reference, MPEC, 2)
    month = F.floor((F.instr(F.lit(HALF_MONTHS), letter) + 1) / 2)
    return F.when(year != "", year.try_cast("int") * 100 + month.cast("int"))


def cumulative_counts(entries: DataFrame, key: str, when: Column, pos: str = "pos") -> DataFrame:
    """(key, at, n, last): for each time of a key, how many entries had come by then, entries without a time included, and the last entry of that time.

    Counted once a key and time, then summed in order.
    """
    e = entries.withColumn("at", when)
    undated = e.groupBy(key).agg(F.sum(F.when(F.col("at").isNull(), 1).otherwise(0)).alias("_u"))
    per = e.where("at IS NOT NULL").groupBy(key, "at").agg(F.count("*").alias("_n"), F.max(pos).alias("last"))
    run = F.sum("_n").over(Window.partitionBy(key).orderBy("at"))
    return per.withColumn("n", run).join(undated, key).select(key, "at", (F.col("n") + F.col("_u")).alias("n"), "last")


_ROMAN = re.compile(r"M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})")
_DESIGNATION = re.compile(r"S/\d{4}\s+[A-Z]\d+")
_HEADER = re.compile(r"^Satellites of ([A-Z][a-z]+):$")


def table_entries(text: str) -> list[tuple[str, int | None, int, str, str, str, str]]:
    """(planet, declared total, nth, name, designation, year, reference) of the rows of satellite tables, one value a line.

    A row is a Roman numeral, a name, perhaps a designation, a year, one value
    that is skipped and a reference; or a designation, a year, a skipped value
    and a reference.
    """
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
    heads = [i for i, x in enumerate(lines) if _HEADER.match(x)]
    out = []
    for i, stop in zip(heads, [*heads[1:], len(lines)][: len(heads)], strict=True):
        planet, at, total, nth = _HEADER.match(lines[i])[1], i + 1, None, 0
        if at < stop and re.fullmatch(r"[-+]?\d+", lines[at]):
            total, at = int(lines[at]), at + 1
        rows = lines[at:stop]
        at = 0
        while at < len(rows):
            numeral = bool(rows[at]) and bool(_ROMAN.fullmatch(rows[at]))
            if not numeral and not _DESIGNATION.fullmatch(rows[at]):
                at += 1
                continue
            if at + (4 if numeral else 3) >= len(rows):
                break
            name = rows[at + 1] if numeral else rows[at]
            at += 2 if numeral else 0
            named = bool(_DESIGNATION.fullmatch(rows[at]))
            designation, at = (rows[at], at + 1) if named else ("", at)
            if at + 2 >= len(rows):
                break
            out.append((planet, total, nth, name, designation, rows[at], rows[at + 2]))
            nth, at = nth + 1, at + 3
    return out


def satellite_entries(docs: DataFrame, key: str = "source_id") -> DataFrame:
    """table_entries of each document's text, in Arrow batches: the rows are read by a state machine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *e) for k, t in zip(b[key], b["text"], strict=True) for e in table_entries(t)]
            yield pd.DataFrame(rows, columns=[key, "planet", "total", "nth", "name", "designation", "year", "reference"]).astype({"total": "Int64"})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, planet string, total long, nth long, name string, designation string, year string, reference string")


def count_facts(entries: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, planet, fact_id, heading, text): the declared total and, for each month of the references, the entries available by then."""
    group = [key, "planet"]
    e = entries.withColumn("at", circular_month(F.col("reference")))
    heading = F.concat(F.lit("Structured Satellite Counts - "), "planet")
    total = e.where("total IS NOT NULL").groupBy(*group).agg(F.first("total").alias("total"))
    total = total.select(*group, F.concat(F.lower("planet"), F.lit("_satellite_count_current")).alias("fact_id"), heading.alias("heading"), F.concat(F.lit("Structured satellite count fact: "), "planet", F.lit(" has "), F.col("total").cast("string"), F.lit(" listed satellites or moons in this source's current table.")).alias("text"))
    undated = e.groupBy(*group).agg(F.sum(F.when(F.col("at").isNull(), 1).otherwise(0)).alias("u"))
    per = e.where("at IS NOT NULL").groupBy(*group, "at").agg(F.count("*").alias("c"), F.max_by(F.struct("reference", F.coalesce(F.nullif("designation", F.lit("")), "name").alias("label")), "nth").alias("last"))
    per = per.withColumn("n", F.sum("c").over(Window.partitionBy(*group).orderBy("at"))).join(undated, group)
    names = F.array(F.lit("Unknown"), *[F.lit(m) for m in MONTH_NAMES])
    year, month = F.floor(F.col("at") / 100).cast("string"), F.col("at") % 100
    said = F.concat(F.lit("As of "), F.get(names, month), F.lit(" "), year, F.lit(", "), "planet", F.lit(" had "), (F.col("n") + F.col("u")).cast("string"), F.lit(" confirmed moons or listed satellites in this source's discovery table. The count includes entries available through "), F.col("last.reference"), F.when(F.col("last.label") != "", F.concat(F.lit(" ("), F.col("last.label"), F.lit(")"))).otherwise(F.lit("")), F.lit(" and excludes later MPEC entries."))
    dated = per.select(*group, F.concat(F.lower("planet"), F.lit("_satellite_count_as_of_"), year, F.lit("_"), F.lpad(month.cast("string"), 2, "0")).alias("fact_id"), heading.alias("heading"), said.alias("text"))
    return total.unionByName(dated)


def all_chunks(docs: DataFrame, size: int = 140, overlap: int = 30, entities=T.CHUNK_ENTITIES, hints=T.PREDICATE_HINTS) -> DataFrame:
    """chunks(), and after them the sources' count facts as chunks: numbered <source>_fact_0000 on from the text chunks' number, with
    structured_fact_id; content_type tells them apart."""
    text = chunks(docs, size, overlap, entities, hints).withColumn("structured_fact_id", F.lit(None).cast("string"))
    begin = text.groupBy("source_id").agg((F.max("nth") + 1).alias("begin"))
    facts = count_facts(satellite_entries(docs.select("source_id", "text"))).join(docs.drop("text"), "source_id").join(begin, "source_id", "left")
    nth = F.coalesce("begin", F.lit(0)) + F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("fact_id").contains("_as_of_"), "fact_id")) - 1
    facts = facts.withColumn("nth", nth)
    facts = facts.select(
        F.format_string("%s_fact_%04d", "source_id", "nth").alias("chunk_id"),
        *docs.drop("text").columns,
        F.col("heading").alias("section"),
        "text",
        T.entity_tags(F.col("text"), entities).alias("entities"),
        T.predicate_hints(F.col("text"), hints).alias("predicate_hints"),
        F.greatest(F.size(T.words(F.col("text"))), F.lit(1)).alias("tokens_estimate"),
        F.lit("structured_fact").alias("content_type"),
        "nth",
        F.col("fact_id").alias("structured_fact_id"),
    )
    return text.unionByName(facts)
