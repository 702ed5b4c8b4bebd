"""Line dedup: a suffix array over line identifiers by prefix doubling, and the maximal repeated line runs that its longest common prefixes give, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.llm.staging import FEW_ROWS, read_table, spare, stage
from chronoweave.llm.textops import WORD

BLANK = " \t\n\x0b\x0c\r"
#: A run is deleted from so many lines on, or from so many words in one line.
MIN_LINES, MIN_WORDS = 2, 50
KEY = ["doc_id", "version"]
#: Keys of more than MANY rows and more than a HOT-th of all rows are joined by broadcast.
HOT, MANY = 1000, 50_000


def _key(docs: DataFrame):
    return docs.withColumn("version", F.xxhash64("text"))


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) != ""


def _place() -> Column:
    return F.struct("doc_id", "version", "pos")


def line_ids(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, pos, h1, h2, long): the lines with a word, by two hashes; pos counts them; long: min_words words or more."""
    parts = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    df = _key(docs.select("doc_id", "text")).select(*KEY, F.posexplode(parts).alias("pos", "line"))
    long = (F.length("line") >= 2 * min_words - 1) & (F.regexp_count("line", F.lit(WORD)) >= min_words)
    return df.select(*KEY, "pos", F.xxhash64("line").alias("h1"), F.hash("line", F.lit(1)).alias("h2"), long.alias("long"))


def _with_keys(rows: DataFrame, keys: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with staged keys(by, n: rows that have the key, ..). Keys of more than MANY rows and of more than a HOT-th of all
    are HOT at most: these are broadcast, so that no task gets all rows of one; the rest are joined by shuffle."""
    size = keys.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    limit = max(MANY, size.all // HOT)
    if size.most <= limit:
        return rows.join(keys, by, how)
    hot = F.broadcast(keys.where(F.col("n") > limit))
    rest = rows.join(hot.select(*by), by, "left_anti").join(keys.where(F.col("n") <= limit), by, how)
    return rows.join(hot, by).unionByName(rest)


def _ranked(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The keys of two rows or more, ranked in their order, with their first place; and rows of such keys with rank and first place."""
    keys = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
    ranked = stage(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "ranks")
    return ranked, _with_keys(rows, ranked, by).select(*KEY, "pos", F.col("name").alias("rank"), "first", "long")


def suffix_ranks(docs: DataFrame, min_words: int = MIN_WORDS) -> list[DataFrame]:
    """For j = 0, 1, ..: (doc_id, version, pos, rank, first, long), the places where a block of 2^j lines stands that stands more than once.

    Prefix doubling: the rank of a place among all blocks of 2^(j+1) lines is
    that of its pair of ranks at j, here and 2^j lines on. Ranks keep the
    order of the suffixes; places of one rank are an interval of the suffix
    array whose longest common prefix is 2^j lines or more, and first is the
    first of them. Lines that stand once end every run, so they leave after
    the first round, and places that have become unique leave after theirs.
    Rounds go on until nothing repeats.
    """
    found: list[DataFrame] = []
    rows, by, step = stage(line_ids(docs, min_words), "lines"), ["h1", "h2"], 1
    while True:
        ranked, rows = _ranked(rows, by)
        if ranked.isEmpty():
            return found
        rows = stage(rows if found else rows.dropDuplicates([*KEY, "pos"]), "suffixes")
        found.append(rows)
        ahead = Window.partitionBy(*KEY).orderBy("pos").rangeBetween(step, step)
        rows = rows.withColumn("next", F.max("rank").over(ahead)).where("next IS NOT NULL").select(*KEY, "pos", "rank", "next", "long")
        step, by = step * 2, ["rank", "next"]


def _same(a: str, b: str, pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for x, y in pairs:
        out = out & F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{y}"))
    return out


def _level(ranks: list[DataFrame], j: int) -> DataFrame:
    """The places of a block of 2^j lines whose block of 2^(j+1) lines no earlier place has: all but each block's first repeat
    2^j lines or more, but fewer than 2^(j+1), of an earlier place."""
    rows = ranks[j].select(*KEY, "pos", F.xxhash64(F.lit(j), "rank").alias("node"), F.lit(1 << j).alias("length"))
    if j + 1 < len(ranks):
        longer = ranks[j + 1].where(_place() > F.col("first")).select(*KEY, "pos")
        rows = rows.alias("a").join(longer.alias("b"), _same("a", "b", [(c, c) for c in (*KEY, "pos")]), "left_anti")
    return rows


def longest_repeats(ranks: list[DataFrame], least: int = 0) -> DataFrame | None:
    """(doc_id, version, pos, length, first): of each place the longest block of 2^least lines or more that an earlier place has, and the first place that has it.

    Blocks that stand more than once are a tree, longer ones under their
    beginnings, the intervals of the suffix array by their longest common
    prefix. A place is the first one of some nodes on its path and no longer
    of their parent: that parent is its longest repeat. Levels of 2^j lines
    come from the ranks; the nodes between 2^j and 2^(j+1) are found by
    halving: places of a node that go on alike for 2^i more lines make up a
    node of their own, and only the first of them stays to stand for all in
    the half below. A node of k places settles k - 1 of them, so that a round
    holds at most two rows a place, whatever the lengths.
    """
    nodes = None
    for i in range(len(ranks) - 1, -1, -1):
        if nodes is not None:
            nodes = stage(_halved(nodes, ranks[i], i), "nodes")
        if i >= least:
            level = _level(ranks, i)
            nodes = level if nodes is None else nodes.unionByName(level)
    if nodes is None:
        return None
    firsts = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
    return _with_keys(nodes, stage(firsts, "firsts"), ["node"]).where(_place() > F.col("first")).select(*KEY, "pos", "length", "first")


def _halved(nodes: DataFrame, ranks: DataFrame, i: int) -> DataFrame:
    """Nodes of places alike in length lines, and in fewer than length + 2^(i+1), cut at length + 2^i."""
    ahead = nodes.alias("a").join(ranks.alias("b"), _same("a", "b", [(c, c) for c in KEY]) & (F.col("a.pos") + F.col("a.length") == F.col("b.pos")), "left")
    rows = stage(ahead.select("a.*", F.col("b.rank").alias("rank")), "ahead")
    go_on = rows.where("rank IS NOT NULL")
    pairs = go_on.groupBy("node", "rank").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
    met = _with_keys(go_on, stage(pairs, "pairs"), ["node", "rank"], "left")
    upper = F.struct(F.xxhash64(F.lit(i), "node", "rank").alias("node"), (F.col("length") + (1 << i)).alias("length"))
    stays = F.col("first").isNull() | ~(_place() > F.col("first"))
    both = F.array_compact(F.array(F.when(F.col("first").isNotNull(), upper), F.when(stays, F.struct("node", "length"))))
    return met.select(*KEY, "pos", F.inline(both)).unionByName(rows.where("rank IS NULL").select(*KEY, "pos", "node", "length"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, pos, length, first_doc, first_version, first_pos, upto): maximal runs of lines that stand earlier too; upto: where the runs before it end.

    Each place's run is its longest that an earlier place has, with the first
    place that has it whole; those count that no run from an earlier place of
    the document holds. A line of min_words words is a run of one.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    ranks = suffix_ranks(docs, min_words)
    if not ranks:
        return line_ids(docs, min_words).where("false").select(*KEY, "pos", F.col("pos").alias("length"), F.col("doc_id").alias("first_doc"), F.col("version").alias("first_version"), F.col("pos").alias("first_pos"), F.col("pos").alias("upto"))
    found = ranks[0].where(F.col("long") & (_place() > F.col("first"))).select(*KEY, "pos", F.lit(1).alias("length"), "first")
    longest = longest_repeats(ranks, min_lines.bit_length() - 1)
    if longest is not None:
        found = found.unionByName(longest.where(F.col("length") >= min_lines))
    runs = found.select(*KEY, "pos", "length", F.col("first.doc_id").alias("first_doc"), F.col("first.version").alias("first_version"), F.col("first.pos").alias("first_pos"))
    # of a place's two runs the longer comes first, so that the one line is held by it
    past = Window.partitionBy(*KEY).orderBy("pos", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.max(F.col("pos") + F.col("length")).over(past), F.lit(0))
    return runs.withColumn("upto", upto).where("pos + length > upto")


def _runs_of(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc_id, version, runs, gone): a document's runs in order, and the stretches [begin, finish) of its lines that they cover, each line once."""
    runs = repeated_runs(docs, min_lines, min_words)
    row = F.struct("pos", "length", "first_doc", "first_pos", F.greatest("pos", "upto").alias("begin"), (F.col("pos") + F.col("length")).alias("finish"))
    return runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(row)).alias("runs"))


def _cuts(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc_id, version, runs) with the stretches that go alone: broadcast where they are few (a piece is two numbers), so that texts are not shuffled."""
    runs = stage(_runs_of(docs, min_lines, min_words).select(*KEY, F.transform("runs", lambda r: F.struct(r["begin"].alias("begin"), r["finish"].alias("finish"))).alias("runs")), "cuts")
    size = runs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("pieces")).first()
    return F.broadcast(runs) if size.rows + size.pieces / 5 <= FEW_ROWS else runs


def _deleted() -> Column:
    """Positions, among lines with a word, that a document's runs cover."""
    return F.flatten(F.transform("g.runs", lambda r: F.sequence(r["begin"], r["finish"] - 1)))


def dedup_report(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_deleted, deleted, n_runs, longest, runs), a row for each row of docs.

    A line is deleted if it lies in a run of min_lines lines or more, or in a
    line of min_words words or more, that stands earlier too, in the order of
    (doc_id nulls first, text hash, line); the earliest copy stays. Lines
    compare without white space at their ends; lines without a word are no
    lines: they are kept and do not break runs. deleted: the deleted lines'
    positions among the lines with a word, with commas between. n_runs,
    longest: the number of maximal runs and the lines of the longest. runs:
    their place, length and first place (doc_id.line), as 4+12<7.0.

    Null or empty text has no lines. Rows alike in doc_id and text count as
    one document. Null ids, other columns and an empty table pass; very long
    texts are a row of lines each, like others.
    """
    parts = F.filter(F.split("text", "\n", -1), _has_word)
    base = _key(docs.select("doc_id", "text")).select(*KEY, F.greatest(F.coalesce(F.size(parts), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"))
    out = base.alias("b").join(_runs_of(docs, min_lines, min_words).alias("g"), _same("b", "g", [(c, c) for c in KEY]), "left")
    name = lambda r: F.concat(r["pos"].cast("string"), F.lit("+"), r["length"].cast("string"), F.lit("<"), F.coalesce(r["first_doc"].cast("string"), F.lit("")), F.lit("."), r["first_pos"].cast("string"))
    some = lambda x, none: F.when(F.col("g.runs").isNotNull(), x).otherwise(F.lit(none))
    return out.select(
        "b.doc_id",
        "n_lines",
        some(F.aggregate("g.runs", F.lit(0), lambda a, r: a + r["finish"] - r["begin"]), 0).cast("long").alias("n_deleted"),
        some(F.array_join(F.transform(_deleted(), lambda x: x.cast("string")), ","), "").alias("deleted"),
        some(F.size("g.runs"), 0).cast("long").alias("n_runs"),
        some(F.array_max(F.transform("g.runs", lambda r: r["length"])), 0).cast("long").alias("longest"),
        some(F.array_join(F.transform("g.runs", name), ","), "").alias("runs"),
    )


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the later copies of repeated line runs; documents that lose their last line with a word go.

    A text is put together again from the numbers of the lines that stay, in
    time proportional to its lines.
    """
    version, at, lines, worded = (spare(docs, c) for c in ("version", "cut_runs", "cut_lines", "cut_worded"))
    runs = _cuts(docs, min_lines, min_words).withColumnRenamed("runs", at)
    # lines and the numbers of those with a word are made below the join, so that nothing above repeats that for each line
    keyed = docs.withColumn(version, F.xxhash64("text")).withColumn(lines, F.split("text", "\n", -1))
    words = F.transform(F.col(lines), lambda x, i: F.when(_has_word(x), i))
    keyed = keyed.withColumn(worded, F.array_compact(words)).drop("text")
    out = keyed.alias("d").join(runs.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{version}") == F.col("g.version")), "left")
    out = out.select("d.*", F.col(f"g.{at}").alias(at))
    n_gone = F.aggregate(at, F.lit(0), lambda a, r: a + r["finish"] - r["begin"])
    out = out.where(F.col(at).isNull() | (F.size(worded) > n_gone))
    gone = F.flatten(F.transform(at, lambda r: F.slice(F.col(worded), r["begin"] + 1, r["finish"] - r["begin"])))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col(at).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    return dedup_report(read_table(spark, sf_dir, "documents"))


#: Blocks grown line by line while they stand more than once, told apart by chained hashes: the last length at which a place is not its block's first is its longest repeat.
OP9_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, E'\n'), lambda s: trim(s, E' \t\n\x0b\x0c\r')), lambda s: s <> '') AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS line FROM parts),
grown AS (
  SELECT doc_id, pos, 1 AS m, md5(line) AS h, first_value({'d': doc_id, 'p': pos}) OVER w AS f FROM lines WINDOW w AS (PARTITION BY line ORDER BY doc_id, pos)
  QUALIFY count(*) OVER (PARTITION BY line) > 1
  UNION ALL
  SELECT doc_id, pos, m + 1, k, first_value({'d': doc_id, 'p': pos}) OVER (PARTITION BY k ORDER BY doc_id, pos)
  FROM (SELECT g.doc_id, g.pos, g.m, md5(g.h || md5(n.line)) AS k FROM grown g JOIN lines n ON n.doc_id = g.doc_id AND n.pos = g.pos + g.m)
  QUALIFY count(*) OVER (PARTITION BY k) > 1),
longest AS (SELECT doc_id, pos, max(m) AS n, arg_max(f, m) AS f FROM grown WHERE doc_id <> f.d OR pos <> f.p GROUP BY doc_id, pos),
kept AS (SELECT g.* FROM longest g JOIN lines x USING (doc_id, pos) WHERE n >= 2 OR len(regexp_extract_all(x.line, '[^\x20\x09-\x0D]+')) >= 50),
runs AS (SELECT *, coalesce(max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM kept QUALIFY pos + n > upto),
gone AS (SELECT doc_id, unnest(range(greatest(pos, upto), pos + n)) AS pos FROM runs),
per AS (SELECT doc_id, count(*) AS n_deleted, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS deleted FROM gone GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest, string_agg(pos || '+' || n || '<' || f.d || '.' || f.p, ',' ORDER BY pos) AS runs FROM runs GROUP BY doc_id)
SELECT p.doc_id, coalesce(len(p.l), 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(deleted, '') AS deleted,
       coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(longest, 0)::BIGINT AS longest, coalesce(runs, '') AS runs
FROM parts p LEFT JOIN per USING (doc_id) LEFT JOIN named USING (doc_id)
"""
